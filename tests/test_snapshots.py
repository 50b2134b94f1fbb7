from __future__ import annotations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skein.operators.snapshots import snapshot_changes, snapshot_order

RUNS = "board string, snap int, whole boolean, run_status string"
ROWS = "board string, snap int, id long, at timestamp, status string, title string, due timestamp, _s string, _at int"


def t(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(hours=n)


def changes(spark, runs, rows):
    order = snapshot_order(spark.createDataFrame(runs, RUNS), "board", "snap", "whole")
    out = snapshot_changes(spark.createDataFrame(rows, ROWS), order, "board", "snap", "id", "at", ["status", "title"], ["due"], ranges=3)
    return sorted((r["board"], r["snap"], r["id"], r["change_kind"], tuple(r["changed_fields"])) for r in out.collect())


def row(board, snap, i, at=0, status="a", title="T", due=None):
    return (board, snap, i, t(at), status, title, due, "x", 9)


def test_kinds_and_counting_runs(spark):
    runs = [("b", 1, True, ""), ("b", 2, False, ""), ("b", 3, True, ""), ("b", 3, True, "again"), ("b", 4, None, ""), ("c", 1, True, "")]
    rows = [row("b", 1, 1), row("b", 1, 2), row("b", 2, 9), row("b", 3, 2, status="z"), row("b", 3, 3), row("c", 1, 5), row("d", 1, 6), row("b", 4, 7)]
    assert changes(spark, runs, rows) == [("b", 3, 1, "removed", ()), ("b", 3, 2, "changed", ("status",)), ("b", 3, 3, "added", ())]


def test_cosmetics_nulls_and_redelivery(spark):
    runs = [("b", n, True, "") for n in (1, 2, 3)]
    rows = [row("b", 1, 1, title=" A  b "), row("b", 2, 1, title="a B"), row("b", 1, 2, title=None), row("b", 2, 2, title=""), row("b", 1, 3, at=1), row("b", 1, 3, at=5, status="new"), row("b", 1, 3, at=5, status="new")]
    rows += [row("b", 2, 3, status="NEW"), row("b", 1, 4, due=None), row("b", 2, 4, due=t(1)), (None, 1, 8, t(0), "a", "t", None, "", 0), ("b", 1, None, t(0), "a", "t", None, "", 0), row("b", 3, 1), row("b", 3, 2, title=None), row("b", 3, 3, status="new"), row("b", 3, 4, due=t(1))]
    assert changes(spark, runs, rows) == [("b", 2, 4, "changed", ("due",)), ("b", 3, 1, "changed", ("title",)), ]


def test_vanishing_returning_and_an_empty_snapshot(spark):
    runs = [("b", n, True, "") for n in (1, 2, 3)]
    assert changes(spark, runs, [row("b", 1, 1), row("b", 3, 1)]) == [("b", 2, 1, "removed", ()), ("b", 3, 1, "added", ())]


def test_empty(spark):
    assert changes(spark, [("b", 1, True, "")], []) == []
    assert changes(spark, [], [row("b", 1, 1)]) == []


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 4), st.integers(0, 2), st.sampled_from(["a", "b", None])), max_size=20))
def test_against_brute_force(spark, given_rows):
    runs = [("b", n, True, "") for n in (1, 2, 3)]
    rows = [row("b", s, i, at=v, status=x) for s, i, v, x in given_rows]
    state = {}
    for s, i, v, x in given_rows:
        state[s, i] = max(state.get((s, i), (-1, "")), (v, x or ""))
    want = []
    for s in (2, 3):
        for i in range(1, 5):
            a, b = state.get((s - 1, i)), state.get((s, i))
            if a and not b:
                want.append(("b", s, i, "removed", ()))
            elif b and not a:
                want.append(("b", s, i, "added", ()))
            elif a and b and a[1] != b[1]:
                want.append(("b", s, i, "changed", ("status",)))
    assert changes(spark, runs, rows) == sorted(want)
