"""Planted leaks against brute force: long, scattered, marked up and reworded items, and items in blocks."""

from __future__ import annotations

import random

import pytest

from skein.llm.leaks import NEAR, covered, leaks, words

RUN = "run_share >= 0.5"
REWORDED = f"run_share < 0.5 and cosine >= {NEAR} and lcs_share >= 0.6 and answer_share >= 0.8"


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def found(spark, docs, items, where=RUN, **kw):
    df, it = frames(spark, docs, items)
    return sorted((r["doc_id"], r["item_id"]) for r in leaks(df, "doc_id", "text", it, "item_id", "text", **kw).where(where).collect())


def brute(docs, items):
    return sorted((d, i) for d, text in docs for i, t in items if covered(words(text), words(t), 8).mean() >= 0.5)


def speech(rng, n, vocab=300):
    return [f"v{rng.randrange(vocab)}" for _ in range(n)]


def test_long_and_scattered_items(spark):
    rng = random.Random(11)
    items = [(0, " ".join(speech(rng, 1000))), (1, " ".join(speech(rng, 200))), (2, " ".join(speech(rng, 60)))]
    docs = [(100 + i, " ".join(speech(rng, 150))) for i in range(80)]
    docs += [(0, items[0][1])]  # a document that is the whole long item
    scattered, own = [], items[1][1].split()
    for a in range(0, 200, 8):
        scattered += own[a : a + 8] + speech(rng, 80)
    docs += [(1, " ".join(scattered)), (2, " ".join(speech(rng, 3000) + items[2][1].split()[:31] + speech(rng, 3000)))]
    assert found(spark, docs, items) == brute(docs, items) == [(0, 0), (1, 1), (2, 2)]


@pytest.mark.parametrize("length", [10, 199, 201, 5000])
def test_markup_of_any_length(spark, length):
    rng = random.Random(12)
    item = [f"w{i}" for i in range(40)]
    tag = f'<span title="{"x" * length}">'
    text = " ".join(w if i % 5 else tag + w + "</span>" for i, w in enumerate(item))
    note = "<!--" + "y " * length + "-->"
    docs = [(1, text), (2, note.join([" ".join(item[:20]), " ".join(item[20:])])), (3, " ".join(speech(rng, 200))), (4, "a < b, 3 <5 and " + " ".join(item) + " <!-- open")]
    assert found(spark, docs, [(7, " ".join(item))]) == [(1, 7), (2, 7), (4, 7)]
    assert words("<!--" * 50_000)[:1] == [] and words("<p " * 100_000 + "x")[-1:] == ["x"]


def test_blocks_of_items_change_nothing(spark):
    rng = random.Random(13)
    items = [(i, " ".join(speech(rng, rng.randrange(1, 90)))) for i in range(40)]
    docs = [(d, " ".join(speech(rng, 60) + items[d % 40][1].split()[: rng.randrange(1, 90)] + speech(rng, 60))) for d in range(200)] + [(900, None), (901, "")]
    df, it = frames(spark, docs, items)
    key = lambda n: sorted((r["doc_id"], r["item_id"], r["run_share"], r["lcs_share"]) for r in leaks(df, "doc_id", "text", it, "item_id", "text", block_letters=n).collect())
    assert key(1_000_000) == key(3_000) == key(1_500)
    assert [(d, i) for d, i, r, _ in key(3_000) if r >= 0.5] == brute([d for d in docs if d[1]], items)


def test_reworded_copies_are_near(spark):
    """Every sixth word of an item exchanged: no run of eight, the same order and numbers. At least nine of ten must be found, and by the cosine alone."""
    rng = random.Random(14)
    items = [(i, " ".join([f"i{i}w{j}" if rng.random() < 0.5 else f"v{rng.randrange(200)}" for j in range(70)] + [str(1000 + i)])) for i in range(20)]
    docs, planted = [], set()
    for d in range(400):
        body = speech(rng, rng.randrange(40, 400))
        if d % 4 == 0:
            i = d // 4 % 20
            reworded = [f"z{rng.randrange(900)}" if j % 6 == 5 else w for j, w in enumerate(items[i][1].split())]
            at = rng.randrange(len(body))
            body[at:at] = [*reworded, str(1000 + i)]
            planted.add((d, i))
        docs.append((d, " ".join(body)))
    got = set(found(spark, docs, items, REWORDED))
    assert len(got & planted) >= 0.9 * len(planted) and got <= planted
