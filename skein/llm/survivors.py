"""One surviving value per field of a group of duplicate records.

`truth` is the iterative truth discovery: it weighs sources by how often their values are
supported and values by the weight of the sources that state them, until the weights stand
still. Where an order of trust is given, it enters as priors steep enough that no coalition
of less trusted sources overrules a more trusted one. `survivors` picks by the order alone, as
a single aggregation: the plain way that `truth` is tested against.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut

# What people and programs write for "unknown".
STAND_INS = ["unknown", "n/a", "na", "none", "null", "nil", "nan", "undefined", "tbd", "tba", "tbc", "not available", "not stated", "-", "--", "—", "–", "?", "??", "???", "0", "უცნობია", "უცნობი", "არ არის", "неизвестно"]
STATUSES = ["discovered", "active", "missing_suspected", "closed", "expired", "quarantined"]

#: Sources above which their weights no longer count as small.
MAX_SOURCES = 1_000_000
#: Ranks of trust that weights falling fourfold can tell apart.
MAX_RANKS = 500


def text_stated(c: str) -> Column:
    """A text that is neither null, blank, a stand-in nor cut off at its end."""
    t = F.lower(F.trim(F.regexp_replace(F.col(c), "[\\s\\p{Z}\\x{200B}\\x{FEFF}]+", " ")))
    return F.coalesce((t != "") & ~t.isin(STAND_INS) & ~t.rlike("(\\.\\.+|…)[\\s)\\]\"']*$"), F.lit(False))


def status_stated(c: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(c))).isin(STATUSES), F.lit(False))


def time_stated(c: str) -> Column:
    """A timestamp that isn't one of the two stand-in days (UTC)."""
    day = F.date_from_unix_date(F.floor(F.unix_micros(F.col(c)) / 86_400_000_000).cast("int"))
    return F.coalesce(~day.cast("string").isin("1970-01-01", "2099-12-31"), F.lit(False))


def survivors(records: DataFrame, group: str, record: str, stated: Mapping[str, Column], preference: list[Column]) -> DataFrame:
    """(`group`, field_name, `record`): the record whose value of a field survives.

    For each group of at least two records: of those that state the field, the first by
    `preference` (ascending; nulls last), ties to the smallest record id. No row if none
    states it. Repeated rows of a record count as one. One aggregation with map-side
    combine over all fields, so a hot group is no hot task. Rows with a null group are
    ignored; an empty table gives none; other columns are ignored.
    """
    ranked = [x for i, p in enumerate(preference) for x in (p.isNull().alias(f"_n{i}"), p.alias(f"_p{i}"))]
    base = records.where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col(record).alias("_r"), F.struct(*ranked, F.col(record).alias("id")).alias("_rank"), *(s.alias(f"_s{i}") for i, s in enumerate(stated.values())))
    best = base.groupBy("_g").agg(F.min("_r").alias("_first"), F.max("_r").alias("_last"), *(F.min(F.when(F.col(f"_s{i}"), F.col("_rank"))).alias(f"_b{i}") for i in range(len(stated))))
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"_b{i}.id").alias("id")) for i, f in enumerate(stated)))).alias("_x")
    return best.where("_first <> _last").select("_g", rows).where("_x.id is not null").select(F.col("_g").alias(group), F.col("_x.f").alias("field_name"), F.col("_x.id").alias(record))


def truth(
    records: DataFrame, group: str, source: str, values: Mapping[str, Column], rounds: int = 100, tolerance: float = 1e-4, record: str | None = None, latest: Sequence[Column] = (), prior: Mapping[object, float] | None = None
) -> DataFrame:
    """(`group`, field_name, value, support, n_sources, converged): the best supported value of each field, by truth discovery.

    `values` maps a field to its value as text, null where it isn't stated. A value's
    support is the share of the group's source weight that states it; a source's reliability is
    the mean support of what it states, and its weight that reliability. All start equal; rounds end when none moves
    by more than `tolerance`; converged is false if `rounds` didn't suffice. A source that copies itself within a group counts once for a value. Ties go
    to the value with more sources, then to the smaller text. Only the weights, one number a source,
    come to the driver. Groups of one record are included; null groups or sources are ignored.

    With `record` a source speaks in each group through one record a field, the first by `latest` (ascending, nulls
    last), ties to the smallest id; the result has `record`, that of the heaviest source which states the value. With `prior` a source's
    weight is its prior times 1/2 + reliability/2, so that priors falling by more than threefold from each source to
    the next (`steep`) let no coalition overrule a source whose prior is higher; sources without one have the least of all.
    """
    fields = list(values)
    preference = [x for i, p in enumerate(latest) for x in (p.isNull().alias(f"n{i}"), p.alias(f"p{i}"))]
    rid = F.col(record) if record else F.lit(0)
    base = records.where(F.col(group).isNotNull() & F.col(source).isNotNull()).select(F.col(group).alias("_g"), F.col(source).alias("_s"), *(v.cast("string").alias(f"_v{i}") for i, v in enumerate(values.values())), F.struct(*preference, rid.alias("id")).alias("_p"))
    if record:
        said = [F.min(F.when(F.col(f"_v{i}").isNotNull(), F.struct("_p", F.col(f"_v{i}").alias("v")))).alias(f"_b{i}") for i in range(len(fields))]
        spoken = base.groupBy("_g", "_s").agg(*said)
        parts = [F.struct(F.lit(i).alias("f"), F.col(f"_b{i}.v").alias("v"), F.col(f"_b{i}._p.id").alias("id")) for i in range(len(fields))]
        claims = spoken.select("_g", "_s", F.explode(F.array(*parts)).alias("_x")).select("_g", "_s", "_x.*").where("v is not null")
    else:
        parts = [F.struct(F.lit(i).alias("f"), F.col(f"_v{i}").alias("v"), F.lit(0).alias("id")) for i in range(len(fields))]
        claims = base.select("_g", "_s", F.explode(F.array(*parts)).alias("_x")).select("_g", "_s", "_x.*").where("v is not null").distinct()
    claims = cut(claims.repartition("_g").sortWithinPartitions("_g", "f", "v"))
    kind = claims.schema["_s"].dataType.simpleString()
    reliable = {r["_s"]: 1.0 for r in claims.select("_s").distinct().limit(MAX_SOURCES + 1).collect()}
    if len(reliable) > MAX_SOURCES:
        raise ValueError("there are too many sources to send their weights to every task")
    least = min(prior.values(), default=1.0) / 4 if prior else 1.0
    weigh = lambda s, r: prior.get(s, least) * (0.5 + r / 2) if prior is not None else r
    whole, same = Window.partitionBy("_g", "f"), Window.partitionBy("_g", "f", "v")

    def voted() -> DataFrame:
        """The claims with their value's share of the votes; partitioned and sorted by group since they were written, so nothing is exchanged."""
        rows = [(s, float(weigh(s, r))) for s, r in reliable.items()] or [(None, 0.0)]
        weight = F.broadcast(claims.sparkSession.createDataFrame(rows, f"_s {kind}, w double"))
        return claims.join(weight, "_s").withColumn("share", F.sum("w").over(same) / F.sum("w").over(whole))

    converged = not reliable
    for _ in range(0 if converged else rounds):
        seen = voted().groupBy("_s").agg(F.avg("share").alias("r")).collect()
        moved = max(abs(r["r"] - reliable[r["_s"]]) for r in seen)
        reliable |= {r["_s"]: r["r"] for r in seen}
        if converged := moved <= tolerance:
            break
    voices = voted().groupBy("_g", "f", "v").agg(F.max("share").alias("share"), F.count("*").alias("n"), F.max_by("id", F.struct("w", -F.col("id"))).alias("id"), F.max("w").alias("top"))
    best = voices.groupBy("_g", "f").agg(F.min(F.struct((-F.round("share", 9)).alias("s"), (-F.col("top")).alias("t") if prior is not None else F.lit(0).alias("t"), (-F.col("n")).alias("n"), "v", "id")).alias("b"))
    names = F.array(*map(F.lit, fields))
    out = best.select(F.col("_g").alias(group), names[F.col("f")].alias("field_name"), F.col("b.v").alias("value"), F.round(-F.col("b.s"), 6).alias("support"), (-F.col("b.n")).cast("long").alias("n_sources"), F.lit(converged).alias("converged"), *([F.col("b.id").alias(record)] if record else []))
    return out


def steep(ranks: Mapping[object, int]) -> dict[object, float]:
    """Priors that fall fourfold from each rank to the next lower one, however the ranks are numbered: the ranks are dense first.

    The least ratio of two doubles bounds how many ranks can be told apart: 500.
    """
    dense = {r: i for i, r in enumerate(sorted(set(ranks.values())))}
    if len(dense) > MAX_RANKS:
        raise ValueError("there are more ranks of trust than weights can tell apart")
    return {s: 4.0 ** -dense[r] for s, r in ranks.items()}
