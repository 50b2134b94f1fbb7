"""Sources of records inside other formats, and sinks that say what they wrote."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def embedded_json(pages: DataFrame, html: str, element: str, schema: str, out: str) -> DataFrame:
    """`pages` with `out`: the JSON in the script element with the id `element`, typed by `schema`; null if absent or broken."""
    raw = F.regexp_extract(html, f"(?s)<script[^>]*\\bid=[\"']{element}[\"'][^>]*>(.*?)</script>", 1)
    return pages.withColumn(out, F.from_json(F.when(raw != "", raw), schema))


def sitemap(pages: DataFrame, xml: str, since: str | None = None) -> DataFrame:
    """(loc, lastmod): each url entry of sitemap texts, those changed on or after `since` if given; entries without a date stay."""
    entries = pages.select(F.explode(F.regexp_extract_all(xml, F.lit("(?s)<url>(.*?)</url>"), 1)).alias("u"))
    field = lambda n: F.trim(F.regexp_extract("u", f"(?s)<{n}>(.*?)</{n}>", 1))
    found = entries.select(F.regexp_replace(field("loc"), "&amp;", "&").alias("loc"), F.to_date(F.substring(F.when(field("lastmod") != "", field("lastmod")), 1, 10)).alias("lastmod")).where("loc <> ''")
    return found if since is None else found.where(F.col("lastmod").isNull() | (F.col("lastmod") >= F.lit(since)))


def rate_days(texts: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Rates (currency, valid_from, quantity, rate) of JSON texts of a day, and the entries that were skipped as unusable."""
    schema = "array<struct<date:string,currencies:array<struct<code:string,quantity:int,rate:string,date:string>>>>"
    rows = texts.select(F.explode(F.from_json(text, schema)).alias("d")).select(F.col("d.date").alias("day"), F.explode("d.currencies").alias("c")).select("day", "c.*")
    parsed = rows.select(F.upper("code").alias("currency"), F.coalesce(F.try_to_date(F.substring("day", 1, 10)), F.try_to_date(F.substring("date", 1, 10))).alias("valid_from"), "quantity", F.col("rate").try_cast("decimal(14,6)").alias("rate"))
    good = F.coalesce(F.col("currency").rlike("^[A-Z]{3}$") & F.col("valid_from").isNotNull() & (F.col("quantity") > 0) & (F.col("rate") > 0), F.lit(False))
    return parsed.where(good), parsed.where(~good)


def table_digest(df: DataFrame) -> DataFrame:
    """(n_rows, digest): a fingerprint of a table's rows, whatever their order: counts and sums of row hashes, no list of rows."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    parts = df.select(F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(20,0)").alias("a"), F.conv(F.substring(F.md5(row), 17, 15), 16, 10).cast("decimal(20,0)").alias("b"))
    return parts.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws("|", F.count("*"), F.sum("a"), F.sum("b")), 256).alias("digest"))


def export(df: DataFrame, path: str, version: str) -> dict:
    """Writes a version of a table and then its manifest; a reader that trusts manifests only never sees half a version."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{path}/{version}")
    written = spark.read.parquet(f"{path}/{version}")
    told = table_digest(written).first()
    manifest = {"version": version, "n_rows": told["n_rows"], "digest": told["digest"], "columns": written.columns}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
    return manifest


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The version that the manifest names, if its rows are those that were written."""
    manifest = json.loads(spark.read.text(f"{path}/current").first()[0])
    df = spark.read.parquet(f"{path}/{manifest['version']}")
    told = table_digest(df).first()
    if (told["n_rows"], told["digest"]) != (manifest["n_rows"], manifest["digest"]):
        raise ValueError(f"{path}: version {manifest['version']} is not what its manifest says")
    return df
