"""Catalog files as DataFrames: JSON lists and id-keyed JSON maps, caches with a time to live, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.history import safe_to_replace

ITEM = "id string, name string, description string, author string, languages array<string>, repo string, downloads double, updated bigint, firstListedAt bigint"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON list with their place in it; rows without an id are dropped."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in ITEM.split(', '))}>>")).alias("list_index", "i"))
    return rows.select("i.*", F.col("list_index").cast("bigint").alias("list_index")).filter("id IS NOT NULL")


def id_map(json: Column, value: str) -> Column:
    """Entries of an id-keyed JSON object; anything else has none."""
    return F.map_entries(F.coalesce(F.from_json(json, f"map<string,{value}>"), F.create_map().cast(f"map<string,{value}>")))


def parse_stats(df: DataFrame, json: str = "json") -> DataFrame:
    """(id, downloads, updated) of id-keyed statistics; entries without finite downloads are dropped, odd times are null."""
    number = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    rows = df.select(F.explode(id_map(F.col(json), "string")).alias("e")).select(F.col("e.key").alias("id"), F.from_json("e.value", "struct<downloads:double,updated:double>").alias("s"))
    return rows.select("id", number(F.col("s.downloads")).alias("downloads"), number(F.col("s.updated")).cast("bigint").alias("updated")).filter("downloads IS NOT NULL")


def parse_tags(df: DataFrame, json: str = "json") -> DataFrame:
    rows = df.select(F.explode(id_map(F.col(json), "struct<category:string,tags:array<string>>")).alias("e"))
    return rows.select(F.col("e.key").alias("id"), "e.value.category", "e.value.tags").filter("category IS NOT NULL OR tags IS NOT NULL")


def parse_release_dates(df: DataFrame, json: str = "json") -> DataFrame:
    """(id, released_at): seconds become milliseconds; what is not a finite number is dropped."""
    rows = df.select(F.explode(id_map(F.col(json), "double")).alias("e"))
    good = F.col("e.value").isNotNull() & ~F.isnan("e.value") & (F.abs("e.value") < float("inf"))
    return rows.filter(good).select(F.col("e.key").alias("id"), (F.col("e.value") * 1000).cast("bigint").alias("released_at"))


def parse_id_set(df: DataFrame, json: str = "json") -> DataFrame:
    """Ids of an {id: true} map."""
    return df.select(F.explode(id_map(F.col(json), "boolean")).alias("e")).filter("e.value").select(F.col("e.key").alias("id"))


def parse_trend_history(df: DataFrame, json: str = "json", keep: int = 30) -> DataFrame:
    """(id, ts, downloads): the last samples of each id; odd samples and ids without any are dropped."""
    rows = df.select(F.explode(id_map(F.col(json), "array<struct<downloads:double,timestamp:double>>")).alias("e"))
    good = F.filter("e.value", lambda p: p.downloads.isNotNull() & p.timestamp.isNotNull() & ~F.isnan(p.downloads) & ~F.isnan(p.timestamp))
    last = rows.select(F.col("e.key").alias("id"), good.alias("s")).select("id", F.explode(F.slice("s", F.greatest(F.size("s") - keep + 1, F.lit(1)), keep)).alias("p"))
    return last.select("id", F.col("p.timestamp").cast("bigint").alias("ts"), F.col("p.downloads").alias("downloads"))


def fresh_cache(df: DataFrame, now_ms: int, ttl_ms: int = 6 * 3_600_000, saved: str = "saved_at") -> DataFrame:
    """Rows of a cache that are not older than its time to live."""
    return df.filter(F.lit(now_ms) - F.col(saved) <= ttl_ms)


def insight_cache(df: DataFrame, version: int = 2) -> DataFrame:
    """Entries (ids, v, body) of the current version, by their sorted ids."""
    return df.filter(F.col("v") == version).select(F.array_join(F.array_sort("ids"), "|").alias("key"), "body")


def replace_table(df: DataFrame, path: str, loaded: int) -> bool:
    """Overwrites a table unless that would lose over half of what was loaded from it; whether it did."""
    if not safe_to_replace(df.count(), loaded):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def schema_of(fields: str) -> T.StructType:
    return T._parse_datatype_string(fields)
