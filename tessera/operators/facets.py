"""Counts and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import first_letter


def counts(df: DataFrame, by: str, name: str = "n") -> DataFrame:
    """Rows by a value, null and empty ones left out."""
    return df.filter(F.col(by).isNotNull() & (F.col(by) != "")).groupBy(by).agg(F.count("*").alias(name))


def tag_counts(df: DataFrame) -> DataFrame:
    return counts(df.select(F.explode("tags").alias("tag")), "tag")


def author_facet(df: DataFrame, surnames: dict[str, str], least: int = 2) -> DataFrame:
    """(letter, author, n) of authors of several items."""
    return counts(df, "author").filter(F.col("n") >= least).withColumn("letter", first_letter(F.col("author"), surnames))


def coverage(items: DataFrame, memory: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: items whose name memory has approved, else those with a cached translation, and their share."""
    m = memory.filter("status = 'approved' AND trim(name) <> ''").select("id", F.lit(True).alias("m")).distinct()
    c = cache.filter("source <> 'original'").select("id", F.lit(True).alias("c")).distinct()
    hit = items.select("id").join(m, "id", "left").join(c, "id", "left")
    bulk, cached = F.count(F.when(F.col("m"), 1)), F.count(F.when(F.col("m").isNull() & F.col("c"), 1))
    total = F.count("*")
    return hit.agg(total.alias("total"), bulk.alias("bulk_hits"), cached.alias("cache_hits"), (bulk + cached).alias("covered"), F.when(total > 0, F.round((bulk + cached) / total, 6)).otherwise(0.0).alias("coverage"))


def review_stats(reviews: DataFrame) -> DataFrame:
    """One row of the review ledger: counts by status, rated ones, share abandoned, installs."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    known = F.count("status")
    return reviews.agg(n("using").alias("using"), n("abandoned").alias("abandoned"), n("watching").alias("watching"), F.count(F.when(F.col("status").isNull(), 1)).alias("tried"), F.count("rating").alias("rated"), F.when(known > 0, F.round(n("abandoned") / known, 6)).otherwise(0.0).alias("abandon_rate"), F.coalesce(F.sum("install_count"), F.lit(0)).alias("installs"))


def top_verdicts(reviews: DataFrame, top: int = 5) -> DataFrame:
    v = counts(reviews.select(F.explode("verdict").alias("verdict")), "verdict")
    return v.orderBy(F.col("n").desc(), F.col("verdict").asc()).limit(top)


def verdict_ids(reviews: DataFrame) -> DataFrame:
    return reviews.select("id", F.explode("verdict").alias("verdict")).groupBy("verdict").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def with_total(df: DataFrame, by: str, total: str = "all") -> DataFrame:
    """Counts by a value and of all rows, in one pass."""
    return df.rollup(by).agg(F.count("*").alias("n"), F.grouping(by).alias("g")).select(F.when(F.col("g") == 1, total).otherwise(F.col(by)).alias(by), "n")


def update_bucket(is_outdated: Column, is_pinned: Column, is_enabled: Column) -> Column:
    flag = lambda c: F.coalesce(c, F.lit(False))
    return F.when(flag(is_outdated), "outdated").when(flag(is_pinned), "pinned").when(~flag(is_enabled), "disabled").otherwise("latest")


def favorite_buckets(favorites: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, n, position): all named groups in their order, empty ones too, those without a group last."""
    n = favorites.groupBy("grp").agg(F.count("*").alias("n"))
    named = groups.join(n, "grp", "left").select("grp", F.coalesce("n", F.lit(0)).alias("n"), "position")
    rest = favorites.join(groups.select("grp"), "grp", "left_anti").agg(F.count("*").alias("n"))
    return named.union(rest.select(F.lit("__none__"), "n", F.lit(1_000_000).cast("bigint")))
