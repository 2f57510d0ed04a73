"""Lookups of the catalog as joins: statistics, translations, reviews, dependencies, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import compare_versions


def with_stats(items: DataFrame, stats: DataFrame) -> DataFrame:
    """Downloads from the statistics where there are any; the time of update only if they have one."""
    s = stats.select("id", F.col("downloads").alias("s_downloads"), F.col("updated").alias("s_updated"))
    return items.join(s, "id", "left").withColumns({"downloads": F.coalesce("s_downloads", "downloads"), "updated": F.coalesce("s_updated", "updated")}).drop("s_downloads", "s_updated")


def search_rows(items: DataFrame, translations: DataFrame) -> DataFrame:
    """Items with translated name and description, null where the translation is the original."""
    t = translations.filter("source <> 'original'").select("id", F.col("translated_name").alias("name_zh"), F.col("translated_desc").alias("desc_zh"))
    return items.select("id", "name", "description", "ord").join(t, "id", "left")


def view_rows(items: DataFrame, translations: DataFrame, tags: DataFrame) -> DataFrame:
    """Display name and description, empty translations falling through to the original, with source and category."""
    t = translations.select("id", "translated_name", "translated_desc", "source")
    shown = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    joined = items.select("id", "name", "description").join(t, "id", "left").join(tags.select("id", "category"), "id", "left")
    return joined.select("id", shown("translated_name", "name").alias("display_name"), shown("translated_desc", "description").alias("display_desc"), F.coalesce("source", F.lit("original")).alias("source"), "category")


def journal_rows(reviews: DataFrame, history: DataFrame) -> DataFrame:
    h = history.select("id", "install_count", F.coalesce("uninstalled", "last_installed").alias("last_active"))
    return reviews.join(h, "id", "left")


def bilingual(english: Column, chinese: Column) -> Column:
    """`en（zh）`; one name if the other is missing or the same but for case."""
    en, zh = F.nullif(F.trim(english), F.lit("")), F.nullif(F.trim(chinese), F.lit(""))
    return F.when(zh.isNull(), en).when(en.isNull(), zh).when(F.lower(en) == F.lower(zh), en).otherwise(F.concat(en, F.lit("（"), zh, F.lit("）")))


def dependents(edges: DataFrame) -> DataFrame:
    """(dep_id, dependents): who depends on each, in order."""
    return edges.groupBy("dep_id").agg(F.array_sort(F.collect_set("src_id")).alias("dependents"))


def dependency_status(edges: DataFrame, catalog: DataFrame, installed: DataFrame, enabled: DataFrame) -> DataFrame:
    """Edges (src_id, dep_id, kind, min_version) with status unknown, missing, disabled, outdated or ok; installed has (id, version)."""
    flag = lambda df, name: df.select(F.col("id").alias("dep_id"), F.lit(True).alias(name)).distinct()
    d = edges.join(flag(catalog, "known"), "dep_id", "left").join(installed.select(F.col("id").alias("dep_id"), "version", F.lit(True).alias("there")), "dep_id", "left").join(flag(enabled, "on"), "dep_id", "left")
    old = F.col("min_version").isNotNull() & F.col("version").isNotNull() & (compare_versions(F.col("version"), F.col("min_version")) < 0)
    status = F.when(F.col("known").isNull() & F.col("there").isNull(), "unknown").when(F.col("there").isNull(), "missing").when(F.col("on").isNull(), "disabled").when(old, "outdated").otherwise("ok")
    return d.withColumn("status", status).drop("known", "there", "on", "version")


def blocking(status: DataFrame) -> DataFrame:
    """Required dependencies that are not in order, and what to do about each."""
    action = F.when(F.col("status").isin("unknown", "missing"), "install").when(F.col("status") == "disabled", "enable").otherwise("update")
    return status.filter("kind = 'required' AND status <> 'ok'").withColumn("action", action)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def overlaid(base: DataFrame, user: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both by key; where both have one, the user's."""
    return base.join(user.select(key), key, "left_anti").unionByName(user)


def curated_edges(detected: DataFrame, curated: DataFrame) -> DataFrame:
    """Detected edges with curated ones, of confidence 1, in place of those with the same ends."""
    ends = ["src_id", "dep_id"]
    return detected.join(curated.select(*ends), ends, "left_anti").unionByName(curated.withColumn("confidence", F.lit(1.0)))


def outdated(local: DataFrame, remote: DataFrame, pins: DataFrame) -> DataFrame:
    """(id, local_version, remote_version) of those with a newer version that are not pinned."""
    both = local.select("id", F.col("version").alias("local_version")).join(remote.select("id", F.col("version").alias("remote_version")), "id")
    return both.filter(compare_versions(F.col("remote_version"), F.col("local_version")) > 0).join(pins.select("id"), "id", "left_anti")


def tag_sets(items: DataFrame) -> DataFrame:
    """(id, common, only): tags that all given items have, and those that an item has alone; both empty for fewer than two items."""
    tags = items.select("id", F.explode_outer(F.array_distinct("tags")).alias("tag"))
    n = items.agg(F.count_distinct("id").alias("n"))
    per = tags.filter("tag IS NOT NULL").groupBy("tag").agg(F.count_distinct("id").alias("k"))
    marked = tags.join(per, "tag", "left").crossJoin(F.broadcast(n))
    pick = lambda test: F.array_sort(F.collect_set(F.when(test & (F.col("n") >= 2), F.col("tag"))))
    return marked.groupBy("id").agg(pick(F.col("k") == F.col("n")).alias("common"), pick(F.col("k") == 1).alias("only"))


def profile_switch(target: DataFrame, current: DataFrame, manifests: DataFrame, self_id: str) -> DataFrame:
    """(id, action): what to enable and to disable to go from one set to another; never oneself."""
    on = target.select("id").join(current.select("id"), "id", "left_anti").join(manifests.select("id"), "id", "left_semi").withColumn("action", F.lit("enable"))
    off = current.select("id").join(target.select("id"), "id", "left_anti").withColumn("action", F.lit("disable"))
    return on.union(off).filter(F.col("id") != self_id)


def resolve_offline(items: DataFrame, cache: DataFrame, memory: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, translated_name, translated_desc, source, pending): cache, then approved memory, then dictionary, then the original.

    A cached `original` whose name was changed counts as `bulk`; pending is what is
    still original.
    """
    c = cache.select("id", F.struct("translated_name", "translated_desc", "source").alias("c"))
    m = memory.filter("status = 'approved'").select("id", F.struct(F.col("name").alias("n"), F.col("description").alias("d"), "source").alias("m"))
    a = dictionary.select("id", F.struct(F.col("name").alias("n"), F.col("description").alias("d")).alias("a"))
    j = reduce(lambda x, y: x.join(y, "id", "left"), (c, m, a), items.select("id", "name", "description"))
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    source = (
        F.when(F.col("c").isNotNull(), F.when((F.col("c.source") == "original") & (F.col("c.translated_name") != F.col("name")), "bulk").otherwise(F.col("c.source")))
        .when(F.col("m").isNotNull(), F.when(F.col("m.source") == "human", "custom").otherwise(F.col("m.source")))
        .when(F.col("a").isNotNull(), "ai")
        .otherwise("original")
    )
    pick = lambda part, own: F.when(F.col("c").isNotNull(), F.col(f"c.translated_{part}")).when(F.col("m").isNotNull(), F.coalesce(blank(F.col("m.n" if part == "name" else "m.d")), F.col(own))).when(F.col("a").isNotNull(), F.coalesce(F.nullif(F.col("a.n" if part == "name" else "a.d"), F.lit("")), F.col(own))).otherwise(F.col(own))
    out = j.select("id", pick("name", "name").alias("translated_name"), pick("desc", "description").alias("translated_desc"), source.alias("source"))
    return out.withColumn("pending", F.col("source") == "original")
