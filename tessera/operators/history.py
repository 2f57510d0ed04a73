"""Histories and incremental upkeep: samples over time, installs, snapshots and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import DAY_MS, TrendConfig


def keep_last(history: DataFrame, n: int = 30, key: str = "id", time: str = "ts") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(time).desc())
    return history.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def last_sample(history: DataFrame) -> DataFrame:
    return history.groupBy("id").agg(F.max_by("downloads", "ts").alias("downloads"), F.max("ts").alias("ts"))


def prune(history: DataFrame, now_ms: int, keep_days: int = 90) -> DataFrame:
    return history.filter(F.col("ts") >= now_ms - keep_days * DAY_MS)


def ingest(samples: DataFrame, config: TrendConfig = TrendConfig()) -> DataFrame:
    """(id, ts, downloads): samples taken up in order of time.

    A sample within the least interval of the last kept one only raises its downloads;
    others are appended; the last max_samples of a key stay. One fold a key, in the JVM.
    """
    point = "struct<ts:bigint,downloads:double>"
    rows = samples.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("ts").cast("bigint").alias("ts"), F.col("downloads").cast("double").alias("downloads")))).alias("s"))

    def take(kept, x):
        last = F.element_at(kept, -1)
        close = (F.size(kept) > 0) & (x.ts - last.ts < config.min_interval_ms)
        raised = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(F.struct(last.ts.alias("ts"), F.greatest(last.downloads, x.downloads).alias("downloads"))))
        grown = F.concat(kept, F.array(x))
        return F.when(close, raised).otherwise(F.slice(grown, F.greatest(F.size(grown) - config.max_samples + 1, F.lit(1)), config.max_samples))

    start = F.expr(f"cast(array() as array<{point}>)")
    head = F.array(F.element_at("s", 1))
    folded = rows.select("id", F.aggregate(F.slice("s", 2, F.size("s")), F.when(F.size("s") > 0, head).otherwise(start), take).alias("k"))
    return folded.select("id", F.explode("k").alias("p")).select("id", "p.ts", "p.downloads")


def merge_installs(current: DataFrame, added: DataFrame, removed: DataFrame, installed: DataFrame, enabled: DataFrame, now_ms: int) -> DataFrame:
    """The ledger after a change: added ids count one install more, removed and vanished ones are marked.

    current has (id, name, first_installed, last_installed, uninstalled, install_count);
    added has (id, name) and may have stamps (stamp_first, stamp_last, estimated).
    """
    flag = lambda df, name: df.select("id", F.lit(True).alias(name)).distinct()
    for c, kind in (("stamp_first", "bigint"), ("stamp_last", "bigint"), ("estimated", "boolean")):
        if c not in added.columns:
            added = added.withColumn(c, F.lit(None).cast(kind))
    a = added.select("id", F.col("name").alias("a_name"), "stamp_first", "stamp_last", "estimated", F.lit(True).alias("is_added"))
    j = current.join(a, "id", "full").join(flag(removed, "is_removed"), "id", "left").join(flag(installed, "is_in"), "id", "left").join(flag(enabled, "is_on"), "id", "left")
    new, gone, here = F.col("is_added").isNotNull(), F.col("is_removed").isNotNull(), F.col("is_in").isNotNull()
    now = F.lit(now_ms).cast("bigint")
    return j.select(
        "id",
        F.coalesce("name", "a_name").alias("name"),
        F.when(new, F.coalesce("stamp_first", "first_installed", now)).otherwise(F.col("first_installed")).alias("first_installed"),
        F.when(new, F.coalesce("stamp_last", now)).otherwise(F.col("last_installed")).alias("last_installed"),
        F.when(gone & F.col("name").isNotNull(), now).when(new, F.lit(None).cast("bigint")).when(~here & F.col("uninstalled").isNull(), now).otherwise(F.col("uninstalled")).alias("uninstalled"),
        F.when(new, F.coalesce("install_count", F.lit(0)) + 1).otherwise(F.col("install_count")).alias("install_count"),
        F.when(gone, False).when(new, True).otherwise(here).alias("currently_installed"),
        F.when(gone, False).otherwise(F.col("is_on").isNotNull()).alias("currently_enabled"),
        F.when(new, F.coalesce("estimated", F.lit(False))).otherwise(F.lit(False)).alias("estimated"),
    )


def estimated_times(stamps: DataFrame, now_ms: int, slack_ms: int = 60_000) -> DataFrame:
    """(id, stamp_first, stamp_last, estimated) from folder and manifest times; times after now, but for a minute, do not count."""
    good = lambda c: F.when((F.col(c) > 0) & (F.col(c) <= now_ms + slack_ms), F.col(c))
    first, last = good("dir_ctime"), good("manifest_mtime")
    return stamps.select("id", F.coalesce(F.least(first, last), first, last).alias("stamp_first"), F.coalesce(F.greatest(first, last), last, first).alias("stamp_last"), F.lit(True).alias("estimated"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change): added and removed ids."""
    up = after.select("id").join(before.select("id"), "id", "left_anti").withColumn("change", F.lit("added"))
    return up.union(before.select("id").join(after.select("id"), "id", "left_anti").withColumn("change", F.lit("removed")))


def first_seen(items: DataFrame, seen: DataFrame, known: DataFrame, now_ms: int) -> DataFrame:
    """(id, seen_at): what is on record, 0 for ids of the first load, now for the rest."""
    j = items.select("id").join(seen.select("id", "seen_at"), "id", "left").join(known.select("id", F.lit(0).cast("bigint").alias("base")).distinct(), "id", "left")
    return j.select("id", F.coalesce("seen_at", "base", F.lit(now_ms).cast("bigint")).alias("seen_at"))


def table_changes(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """(id, change): added, changed or removed rows of two versions of a table."""
    mark = lambda df, name: df.select("id", F.xxhash64(*fields).alias(name))
    j = mark(before, "b").join(mark(after, "a"), "id", "full")
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return j.select("id", kind.alias("change")).filter("change IS NOT NULL")


def overlay(baseline: DataFrame, upserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """The baseline with a delta on top: deleted ids go, upserted ones are replaced; only approved entries stay."""
    kept = baseline.join(deletes.select("id").union(upserts.select("id")).distinct(), "id", "left_anti")
    return kept.unionByName(upserts.join(deletes.select("id"), "id", "left_anti")).filter("status = 'approved'")


def latest_versions(history: DataFrame, keep: int = 12) -> DataFrame:
    """The newest rows by version's date, one a version, the newest `keep` of them."""
    w = Window.partitionBy("version").orderBy(F.col("date").desc())
    one = history.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return one.orderBy(F.col("date").desc(), F.col("version").desc()).limit(keep)


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def safe_to_replace(new_count: int | Column, loaded: int | Column, share: float = 0.5) -> bool | Column:
    """Whether a sink may be overwritten: not if it would lose more than half of what was loaded. Numbers or Columns."""
    return (loaded == 0) | (new_count >= loaded * share)


def flushes(changes: DataFrame, most: int = 100, idle_ms: int = 30_000, key: str = "id", time: str = "ts") -> DataFrame:
    """changes with `flush`: the number of the write that takes each one, per key: one after `most` changes or a pause of idle_ms.

    `ord` settles equal times.
    """
    w = Window.partitionBy(key).orderBy(time, "ord")
    burst = F.sum(F.coalesce((F.col(time) - F.lag(time).over(w) >= idle_ms).cast("int"), F.lit(0))).over(w)
    rows = changes.withColumn("__b", burst)
    inside = Window.partitionBy(key, "__b").orderBy(time, "ord")
    rows = rows.withColumn("__c", F.floor((F.row_number().over(inside) - 1) / most))
    return rows.withColumn("flush", F.dense_rank().over(Window.partitionBy(key).orderBy("__b", "__c")).cast("long")).drop("__b", "__c")


def debounced(events: DataFrame, gap_ms: int, key: str = "id", time: str = "ts") -> DataFrame:
    """Of calls that follow each other within gap_ms, the last; `ord` settles equal times."""
    w = Window.partitionBy(key).orderBy(time, "ord")
    return events.withColumn("__next", F.lead(time).over(w)).filter(F.col("__next").isNull() | (F.col("__next") - F.col(time) >= gap_ms)).drop("__next")


def still_dirty(marks: DataFrame, writes: DataFrame) -> DataFrame:
    """(id, ts): the latest mark of ids that no later write that succeeded has taken along.

    marks has (id, ts), writes (id, ts, ok): a failed write clears nothing, and a mark
    set while a write was under way (later than its start) stays.
    """
    last = marks.groupBy("id").agg(F.max("ts").alias("ts"))
    done = writes.filter("ok").groupBy("id").agg(F.max("ts").alias("done"))
    return last.join(done, "id", "left").filter(F.col("done").isNull() | (F.col("ts") > F.col("done"))).select("id", "ts")
