"""Filter dimensions: each gives a Column, or a semi or anti join where it asks for membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.schema import DAY_MS


def members(df: DataFrame, ids: DataFrame, wanted: bool = True, key: str = "id") -> DataFrame:
    """Rows whose key is, or is not, among the ids; Spark sends the ids to all tasks if they are few."""
    return df.join(ids.select(key), key, "left_semi" if wanted else "left_anti")


def translated(source: Column) -> Column:
    return F.coalesce(source, F.lit("original")) != "original"


def untranslated_ever(df: DataFrame, *stores: DataFrame) -> DataFrame:
    """Rows that are original and in none of the stores of earlier translations."""
    known = stores[0].select("id")
    for s in stores[1:]:
        known = known.union(s.select("id"))
    return df.filter(~translated(F.col("source"))).join(known.distinct(), "id", "left_anti")


def install_state(df: DataFrame, state: str, installed: DataFrame, enabled: DataFrame) -> DataFrame:
    if state == "installed":
        return members(df, installed)
    if state == "enabled":
        return members(df, enabled)
    if state == "installedNotEnabled":
        return members(members(df, installed), enabled, False)
    return df


def series(df: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Members of a curated series; without the series' list nothing passes."""
    return df.limit(0) if ids is None else members(df, ids)


def new_within(listed_at: Column, days: int, now_ms: int) -> Column:
    return F.coalesce((listed_at > 0) & (F.lit(now_ms) - listed_at <= days * DAY_MS), F.lit(False))


def updated_within(updated: Column, days: int, now_ms: int) -> Column:
    """Updated in the last `days`; for a negative number, longer ago than that. A missing or zero time passes neither."""
    age = F.lit(now_ms) - updated
    test = age <= days * DAY_MS if days > 0 else age > -days * DAY_MS
    return F.coalesce((updated > 0) & test, F.lit(False))


def in_categories(category: Column, wanted: list[str]) -> Column:
    return F.coalesce(category.isin(wanted), F.lit(False)) if wanted else F.lit(True)


def manage_filter(keyword: str = "", group: str = "", status: str = "") -> Column:
    """Filter of the management list over name, author, remark, group and enabled; `???` asks for an empty remark."""
    k = keyword.strip().lower()
    test = F.lit(True)
    if k == "???":
        test = F.trim(F.coalesce("remark", F.lit(""))) == ""
    elif k:
        test = F.instr(F.lower(F.concat_ws("\n", "name", "author", "remark")), k) > 0
    if group:
        test = test & (F.col("grp") == group)
    if status in ("enabled", "disabled"):
        test = test & (F.col("enabled") == (status == "enabled"))
    return test


def journal_filter(status: str = "", verdict: str = "", search: str = "") -> Column:
    """Filter of the review table; status `tried` asks for none."""
    test = F.lit(True)
    if status == "tried":
        test = F.col("status").isNull()
    elif status:
        test = F.coalesce(F.col("status") == status, F.lit(False))
    if verdict:
        test = test & F.coalesce(F.array_contains("verdict", verdict), F.lit(False))
    if search.strip():
        test = test & (F.instr(F.lower(F.concat_ws(" ", "name", "id", "note")), search.strip().lower()) > 0)
    return test


def ecosystem(df: DataFrame, curated: DataFrame, heuristic: Column) -> DataFrame:
    """Rows that are curated as members of the local ecosystem or look like it."""
    flags = curated.select("id", F.lit(True).alias("__curated")).distinct()
    return df.join(flags, "id", "left").filter(F.coalesce("__curated", F.lit(False)) | F.coalesce(heuristic, F.lit(False))).drop("__curated")
