"""Small decisions as Columns and plain functions: keys, empty lists, what may be stored, which filters are on."""

from __future__ import annotations

from functools import lru_cache
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_key(source: Column, base_url: Column, model: Column, default_model: str = "default") -> Column:
    """What an index was made by: `local|model`, `api@base|model`, or the model alone for a provider's own address."""
    base = F.regexp_replace(F.trim(F.coalesce(base_url, F.lit(""))), "/+$", "")
    m = F.coalesce(model, F.lit(""))
    local = F.concat(F.lit("local|"), F.when(F.trim(m) == "", F.lit(default_model)).otherwise(F.trim(m)))
    return F.when(F.coalesce(source == "local", F.lit(False)), local).when(base == "", m).otherwise(F.concat(F.lit("api@"), base, F.lit("|"), m))


def result_key(mode: Column, query: Column, categories: Column, config: Column, data: Column) -> Column:
    """What a kept result is valid for: equal for equal mode, query, set of categories, configuration and data."""
    parts = [F.coalesce(c, F.lit("")) for c in (mode, query, F.array_join(F.array_sort(F.array_distinct(categories)), "\u001e"), config, data)]
    return F.md5(F.concat_ws("\u001f", *parts))


def empty_state(has_query: Column, mode: Column, answered: Column, has_key: Column, narrowed: Column, short_query: Column, rich_query: Column) -> Column:
    """(title, hint, clear, bridge) of an empty list.

    Without a query there is no data; a semantic search without an answer yet is
    pending; else nothing matched, and the other kind of search is offered where the
    query suits it: keywords for a short one, the ranker for a rich one with a key.
    """
    semantic = mode.isin("ai", "local")
    pending = has_query & semantic & ~answered
    title = F.when(~has_query, "no data").when(pending, F.concat(mode, F.lit(" pending"))).otherwise("no match")
    hint = F.when(~has_query, "loosen filters").when(pending, F.concat(mode, F.lit(" hint"))).otherwise("clear filters")
    bridge = F.when(has_query & semantic & answered & short_query, "keyword").when(has_query & ~semantic & has_key & rich_query, "ai")
    return F.struct(title.alias("title"), hint.alias("hint"), (has_query | narrowed).alias("clear"), bridge.alias("bridge"))


def without_credentials(settings: Column, names: list[str]) -> Column:
    """A map of settings less the named keys, which are kept elsewhere."""
    return F.map_filter(settings, lambda k, _: ~k.isin(names))


def expanded(query: Column, synonyms: dict[str, list[str]]) -> Column:
    """A query with the synonyms of the keys that it holds, in the table's order, each once; ASCII keys only as words."""
    import re

    low = F.lower(query)
    none = F.array().cast("array<string>")
    found = []
    for key, words in synonyms.items():
        held = low.rlike(rf"\b{re.escape(key)}\b") if key.isascii() else F.contains(low, F.lit(key))
        found.append(F.when(held, F.array(*map(F.lit, words))).otherwise(none))
    return F.array_join(F.array_distinct(F.concat(F.array(query), *found)), " ")


def active_filters(state: dict[str, object], order: list[str], neutral: dict[str, object]) -> list[tuple[str, str]]:
    """(name, value) of the filters that differ from their neutral value, in a fixed order."""
    text = lambda x: ", ".join(map(str, x)) if isinstance(x, (list, tuple)) else str(x)
    return [(n, text(state[n])) for n in order if state.get(n) not in (None, "", [], (), neutral.get(n))]


def filter_signature(state: dict[str, object], order: list[str], neutral: dict[str, object]) -> str:
    """The same for the same active filters."""
    return "\u001e".join(f"{n}\u001f{v}" for n, v in active_filters(state, order, neutral))


def remembered(embed: Callable[[str], list[float]], most: int = 64) -> Callable[[str], tuple[float, ...]]:
    """An embedder of queries that keeps the vectors of the last `most` different ones."""
    return lru_cache(maxsize=most)(lambda text: tuple(embed(text)))
