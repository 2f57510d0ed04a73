"""Sort orders. All end in `ord`, the row's place in the catalog, so that ties keep it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keys(order: str) -> list[Column]:
    """Sort keys of an order over columns downloads, updated, list_index, display_name, installed, trending, recommended, ord."""
    down = F.coalesce("downloads", F.lit(0.0)).desc()
    kinds = {
        "relevance": [],
        "downloads": [down],
        "updated": [F.col("updated").desc_nulls_last()],
        "published": [F.col("list_index").desc_nulls_last()],
        "name": [F.collate("display_name", "zh")],
        "popular": [F.coalesce("installed", F.lit(False)).asc(), down, F.col("updated").desc_nulls_last()],
        "trending": [F.coalesce("trending", F.lit(0.0)).desc()],
        "recommended": [F.coalesce("recommended", F.lit(0.0)).desc()],
    }
    return [*kinds[order], F.col("ord").asc()]


def ranked(df: DataFrame, order: list[Column], name: str = "position", limit: int | None = None) -> DataFrame:
    """df with its place in the order, from 1. With a limit only so many rows meet in one task."""
    cut = df.orderBy(*order).limit(limit) if limit else df
    return cut.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def overlays(order: list[Column]) -> list[Column]:
    """The order below what always comes first: at-risk rows last, editor's picks first, then favorites."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    return [flag("at_risk").asc(), flag("pick").desc(), flag("favorite").desc(), *order]


def top_k(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k rows of highest score, ties by ord: TakeOrderedAndProject, no full sort."""
    return df.orderBy(F.col(score).desc(), F.col("ord").asc()).limit(k)


def page(df: DataFrame, order: list[Column], row_height: int, scroll: int, height: int, spare: int = 3) -> DataFrame:
    """Rows that a window of a scrolled list shows, with some to spare on both sides."""
    first = max(0, scroll // row_height - spare)
    last = -(-(scroll + height) // row_height) + spare
    return df.orderBy(*order).offset(first).limit(last - first)


# Rank of a review's status.
STATUS_RANK = {"using": 0, "abandoned": 1, "watching": 2}


def journal_keys(by: str, descending: bool) -> list[Column]:
    """Sort keys of the review table; the name settles ties and turns with the direction."""
    status = F.coalesce(F.create_map(*(F.lit(x) for p in STATUS_RANK.items() for x in p))[F.col("status")], F.lit(3))
    column = {"name": F.lower("name"), "status": status, "rating": F.coalesce("rating", F.lit(0)), "installCount": F.coalesce("install_count", F.lit(0)), "lastActive": F.coalesce("last_active", F.lit(0)), "updated": F.coalesce("updated", F.lit(0))}[by]
    turn = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    return [turn(column), turn(F.lower("name")), turn(F.col("id"))]
