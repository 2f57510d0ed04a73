"""Markdown exports of reviews and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(c: Column) -> Column:
    """Text that is safe inside a table's row."""
    return F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")


def review_rows(reviews: DataFrame, longest: int = 60) -> DataFrame:
    """(id, line): a table row for each review: name, status, stars, verdict, note cut to a length."""
    stars = F.repeat(F.lit("★"), F.coalesce(F.col("rating"), F.lit(0)).cast("int"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", cell(F.col("name")), cell(F.coalesce("status", F.lit("tried"))), stars, cell(F.array_join("verdict", ", ")), cell(F.substring("note", 1, longest))), F.lit(" |"))
    return reviews.select("id", line.alias("line"))


def comparison(items: DataFrame, tags: DataFrame) -> DataFrame:
    """(id, section): a section for each compared item with what it has in common and alone; tags has (id, common, only)."""
    section = F.concat(F.lit("## "), "name", F.lit("\n\n"), "description", F.lit("\n\n- common: "), F.array_join("common", ", "), F.lit("\n- only: "), F.array_join("only", ", "), F.lit("\n"))
    return items.join(tags, "id").select("id", section.alias("section"))
