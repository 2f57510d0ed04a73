"""Offline jobs: rule classification, tags, dependencies found in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(items: DataFrame, rules: list[tuple[str, float, list[str]]], text: Column, fallback: str = "other") -> DataFrame:
    """items with category: the rule with the highest sum over its signals; the earliest rule wins ties.

    A signal found in text or id adds the rule's weight, one more if it has four
    characters or more, and one more if the id has it. Rules are folded into columns,
    so a row is scored where it lies.
    """
    t, i = F.lower(text), F.lower("id")
    points = []
    for _, weight, signals in rules:
        total = F.lit(0.0)
        for s in signals:
            low = s.lower()
            total = total + F.when((F.instr(t, low) > 0) | (F.instr(i, low) > 0), F.lit(weight + (1 if len(s) >= 4 else 0)) + F.when(F.instr(i, low) > 0, 1).otherwise(0)).otherwise(0.0)
        points.append(total)
    if not rules:
        return items.withColumn("category", F.lit(fallback))
    names = F.array(*(F.lit(n) for n, _, _ in rules))
    first = F.element_at(names, F.array_position("__p", F.array_max("__p")).cast("int"))
    return items.withColumn("__p", F.array(*points)).withColumn("category", F.when(F.array_max("__p") > 0, first).otherwise(fallback)).drop("__p")


def vocabulary_tags(text: Column, vocabulary: list[str], category: Column, most: int = 4, front: int = 24) -> Column:
    """Words of the vocabulary that a text has, those near its start first, at most four; the category if there are none."""
    words = F.array(*(F.lit(w) for w in vocabulary))
    held = lambda t: F.filter(words, lambda w: F.contains(t, w))
    tags = F.slice(F.array_distinct(F.concat(held(F.substring(text, 1, front)), held(text))), 1, most)
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(category))


def keep_classified(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """(id, category): existing ones stay, new ids get the fresh one."""
    return fresh.select("id", F.col("category").alias("f")).join(existing.select("id", "category"), "id", "left").select("id", F.coalesce("category", "f").alias("category"))


def detect_dependencies(manifests: DataFrame, texts: DataFrame, dictionary: DataFrame, strong: str = "requires|depends on|needs", code: DataFrame | None = None) -> DataFrame:
    """(src_id, dep_id, kind, confidence): what manifests declare (0.9), code refers to (0.85) and texts name, near a strong word (0.7) or not (0.35).

    The dictionary's names meet the words of texts by equality, so no pair of text and
    name without a common word is looked at. The highest confidence counts, under 0.4
    none; below 0.7 a dependency is optional.
    """
    declared = manifests.select("src_id", "dep_id", F.lit(0.9).alias("c"))
    if code is not None:
        declared = declared.union(code.select("src_id", "dep_id", F.lit(0.85).alias("c")))
    words = texts.select("src_id", F.explode(F.split("text", r"(?<=[.!?\n])\s*")).alias("s"))
    words = words.select("src_id", F.lower("s").rlike(strong).alias("near"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("s"), F.lit("([a-z0-9_-]+)"), F.lit(1)))).alias("name"))
    named = words.join(dictionary.select(F.col("id").alias("dep_id"), F.lower("name").alias("name")), "name").select("src_id", "dep_id", F.when(F.col("near"), 0.7).otherwise(0.35).alias("c"))
    known = dictionary.select(F.col("id").alias("dep_id")).distinct()
    best = declared.union(named).filter("src_id <> dep_id").join(known, "dep_id", "left_semi").groupBy("src_id", "dep_id").agg(F.max("c").alias("confidence"))
    return best.filter("confidence >= 0.4").withColumn("kind", F.when(F.col("confidence") >= 0.7, "required").otherwise("optional"))


def admitted(edges: DataFrame) -> DataFrame:
    """Edges with where they go: the graph from 0.7, candidates from 0.4, nowhere below."""
    return edges.withColumn("goes", F.when(F.col("confidence") >= 0.7, "edge").when(F.col("confidence") >= 0.4, "candidate")).filter("goes IS NOT NULL")
