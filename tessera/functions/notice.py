"""Small text rules, and the signature of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the closing sentence that says an item has not been reviewed by hand.
NOTICE = r"[\s\-—–。．]*[此该]?插?件?尚?未经过[^审核]*?(?:人工|手动)\s*审核[。.]?\s*$"


def strip_notice(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, NOTICE, ""))


def table_signature(df: DataFrame, fields: list[str], version: str) -> DataFrame:
    """One row: a signature that changes if any field of any row does, whatever the order of rows, made of partial sums."""
    h = F.xxhash64(*fields).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(h).alias("a"), F.sum(F.xxhash64(F.xxhash64(*fields), F.lit(1)).cast("decimal(38,0)")).alias("b")).select(F.concat_ws(":", F.lit(version), "n", "a", "b").alias("signature"))


def ordered_signatures(df: DataFrame, order: str, shared: list[str], more: list[str], version: str) -> DataFrame:
    """One row (text_index, fields): signatures that also change when two rows change places.

    text_index covers the shared fields and the tokenizer's version, fields covers all.
    Each row is hashed together with its place, so the sums stay partial and no row has
    to wait for another.
    """
    null_safe = lambda names: [F.coalesce(F.col(c).cast("string"), F.lit("\u001e")) for c in names]
    sums = []
    for name, fields in (("text_index", shared), ("fields", [*shared, *more])):
        for seed in (0, 1):
            h = F.xxhash64(F.concat_ws("\u001f", *null_safe([order, *fields])), F.lit(seed)).cast("decimal(38,0)")
            sums.append(F.sum(h).alias(f"{name}_{seed}"))
    out = df.agg(F.count("*").alias("n"), *sums)
    return out.select(F.concat_ws(":", F.lit(version), "n", "text_index_0", "text_index_1").alias("text_index"), F.concat_ws(":", "n", "fields_0", "fields_1").alias("fields"))
