"""Pairs of rows of two tables by a key that many rows share: blocks of values meet, and become rows in the task that returns them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: About how many values a block has.
BLOCK = 1024


def blocks(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """(key, <name>_at, name): the values of each key in arrays of about BLOCK, whatever the number of its rows."""
    rows = rows.select(key, value.alias(name))
    sizes = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    at = F.pmod(F.xxhash64(name), F.ceil(F.col("__n") / BLOCK))
    return rows.join(sizes, F.col(key) == F.col("__key")).groupBy(key, at.alias(f"{name}_at")).agg(F.collect_list(name).alias(name))


def unfolded(met: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """(left, right): all pairs of values of two blocks that have met, dealt out by `by` and the blocks' numbers.

    A pair of blocks moves once for about BLOCK * BLOCK rows, and no task has to hold more than one.
    """
    tasks = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.repartition(tasks, *by, f"{left}_at", f"{right}_at").select(left, right)
    return dealt.select(F.explode(left).alias(left), right).select(left, F.explode(right).alias(right))
