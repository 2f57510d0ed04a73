"""The boundary for embedding models: batches of texts to vectors on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def embedded(text: Column, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Column:
    """Vectors of texts by a model that `load` makes once a task."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model([t or "" for t in batch]))

    return F.pandas_udf(run, "array<float>")(text)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row: a lambda's variable, where a Column would be computed at each of its uses."""
    return F.transform(F.array(value), f)[0]


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """A stand-in for a model that needs no download: signed counts of hashed words at length one, inside the JVM."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    of = lambda hashes, i: F.aggregate(hashes, F.lit(0.0), lambda a, h: a + F.when(F.pmod(h, F.lit(dims)) == i, F.when(h > 0, 1.0).otherwise(-1.0)).otherwise(0.0))
    counts = lambda hashes: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: of(hashes, i))
    norm = lambda raw: F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, e: a + e * e))
    unit = lambda raw: once(norm(raw), lambda n: F.transform(raw, lambda e: F.when(n > 0, e / n).otherwise(0.0)))
    return once(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: once(counts(hashes), unit))
