"""What the corpus operators share: reading, cutting lineage, dealing texts into chunks, word identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text in a chunk, and the least number of chunks; a chunk is what one Python task holds.
CHUNK_CHARS, LEAST_CHUNKS = 3_000_000, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that other columns, whatever their names, play no part. A null text is empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def joined_by(rows: DataFrame, facts: DataFrame, by: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """rows with the facts of their keys, one row a key, keys not null.

    The keys are joined as one struct, which the aggregate that made the facts was not
    dealt by. So both sides get an exchange of their own right below the join, and
    Spark can split the rows of a hot key among tasks. Facts that are known to be few
    (small) go to every task instead.
    """
    key, fact = unused(rows, "key"), unused(facts, "fact")
    left = rows.withColumn(key, F.struct(*by))
    right = facts.select(F.struct(*by).alias(fact), *(c for c in facts.columns if c not in by))
    return left.join(F.broadcast(right) if small else right, F.col(key) == F.col(fact), how).drop(key, fact)


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it differ from those of all columns."""
    while name.lower() in map(str.lower, df.columns):
        name = "_" + name
    return name


def chunked(docs: DataFrame, chunk_chars: int = CHUNK_CHARS, least: int = LEAST_CHUNKS) -> DataFrame:
    """(chunk, doc_id, text): documents dealt by their id, about chunk_chars characters to a chunk.

    The number of chunks follows the input, so a chunk fits in a task at any size.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(least, -(-chars // chunk_chars))
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).select("chunk", "doc_id", "text")


def as_rows(batch, *names):
    """Python values of the named columns of an Arrow batch, row by row."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


class WordIds(dict):
    """word -> number in order of first sight; at() has 64-bit hashes of words, the same in every process."""

    def __init__(self):
        import numpy as np
        import xxhash

        self.hash, self.fresh, self.known, self.kept = xxhash.xxh64_intdigest, [], np.zeros(4096, np.uint64), 0

    def __missing__(self, word):
        self[word] = n = self.kept + len(self.fresh)
        self.fresh.append(self.hash(word))
        return n

    def array(self):
        """Hashes by number."""
        import numpy as np

        if self.fresh:
            n = self.kept + len(self.fresh)
            if n > len(self.known):
                self.known = np.concatenate([self.known[: self.kept], np.zeros(2 * n - self.kept, np.uint64)])
            self.known[self.kept : n] = self.fresh
            self.kept, self.fresh = n, []
        return self.known[: self.kept]

    def numbers(self, words):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def at(self, words):
        """Hashes of the words."""
        n = self.numbers(words)
        return self.array()[n]


#: ASCII letters in lower case; ASCII letters, digits and all bytes above ASCII are kept, the rest become spaces.
ALNUM = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
#: ASCII letters in lower case, the rest as it is.
LOWER = bytes(ord(chr(b).lower()) if b < 128 else b for b in range(256))


def alnum_words(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, ASCII letters in lower case, as UTF-8."""
    return text.encode().translate(ALNUM).split()


def mixed(h):
    """A bijective scramble of 64-bit numbers."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(words, lengths):
    """{n: hashes of the windows of n words that start at each place} for 64-bit word hashes, made by doubling.

    Windows of 2n words are two windows of n; other lengths are put together from
    these. Windows run on past the end of a document where many lie end to end: the
    caller leaves those out.
    """
    import numpy as np

    level, out = {1: mixed(words)}, {}
    most = max(lengths)
    while 2 * max(level) <= most:
        n = max(level)
        h = level[n]
        level[2 * n] = mixed(h[: max(0, len(h) - n)] * np.uint64(0x9E3779B97F4A7C15) + h[n:])
    for n in lengths:
        at, h = 0, None
        for k in sorted(level, reverse=True):
            while at + k <= n:
                part = level[k][at : at + max(0, len(words) - n + 1)]
                h = part if h is None else mixed(h * np.uint64(0x9E3779B97F4A7C15) + part)
                at += k
        out[n] = h
    return out


def lowest_of_each(h, w):
    """Places whose value is the lowest, the last of equals, in some run of w consecutive places (winnowing)."""
    import numpy as np

    if len(h) == 0:
        return np.zeros(0, np.int64)
    if len(h) <= w:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
    windows = np.lib.stride_tricks.sliding_window_view(h, w)
    return np.unique(np.arange(len(windows)) + w - 1 - np.argmin(windows[:, ::-1], axis=1))


def packed(sorted_hashes) -> bytes:
    """Ascending 64-bit numbers as compressed differences."""
    import numpy as np
    import zstandard

    steps = np.diff(sorted_hashes, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes):
    import numpy as np
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(np.uint64), dtype=np.uint64)


def squeezed(numbers) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(numbers.tobytes())


def loosened(data: bytes, dtype):
    import numpy as np
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def among(values, ascending):
    """Which of the values are in the ascending array."""
    import numpy as np

    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def bucketed(ascending, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, stop) of the runs of ascending 64-bit hashes that share a bucket, by their upper bits."""
    import numpy as np

    if not len(ascending):
        return []
    which = (ascending >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
    cuts = np.concatenate([[0], np.flatnonzero(which[1:] != which[:-1]) + 1, [len(which)]])
    return list(zip(which[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist()))


def bucket_of(hash_column, buckets: int):
    """The same bucket as a Column of a signed 64-bit hash."""
    return F.shiftrightunsigned(F.shiftrightunsigned(hash_column, 40) * F.lit(buckets).cast("bigint"), 24).cast("int")
