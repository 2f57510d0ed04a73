"""MinHash near-dedup with order: sketches of occurrence-labelled shingles in text order, checked by banded alignment.

Shingles are five words, labelled with how often they came before in the document. A
sketch takes the PICKED lowest of one hash of them and puts these in text order, so two
documents share a sketch if they share these shingles and their order. Documents with
equal words are one class from the start. Of the others, those that share a sketch are
held against one document of the bucket, chosen by the bucket's own hash; two whose
shingle sequences align well enough, within the band that the similarity allows, are
linked. Members that have much in common with a choice, as those of a template have, but
are not linked to it, are sketched a second time by what sets them apart from the choice
that has most of them, and those that share such a sketch are held against its bucket's choice in turn. A round
takes a pair for each document and bucket, never all pairs.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordIds, alnum_words, as_rows, gram_hashes, joined_by, mixed, table, texts
from tessera.lineage import MOST_IN_ONE, checkpointed, in_one, let_go, rows_of

SHINGLE, SIMILAR = 5, 0.8
#: Sketches of a document, and shingles in a sketch.
SKETCHES, PICKED = 24, 3
#: Least share of a document's distinct shingles that a choice has for it to be sketched by the rest, and sketches of the rest.
TEMPLATE, RESTS = 0.6, 16


def shingles(hashes, n: int = SHINGLE):
    """Hashes of the runs of n words; of a shorter text, of all its words."""
    return gram_hashes(hashes, [min(n, len(hashes))])[min(n, len(hashes))] if len(hashes) else hashes


def labelled(grams):
    """Hashes of the shingles with their number among equals."""
    import numpy as np

    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    first = np.ones(len(grams), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    heads = np.flatnonzero(first)
    number = np.arange(len(grams)) - np.repeat(heads, np.diff(np.append(heads, len(grams))))
    out = np.empty(len(grams), np.uint64)
    out[order] = ordered + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return out


def sketches(grams, n: int = SKETCHES, picked: int = PICKED):
    """n hashes, each of the picked lowest labelled shingles, in text order, by a hash function of its own.

    Of long texts only the shingles under a bar that a few are expected to pass are
    ordered; where fewer than `picked` pass, all are.
    """
    import numpy as np

    keys = mixed(labelled(grams))
    seeds = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    size, total, block = len(keys), np.arange(n, dtype=np.uint64), max(1, 1_000_000 // max(1, len(keys)))
    for start in range(0, n, block):
        h = keys[None, :] * seeds[start : start + block, None]
        if size > 16 * picked:
            row, column = np.nonzero(h < np.uint64(2**64 * 4 * picked // size))
            values = h[row, column]
            order = np.lexsort((values, row))
            count = np.bincount(row, minlength=len(h))
            first = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) < picked
            low = np.zeros(len(row), bool)
            low[order[first]] = True
            few = count < picked
            chosen = np.empty((len(h), picked), np.uint64)
            chosen[~few] = values[low & ~few[row]].reshape(-1, picked)
            for k in np.flatnonzero(few):
                chosen[k] = h[k, np.sort(np.argpartition(h[k], picked - 1)[:picked])]
        else:
            chosen = np.take_along_axis(h, np.sort(np.argpartition(h, picked - 1, axis=1)[:, :picked], axis=1), axis=1) if size > picked else h
        for i in range(chosen.shape[1]):
            total[start : start + block] = mixed(total[start : start + block] * np.uint64(0x9E3779B97F4A7C15) + chosen[:, i])
    return total


def in_order(places) -> int:
    """Length of the longest ascending subsequence."""
    tails: list = []
    for p in places:
        at = bisect.bisect_left(tails, p)
        if at == len(tails):
            tails.append(p)
        else:
            tails[at] = p
    return len(tails)


def within_band(x: list, y: list, band: int, step: int = 256) -> int:
    """Length of the longest common subsequence of x and y whose matches lie at most `band` apart, by bit-parallel steps.

    Only the bits of the band are held: those that fall behind it are counted and let
    go. Values with many places are held as one long number, few enough of them to
    take about the room of x.
    """
    where: dict = {}
    for i, v in enumerate(x):
        where.setdefault(v, []).append(i)
    many = {v: sum(1 << i for i in at) if len(at) < 4096 else int.from_bytes(bits_of(at, len(x)), "little") for v, at in where.items() if len(at) > max(64, len(x) // 512)}
    bits = 2 * band + 1 + step
    full, low = (1 << bits) - 1, (1 << step) - 1
    row, base, passed = full, -band, 0
    for j, v in enumerate(y):
        start = j - band
        if start - base >= step:
            passed += step - (row & low).bit_count()
            row, base = (row >> step) | (low << (bits - step)), base + step
        if v in many:
            at = max(start, 0)
            match = ((many[v] >> at) & ((1 << max(0, j + band + 1 - at)) - 1)) << (at - base)
        else:
            at, match = where.get(v, ()), 0
            for k in range(bisect.bisect_left(at, start), len(at)):
                if at[k] > j + band:
                    break
                match |= 1 << (at[k] - base)
        if u := row & match:
            row = ((row + u) | (row - u)) & full
    return passed + bits - row.bit_count()


def bits_of(places, n: int) -> bytes:
    import numpy as np

    flags = np.zeros(n, np.uint8)
    flags[places] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def aligned(a, b, least: float = SIMILAR) -> float:
    """Similarity of two shingle sequences: matches of the best alignment over all shingles of both, 0 if under `least`.

    Labelled shingles that both have bound the matches from above; if these stand in
    one order they are the alignment. Else it is the longest common subsequence within
    the band of offsets that the similarity leaves.
    """
    import numpy as np

    n, m = len(a), len(b)
    need = least * (n + m) / (1 + least)
    if not n or not m or min(n, m) < need - 1e-9:
        return 0.0
    x, y = labelled(a), labelled(b)
    order = np.argsort(x)
    at = np.minimum(np.searchsorted(x[order], y), n - 1)
    places = order[at][x[order[at]] == y]
    if len(places) < need - 1e-9:
        return 0.0
    same = len(places)
    if (np.diff(places) < 0).any() and in_order(places.tolist()) < same:
        differ = np.flatnonzero(a[: min(n, m)] != b[: min(n, m)])
        start = int(differ[0]) if len(differ) else min(n, m)
        left = min(n, m) - start
        differ = np.flatnonzero(a[n - left :][::-1] != b[m - left :][::-1]) if left else differ
        stop = int(differ[0]) if left and len(differ) else left
        same = start + stop + within_band(a[start : n - stop].tolist(), b[start : m - stop].tolist(), int(n + m - 2 * need) + 1)
    s = same / (n + m - same)
    return s if s >= least - 1e-12 else 0.0


def shared(a, b, least: float = SIMILAR) -> float:
    """Distinct shingles of both over those of either, 0 if under `least`: near copies whose passages moved or repeat do not align, but share these."""
    import numpy as np

    a, b = np.unique(a), np.unique(b)
    if min(len(a), len(b)) < least * max(len(a), len(b), 1):
        return 0.0
    same = len(np.intersect1d(a, b, assume_unique=True))
    s = same / max(1, len(a) + len(b) - same)
    return s if s >= least - 1e-12 else 0.0


def components(links: DataFrame) -> DataFrame:
    """(id, root): every id of the links (a, b) with the least id it is linked to, directly or not.

    Each round links all neighbours of an id to the least of them, first the larger
    neighbours, then the smaller ones, until nothing changes; rounds grow with the log
    of the longest chain.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())

    def mark(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r.n, r.h

    small = rows_of(edges) <= MOST_IN_ONE // 2
    edges = in_one(edges, small)
    was = mark(edges)
    while was[0]:
        both = in_one(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), small)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = joined_by(both, low, ["a"], small=small).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        near = joined_by(large, low, ["a"], small=small)
        near = in_one(near.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b"))), small).filter("a <> b").distinct()
        edges = in_one(checkpointed(near), small)
        now = mark(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, words, n, kinds, keys): a hash of all words, null without words, the numbers of shingles and of distinct ones, and the sketches."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, schema = WordIds(), None
        for batch in batches:
            schema = schema or pa.schema([("doc_id", batch.column(0).type), ("words", pa.binary()), ("n", pa.int64()), ("kinds", pa.int64()), ("keys", pa.list_(pa.int64()))])
            rows = []
            for (text,) in as_rows(batch, "text"):
                if len(ids) > 400_000:
                    ids = WordIds()
                words = alnum_words(text)
                if words:
                    grams = shingles(ids.at(words) & np.uint64(0xFFFFFFFF))
                    rows.append((hashlib.blake2b(b" ".join(words), digest_size=16).digest(), len(grams), len(np.unique(grams)), sketches(grams).view(np.int64)))
                else:
                    rows.append((None,) * 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, schema.types[1:]))], schema=schema)

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, words binary, n bigint, kinds bigint, keys array<bigint>")


def rest_of(t, s, n: int = RESTS):
    """How many distinct shingles of t s has not, and n hashes of them, each the lowest by a hash function of its own; none if s has few of t or all."""
    import numpy as np

    own = np.unique(t)
    rest = mixed(np.setdiff1d(own, s))
    if not len(rest) or len(own) - len(rest) < TEMPLATE * len(own):
        return None
    seeds = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    return len(rest), np.array([(rest * seed).min() for seed in seeds], np.uint64).view(np.int64)


def against_choice(members: DataFrame) -> DataFrame:
    """(a, b): the members of each bucket (band, key, doc_id, n, kinds) of two or more with its choice, once, where their numbers of shingles leave a chance.

    The choice depends on the bucket, so a document is held against another one in each.
    """
    rank = F.struct(F.xxhash64("band", "key", "doc_id").alias("h"), "doc_id", "n", "kinds")
    chosen = members.groupBy("band", "key").agg(F.min(rank).alias("r"), F.count("*").alias("size")).filter("size > 1").select("band", "key", F.col("r.doc_id").alias("a"), F.col("r.n").alias("a_n"), F.col("r.kinds").alias("a_kinds"))
    return joined_by(members, chosen, ["band", "key"]).filter("a <> doc_id").select("a", F.col("doc_id").alias("b"), "n", "kinds", "a_n", "a_kinds")


def likely(pairs: DataFrame, least: float) -> DataFrame:
    near = lambda x, y: F.least(x, y) >= least * F.greatest(x, y) - 1e-9
    return pairs.filter(near(F.col("n"), F.col("a_n")) | near(F.col("kinds"), F.col("a_kinds"))).select("a", "b").distinct()


def words_of(docs: DataFrame) -> DataFrame:
    """(doc_id, grams): 32-bit hashes of the words of each document, from which its shingles follow."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids = WordIds()
        for batch in batches:
            out = []
            for (text,) in as_rows(batch, "text"):
                if len(ids) > 400_000:
                    ids = WordIds()
                out.append((ids.at(alnum_words(text)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "grams"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, grams binary")


def classes_of(reps: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """(id, root) as components() gives them, of the similar documents that share a bucket; reps has (doc_id, n, kinds, keys).

    Only the words of documents that are in some pair are written, once for both rounds.
    """
    members = reps.select("doc_id", "n", "kinds", F.posexplode("keys").alias("band", "key"))
    pairs = checkpointed(likely(against_choice(members), least))
    paired = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    made = checkpointed(words_of(docs.join(paired.hint("merge"), "doc_id", "left_semi").select("doc_id", "text")))
    found = checkpointed(checked(pairs, made, least))
    del pairs, paired, members
    let_go(docs.sparkSession)
    roots = components(found.filter("rest IS NULL").select("a", "b"))
    let_go(docs.sparkSession)
    of = lambda c, to: roots.select(F.col("id").alias(c), F.col("root").alias(to))
    apart = found.filter("rest IS NOT NULL").join(of("a", "its"), "a", "left").join(of("b", "mine"), "b", "left")
    apart = apart.withColumn("mine", F.coalesce("mine", "b")).filter(F.col("mine") != F.coalesce("its", "a"))
    apart = apart.groupBy(F.col("b").alias("doc_id"), "n", "kinds", "mine").agg(F.min(F.struct("left", "rest")).alias("least"))
    apart = apart.select("doc_id", "n", "kinds", "mine", F.posexplode("least.rest").alias("band", "key"))
    several = apart.groupBy("band", "key").agg(F.min("mine").alias("x"), F.max("mine").alias("y")).filter("x <> y").select("band", "key")
    again = checkpointed(checked(likely(against_choice(joined_by(apart, several, ["band", "key"]).drop("mine")), least), made, least))
    return components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(again.filter("rest IS NULL").select("a", "b")))


def checked(pairs: DataFrame, made: DataFrame, least: float) -> DataFrame:
    """(a, b, aligned, shared, left, rest, n, kinds): the pairs that are similar, by either measure, one that does not reach `least` being 0; and those where a has much of b, with what b has besides and its numbers of shingles."""
    both = pairs.join(made.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")), "a").join(made.select(F.col("doc_id").alias("b"), F.col("grams").alias("y")), "b")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep, found = [], []
            for i, (x, y) in enumerate(as_rows(batch, "x", "y")):
                s, t = (shingles(np.frombuffer(v, np.uint32).astype(np.uint64)) for v in (x, y))
                v, w = aligned(s, t, least), shared(s, t, least)
                rest = None if v or w else rest_of(t, s)
                if v or w or rest is not None:
                    keep.append(i)
                    found.append((v, w, *(rest or (None, None)), len(t), len(np.unique(t))))
            at = pa.array(keep, pa.int64())
            more = [pa.array(c, kind) for c, kind in zip(zip(*found) if found else [[]] * 6, (pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *more], ["a", "b", "aligned", "shared", "left", "rest", "n", "kinds"])

    kind = dict(made.dtypes)["doc_id"]
    return both.select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}, aligned double, shared double, left bigint, rest array<bigint>, n bigint, kinds bigint")


def near_duplicates(df: DataFrame, id_col="doc_id", text_col="text", least: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id) for every row: the least id of the documents that it is a copy or near copy of, directly or not.

    Two documents are near copies if their sequences of five-word shingles align to
    `least` or more (matches over all shingles of both). A second rule, of its own,
    links those that have as large a share of their distinct shingles in common:
    copies whose passages moved, or repeat more often, do not align, but are met here
    if they share a sketch. Words are runs of ASCII letters (in lower case), ASCII
    digits and non-ASCII characters; texts of fewer than five have one shingle.
    Documents with the same words are one class. Null texts and texts without words
    are each a class of their own; rows with one id each give a row, of one class;
    rows without an id have no class; other columns are left out; no rows give no rows.

    Copies are counted by the hash of their words before anything is joined, and only
    the least document of each kind is held against others, so groups of any size
    cost a row a document. Texts are read again for the documents in pairs alone.
    """
    let_go(df.sparkSession)
    docs = texts(df, id_col, text_col)
    made = checkpointed(sketched(docs))
    some = made.filter(F.col("words").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "words")
    kinds = some.groupBy("words").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep < last").drop("last")
    of = checkpointed(joined_by(some, kinds, ["words"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")))
    reps = made.filter(F.col("words").isNotNull()).join(of.filter("doc_id <> rep").select("doc_id").distinct(), "doc_id", "left_anti").filter(F.col("doc_id").isNotNull())
    roots = classes_of(reps.select("doc_id", "n", "kinds", "keys"), docs, least)
    one = of.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    found = made.select("doc_id").join(one, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    return found.join(roots, found.rep == roots.id, "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"))


def op3_minhash_near_dedup(spark, sf_dir) -> DataFrame:
    """The class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))
