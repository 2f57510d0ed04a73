"""Substring dedup by level-wise doubling: windows that repeat at one length alone are looked at at twice that length.

The first level takes windows of half the final length, and of these only the lowest
hash in each run of neighbours (any final window holds one of them whole, at a place
that depends on its words alone). Final windows around the survivors are the
candidates of the last level; longer repeats are made of them.

Hashes meet in buckets by value. A chunk of documents sends each hash once, with its
lowest document, so a passage that a third of all documents hold sends one entry a
chunk, and no task gathers its copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordIds, among, bucketed, chunked, gram_hashes, loosened, lowest_of_each, mixed, packed, squeezed, table, texts, unpacked

WINDOW = 13
#: Entries that a task gathers from all chunks, about.
BUCKET = 1_000_000
SENT = "bucket int, chunk int, hashes binary, lowest binary, several binary"


class Chunk:
    """The words of a chunk's documents, end to end, in the order of their ids; windows stay within a document."""

    def __init__(self, group):
        import numpy as np

        order = np.argsort(group.column("doc_id").to_numpy(zero_copy_only=False), kind="stable")
        ids, numbers, sizes, self.docs = WordIds(), [], [], []
        column = group.column("text")
        doc_ids = group.column("doc_id")
        for i in order.tolist():
            n = ids.numbers(column[i].as_py().encode().split())
            numbers.append(n.astype(np.uint32))
            sizes.append(len(n))
            self.docs.append(doc_ids[i].as_py())
        self.order, self.column = order, column
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.hashes = ids.array()[np.concatenate(numbers)] if numbers else np.zeros(0, np.uint64)
        self.docs = np.array(self.docs, np.int64)

    def anchors(self, window: int):
        """(hash, index of document) of the lowest half windows, once a document; hashed anew, as lowest ones crowd at the low end."""
        import numpy as np

        half = (window + 1) // 2
        grams = gram_hashes(self.hashes, [half])[half]
        out, docs = [], []
        for k, (start, size) in enumerate(zip(self.starts.tolist(), self.sizes.tolist())):
            if size >= window:
                g = grams[start : start + size - half + 1]
                h = np.unique(mixed(g[lowest_of_each(g, window - half + 1)]))
                out.append(h)
                docs.append(np.full(len(h), k, np.int32))
        return (np.concatenate(out), np.concatenate(docs)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int32))

    def windows(self, window: int):
        """(hashes, place of the first word, index of document) of all windows."""
        import numpy as np

        n = np.maximum(self.sizes - window + 1, 0)
        docs = np.repeat(np.arange(len(n), dtype=np.int32), n)
        places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts, n)
        grams = gram_hashes(self.hashes, [window])[window]
        return grams[places], places, docs

    def candidates(self, window: int, anchors):
        """As windows(), those that hold one of the anchors, which ascend, as their lowest half window."""
        import numpy as np

        half = (window + 1) // 2
        grams = gram_hashes(self.hashes, [half])[half]
        w = window - half + 1
        lows = np.zeros(0, np.uint64)
        if len(grams) >= w:
            lows = grams[: len(grams) - w + 1].copy()
            for j in range(1, w):
                np.minimum(lows, grams[j : len(grams) - w + 1 + j], out=lows)
        hashes, places, docs = self.windows(window)
        keep = among(mixed(lows[places]), anchors)
        return hashes[keep], places[keep], docs[keep]


def sent(chunk: int, hashes, docs, doc_ids, buckets: int):
    """A row for each bucket: each hash once, the lowest document with it, and whether others of the chunk have it."""
    import numpy as np
    import pyarrow as pa

    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    heads = np.flatnonzero(first)
    ends = np.append(heads[1:], len(hashes)) - 1 if len(heads) else heads
    lowest, several, hashes = doc_ids[docs[heads]], docs[heads] != docs[ends], hashes[heads]
    rows = bucketed(hashes, buckets)
    return pa.table(
        {
            "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
            "chunk": pa.array([chunk] * len(rows), pa.int32()),
            "hashes": pa.array([packed(hashes[s:e]) for _, s, e in rows], pa.binary()),
            "lowest": pa.array([squeezed(lowest[s:e]) for _, s, e in rows], pa.binary()),
            "several": pa.array([squeezed(several[s:e]) for _, s, e in rows], pa.binary()),
        }
    )


def meet(key, group):
    """For each chunk of a bucket, its hashes that more than one document has, with the lowest document of all."""
    import numpy as np
    import pyarrow as pa

    parts = [unpacked(x.as_py()) for x in group.column("hashes")]
    sizes = [len(x) for x in parts]
    hashes = np.concatenate(parts)
    lowest = np.concatenate([loosened(x.as_py(), np.int64) for x in group.column("lowest")])
    several = np.concatenate([loosened(x.as_py(), np.bool_) for x in group.column("several")])
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    heads = np.flatnonzero(first)
    number = np.cumsum(first) - 1
    low = np.minimum.reduceat(lowest[order], heads)
    many = (np.diff(np.append(heads, len(ordered))) > 1) | np.logical_or.reduceat(several[order], heads)
    back = np.empty(len(order), np.int64)
    back[order] = number
    rows, at = [], 0
    for chunk, n in zip(group.column("chunk").to_pylist(), sizes):
        mine = back[at : at + n]
        keep = many[mine]
        if keep.any():
            rows.append((chunk, packed(hashes[at : at + n][keep]), squeezed(low[mine][keep])))
        at += n
    return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int32()), "hashes": pa.array([r[1] for r in rows], pa.binary()), "lowest": pa.array([r[2] for r in rows], pa.binary())})


def gathered(group):
    """The ascending hashes that came back to a chunk, and their lowest documents."""
    import numpy as np

    if group.num_rows == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.concatenate([unpacked(x.as_py()) for x in group.column("hashes")])
    lowest = np.concatenate([loosened(x.as_py(), np.int64) for x in group.column("lowest")])
    order = np.argsort(hashes, kind="stable")
    return hashes[order], lowest[order]


def repeated_words(df: DataFrame, id_col="doc_id", text_col="text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, runs) for every document; ids must be integers.

    Words lie between ASCII white space. A word goes if a window of `window` words
    around it, all of one document, also starts in a document with a lower id. `runs`
    are the stretches removed, as pairs of word numbers, `kept` the words left, with
    single spaces. Texts are dealt once into chunks by id; a task holds a chunk.
    Windows are compared by 64-bit hashes. Null and empty texts have no words; a
    document shorter than the window loses nothing; equal rows with one id are one
    document twice, and lose nothing to each other; other columns are left out; no
    rows give no rows.
    """
    docs = chunked(texts(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint")))
    size = docs.agg(F.sum(F.length("text")), F.count_distinct("chunk")).first()
    buckets = max(64, (size[0] or 0) // 6 // 4 // BUCKET)

    def seeds(key, group):
        chunk = Chunk(group)
        return sent(key[0].as_py(), *chunk.anchors(window), chunk.docs, buckets)

    def doubled(key, group, back):
        chunk = Chunk(group) if group.num_rows else None
        if chunk is None:
            import pyarrow as pa

            return pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("hashes", "lowest", "several")}})
        hashes, _, docs_of = chunk.candidates(window, gathered(back)[0])
        return sent(key[0].as_py(), hashes, docs_of, chunk.docs, buckets)

    def removed(key, group, back):
        import numpy as np
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("runs", kind)])
        if not group.num_rows:
            return schema.empty_table()
        chunk = Chunk(group)
        known, lowest = gathered(back)
        hashes, places, docs_of = chunk.windows(window)
        if len(known):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            gone = (known[at] == hashes) & (lowest[at] < chunk.docs[docs_of])
        else:
            gone = np.zeros(len(hashes), bool)
        n = len(chunk.hashes) + 1
        cover = np.cumsum(np.bincount(places[gone], minlength=n) - np.bincount(places[gone] + window, minlength=n)) > 0
        rows = []
        for k, i in enumerate(chunk.order.tolist()):
            start, size = int(chunk.starts[k]), int(chunk.sizes[k])
            mask = cover[start : start + size]
            words = chunk.column[i].as_py().encode().split()
            if mask.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                runs = [{"start": s, "stop": e} for s, e in edges.reshape(-1, 2).tolist()]
                words = [words[j] for j in np.flatnonzero(~mask).tolist()]
            else:
                runs = []
            rows.append((int(chunk.docs[k]), size, int(mask.sum()), b" ".join(words).decode(), runs))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    back = "chunk int, hashes binary, lowest binary"
    by = docs.groupBy("chunk")
    first = by.applyInArrow(seeds, SENT).groupBy("bucket").applyInArrow(meet, back)
    last = by.cogroup(first.groupBy("chunk")).applyInArrow(doubled, SENT).groupBy("bucket").applyInArrow(meet, back)
    return by.cogroup(last.groupBy("chunk")).applyInArrow(removed, "doc_id bigint, n_words bigint, n_removed bigint, kept string, runs array<struct<start:bigint,stop:bigint>>")


def op7_substring_dedup(spark, sf_dir) -> DataFrame:
    """What every document loses to documents before it."""
    found = repeated_words(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("runs").cast("long").alias("n_runs"))


ORACLE = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, p, md5(array_to_string(words[p + 1 : p + {WINDOW}], ' ')) AS g FROM (SELECT doc_id, words, unnest(range(len(words) - {WINDOW} + 1)) AS p FROM w WHERE len(words) >= {WINDOW})),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS low FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS spot FROM m WHERE low < doc_id),
r AS (SELECT doc_id, list_sort(list(spot)) AS gone FROM c GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_runs FROM (SELECT doc_id, spot, lag(spot) OVER (PARTITION BY doc_id ORDER BY spot) AS b FROM c) WHERE b IS NULL OR b < spot - 1 GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i - 1)) END, ' '), '')) AS kept_sha256, coalesce(n_runs, 0)::BIGINT AS n_runs
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)"""
