"""Benchmark decontamination by winnowing: fingerprints of tests and documents are joined and their hits extended.

Each run of `SPAN` consecutive k-gram hashes gives its lowest one as a fingerprint, so
two texts that share K + SPAN - 1 = 10 words share a fingerprint within these words. A
hit is extended to the windows of ten words around it, and those that the benchmark
holds, by their hash, make up the shared stretches. Windows are looked up by value, so a
text that says one thing over and over costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordIds, alnum_words, among, as_rows, gram_hashes, lowest_of_each, table, texts

WINDOW, K, SPAN = 10, 5, 6
#: Largest benchmark, in characters, that each task gets whole; a larger one is joined by fingerprint.
MOST_SENT = 16_000_000


def winnowed(grams):
    """Places of the lowest hash of each SPAN neighbours; of a stretch of equal hashes as few as leave none without."""
    import numpy as np

    places = lowest_of_each(grams, SPAN)
    values = grams[places]
    if len(places) < 3 or not (values[1:] == values[:-1]).any():
        return places
    kept, all_places, all_values = [int(places[0])], places.tolist(), values.tolist()
    for i in range(1, len(all_places) - 1):
        if not (all_values[i - 1] == all_values[i] == all_values[i + 1] and all_places[i + 1] - kept[-1] <= SPAN):
            kept.append(all_places[i])
    return np.array([*kept, all_places[-1]])


def windows_of(words: list[bytes], ids: WordIds):
    """(length, hashes of all windows, hashes of the fingerprints) of an item; a short item is one window, without fingerprints."""
    import numpy as np

    n, h = min(WINDOW, len(words)), ids.at(words)
    grams = gram_hashes(h, sorted({n, K})) if n == WINDOW else gram_hashes(h, [n])
    return n, np.unique(grams[n]), np.unique(grams[K][lowest_of_each(grams[K], SPAN)]) if n == WINDOW else np.zeros(0, np.uint64)


def around(places, n_words: int):
    """Starts of the windows of a document that hold the K-grams at these places."""
    import numpy as np

    starts = np.unique((places[:, None] - np.arange(SPAN)[None, :]).ravel())
    return starts[(starts >= 0) & (starts <= n_words - WINDOW)]


class Tests:
    """The windows and fingerprints of a benchmark, for one task."""

    def __init__(self, items: list[list[bytes]]):
        import numpy as np

        ids, prints, of = WordIds(), [], {}
        for number, words in enumerate(items):
            if words:
                n, windows, own = windows_of(words, ids)
                prints.append(own)
                of.setdefault(n, []).append((windows, np.full(len(windows), number)))
        self.prints, self.by_length = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64), {}
        for n, parts in of.items():
            hashes, numbers = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            values, first = np.unique(hashes[order], return_index=True)
            self.by_length[n] = values, numbers[order], np.append(first, len(order))

    def runs(self, words: list[bytes], ids: WordIds) -> dict:
        """{item: stretches (start, stop) of the words that are made of its windows}."""
        import numpy as np

        found: dict = {}
        if not words or not self.by_length:
            return found
        h = ids.at(words)
        grams = gram_hashes(h, sorted({K, *(n for n in self.by_length if n < WINDOW)}))
        for n, (values, numbers, first) in self.by_length.items():
            if n < WINDOW:
                hashes = grams[n]
                starts = np.flatnonzero(among(hashes, values))
            else:
                places = winnowed(grams[K])
                hits = places[among(grams[K][places], self.prints)]
                if not len(hits):
                    continue
                starts = around(hits, len(words))
                hashes = gram_hashes(h, [WINDOW])[WINDOW]
                starts = starts[among(hashes[starts], values)]
            if not len(starts):
                continue
            at = np.searchsorted(values, hashes[starts])
            order = np.argsort(at, kind="stable")
            for which in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                runs, k = stretches(starts[which], n), int(at[which[0]])
                for item in numbers[first[k] : first[k + 1]].tolist():
                    found.setdefault(item, []).extend(runs)
        return {item: merged(runs) for item, runs in found.items()}


def stretches(starts, n: int) -> list[tuple[int, int]]:
    """The places covered by windows of n words with these ascending starts, as (start, stop)."""
    import numpy as np

    cuts = np.flatnonzero(np.diff(starts) > n) + 1
    return list(zip(starts[np.concatenate([[0], cuts])].tolist(), (starts[np.append(cuts, len(starts)) - 1] + n).tolist()))


def merged(runs) -> list[tuple[int, int]]:
    out: list = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


FOUND = "n_words bigint, n_hit bigint, items array<string>, runs array<struct<item_id:string,start:bigint,stop:bigint>>"


def row_of(doc_id, n, found: dict) -> dict:
    covered = sum(e - s for s, e in merged(x for runs in found.values() for x in runs))
    return {"doc_id": doc_id, "n_words": n, "n_hit": covered, "items": sorted(found), "runs": [{"item_id": i, "start": s, "stop": e} for s, e, i in sorted((s, e, i) for i, runs in found.items() for s, e in runs)]}


def as_batch(rows: list[dict], id_type):
    import pyarrow as pa

    run = pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
    return pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", id_type), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("runs", pa.list_(run))]))


def find_contamination(docs: DataFrame, bench: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, n_words, n_hit, items, runs) for every row of docs.

    Words are runs of ASCII letters (in lower case), ASCII digits and non-ASCII
    characters. A window is ten consecutive words of an item, or all words of a shorter
    one. `runs` are the stretches of a document's words made of windows of an item,
    `items` the items with any, `n_hit` the words in any run. Windows are compared by
    64-bit hashes.

    A benchmark of up to most_sent characters, which is checked, goes to every task
    whole and documents are read once without a shuffle; beyond, fingerprints and
    windows of both sides are joined, and the texts with hits are read again. Both ways
    give the same rows. Null and empty texts have no words; ids of documents may be of
    any type, null or repeated, and each row is judged by its own text; items without
    an id are left out, equal items all count; an empty benchmark hits nothing; other
    columns are left out; no rows give no rows.
    """
    docs = texts(docs, id_col, text_col)
    bench = bench.select(F.col(item_id).cast("string").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).filter(F.col("item_id").isNotNull()).distinct()
    if (bench.agg(F.sum(F.length("text") + 64)).first()[0] or 0) > most_sent:
        return by_fingerprint(docs, bench)
    sent = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in bench.collect()])

    def run(batches):
        tests, names, ids = Tests([alnum_words(text) for _, text in sent.value]), [item for item, _ in sent.value], WordIds()
        for batch in batches:
            rows = []
            for doc_id, text in as_rows(batch, "doc_id", "text"):
                if len(ids) > 400_000:
                    ids = WordIds()
                words = alnum_words(text)
                found: dict = {}
                for n, runs in tests.runs(words, ids).items():
                    found.setdefault(names[n], []).extend(runs)
                rows.append(row_of(doc_id, len(words), {item: merged(runs) for item, runs in found.items()}))
            yield as_batch(rows, batch.column(0).type)

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {FOUND}")


def hashed_rows(df: DataFrame, key: str, make, more: str) -> DataFrame:
    """The key of each row once for each (place, n, hash) that make(words, ids, rest) gives, rest being what the row has besides."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids = WordIds()
        for batch in batches:
            which, parts = [], [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64))]
            for i, (text, rest) in enumerate(as_rows(batch, "text", more)):
                if len(ids) > 400_000:
                    ids = WordIds()
                for place, n, h in make(alnum_words(text), ids, rest):
                    parts.append((place, np.full(len(h), n, np.int32), h))
                    which.append(np.full(len(h), i))
            place, n, h = (np.concatenate(x) for x in zip(*parts))
            keys = batch.column(0).take(pa.array(np.concatenate(which) if which else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(place, pa.int64()), pa.array(n, pa.int32()), pa.array(h.view(np.int64))], [key, "place", "n", "hash"])

    return df.select(key, "text", more).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, place bigint, n int, hash bigint")


def by_fingerprint(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """find_contamination for benchmarks of any size: rows are known by id and hash of the text, and read again where fingerprints meet."""
    import numpy as np

    nothing = F.lit(None).cast("array<bigint>")
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("row"), "text")

    def of_item(words, ids, _):
        if words:
            n, windows, prints = windows_of(words, ids)
            yield np.zeros(len(windows), np.int64), n, windows
            yield np.zeros(len(prints), np.int64), 0, prints

    def of_document(words, ids, _):
        grams = gram_hashes(ids.at(words), sorted({K, *lengths})) if words else {}
        if len(words) >= WINDOW:
            places = winnowed(grams[K])
            yield places, 0, grams[K][places]
        for n in lengths if words else ():
            yield np.arange(len(grams[n])), n, grams[n]

    def of_hits(words, ids, places):
        starts = around(np.array(places), len(words))
        yield starts, WINDOW, gram_hashes(ids.at(words), [WINDOW])[WINDOW][starts]

    tests = hashed_rows(bench.withColumn("rest", nothing), "item_id", of_item, "rest").drop("place").distinct()
    lengths = sorted(r.n for r in tests.select("n").distinct().collect() if 0 < r.n < WINDOW)
    wanted = tests.select("n", "hash").distinct()
    met = hashed_rows(keyed.withColumn("rest", nothing), "row", of_document, "rest").join(wanted, ["n", "hash"]).distinct()
    hits = met.filter("n = 0").groupBy("row").agg(F.collect_set("place").alias("hits"))
    long = hashed_rows(keyed.dropDuplicates(["row"]).join(hits, "row"), "row", of_hits, "hits").join(wanted, ["n", "hash"])
    windows = met.filter("n > 0").unionByName(long).join(tests, ["n", "hash"]).groupBy("row", "item_id").agg(F.collect_set(F.struct("place", F.col("n").cast("bigint").alias("n"))).alias("at"))
    per = windows.groupBy(F.col("row").alias("r")).agg(F.collect_list(F.struct("item_id", "at")).alias("found"))

    def count(batches):
        for batch in batches:
            rows = [row_of(doc_id, len(alnum_words(text)), {x["item_id"]: merged((w["place"], w["place"] + w["n"]) for w in x["at"]) for x in found or ()}) for doc_id, text, found in as_rows(batch, "doc_id", "text", "found")]
            yield as_batch(rows, batch.column(0).type)

    return keyed.join(per, F.col("row") == F.col("r"), "left").select("row.doc_id", "text", "found").mapInArrow(count, f"doc_id {dict(docs.dtypes)['doc_id']}, {FOUND}")


def op5_benchmark_decontamination(spark, sf_dir) -> DataFrame:
    """What every document holds of the benchmark."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
i AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(words[q + 1 : q + n], ' ') AS g FROM (SELECT item_id, words, least({WINDOW}, len(words)) AS n, unnest(range(len(words) - least({WINDOW}, len(words)) + 1)) AS q FROM i WHERE len(words) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(words[p + 1 : p + n], ' ') AS g FROM (SELECT doc_id, words, n, unnest(range(len(words) - n + 1)) AS p FROM w, ns WHERE len(words) >= n)),
h AS (SELECT doc_id, item_id, p, dw.n FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS at FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""
