"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is good or bad. Its features are its own shape and that of the lines before
and after it; neighbouring labels attract or repel by learned weights. Training takes
the document's label for each of its lines. A document's quality is the mean of its
lines' marginal probabilities of being good, by forward and backward sums, weighted by
length, and mapped to the share of good documents among those that look like it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_rows, table, texts

#: The bounded sample of labelled documents that the model is fitted on, and the most lines in it.
MOST_DOCS, MOST_LINES = 4000, 200_000
#: Character classes of a line whose shares are features.
UPPER, LOWER, DIGIT, SPACE, STOP, SYMBOL, OTHER_MARK, HIGH = range(8)
SHAPES = 20
THRESHOLD = 0.3


def classes():
    """Class of each code point below 256; those above count as letters of their own class."""
    import numpy as np

    of = np.full(256, OTHER_MARK, np.uint8)
    for c in range(256):
        s = chr(c)
        of[c] = UPPER if s.isupper() else LOWER if s.isalpha() else DIGIT if s.isdigit() else SPACE if s.isspace() or c < 32 else STOP if s in ".,;:'\"()-?" else SYMBOL if s in "#*$%&|<>@^~=+_/\\{}[]" else OTHER_MARK
    return of


def shapes(texts: list[str], of):
    """(features of all lines of the texts, lines of each text, lengths of lines): a text has one line at least."""
    import numpy as np

    lines, counts, words, fresh, ending, again, twin = [], [], [], [], [], [], []
    for text in texts:
        own = text.split("\n")
        counts.append(len(own))
        lines += own
        seen = set()
        for line in own:
            w = line.split()
            words.append(len(w))
            fresh.append(len(set(w)))
            again.append(line in seen)
            seen.add(line)
    joined = np.frombuffer("\n".join(lines).encode("utf-32-le"), np.uint32)
    kind = np.where(joined < 256, of[np.minimum(joined, 255)], HIGH).astype(np.uint8)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.cumsum(sizes + 1) - sizes - 1
    share = np.zeros((len(lines), 8))
    for k in range(8):
        sums = np.concatenate([[0], np.cumsum(kind == k)])
        share[:, k] = sums[starts + sizes] - sums[starts]
    length = np.maximum(sizes, 1)
    share /= length[:, None]
    words, fresh = np.array(words, float), np.array(fresh, float)
    some = np.maximum(words, 1)
    x = np.empty((len(lines), SHAPES))
    x[:, :8] = share
    x[:, 8] = np.log1p(sizes) / 6
    x[:, 9] = np.log1p(words) / 5
    x[:, 10] = np.minimum(sizes / some, 30) / 10
    x[:, 11] = fresh / some
    x[:, 12] = (fresh / some < 0.5) & (words >= 6)
    x[:, 13] = again
    x[:, 14] = share[:, UPPER] > 0.5
    x[:, 15] = share[:, SYMBOL] > 0.08
    x[:, 16] = share[:, OTHER_MARK] > 0.08
    x[:, 17] = sizes == 0
    x[:, 18] = share[:, DIGIT] > 0.2
    x[:, 19] = 1
    return x, np.array(counts, np.int64), sizes


def with_neighbours(x, counts):
    """Features of each line, of the line before and of the line after, zeros beyond the ends."""
    import numpy as np

    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    starts = np.cumsum(counts) - counts
    before[starts] = 0
    after[starts + counts - 1] = 0
    return np.hstack([x, before, after])


def sums(emit, moves, counts):
    """Forward and backward log sums of all documents at once: (marginal log odds' parts) alpha, beta and log Z.

    emit has a row of two scores a line; moves[i, j] is that of label j after i.
    Documents are taken in order of their length, so each step works on those that
    still have lines.
    """
    import numpy as np

    n, starts = len(counts), np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    begin, size = starts[order], counts[order]
    longest = int(size[0]) if n else 0
    alive = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    if n:
        alpha[begin] = emit[begin]
    for t in range(1, longest):
        at = begin[: alive[t]] + t
        a = alpha[at - 1]
        alpha[at] = emit[at] + np.logaddexp(a[:, :1] + moves[0], a[:, 1:] + moves[1])
    for t in range(longest - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        b = emit[at + 1] + beta[at + 1]
        beta[at, 0] = np.logaddexp(b[:, 0] + moves[0, 0], b[:, 1] + moves[0, 1])
        beta[at, 1] = np.logaddexp(b[:, 0] + moves[1, 0], b[:, 1] + moves[1, 1])
    z = np.logaddexp(*alpha[starts + counts - 1].T) if n else np.zeros(0)
    return alpha, beta, z


def good_lines(weights, moves, x, counts):
    """Marginal probability of each line of being good."""
    import numpy as np

    emit = np.zeros((len(x), 2))
    emit[:, 1] = x @ weights
    alpha, beta, _ = sums(emit, moves, counts)
    d = alpha + beta
    return 1 / (1 + np.exp(np.clip(d[:, 0] - d[:, 1], -500, 500)))


def fit(x, counts, labels, steps: int = 150, rate: float = 0.1, ridge: float = 1e-3):
    """(weights, moves) of greatest likelihood of the lines' labels, less a ridge, by Adam from zero; classes weigh alike."""
    import numpy as np

    y = np.repeat(labels, counts)
    good = max(labels.mean(), 1e-9)
    each = np.where(labels == 1, 0.5 / good, 0.5 / max(1 - good, 1e-9)) / len(labels) / counts
    weight = np.repeat(each, counts)
    inside = np.ones(len(y), bool)
    inside[np.cumsum(counts) - counts] = False
    pairs = np.flatnonzero(inside)
    p = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, moves = p[:-4], p[-4:].reshape(2, 2)
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ w
        alpha, beta, z = sums(emit, moves, counts)
        zs = np.repeat(z, counts)
        prob = np.exp(np.clip(alpha[:, 1] + beta[:, 1] - zs, -500, 0))
        g = np.empty_like(p)
        g[:-4] = x.T @ ((y - prob) * weight)
        for i in range(2):
            for j in range(2):
                both = np.exp(np.clip(alpha[pairs - 1, i] + moves[i, j] + emit[pairs, j] + beta[pairs, j] - zs[pairs], -500, 0))
                seen = (y[pairs - 1] == i) & (y[pairs] == j)
                g[len(p) - 4 + 2 * i + j] = ((seen - both) * weight[pairs]).sum()
        g -= ridge * p
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:-4], p[-4:].reshape(2, 2)


def calibrated(raw, labels, steps: int = 400):
    """(slope, offset) that map the log odds of raw scores to those of label 1, by logistic regression on standardised odds."""
    import numpy as np

    s = odds(raw)
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -500, 500)))
        r = p * (1 - p) + 1e-6
        g = np.array([((labels - p) * s).sum() - 0.01 * a, (labels - p).sum()])
        h = np.array([[(r * s * s).sum() + 0.01, (r * s).sum()], [(r * s).sum(), r.sum()]])
        d = np.linalg.solve(h, g)
        a, b = a + np.clip(d[0], -1, 1), b + np.clip(d[1], -1, 1)
        if abs(d).max() < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def odds(p):
    import numpy as np

    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def document_means(good, counts, sizes):
    """Mean of the lines' probabilities by length; a line weighs one more than its characters, so that empty texts have a score."""
    import numpy as np

    starts = np.cumsum(counts) - counts
    weight = sizes + 1.0
    return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)


def sample_of(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """At most `most` labelled ids, those with the lowest hash; an id with several labels counts with the least."""
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


class Classifier:
    """weights, moves, slope and offset, all of a few dozen numbers."""

    def __init__(self, weights, moves, slope, offset):
        self.weights, self.moves, self.slope, self.offset = weights, moves, slope, offset

    def scores(self, texts: list[str], of):
        import numpy as np

        x, counts, sizes = shapes(texts, of)
        raw = document_means(good_lines(self.weights, self.moves, with_neighbours(x, counts), counts), counts, sizes)
        return raw, 1 / (1 + np.exp(-np.clip(self.slope * odds(raw) + self.offset, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", most_docs: int = MOST_DOCS, most_lines: int = MOST_LINES) -> Classifier:
    """The classifier of a sample of the labelled documents.

    The sample has at most most_docs documents, those whose ids have the lowest
    hashes, and of these, in that order, as many as have most_lines lines in all; their
    lines are counted first, so what comes to the driver is bounded by most_lines.
    Documents of more lines than that are never in the sample. Without labels of both
    kinds the classifier gives every document the share of label 1 (one half without
    any).
    """
    import numpy as np

    chosen = F.broadcast(sample_of(labels, id_col, label_col, most_docs))
    found = texts(docs, id_col, text_col).join(chosen, "doc_id").select("doc_id", "label", "text")
    sizes = found.select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("n")).filter(F.col("n") <= most_lines).groupBy("doc_id").agg(F.sum("n").alias("n"))
    total, within = 0, []
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        total += r.n
        if total > most_lines and len(within) >= 2:
            break
        within.append(r.doc_id)
    found = found.filter(F.col("doc_id").isin(within) if within else F.lit(False))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        of = classes()
        for batch in batches:
            out = []
            for doc, label, text in as_rows(batch, "doc_id", "label", "text"):
                x, counts, sizes = shapes([text], of)
                if counts[0] <= most_lines:
                    out.append((doc, label, x.astype(np.float32).tobytes(), sizes.tobytes()))
            kinds = (batch.column(0).type, pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds)], ["doc_id", "label", "x", "sizes"])

    rows = found.mapInArrow(run, f"doc_id {dict(found.dtypes)['doc_id']}, label int, x binary, sizes binary").collect()
    rows = sorted(rows, key=lambda r: r.doc_id)
    y = np.array([r.label for r in rows], float)
    rest = float(y.mean()) if len(y) else 0.5
    width = 3 * SHAPES
    if not 0 < y.sum() < len(y):
        return Classifier(np.zeros(width), np.zeros((2, 2)), 1e-3, float(odds(np.array(rest))))
    parts = [np.frombuffer(r.x, np.float32).reshape(-1, SHAPES) for r in rows]
    sizes = np.concatenate([np.frombuffer(r.sizes, np.int64) for r in rows])
    counts = np.array([len(p) for p in parts])
    x = with_neighbours(np.concatenate(parts).astype(float), counts)
    weights, moves = fit(x, counts, y)
    raw = document_means(good_lines(weights, moves, x, counts), counts, sizes)
    return Classifier(weights, moves, *calibrated(raw, y))


def score_quality(df: DataFrame, model: Classifier, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, line_quality, score) for every row: the mean marginal of its lines, and the probability of label 1.

    One pass over whole texts without a shuffle. Null and empty texts have one empty
    line; repeated rows each give a row; other columns play no part and are left out;
    no rows give no rows.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        of = classes()
        for batch in batches:
            ids, held, size = [], [], 0
            for doc, text in as_rows(batch, "doc_id", "text"):
                ids.append(doc)
                held.append(text)
                size += len(text)
                if size > 1_000_000:
                    yield rows(ids, held, of, batch.column(0).type)
                    ids, held, size = [], [], 0
            if ids:
                yield rows(ids, held, of, batch.column(0).type)

    def rows(ids, held, of, kind):
        import pyarrow as pa

        raw, score = model.scores(held, of)
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(raw), pa.array(score)], ["doc_id", "line_quality", "score"])

    docs = texts(df, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, line_quality double, score double")


def keep_good(df: DataFrame, model: Classifier, text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, as they are, whose texts score `threshold` or more; a null text scores as an empty one."""
    at = df.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        of = classes()
        for batch in batches:
            held, start, size, lengths = [], 0, 0, batch.column(at).to_pylist()
            for i, text in enumerate(lengths):
                held.append(text or "")
                size += len(held[-1])
                if size > 1_000_000 or i + 1 == len(lengths):
                    keep = model.scores(held, of)[1] >= threshold
                    yield batch.slice(start, len(held)).filter(pa.array(keep))
                    held, start, size = [], i + 1, 0

    return df.mapInArrow(run, df.schema)


def held_out(column) -> F.col:
    """Whether a fifth of all ids, by crc32 of their text, holds this one."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def quality_model(spark, sf_dir, docs: DataFrame) -> Classifier:
    """The classifier by `labels.quality` of the documents that are not held out."""
    labels = table(spark, sf_dir, "labels")
    return train(docs, labels.filter(~held_out(F.col("doc_id"))))


def op4_quality_classifier(spark, sf_dir) -> DataFrame:
    """The score of every document."""
    docs = table(spark, sf_dir, "documents")
    found = score_quality(docs, quality_model(spark, sf_dir, docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "line_quality")
