"""LM scoring with a probabilistic suffix tree over words.

Symbols are words and an end. Contexts grow level by level: a context is looked at
only if it, and each of its next symbols, was seen LEAST times or more, an absolute
count, so what is learned grows with the corpus. It is kept as a state if what its next symbols say, against those of the next shorter context, is
worth its parameters (a likelihood-ratio divergence against half the log of the
tokens for each). Next-symbol distributions are discounted; the rest of their mass goes
to the shorter context's distribution over the other symbols, down to add-one word
frequencies. A token is scored in the longest suffix of its history that is a state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, WordIds, as_rows, bucketed, loosened, mixed, packed, squeezed, table, texts, unpacked
from tessera.lineage import checkpointed

#: Least count of a gram; most words of a context; discount of a kept gram's count.
LEAST, DEPTH, DISCOUNT = 4, 2, 0.75
#: Largest model, in bytes, that comes to the driver and goes to every task; of a larger one, runs of documents ask buckets for what they hold.
MOST_SENT = 40_000_000
#: Most bytes of a model for each token that it is learned from: 12 for its word if no other token has it, and 16 for each level's gram, seen LEAST times.
BYTES_A_TOKEN = 20
#: Counts that a task gathers, about.
BUCKET = 500_000
#: Not a word: it has a space.
END = b" end"
TOKENS = 1_000_000


def symbols(text: str) -> list[bytes]:
    """Words between ASCII white space, ASCII letters in lower case."""
    return text.encode().translate(LOWER).split()


class Run:
    """Documents end to end, each with an end before and after, as numbers of distinct words."""

    def __init__(self):
        self.ids, self.parts, self.sizes, self.keys = WordIds(), [], [], []
        self.end, self.tokens = self.ids[END], 0

    def add(self, key, text):
        import numpy as np

        words = symbols(text)
        part = np.empty(len(words) + 2, np.uint32)
        part[0] = part[-1] = self.end
        part[1:-1] = self.ids.numbers(words)
        self.parts.append(part)
        self.sizes.append(len(part))
        self.keys.append(key)
        self.tokens += len(part)

    def full(self, tokens: int = TOKENS) -> bool:
        return self.tokens >= tokens

    def close(self):
        """numbers and, for each, how many stand before it in its document."""
        import numpy as np

        numbers, sizes = np.concatenate(self.parts), np.array(self.sizes)
        self.starts = np.cumsum(sizes) - sizes
        return numbers, np.arange(len(numbers)) - np.repeat(self.starts, sizes)


def runs_of(batches, tokens: int = TOKENS, flags: tuple = ()):
    """Runs of about so many tokens; a key is the id, and what the columns named by flags hold."""
    run = Run()
    for batch in batches:
        for text, key, *more in as_rows(batch, "text", "doc_id", *flags):
            run.add((key, *more) if flags else key, text)
            if run.full(tokens) or len(run.ids) > 500_000:
                yield run
                run = Run()
    if run.parts:
        yield run


def index_in(values, ascending):
    """Places of the values in the ascending array, -1 for those not in it."""
    import numpy as np

    if not len(ascending):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return np.where(ascending[at] == values, at, -1)


def states(words, before, levels, n_words: int):
    """For each level, the gram that ends at each place, or -1: grams of one word first."""
    import numpy as np

    out = [words]
    for k, codes in enumerate(levels):
        grams = np.full(len(words), -1, np.int64)
        ok = np.flatnonzero((out[-1][:-1] >= 0) & (words[1:] >= 0) & (before[1:] > k)) + 1
        grams[ok] = index_in(out[-1][ok - 1] * n_words + words[ok], codes)
        out.append(grams)
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """(hash, n): words and ends of the documents, by 64-bit hash."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part in runs_of(batches, 3 * TOKENS):
            numbers, before = part.close()
            n = np.bincount(numbers[before > 0], minlength=len(part.ids))
            yield pa.RecordBatch.from_arrays([pa.array(part.ids.array().view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

    return docs.mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 0")


def count_grams(docs: DataFrame, sent, contexts: int, buckets: int, least: int) -> DataFrame:
    """(code, n): grams one word longer than those of the last level, both of whose parts are kept, seen least times or more.

    Codes ascend with their contexts, and a bucket is a range of contexts: each run's
    codes go there as packed differences, and are merged.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        frequent, levels = sent.value
        for part in runs_of(batches, 3 * TOKENS):
            numbers, before = part.close()
            words = index_in(part.ids.array(), frequent)[numbers]
            last = states(words, before, levels, len(frequent))[-1]
            ok = np.flatnonzero((last[:-1] >= 0) & (last[1:] >= 0) & (before[1:] > len(levels))) + 1
            codes, n = np.unique(last[ok - 1] * len(frequent) + words[ok], return_counts=True)
            which = codes // len(frequent) * buckets // contexts
            cuts = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(which)]
            rows = [(int(which[i]), packed(codes[i:j].astype(np.uint64)), squeezed(n[i:j].astype(np.int32))) for i, j in zip(cuts, cuts[1:]) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["bucket", "codes", "counts"])

    def merged(group):
        import numpy as np
        import pyarrow as pa

        codes = np.concatenate([unpacked(x) for x in group.column("codes").to_pylist()]).view(np.int64)
        n = np.concatenate([loosened(x, np.int32) for x in group.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        codes, n = codes[first], np.add.reduceat(n, first)
        often = n >= least
        return pa.table({"code": pa.array(codes[often]), "n": pa.array(n[often])})

    return docs.mapInArrow(run, "bucket int, codes binary, counts binary").groupBy("bucket").applyInArrow(merged, "code bigint, n bigint")


def judged(counts, sums, tokens: int):
    """(rest, kept) of contexts with these counts: the log weight of the shorter context for other symbols, and whether they are states."""
    import numpy as np

    n, seen, p, shorter, gain = sums
    rest = np.log(np.maximum(1 - p, 1e-12) / np.maximum(1 - shorter, 1e-12))
    gain = gain + np.maximum(counts - seen, 0) * rest
    return rest, (n > 0) & (gain > n * 0.5 * np.log(max(tokens, 2)))


class Model:
    """The states. levels[k] has the ascending codes of the kept grams of k + 2 words: state of the words before the last, and the last."""

    def __init__(self, tokens: int, distinct: int, frequent, counts):
        import numpy as np

        self.tokens, self.distinct, self.frequent = tokens, distinct, frequent
        self.levels, self.grams, self.kept, self.rest = [], [], [], []
        #: of the last level: counts, log probability in the model, and for each gram the one without its first word
        self.counts, self.log_p, self.shorter = counts, np.log((counts + 1) / (tokens + distinct + 1)), None

    def grow(self, codes, counts) -> None:
        """Adds a level: the grams' contexts are tested, and become states or not."""
        context, word = codes // len(self.frequent), codes % len(self.frequent)
        shorter = word if self.shorter is None else index_in(self.shorter[context] * len(self.frequent) + word, self.levels[-1])
        self.add(codes, counts, context, shorter, *judged(self.counts, self.sums(counts, context, shorter), self.tokens))

    def sums(self, counts, context, shorter):
        """Sums over each context's grams, which can be added up: how many, their counts, probabilities, those in the shorter context, and what is gained."""
        import numpy as np

        parent, p = self.log_p[shorter], (counts - DISCOUNT) / self.counts[context]
        return np.stack([np.bincount(context, x, len(self.counts)) for x in (np.ones(len(counts)), counts, p, np.exp(parent), counts * (np.log(p) - parent))])

    def add(self, codes, counts, context, shorter, rest, kept) -> None:
        """Adds a level whose contexts have been tested."""
        import numpy as np

        p = np.log((counts - DISCOUNT) / self.counts[context])
        self.levels.append(codes)
        self.kept.append(kept)
        self.rest.append(rest)
        self.grams.append(p)
        self.log_p = np.where(kept[context], p, self.log_p[shorter])
        self.counts, self.shorter = counts, shorter

    def score(self, numbers, before, hashes, n_of, grams=None):
        """(base, score, known) of each place: natural logs, and whether training has the word; n_of has counts by number, grams what states() gives."""
        import numpy as np

        base = np.log((n_of + 1) / (self.tokens + self.distinct + 1))[numbers]
        if grams is None:
            grams = states(index_in(hashes, self.frequent)[numbers], before, self.levels, len(self.frequent))
        score = base.copy()
        for k in range(len(self.levels)):
            ok = np.flatnonzero((grams[k][:-1] >= 0) & (before[1:] > k)) + 1
            ok = ok[self.kept[k][grams[k][ok - 1]]]
            gram = grams[k + 1][ok]
            score[ok] = np.where(gram >= 0, self.grams[k][gram] if len(self.grams[k]) else 0, score[ok] + self.rest[k][grams[k][ok - 1]])
        return base, score, (n_of > 0)[numbers]


def learn(docs: DataFrame, counts: DataFrame, least: int = LEAST, depth: int = DEPTH) -> Model:
    """The model of the documents. What comes to the driver are the grams seen least times or more; they grow with the corpus."""
    import numpy as np

    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = total.n or 0, total.v
    buckets = max(64, tokens // (8 * BUCKET))

    def ascending(df: DataFrame, name: str):
        rows = df.filter(F.col("n") >= least).toArrow()
        codes = rows.column(name).to_numpy().astype(np.int64)
        codes = codes.view(np.uint64) if name == "hash" else codes
        order = np.argsort(codes)
        return codes[order], rows.column("n").to_numpy().astype(np.int64)[order]

    model = Model(tokens, distinct, *ascending(counts, "hash"))
    for _ in range(depth):
        if not len(model.counts):
            break
        sent = docs.sparkSession.sparkContext.broadcast((model.frequent, model.levels))
        codes, n = ascending(count_grams(docs, sent, len(model.counts), buckets, least), "code")
        if not len(codes):
            break
        model.grow(codes, n)
    return model


SCHEMA = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def scored(run: Run, model: Model, hashes, counts, id_type):
    """A row for each document of the run; hashes ascend, with their counts."""
    import numpy as np
    import pyarrow as pa

    numbers, before = run.close()
    mine = run.ids.array()
    at = index_in(mine, hashes)
    n_of = np.where(at >= 0, counts[at], 0) if len(counts) else np.zeros(len(mine), np.int64)
    base, score, known = model.score(numbers, before, mine, n_of)
    first = before == 0
    base[first] = score[first] = 0
    total = lambda x: np.add.reduceat(x, run.starts)
    columns = [np.array(run.sizes) - 1, total((known & ~first).astype(np.int64)), total(base) / np.log(10), total(score) / np.log(10)]
    return pa.RecordBatch.from_arrays([pa.array(run.keys, id_type), *map(pa.array, columns)], [x.split()[0] for x in SCHEMA.split(", ")])


def planes(numbers) -> bytes:
    """Numbers of 32 bits, compressed byte by byte."""
    import numpy as np

    return squeezed(np.ascontiguousarray(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T))


def joined_planes(data: bytes):
    import numpy as np

    return np.ascontiguousarray(loosened(data, np.uint8).reshape(4, -1).T).reshape(-1).view(np.uint32).astype(np.int64)


def numbered(rows: DataFrame) -> DataFrame:
    """(run, keys, sizes, learned, asked, hashes, numbers, places, tokens): runs of the rows (doc_id, text, learned, asked), cut into words once; numbers ascend with the words' hashes."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        id_type = None

        def typed():
            nonlocal id_type
            for batch in batches:
                id_type = batch.column(batch.schema.get_field_index("doc_id")).type
                yield batch

        first = TaskContext.get().partitionId() << 32
        for k, part in enumerate(runs_of(typed(), 2 * TOKENS, ("learned", "asked"))):
            numbers, _ = part.close()
            hashes = part.ids.array()
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            keys, learned, asked = zip(*part.keys)
            sizes, learned, asked = np.array(part.sizes, np.int64), np.array(learned, bool), np.array(asked, bool)
            values = [first + k, list(keys), squeezed(sizes), squeezed(learned), squeezed(asked), packed(hashes[order]), planes(rank[numbers]), len(numbers), int((sizes - 1)[learned].sum())]
            kinds = [pa.int64(), pa.list_(id_type), *[pa.binary()] * 5, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], ["run", "keys", "sizes", "learned", "asked", "hashes", "numbers", "places", "tokens"])

    return rows.mapInArrow(run, f"run bigint, keys array<{kind}>, sizes binary, learned binary, asked binary, hashes binary, numbers binary, places bigint, tokens bigint")


class Piece:
    """A run, and the part of the model that its grams have: levels are added as buckets answer."""

    def __init__(self, row):
        import numpy as np

        get = lambda name: row.column(name)[0].as_py()
        self.hashes, self.numbers = unpacked(get("hashes")), joined_planes(get("numbers"))
        self.sizes, self.learned, self.asked = loosened(get("sizes"), np.int64), loosened(get("learned"), bool), loosened(get("asked"), bool)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.before = np.arange(len(self.numbers)) - np.repeat(self.starts, self.sizes)
        self.learns = np.repeat(self.learned, self.sizes)

    def counts(self):
        """How often learned documents have each word."""
        import numpy as np

        return np.bincount(self.numbers[self.learns & (self.before > 0)], minlength=len(self.hashes)).astype(np.int32)

    def know(self, counts, tokens: int, distinct: int, least: int) -> None:
        """counts: of each word, in all learned documents."""
        import numpy as np

        self.n_of, often = counts, counts >= least
        self.model = Model(tokens, distinct, self.hashes[often], counts[often])
        #: of each level, the hashes of its grams, ascending; and for each place the number of the one that ends there
        self.ids, self.grams = [self.model.frequent], [np.where(often, np.cumsum(often) - 1, -1)[self.numbers]]

    def ask(self) -> None:
        """Lists the grams one word longer than those known, both of whose parts are kept: hashes, and counts in learned documents."""
        import numpy as np

        last = self.grams[-1]
        self.at = np.flatnonzero((last[:-1] >= 0) & (last[1:] >= 0) & (self.before[1:] >= len(self.ids))) + 1
        hashes = mixed(self.ids[-1][last[self.at - 1]] * np.uint64(0x9E3779B97F4A7C15) + self.ids[0][self.grams[0][self.at]])
        order = np.argsort(hashes)
        self.asks = hashes[order]
        fresh = np.diff(self.asks, prepend=~self.asks[:1]) != 0
        self.mine = np.empty(len(order), np.int64)
        self.mine[order] = np.cumsum(fresh) - 1
        self.asks, self.one = self.asks[fresh], self.at[order[fresh]]
        self.n = np.bincount(self.mine[self.learns[self.at]], minlength=len(self.asks)).astype(np.int32)

    def told(self, counts, own) -> None:
        """Keeps those of the grams asked for whose counts in all learned documents are not 0; own: whether this run is to sum them up."""
        import numpy as np

        last, often = self.grams[-1], counts > 0
        grams = np.full(len(last), -1, np.int64)
        grams[self.at] = np.where(often, np.cumsum(often) - 1, -1)[self.mine]
        one = self.one[often]
        self.level, self.own = (self.asks[often], counts[often], last[one - 1], last[one]), own[often]
        self.ids.append(self.level[0])
        self.grams.append(grams)

    def sums(self):
        """Sums of each context over the grams that are this run's."""
        return self.model.sums(*(x[self.own] for x in self.level[1:]))

    def judge(self, rest) -> None:
        """Adds the level to the model; rest: of each context, not a number for those that are no states."""
        import numpy as np

        self.model.add(*self.level, rest, ~np.isnan(rest))


#: What buckets are asked, and what they tell a run. Of kind -1: hashes of words and their counts in the run; whole counts. Of kind 2k: grams of k + 2 words and
#: counts; whole counts, 0 below the least, and which of them the run is to sum up. Of kind 2k + 1: their contexts, with a run's sums for those that it has some of; the rest.
ASKED = "kind int, bucket int, run bigint, ids binary, has binary, n binary"
TOLD = "run bigint, kind int, bucket int, told binary, own binary, tokens bigint, distinct bigint"


def as_batch(rows, kind: str):
    """A record batch of the rows, by a schema of bigint, int and binary columns."""
    import pyarrow as pa

    types, rows = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}, list(rows)
    fields = [x.split() for x in kind.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], [name for name, _ in fields])


def asked_words(runs: DataFrame, buckets: int) -> DataFrame:
    """ASKED of the words of every run."""

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                piece, run = Piece(row), row.column("run")[0].as_py()
                n = piece.counts()
                yield as_batch([(-1, b, run, packed(piece.hashes[s:e]), None, squeezed(n[s:e])) for b, s, e in bucketed(piece.hashes, buckets)], ASKED)

    return runs.mapInArrow(ask, ASKED)


def piece_of(group, told, whole, counted: int, judged: int, least: int):
    """The run of a group, with the levels whose counts, and those whose contexts, buckets have told of."""
    import numpy as np

    by = {}
    for kind, _, said, own in sorted(zip(*(told.column(c).to_pylist() for c in ("kind", "bucket", "told", "own"))), key=lambda r: r[:2]):
        by.setdefault(kind, []).append((said, own))
    joined = lambda kind, i, of: np.concatenate([np.zeros(0, of), *(loosened(r[i], of) for r in by.get(kind, ()))])
    piece = Piece(group)
    piece.know(joined(-1, 0, np.int64), *whole, least)
    for k in range(counted):
        piece.ask()
        piece.told(joined(2 * k, 0, np.int64), joined(2 * k, 1, bool))
        if k < judged:
            piece.judge(joined(2 * k + 1, 0, np.float64))
    return piece


def asked_grams(runs: DataFrame, told: DataFrame, whole, step: int, depth: int, buckets: int, least: int) -> DataFrame:
    """ASKED of the grams of this level, and of the contexts of those of the level before, whose counts are told."""

    def ask(group, known):
        import numpy as np
        import pyarrow as pa

        rows = []
        if group.num_rows:
            run, piece = group.column("run")[0].as_py(), piece_of(group, known, whole, step, step - 1, least)
            if step:
                sums = np.concatenate([piece.sums(), piece.model.counts[None]])
                has, ids = sums[0] > 0, piece.ids[step - 1]
                rows += [(2 * step - 1, b, run, packed(ids[s:e]), squeezed(has[s:e]), squeezed(np.ascontiguousarray(sums[:, s:e][:, has[s:e]]))) for b, s, e in bucketed(ids, buckets)]
            if step < depth:
                piece.ask()
                rows += [(2 * step, b, run, packed(piece.asks[s:e]), None, squeezed(piece.n[s:e])) for b, s, e in bucketed(piece.asks, buckets)]
        return pa.Table.from_batches([as_batch(rows, ASKED)])

    return runs.groupBy("run").cogroup(told.groupBy("run")).applyInArrow(ask, ASKED)


def answered(asks: DataFrame, whole, least: int) -> DataFrame:
    """TOLD for what is asked; tokens and distinct of words add up to the whole."""

    def answer(group):
        import numpy as np
        import pyarrow as pa

        kind, bucket = group.column("kind")[0].as_py(), group.column("bucket")[0].as_py()
        parts = [unpacked(x) for x in group.column("ids").to_pylist()]
        cuts = np.cumsum([0, *map(len, parts)])
        ids = np.concatenate(parts)
        order = np.argsort(ids, kind="stable")
        fresh = np.diff(ids[order], prepend=~ids[order[:1]]) != 0
        mine = np.empty(len(ids), np.int64)
        mine[order] = np.cumsum(fresh) - 1
        own, tokens, distinct, size = None, 0, 0, int(fresh.sum())
        if kind > 0 and kind % 2:
            has = np.concatenate([loosened(x, bool) for x in group.column("has").to_pylist()])
            sums = np.concatenate([loosened(x, np.float64).reshape(6, -1) for x in group.column("n").to_pylist()], axis=1)
            of = np.zeros(size)
            of[mine[has]] = sums[5]
            rest, kept = judged(of, np.stack([np.bincount(mine[has], x, size) for x in sums[:5]]), whole[0])
            told = np.where(kept, rest, np.nan)
        else:
            n = np.concatenate([loosened(x, np.int32) for x in group.column("n").to_pylist()])
            told = np.bincount(mine, n, size).astype(np.int64)
            if kind < 0:
                tokens, distinct = int(told.sum()), int((told > 0).sum())
            else:
                told[told < least] = 0
                own = np.zeros(len(ids), bool)
                own[order[fresh]] = True
        told = told[mine]
        rows = [(run, kind, bucket, squeezed(told[s:e]), None if own is None else squeezed(own[s:e]), tokens * (not s), distinct * (not s)) for run, s, e in zip(group.column("run").to_pylist(), cuts, cuts[1:])]
        return pa.Table.from_batches([as_batch(rows, TOLD)])

    return asks.groupBy("kind", "bucket").applyInArrow(answer, TOLD)


class Told:
    """A model that stays in buckets: its tokens and distinct words, and, if anything else of it is asked for, all of it brought to the driver."""

    def __init__(self, tokens: int, distinct: int, whole):
        self.tokens, self.distinct, self.whole = tokens, distinct, whole

    def __getattr__(self, name):
        if name.startswith("__") or "whole" not in self.__dict__:
            raise AttributeError(name)
        self.__dict__.update(self.whole().__dict__)
        return object.__getattribute__(self, name) if name in self.__dict__ else getattr(Model, name).__get__(self)


def score_texts(df: DataFrame, training: DataFrame | Column, id_col="doc_id", text_col="text", least: int = LEAST, depth: int = DEPTH, most_sent: int = MOST_SENT) -> tuple[DataFrame, Model | Told]:
    """(doc_id, n_tokens, n_known, base_score, score) for every row of df, and the model of `training`: rows like those of df, or a condition on them.

    Scores are log10 probabilities of the text's words and its end: base_score by
    add-one word frequencies, score by the model, which adds up to one over all words,
    one unknown word among them. Counts cover all training texts. A model that cannot
    have more than most_sent bytes goes to every task. Of a larger one, only its totals
    come to the driver: texts are cut into words once, runs of documents ask buckets for
    the counts of their words and grams, level by level, and score with what they are told.
    Null and empty texts have one token, the end; repeated rows each count and each
    give a row; without training rows every probability is that of one unknown word;
    other columns are left out; no rows give no rows.
    """
    import numpy as np

    docs = texts(df, id_col, text_col)
    id_kind = dict(docs.dtypes)["doc_id"]
    kind = SCHEMA.replace("doc_id bigint", f"doc_id {id_kind}")
    if isinstance(training, Column):
        rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("learned"), F.lit(True).alias("asked"))
        training = texts(df.filter(training), id_col, text_col)
    else:
        training = texts(training, id_col, text_col)
        rows = docs.withColumns({"learned": F.lit(False), "asked": F.lit(True)}).unionByName(training.select(F.lit(None).cast(id_kind).alias("doc_id"), "text", F.lit(True).alias("learned"), F.lit(False).alias("asked")))
    runs = checkpointed(numbered(rows.select("doc_id", "text", "learned", "asked")))
    size = runs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("places"), F.lit(0)).alias("places")).first()
    sc = df.sparkSession.sparkContext
    if BYTES_A_TOKEN * size.tokens <= most_sent:
        counts = checkpointed(count_words(training))
        model = learn(training, counts, least, depth)
        found = counts.toArrow()
        hashes = found.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        sent = sc.broadcast((model, hashes[order], found.column("n").to_numpy()[order]))
        del found, hashes, order

        def run(batches):
            model, hashes, counts = sent.value
            id_type = None

            def typed():
                nonlocal id_type
                for batch in batches:
                    id_type = batch.column(0).type
                    yield batch

            for part in runs_of(typed()):
                yield scored(part, model, hashes, counts, id_type)

        return docs.mapInArrow(run, kind), model
    buckets = int(max(64, size.places // (4 * BUCKET)))
    told = checkpointed(answered(asked_words(runs, buckets), None, least))
    whole = tuple(told.agg(F.sum("tokens"), F.sum("distinct")).first())
    for step in range(depth + 1 if depth else 0):
        told = told.unionByName(checkpointed(answered(asked_grams(runs, told, whole, step, depth, buckets, least), whole, least)))

    def answer(group, known):
        import pyarrow as pa

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        if not group.num_rows or not loosened(group.column("asked")[0].as_py(), bool).any():
            return pa.table([pa.array([], group.schema.field("keys").type.value_type), *[pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]], names)
        piece = piece_of(group, known, whole, depth, depth, least)
        base, score, known = piece.model.score(piece.numbers, piece.before, piece.hashes, piece.n_of, piece.grams)
        first = piece.before == 0
        base[first] = score[first] = 0
        total = lambda x: np.add.reduceat(x, piece.starts)
        columns = [piece.sizes - 1, total((known & ~first).astype(np.int64)), total(base) / np.log(10), total(score) / np.log(10)]
        keys = group.column("keys").combine_chunks().flatten()
        return pa.table([keys, *map(pa.array, columns)], names).filter(pa.array(piece.asked))

    found = runs.groupBy("run").cogroup(told.groupBy("run")).applyInArrow(answer, kind)
    return found, Told(*whole, lambda: learn(training, checkpointed(count_words(training)), least, depth))


def op8_lm_scoring(spark, sf_dir) -> DataFrame:
    """Scores of every document, learned from those whose crc32 leaves another remainder than 2 by 7."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    found, model = score_texts(docs, ~held)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
