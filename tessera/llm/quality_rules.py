"""Quality rules: thresholds that follow each language and source, from mergeable quantile sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_rows
from tessera.lineage import checkpointed

SYMBOLS = "#*$%&|<>"
#: Fixed rules: least words, most words in repeated windows, in a hundred, and words in a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A ratio with an adaptive threshold: numerator, denominator, and the least that one event adds to the numerator (two windows are the least that repeats).
RATIOS = {"symbols": ("n_symbols", "word_chars", 1), "dup_lines": ("n_dup_lines", "n_lines", 1), "repeats": ("n_repeat_words", "n_words", 2 * WINDOW), "word_length": ("word_chars", "n_words", 1)}
SIZES = ("word_chars", "n_lines", "n_words")
#: Widths of a ratio's spread that its threshold lies above the median; rows of the group around it that a group's own quantiles are mixed with.
SPREAD, PRIOR = 4.0, 50


def counts_of(text: str, window: int = WINDOW) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of a text; words lie between ASCII white space."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    repeated = 0
    if n > window:
        grams = list(zip(*(words[i:] for i in range(window))))
        if len(set(grams)) < len(grams):
            seen: dict = {}
            for g in grams:
                seen[g] = seen.get(g, 0) + 1
            end = 0
            for i, g in enumerate(grams):
                if seen[g] > 1:
                    repeated += i + window - max(i, end)
                    end = i + window
    return n, chars, sum(map(raw.count, map(str.encode, SYMBOLS))), len(lines) - len(set(lines)), repeated, len(lines)


def text_counts(df: DataFrame, id_col="doc_id", text_col="text", by=("lang", "source")) -> DataFrame:
    """The id, the columns of `by` and the counts of each text; nulls count as empty texts and as a group of their own."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [counts_of(t) for (t,) in as_rows(batch, "text")]
            more = zip(*rows) if rows else [[]] * 6
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = [*batch.schema.names[:-1], *COUNTS, "n_lines"]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(list(c), pa.int64()) for c in more)], names)

    groups = [f"by_{i}" for i in range(len(by))]
    src = df.select(F.col(id_col).alias("doc_id"), *(F.col(c).cast("string").alias(g) for c, g in zip(by, groups)), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = ", ".join(f"{n} {t}" for n, t in [(f.name, f.dataType.simpleString()) for f in src.schema.fields[:-1]] + [(c, "bigint") for c in (*COUNTS, "n_lines")])
    return src.mapInArrow(run, kinds)


def shrunk(counted: DataFrame, groups: list[str], accuracy: int) -> DataFrame:
    """The quantiles of each group, mixed with those of the group around it: all rows, then one column of `groups` more at a time.

    One pass makes the sketches of all levels; a level has a row a group.
    """
    of = {f"m_{k}": F.percentile_approx(k, 0.5, accuracy) for k in (*RATIOS, *SIZES)} | {f"h_{k}": F.percentile_approx(k, 0.9, accuracy) for k in RATIOS}
    rolled = checkpointed(counted.rollup(*groups).agg(*(q.alias(k) for k, q in of.items()), F.count("*").alias("n"), F.grouping_id().alias("level")))
    at = lambda depth: rolled.filter(F.col("level") == 2 ** (len(groups) - depth) - 1)
    around = at(0).select(*of)
    for depth in range(1, len(groups) + 1):
        own, outer = groups[:depth], groups[: depth - 1]
        up = around.select(*(F.col(g).alias(f"up_{g}") for g in outer), *(F.col(k).alias(f"up_{k}") for k in of))
        same = F.lit(True)
        for g in outer:
            same = same & F.col(g).eqNullSafe(F.col(f"up_{g}"))
        around = at(depth).join(up, same).select(*own, *(((F.col("n") * F.col(k) + PRIOR * F.col(f"up_{k}")) / (F.col("n") + PRIOR)).alias(k) for k in of))
    return around


def apply_rules(df: DataFrame, id_col="doc_id", text_col="text", by=("lang", "source"), spread: float = SPREAD, accuracy: int = 10_000) -> DataFrame:
    """(doc_id, counts, base_failed, kept, threshold and value of each ratio) for every row.

    A document fails if it has too few words or too many in repeated windows, or if a
    ratio of its counts lies above its group's threshold: the median plus `spread`
    times the ratio's width there, which is the distance from the median to the ninth
    decile, or what one event makes in a document of the median size if that is more.
    No threshold is fixed: all these numbers are quantiles of the group, from sketches
    that each task makes and that are merged by group, over the rows that pass the
    fixed rules. Small groups lean on the group around them: a group's quantiles are
    mixed with those of its first columns alone, and these with those of all rows, as
    if the larger group had PRIOR rows. A group is one combination of the values of
    `by`, null being a value.

    The texts are read once: their counts, a few numbers a row, are written to the
    shared folder. A hot group only adds sketches, one a task. Empty and null texts
    have no words and fail; repeated rows each count and each give a row; a group
    without a row that passes the fixed rules has no thresholds and needs none; no
    rows give no rows; other columns are left out.
    """
    counted = checkpointed(text_counts(df, id_col, text_col, by))
    groups = [c for c in counted.columns if c.startswith("by_")]
    counted = counted.withColumns({k: F.col(a) / F.greatest(F.col(b), F.lit(1)) for k, (a, b, _) in RATIOS.items()}).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    quantiles = shrunk(counted.filter(~F.col("base_failed")), groups, accuracy)
    width = lambda k, size, unit: F.greatest(F.col(f"h_{k}") - F.col(f"m_{k}"), unit / F.greatest(F.col(f"m_{size}"), F.lit(1.0)))
    limits = quantiles.select(*(F.col(g).alias(f"t_{g}") for g in groups), *((F.col(f"m_{k}") + spread * width(k, size, F.lit(float(unit)))).alias(f"max_{k}") for k, (_, size, unit) in RATIOS.items()))
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"t_{g}"))
    joined = counted.join(limits, same, "left")
    fits = F.lit(True)
    for k in RATIOS:
        fits = fits & F.coalesce(F.col(k) <= F.col(f"max_{k}"), F.lit(True))
    return joined.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & fits).alias("kept"), *RATIOS, *(f"max_{k}" for k in RATIOS))


def op6_quality_rules(spark, sf_dir) -> DataFrame:
    """Counts and verdict of every document."""
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_RATIOS = ", ".join(f"{a} / greatest({b}, 1) AS {k}" for k, (a, b, _) in RATIOS.items())
_OF = {f"m_{k}": f"quantile_disc({k}, 0.5)" for k in (*RATIOS, *SIZES)} | {f"h_{k}": f"quantile_disc({k}, 0.9)" for k in RATIOS}
_QUANTILES = ", ".join(f"{q} AS {k}" for k, q in _OF.items())
_MIXED = ", ".join(f"(a.n * a.{k} + {PRIOR} * b.{k}) / (a.n + {PRIOR}) AS {k}" for k in _OF)
_LIMITS = ", ".join(f"m_{k} + {SPREAD} * greatest(h_{k} - m_{k}, {unit} / greatest(m_{size}, 1.0)) AS max_{k}" for k, (_, size, unit) in RATIOS.items())
#: Exact quantiles: the sketches are exact as long as a group has fewer rows than their accuracy.
ORACLE = f"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS k FROM (SELECT doc_id, p, array_to_string(words[p + 1 : p + {WINDOW}], ' ') AS g FROM (SELECT doc_id, words, unnest(range(len(words) - {WINDOW} + 1)) AS p FROM w WHERE len(words) >= {WINDOW}))),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) FROM g WHERE k > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
c AS (SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {_RATIOS} FROM c),
q0 AS (SELECT {_QUANTILES} FROM f WHERE NOT base_failed),
q1 AS (SELECT a.lang, {_MIXED} FROM (SELECT lang, count(*) AS n, {_QUANTILES} FROM f WHERE NOT base_failed GROUP BY lang) AS a, q0 AS b),
q2 AS (SELECT a.lang, a.source, {_MIXED} FROM (SELECT lang, source, count(*) AS n, {_QUANTILES} FROM f WHERE NOT base_failed GROUP BY lang, source) AS a JOIN q1 AS b ON a.lang IS NOT DISTINCT FROM b.lang),
q AS (SELECT lang, source, {_LIMITS} FROM q2)
SELECT doc_id, {', '.join(COUNTS)}, base_failed, NOT base_failed AND {' AND '.join(f'coalesce({k} <= max_{k}, true)' for k in RATIOS)} AS kept, {', '.join(RATIOS)}, {', '.join(f'max_{k}' for k in RATIOS)}
FROM f LEFT JOIN q ON f.lang IS NOT DISTINCT FROM q.lang AND f.source IS NOT DISTINCT FROM q.source"""
