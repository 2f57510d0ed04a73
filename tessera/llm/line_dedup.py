"""Line dedup: maximal repeated runs of lines, from the suffixes of the sequences of line ids of all documents.

A line's id is a hash of its text. The suffixes are grouped by prefix doubling, as in the
making of a suffix array: at each level the name of a run of 2^k lines is the first place
that it stands at, in the order of documents and lines, so equal prefixes have equal
names, and the name of twice the length follows from those of its halves. Names that
stand at one place leave; the doubling ends when none stay.

Then, from the longest level down, each suffix's longest common prefix with an earlier
suffix is found bit by bit. All suffixes with a prefix of one length in common are one
interval; an interval is split by the names of the lines that follow, 2^j of them, and
the first place of each part tells whether the longer run also starts earlier. So every
maximal run that repeats something before it is found with its whole length and the place
of its first copy. All on DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import joined_by, table, texts, unused
from tessera.lineage import MOST_IN_ONE, checkpointed, in_one, rows_of

#: Least words of a run whose later copies go: shorter ones, such as blank lines and headings, recur by nature.
LEAST_WORDS = 10


def words_in(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^ \t\x0b\x0c\r]+"))


def place() -> Column:
    return F.struct("key", "pos")


def named(runs: DataFrame, by: list[str], bare: DataFrame | None = None, small: bool = False) -> DataFrame:
    """(key, pos, words, name) of the runs that are not alone with their values of `by`; the name is the first place of them. bare: the same rows, if they can be had with less work without their words."""
    first = (runs if bare is None else bare).groupBy(*by).agg(F.min(place()).alias("head"), F.max(place()).alias("last")).filter("head < last").drop("last")
    return joined_by(runs.select("key", "pos", "words", *by), first, by, small=small).select("key", "pos", "words", F.col("head").alias("name"))


def levels_of(lines: DataFrame, bare: DataFrame, most_in_one: int = MOST_IN_ONE) -> list[tuple[DataFrame, bool]]:
    """The names of the runs of 1, 2, 4, ... lines that stand at two places or more, and whether they are few; lines has key, pos, id and words, bare has no words."""
    levels, length = [], 1
    made = checkpointed(named(lines, ["id"], bare).repartition("key").dropDuplicates(["key", "pos"]))
    while n := rows_of(made):
        small = n <= most_in_one
        levels.append((in_one(made, small), small))
        ahead = Window.partitionBy("key").orderBy("pos").rangeBetween(length, length)
        doubled = levels[-1][0].withColumns({"next": F.min("name").over(ahead), "more": F.min("words").over(ahead)}).filter(F.col("next").isNotNull())
        made = checkpointed(named(doubled.select("key", "pos", (F.col("words") + F.col("more")).alias("words"), "name", "next"), ["name", "next"], small=small))
        length *= 2
    return levels


def longer(runs: DataFrame, level: DataFrame, length: int, small: bool) -> DataFrame:
    """The runs (key, pos, n, words, first), each with `length` more lines if it starts earlier with them too."""
    heads = runs.select("n", "first").distinct().select("first.key", "first.pos", "n", F.lit(0).cast("bigint").alias("words"), "first", F.lit(True).alias("head"))
    asked = in_one(runs.withColumn("head", F.lit(False)).unionByName(heads), small).withColumn("at", F.col("pos") + F.col("n"))
    then = joined_by(asked, level.select("key", F.col("pos").alias("at"), F.col("name").alias("follows"), F.col("words").alias("more")), ["key", "at"], "left", small)
    best = then.filter("follows IS NOT NULL").groupBy("n", "first", "follows").agg(F.min(place()).alias("best"))
    found = joined_by(then.filter("NOT head"), best, ["n", "first", "follows"], "left", small).withColumn("up", F.coalesce(F.col("best") < place(), F.lit(False)))
    return found.select("key", "pos", F.when(F.col("up"), F.col("n") + length).otherwise(F.col("n")).alias("n"), F.when(F.col("up"), F.col("words") + F.col("more")).otherwise(F.col("words")).alias("words"), F.when(F.col("up"), F.col("best")).otherwise(F.col("first")).alias("first"))


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS, most_in_one: int = MOST_IN_ONE) -> DataFrame:
    """(key, pos, n, words, first): at each place of docs (key, text), the longest run of lines that also starts earlier, at `first`, if it has least_words words."""
    own = lambda x: F.unhex(F.md5(x))
    line = F.transform(F.split("text", "\n"), lambda x: F.struct(own(x).alias("id"), words_in(x).cast("long").alias("words")))
    lines = docs.select("key", F.posexplode(line).alias("pos", "x")).select("key", F.col("pos").cast("long").alias("pos"), "x.id", "x.words")
    bare = docs.select("key", F.posexplode(F.transform(F.split("text", "\n"), own)).alias("pos", "id")).withColumn("pos", F.col("pos").cast("long"))
    levels, runs = levels_of(lines, bare, most_in_one), None
    for k in range(len(levels) - 1, -1, -1):
        level, small = levels[k]
        later = level.filter(F.col("name") < place())
        if k + 1 < len(levels):
            longer_ones = levels[k + 1][0].filter(F.col("name") < place()).select(place().alias("known"))
            later = later.withColumn("place", place()).join(F.broadcast(longer_ones) if levels[k + 1][1] else longer_ones, F.col("place") == F.col("known"), "left_anti").drop("place")
        these = later.select("key", "pos", F.lit(1 << k).cast("bigint").alias("n"), "words", F.col("name").alias("first"))
        runs = these if runs is None else in_one(longer(in_one(runs, small), level, 1 << k, small).unionByName(these), small)
        runs = checkpointed(runs) if k else runs
    if runs is None:
        return lines.filter("false").select("key", "pos", F.lit(0).cast("bigint").alias("n"), "words", place().alias("first"))
    return runs.filter(F.col("words") >= least_words)


def removed_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, runs): the stretches (start, stop) of line numbers that go, ascending and apart, for documents that lose any."""
    before = Window.partitionBy("key").orderBy("pos", "n").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("key").orderBy("pos", "n").rowsBetween(Window.unboundedPreceding, 0)
    runs = repeated_runs(docs, least_words).select("key", "pos", "n").withColumn("reached", F.max(F.col("pos") + F.col("n")).over(before))
    parts = runs.withColumn("part", F.sum(F.when(F.col("reached") >= F.col("pos"), 0).otherwise(1)).over(upto))
    parts = parts.groupBy("key", "part").agg(F.min("pos").cast("int").alias("start"), F.max(F.col("pos") + F.col("n")).cast("int").alias("stop"))
    return parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def kept_text(text: Column, runs: Column) -> Column:
    """The text without the lines in the stretches."""
    lines = F.split(text, "\n")
    stay = F.zip_with(F.concat(F.array(F.lit(0)), runs["stop"]), F.concat(runs["start"], F.array(F.size(lines))), lambda a, b: F.slice(lines, a + 1, b - a))
    return F.when(F.size(runs) > 0, F.array_join(F.flatten(stay), "\n")).otherwise(text)


def numbers(runs: Column) -> Column:
    """The line numbers in the stretches."""
    return F.flatten(F.transform(runs, lambda r: F.sequence(r["start"], r["stop"] - 1)))


def row_key(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))


def drop_repeated_lines(df: DataFrame, id_col="doc_id", text_col="text", least_words: int = LEAST_WORDS) -> DataFrame:
    """df with the later copies of repeated runs of lines cut from its texts, and one more column, `removed_lines`.

    Lines lie between newlines. A run of lines of any length, with at least least_words
    words in all, goes where an equal run starts earlier: in a document with a lower id
    (of equal ids, with the lower hash of its text), or further up; the two may overlap.
    The first copy of a run stays. `removed_lines` has the numbers of the lines that
    went, from 0. A text without any left is empty; null texts stay null and empty ones
    empty. A null id comes before all others; rows with one id and one text are one
    document, and lose nothing to each other; no rows give no rows. A column of df that
    is called removed_lines is replaced.
    """
    key, mine, runs = unused(df, "row_key"), unused(df, "own_key"), unused(df, "lost_runs")
    removed = removed_lines(df.select(row_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), least_words)
    found = df.withColumn(mine, row_key(id_col, text_col)).join(removed.select(F.col("key").alias(key), F.col("runs").alias(runs)), F.col(mine) == F.col(key), "left")
    gone = F.coalesce(F.col(runs), F.array().cast("array<struct<start:int,stop:int>>"))
    return found.withColumns({text_col: F.when(F.col(runs).isNull(), F.col(text_col)).otherwise(kept_text(F.col(text_col), gone)), "removed_lines": numbers(gone)}).drop(key, mine, runs)


def op9_line_dedup(spark, sf_dir) -> DataFrame:
    """What every document loses and keeps."""
    docs = texts(table(spark, sf_dir, "documents")).withColumn("key", row_key("doc_id", "text"))
    removed = removed_lines(docs.select("key", "text")).withColumnRenamed("key", "k")
    found = docs.join(removed, F.col("key") == F.col("k"), "left").withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<start:int,stop:int>>")))
    return found.select(
        "doc_id",
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.size(numbers(F.col("runs"))).cast("long").alias("n_removed"),
        F.array_join(numbers(F.col("runs")), ",").alias("removed_lines"),
        F.sha2(kept_text(F.col("text"), F.col("runs")), 256).alias("kept_sha256"),
    )


#: Every line of a run with enough words lies in a shortest one that has enough, counted from its first line or from its last, and that is in the run; so
#: the lines that go are those of shortest runs, one from each line on and one up to each line, that also start earlier.
ORACLE = f"""WITH lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, l, list_transform(l, lambda s: len(list_filter(string_split_regex(s, '[ \t\x0b\x0c\r]+'), lambda x: x <> ''))) AS n FROM lines),
places AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line, unnest(n) AS n FROM w),
total AS (SELECT *, upto - n AS before FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM places)),
stops AS (SELECT doc_id, upto, min(pos) AS e FROM total GROUP BY doc_id, upto),
starts AS (SELECT doc_id, before, max(pos) AS s FROM total GROUP BY doc_id, before),
ends AS (SELECT t.doc_id, t.pos AS s, x.e FROM total AS t ASOF JOIN stops AS x ON t.doc_id = x.doc_id AND t.before + {LEAST_WORDS} <= x.upto
UNION SELECT t.doc_id, x.s, t.pos AS e FROM total AS t ASOF JOIN starts AS x ON t.doc_id = x.doc_id AND t.upto - {LEAST_WORDS} >= x.before),
runs AS (SELECT doc_id, s, e, md5(array_to_string(l[s + 1 : e + 1], chr(10))) AS run, e - s AS more FROM ends JOIN lines USING (doc_id)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY run, more ORDER BY doc_id, s) AS k FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos FROM numbered WHERE k > 1),
per AS (SELECT doc_id, list(pos ORDER BY pos) AS removed FROM gone GROUP BY doc_id)
SELECT lines.doc_id, len(l)::BIGINT AS n_lines, coalesce(len(removed), 0)::BIGINT AS n_removed, coalesce(array_to_string(removed, ','), '') AS removed_lines,
sha256(coalesce(array_to_string(list_filter(l, lambda x, i: NOT coalesce(list_contains(removed, i - 1), false)), chr(10)), '')) AS kept_sha256
FROM lines LEFT JOIN per USING (doc_id)"""
