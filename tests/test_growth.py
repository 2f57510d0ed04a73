"""What moves and what a row costs in queries whose pairs or counts grow fast: by their plans, and against plain versions."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.functions import embed
from tessera.operators import blocks, retrieval, scoring
from tessera.plans.catalog import QUERIES


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def catalog(spark, n, rng):
    """Items of few classes, some with a class of their own or without any."""
    def item(k):
        if k % 17 == 0:
            return (str(k), k, None, None if k % 2 else [], ["alone"] if k % 3 else [])
        if k % 13 == 0:
            return (str(k), k, f"only{k}", [f"t{k}"], ["word", f"w{k}"])
        return (str(k), k, rng.choice(["a", "b", "", None]), rng.sample(["x", "y", "z"], rng.randint(0, 2)), rng.choices(["red", "blue", "ring", "bolt"], k=rng.randint(0, 3)))

    rows = [item(k) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id string, ord int, category string, tags array<string>, tokens array<string>")


def plain_candidates(a, rows):
    alike = [b for b in rows if b[0] != a[0] and ((a[2] is not None and a[2] == b[2]) or set(a[3] or ()) & set(b[3] or ()))]
    return alike or [b for b in rows if b[0] != a[0]]


def test_candidates_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 4)
    rows, df = catalog(spark, 150, random.Random(1))
    found = scoring.similar_candidates(df.filter("ord % 2 = 0"), df)
    want = sorted((a[0], b[0]) for a in rows if a[1] % 2 == 0 for b in plain_candidates(a, rows))
    assert sorted((r.source_id, r.id) for r in found.collect()) == want


def test_candidate_pairs_are_not_moved(spark):
    _, df = catalog(spark, 10, random.Random(1))
    plan = optimized(scoring.similar_candidates(df.filter("ord < 5"), df))
    # nothing is grouped or dealt out above the step that makes pairs of ids
    above = plan[: plan.index("Generate explode(id")]
    assert "Aggregate" not in above and "Repartition" not in above


def plain_similar(rows, sources, top):
    out = []
    for a in sources:
        found = []
        for b in plain_candidates(a, rows):
            x, y = set(a[4]), set(b[4])
            jaccard = len(x & y) / len(x | y) if x and y else 0.0
            score = 4.0 * bool(a[2] and a[2] == b[2]) + 2.0 * len(set(a[3] or ()) & set(b[3] or ())) + 2.0 * jaccard
            if score > 0:
                found.append((-round(score, 9), b[1], b[0]))
        out += [(a[0], b, -score, at) for at, (score, _, b) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_similar_is_that_of_all_pairs(spark):
    rows, df = catalog(spark, 200, random.Random(2))
    found = scoring.similar_pairs(df.filter("ord % 3 = 0"), df)
    assert sorted((r.source_id, r.id, round(r.score, 9), r.position) for r in found.collect()) == plain_similar(rows, [r for r in rows if r[1] % 3 == 0], 5)


def test_similar_scores_kinds_of_rows(spark):
    _, df = catalog(spark, 10, random.Random(2))
    plan = optimized(scoring.similar_pairs(df.filter("ord < 5"), df))
    # ids join what is scored already: none is below the step that counts words in common
    below = plan[plan.index("array_intersect") :]
    assert "kind" in below and "source_id" not in below


def test_an_embedding_cuts_a_text_once(spark):
    plan = optimized(spark.createDataFrame([("a b a",)], "t string").select(embed.hash_embedding(F.col("t"), 16).alias("v")))
    assert plan.count("split(") == 1 and plan.count("xxhash64(") == 1


def test_versions_are_compared_before_rows_meet(spark):
    plan = optimized(QUERIES["H1_compare_version"](spark, "/root/testdata/sf0.001"))
    # the pairs of equal versions, the first branch of the union, are rows of ready answers
    assert "split(" not in plan[: plan.index("Generate explode(a")]


def test_terms_are_counted_in_their_rows(spark):
    rng = random.Random(3)
    lists = [[rng.choice(["a", "B", "看", "", "zz"]) for _ in range(n)] for n in (0, 1, 2, 5, 40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "i int, t array<string>")
    got = {r.i: {x.term: x.tf for x in r.c} for r in df.select("i", retrieval.term_counts(F.col("t")).alias("c")).collect()}
    assert got == {i: dict(Counter(t)) for i, t in enumerate(lists)}
    docs = spark.createDataFrame([("1", 1, "a b a")], "id string, ord int, text string")
    assert "Aggregate" not in optimized(retrieval.build_index(docs).postings)


def test_texts_are_cut_once(spark):
    docs = spark.createDataFrame([("1", 1, "a b a"), ("2", 2, ""), ("3", 3, None)], "id string, ord int, text string")
    index = retrieval.build_index(docs)
    assert optimized(index.postings).count("sort_array(") == 1
    assert sorted((r.term, r.id, r.dl, r.tf) for r in index.postings.collect()) == [("a", "1", 3, 2), ("b", "1", 3, 1)]


def test_scores_are_summed_where_a_document_is(spark, monkeypatch):
    rng = random.Random(4)
    docs = spark.createDataFrame([(str(i), i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 9)))) for i in range(60)], "id string, ord int, text string")
    queries = spark.createDataFrame([("p", "a b z"), ("q", "c c d")], "qid string, text string")
    index = retrieval.build_index(docs, retrieval.query_terms(queries))
    found = retrieval.bm25(index, queries)
    got = sorted(map(tuple, found.collect()))
    assert not re.search(r"hashpartitioning\(qid", found._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(retrieval, "MOST_QUERY_TERMS", 0)
    assert got and got == sorted(map(tuple, retrieval.bm25(index, queries).collect()))
