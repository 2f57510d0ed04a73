"""What the corpus operators share, on random inputs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.decontaminate import K, SPAN, WINDOW

words = st.lists(st.integers(0, 5), min_size=0, max_size=60)


def hashed(ws):
    return np.array([w * 7919 + 11 for w in ws], np.uint64)


@settings(max_examples=200, deadline=None)
@given(words, st.integers(1, 14))
def test_equal_windows_have_equal_hashes(ws, n):
    h = common.gram_hashes(hashed(ws), [n])[n]
    grams = [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]
    assert len(h) == len(grams)
    assert len(set(h.tolist())) == len(set(grams))
    both = common.gram_hashes(hashed(ws), sorted({n, 13}))[n]
    assert (both == h).all()


@settings(max_examples=200, deadline=None)
@given(words, words, words, st.lists(st.integers(0, 5), min_size=WINDOW, max_size=WINDOW))
def test_a_shared_window_shares_a_fingerprint(a, b, c, shared):
    def prints(ws):
        grams = common.gram_hashes(hashed(ws), [K])[K]
        places = common.lowest_of_each(grams, SPAN)
        return {(int(p), int(grams[p])) for p in places}

    one, two = prints(a + shared + b), prints(c + shared)
    inside = range(WINDOW - K + 1)
    assert {(p - len(a), h) for p, h in one if p - len(a) in inside} & {(p - len(c), h) for p, h in two if p - len(c) in inside}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_numbers_come_back(values):
    v = np.unique(np.array(values, np.uint64))
    assert (common.unpacked(common.packed(v)) == v).all()
    assert (common.loosened(common.squeezed(v.view(np.int64)), np.int64) == v.view(np.int64)).all()
    assert (common.among(v, v[::2]) == np.isin(v, v[::2])).all()


def test_buckets_are_the_same_for_columns(spark):
    rng = np.random.RandomState(1)
    v = np.unique(rng.randint(-(2**63), 2**63 - 1, 500).astype(np.int64).view(np.uint64))
    want = {int(np.array([h]).view(np.int64)[0]): b for b, s, e in common.bucketed(v, 77) for h in v[s:e]}
    df = spark.createDataFrame([(h,) for h in want], "hash bigint")
    got = {r.hash: r.b for r in df.select("hash", common.bucket_of(F.col("hash"), 77).alias("b")).collect()}
    assert got == want and min(want.values()) >= 0 and max(want.values()) < 77


def test_word_numbers_outlive_growth():
    ids = common.WordIds()
    first = ids.at([b"a", b"b", b"a"])
    ids.at([str(i).encode() for i in range(10_000)])
    assert (ids.at([b"a", b"b", b"a"]) == first).all() and len(ids.array()) == len(ids)


def test_words():
    assert common.alnum_words("It's ÉTÉ-2, a_b") == [w.encode() for w in ["it", "s", "ÉtÉ", "2", "a", "b"]]


def test_hot_keys_keep_all_their_rows(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id", F.lit(1).alias("key"))
    facts = rows.groupBy("k").agg(F.count("*").alias("fact"))
    got = common.joined_by(rows, facts, ["k"])
    assert got.count() == 1000 and set(got.columns) == {"k", "id", "key", "fact"}
