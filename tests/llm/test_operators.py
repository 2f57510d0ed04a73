"""Each corpus operator against a plain version of itself, on a made-up corpus with copies, near copies, repeats and odd rows."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, licences, line_dedup, near_dedup, packing, quality_crf, quality_rules, secrets, substring_dedup, suffix_tree_lm
from tessera.llm.common import alnum_words

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))


def prose(rng, n):
    words = ["the", "of", "and", "to", "in"] + [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, shared passages, repeated lines, junk, odd texts."""
    rng = random.Random(5)
    out = []
    base = [prose(rng, rng.randint(30, 300)) for _ in range(60)]
    base = ["\n".join(t[i : i + 90] for i in range(0, len(t), 90)) for t in base]
    passage = prose(rng, 60)
    for k in range(180):
        t = base[k % 60] if k < 120 else prose(rng, rng.randint(1, 150))
        if 60 <= k < 90:
            w = t.split(" ")
            for _ in range(rng.randint(1, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        if k % 7 == 0:
            t += "\n" + passage
        if k % 11 == 0:
            t += "\nReleased under the MIT License.\nA line that many of the documents hold, word for word, at their end."
        if k % 13 == 0:
            t += f' token = "{rng.getrandbits(80):x}" and AKIA{rng.choice("ABCD") * 18} auth Zq{rng.getrandbits(90):X}k9b'
        if k % 17 == 0:
            t = t.upper() + "!! %%% ###"
        out.append((k, t))
    out += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "word"), (1004, "word"), (1005, LONG), (1006, "été 中文 \U0001f600  x"), (1007, "%%% !!! ***"), (1008, "a b c d"), (1009, "one <|endoftext|> two<|endoftext|>\n <|endoftext")]
    return [(i, t, "en" if i % 3 else None, "hot" if i % 2 else f"s{i % 5}", 1) for i, t in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def clashing(docs):
    """The documents with columns named as the operators name theirs inside."""
    names = ["key", "words", "keys", "rep", "class_id", "chunk", "removed", "findings", "hash", "n", "score", "line_quality", "grams", "start", "__doc_id"]
    return docs.withColumns({c: F.lit(1) for c in names})


def both(operator, docs, key):
    """The operator's rows, the same with more columns, and none for no rows."""
    one = {r[0]: r for r in operator(docs).collect()}
    two = {r[0]: r for r in operator(clashing(docs)).collect()}
    assert {k: key(r) for k, r in one.items()} == {k: key(r) for k, r in two.items()}
    assert operator(docs.limit(0)).collect() == []
    twice = operator(docs.filter("doc_id IN (1003, 1001)").union(docs.filter("doc_id = 1003"))).collect()
    assert sorted(r[0] for r in twice) == [1001, 1003, 1003]
    return one


def test_secrets(docs, rows):
    got = both(secrets.scan_secrets, docs, lambda r: r.findings)
    assign = re.compile(secrets.ASSIGN, re.I | re.A)
    for doc, text, *_ in rows:
        t = text or ""
        want = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = [(f.kind, f.start, f.end) for f in got[doc].findings if f.kind != "novel"]
        assert base == sorted(want, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def test_novel_secrets_are_told_from_names():
    scan = secrets.scanner(1024, 64, 0.8)
    kinds = lambda t: [f["kind"] for f in scan(t)]
    assert kinds("auth header Xk29fLq0Zp81mVbT7sQw here") == ["novel"]
    assert kinds("auth header user_name_default_value1 here") == []
    assert kinds("a plain sentence with Xk29fLq0Zp81mVbT7sQw in it") == []
    assert kinds("password: short token: token: abcdef") == []


def test_values_after_an_unquoted_key_are_measured():
    scan = secrets.scanner(1024, 64, 0.8)
    value = "Xk29fLq0Zp81mVbT7sQw"
    for before in ("AWS_SECRET_ACCESS_KEY=", "session=", "export DB_PWD=", "https://a.example/?x=1&auth="):
        for end in ("", "=="):
            text = f"{before}{value}{end}"
            assert [(f["kind"], f["start"], f["end"]) for f in scan(text + " here")] == [("novel", len(before), len(text))]
    assert scan(f"colour={value} here") == []


def test_licences(docs):
    got = both(licences.scan_licences, docs, lambda r: r.licences)
    assert got[11].licences == ["MIT"] and got[1].licences == [] and got[1000].licences == []


def test_licence_rules_need_their_order(spark):
    bsd = licences.SENTENCES
    said = lambda *keys: ". ".join(bsd[k][0] for k in keys) + "."
    wrapped = said("mit.grant", "mit.keep", "mit.asis").replace(" of ", "\nof ")
    cases = [(1, wrapped, ["MIT"]), (2, said("mit.keep", "mit.grant"), []), (3, said("bsd.may", "bsd.source", "bsd.binary"), ["BSD-2-Clause"]), (4, said("bsd.may", "bsd.source", "bsd.binary", "bsd.endorse"), ["BSD-3-Clause"]), (5, "// SPDX-License-Identifier: Apache-2.0\ncode", ["Apache-2.0"])]
    got = {r.doc_id: r.licences for r in licences.scan_licences(spark.createDataFrame([c[:2] for c in cases], "doc_id bigint, text string")).collect()}
    assert got == {c[0]: c[2] for c in cases}


def test_licences_in_comments(spark):
    """Headers below a copyright line, in the comment styles of several languages."""
    bodies = {"MIT": ["mit.grant", "mit.keep"], "ISC": ["isc.grant"], "GPL-3.0-or-later": ["gpl3.later"]}
    rows, want = [], {}
    for name, keys in bodies.items():
        for mark in ("", "# ", " * ", "// "):
            words = "Copyright (c) 2020 Foo\n\n" + ". ".join(licences.SENTENCES[k][0] for k in keys).replace(" or ", " or\n") + "."
            want[len(rows)] = [name]
            rows.append((len(rows), "\n".join((mark + x).rstrip() for x in words.split("\n"))))
    got = {r.doc_id: r.licences for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_planted_secrets_are_found():
    """Random strings after a sensitive word, of several alphabets, against names and numbers in the same places."""
    rng, scan = random.Random(12), secrets.scanner(1024, 1024, 0.8)
    alphabets = ["0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"]
    before = ["the auth header is ", "session=", "export DB_PWD=", "private key follows " + prose(rng, 60) + " ", '"cookie": "']
    found = named = 0
    for i in range(300):
        value = "".join(rng.choice(alphabets[i % 3]) for _ in range(rng.randint(20, 48))) + "7k"
        name = "_".join(rng.choice(["user", "default", "value", "client", "session", "config", "access", "token"]) for _ in range(4)) + "_1"
        around = prose(rng, 100)
        kinds = lambda v: [f["kind"] for f in scan(f"{around} {before[i % 5]}{v} {around}")]  # noqa: B023, E731
        found += "novel" in kinds(value)
        named += "novel" in kinds(name)
    assert found >= 285 and named <= 6, (found, named)


def test_many_secrets_take_linear_time():
    import time

    scan, took = secrets.scanner(64, 1024, 0.8), []
    for n in (500, 4000):
        text = "\n".join(f"token = abcdef{i} key Zq{i}Xk29fLq0Zp81mVbT7s" for i in range(n))
        start = time.process_time()
        assert sum(f["kind"] == "assign" for f in scan(text)) == n
        took.append(time.process_time() - start)
    assert took[1] < 24 * took[0]


def test_near_duplicates(docs, rows):
    got = {k: r.class_id for k, r in both(near_dedup.near_duplicates, docs.filter("doc_id <> 1004"), lambda r: r.class_id).items()}
    import numpy as np
    import xxhash

    words = {d: alnum_words(t or "") for d, t, *_ in rows if d != 1004}
    grams = {d: near_dedup.shingles(np.array([xxhash.xxh64_intdigest(x) for x in w], np.uint64)) for d, w in words.items()}
    root = {d: d for d in words}

    def top(x):
        return x if root[x] == x else top(root[x])

    ids = sorted(d for d in words if words[d])
    sets = {d: set(grams[d].tolist()) for d in ids}
    links = 0
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] & sets[b] and (words[a] == words[b] or near_dedup.aligned(grams[a], grams[b]) or near_dedup.shared(grams[a], grams[b])):
                links += 1
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    assert links > 30
    assert got == {d: top(d) for d in words}


def test_alignment_is_that_of_a_full_table():
    import numpy as np

    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            b[rng.randrange(len(b))] = rng.randrange(6)
        if rng.random() < 0.3:
            del b[rng.randrange(len(b))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        s = table[-1][-1] / max(1, len(a) + len(b) - table[-1][-1])
        got = near_dedup.aligned(np.array(a), np.array(b), 0.8)
        assert got == pytest.approx(s if s >= 0.8 else 0.0)


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(9)
    base = prose(rng, 200).split(" ")
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(200)] = f"other{i}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).select("class_id").distinct().collect()
    assert [r.class_id for r in got] == [0]


def test_pairs_in_a_family_that_shares_a_template_are_found(spark):
    """Pairs at 0.818 whose buckets are full of documents at 0.739."""
    new = lambda *key, n: " ".join(f"{'x'.join(map(str, key))}y{i}" for i in range(n))
    template = new("t", n=89)
    rows = [(2 * p + k, f"{template} {new('p', p, n=5)} {new('o', p, k, n=10)}") for p in range(100) for k in (0, 1)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_components_follow_chains(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 200) for i in range(30)] + [(7, 7)]
    got = {r.id: r.root for r in near_dedup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got.get(i, 0) == 0 for i in range(1, 41)) and all(got[i] == 100 for i in [*range(101, 130), 200])
    assert near_dedup.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def labelled(spark, rows):
    return spark.createDataFrame([(i, int(i % 17 != 0), 0) for i, *_ in rows], "doc_id bigint, quality int, toxic int")


def test_quality_classifier(spark, docs, rows):
    model = quality_crf.train(docs, labelled(spark, rows))
    got = both(lambda d: quality_crf.score_quality(d, model), docs, lambda r: r.score)
    assert all(0 <= r.score <= 1 for r in got.values()) and set(got) == {r[0] for r in rows}
    good = [got[i].score for i in range(180) if i % 17]
    assert sum(s >= 0.3 for s in good) >= 0.98 * len(good) and max(got[i].score for i in (17, 34, 51, 68, 85, 102)) < 0.3
    assert quality_crf.keep_good(docs, model).columns == docs.columns
    for odd in (labelled(spark, rows).filter("quality = 1"), labelled(spark, rows).limit(0)):
        flat = quality_crf.train(docs, odd)
        assert len({round(r.score, 2) for r in quality_crf.score_quality(docs, flat).collect()}) == 1


def test_marginals_are_those_of_all_labelings():
    import itertools

    import numpy as np

    rng = np.random.RandomState(2)
    counts = np.array([1, 4, 3])
    x, w, moves = rng.randn(8, 5), rng.randn(5), rng.randn(2, 2)
    got = quality_crf.good_lines(w, moves, x, counts)
    at = 0
    for n in counts:
        p, total = np.zeros(n), 0.0
        for y in itertools.product((0, 1), repeat=int(n)):
            v = math.exp(sum((x[at + i] @ w) * y[i] for i in range(n)) + sum(moves[y[i - 1], y[i]] for i in range(1, n)))
            p += v * np.array(y)
            total += v
        assert np.allclose(got[at : at + n], p / total)
        at += n


def items_of(rows):
    texts = [(t or "").split() for _, t, *_ in rows[:150]]
    return [(n, " ".join(w[5:30])) for n, w in enumerate(texts) if n % 9 == 0] + [(900, "the of"), (901, ""), (902, None), (903, "never seen words here at all in any of the documents"), (904, "changed")]


def test_decontamination(spark, docs, rows):
    items = items_of(rows)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    windows = defaultdict(set)
    for n, t in items:
        w = alnum_words(t or "")
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(str(n))
    want = {}
    for d, t, *_ in rows:
        w, hit, found = alnum_words(t or ""), set(), set()
        for k in range(1, 11):
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[g]
        want[d] = (len(w), len(hit), sorted(found))
    for most in (decontaminate.MOST_SENT, 0):
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.find_contamination(clashing(docs), bench, most_sent=most).collect()}
        assert got == want
    none = decontaminate.find_contamination(docs, bench.limit(0)).agg(F.sum("n_hit"), F.count("*")).first()
    assert tuple(none) == (0, len(rows))
    both(lambda d: decontaminate.find_contamination(d, bench), docs, lambda r: r.n_hit)


def odd_rows(spark, kind):
    """Rows with null, equal and repeated ids, of one type."""
    rng = random.Random(8)
    a, b = prose(rng, 60), prose(rng, 60)
    cast = str if kind == "string" else int
    rows = [(cast(1), a), (cast(1), b), (cast(1), a), (None, a), (None, b), (cast(2), a + "\n" + b), (cast(2), None), (cast(3), ""), (cast(10), "short text")]
    return spark.createDataFrame(rows, f"doc_id {kind}, text string"), a, b


@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
def test_odd_ids(spark, kind):
    """Null, repeated and textual ids give a row each, in every operator."""
    docs, a, b = odd_rows(spark, kind)
    bench = spark.createDataFrame([("x", a)], "item_id string, text string")
    for most in (decontaminate.MOST_SENT, 0):
        got = sorted((r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.find_contamination(docs, bench, most_sent=most).collect())
        assert got == [(0, 0, []), (0, 0, []), (2, 0, []), (60, 0, []), (60, 0, []), (60, 60, ["x"]), (60, 60, ["x"]), (60, 60, ["x"]), (120, 60, ["x"])]
    assert secrets.scan_secrets(docs).count() == licences.scan_licences(docs).count() == 9
    assert quality_rules.apply_rules(docs.withColumns({"lang": F.lit("en"), "source": F.lit(None)})).count() == 9
    import numpy as np

    model = quality_crf.Classifier(np.zeros(60), np.zeros((2, 2)), 1.0, 0.0)
    assert quality_crf.score_quality(docs, model).count() == 9
    found, _ = suffix_tree_lm.score_texts(docs, docs)
    assert found.count() == 9
    pieces = packing.pack_documents(spark, docs)
    assert pieces.filter("start = 0").count() == 9 and dict(pieces.dtypes)["doc_id"] == kind
    classes = near_dedup.near_duplicates(docs)
    assert classes.count() == 9
    left = [(r.doc_id, r.text) for r in line_dedup.drop_repeated_lines(docs).collect()]
    cast = str if kind == "string" else int
    want = {a: (None, a), b: (None, b), "": (cast(3), ""), None: (cast(2), None), "short text": (cast(10), "short text")}
    assert len(left) == 9 and all(row in left for row in want.values()) and left.count((cast(1), "")) == 3 and (cast(2), "") in left


def test_one_word_over_and_over(spark):
    """A million times one word against ten thousand: by value, not place by place."""
    import time

    docs = spark.createDataFrame([(1, "again " * 1_000_000), (2, "again " * 9)], "doc_id bigint, text string")
    bench = spark.createDataFrame([("x", "again " * 10_000), ("y", "again " * 12), ("z", "again and")], "item_id string, text string")
    for most in (decontaminate.MOST_SENT, 0):
        start = time.time()
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.find_contamination(docs, bench, most_sent=most).collect()}
        assert got == {1: (1_000_000, 1_000_000, ["x", "y"]), 2: (9, 0, [])}
        assert time.time() - start < 60


def test_quality_rules(docs, rows):
    got = both(quality_rules.apply_rules, docs, lambda r: r.n_words)
    for d, t, *_ in rows:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeated = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated))
        assert r.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w)) and (not r.base_failed or not r.kept)


def test_thresholds_follow_the_group(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(("#" if rng.random() < share else "") + w for w in prose(rng, 100).split()), "en", g) for g, share in (("plain", 0.0), ("marked", 0.5)) for i in range(*((0, 200) if g == "plain" else (200, 400)))]
    rows += [(1000, " ".join("#" + w for w in prose(rng, 100).split()), "en", "plain"), (1001, " ".join("#" + w if i % 2 else w for i, w in enumerate(prose(rng, 100).split())), "en", "marked")]
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not got[1000] and got[1001] and sum(got[i] for i in range(400)) >= 396


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_thresholds_differ_and_bind_on_the_tables(spark):
    """No ratio has one threshold for all groups, each rejects documents, and few of those labelled good go by the thresholds."""
    found = quality_rules.op6_quality_rules(spark, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    for k in quality_rules.RATIOS:
        r = found.filter("NOT base_failed").agg(F.count_distinct(f"max_{k}").alias("limits"), F.sum((F.col(k) > F.col(f"max_{k}")).cast("int")).alias("over")).first()
        assert r.limits > 20 and r.over > 0, (k, r)
    good = found.filter("NOT base_failed").join(labels, "doc_id").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    found.unpersist()
    assert good > 0.97


def test_substring_dedup(docs, rows):
    got = {r.doc_id: r for r in substring_dedup.repeated_words(clashing(docs)).collect()}
    first, words = {}, {}
    for d, t, *_ in sorted(rows):
        words[d] = w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    removed = 0
    for d, w in words.items():
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone).decode()
        assert (got[d].n_words, got[d].n_removed, got[d].kept) == (len(w), len(gone), kept)
        assert sum(r.stop - r.start for r in got[d].runs) == len(gone)
        removed += len(gone)
    assert removed > 1000 and substring_dedup.repeated_words(docs.limit(0)).collect() == []


def held(d):
    return zlib.crc32(str(d).encode()) % 7 == 2


def test_lm_scores(docs, rows):
    train = docs.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2)
    found, model = suffix_tree_lm.score_texts(clashing(docs), train)
    got = {r.doc_id: r for r in found.collect()}
    tokens = {d: suffix_tree_lm.symbols(t or "") + [b" end"] for d, t, *_ in rows}
    c = Counter(x for d, t in tokens.items() if not held(d) for x in t)
    n, v = sum(c.values()), len(c)
    assert model.tokens == n and model.distinct == v
    for d, t in tokens.items():
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)
        assert (got[d].n_tokens, got[d].n_known) == (len(t), sum(x in c for x in t))
        assert got[d].base_score == pytest.approx(base, rel=1e-9)
    again, _ = suffix_tree_lm.score_texts(docs, train, most_sent=0)
    for r in again.collect():
        assert (r.base_score, r.score) == pytest.approx((got[r.doc_id].base_score, got[r.doc_id].score), rel=1e-9)
    empty, none = suffix_tree_lm.score_texts(docs, docs.limit(0))
    assert none.tokens == 0 and all(r.score == 0 for r in empty.collect())
    assert suffix_tree_lm.score_texts(docs.limit(0), docs)[0].collect() == []


def test_a_model_that_stays_in_buckets(docs):
    """No gram comes to the driver, and the scores are those of the whole model."""
    learned = ~F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    _, whole = suffix_tree_lm.score_texts(docs, docs.filter(learned))
    want = {r.doc_id: r for r in suffix_tree_lm.score_texts(docs, docs.filter(learned))[0].collect()}
    assert whole.kept[0].any() and whole.kept[1].any()
    for training in (learned, docs.filter(learned)):
        found, model = suffix_tree_lm.score_texts(docs, training, most_sent=0)
        got = found.collect()
        assert len(got) == len(want) and "levels" not in model.__dict__ and (model.tokens, model.distinct) == (whole.tokens, whole.distinct)
        for r in got:
            assert (r.n_tokens, r.n_known) == (want[r.doc_id].n_tokens, want[r.doc_id].n_known)
            assert (r.base_score, r.score) == pytest.approx((want[r.doc_id].base_score, want[r.doc_id].score), rel=1e-9)
    assert (model.levels[1] == whole.levels[1]).all()
    empty, none = suffix_tree_lm.score_texts(docs, docs.limit(0), most_sent=0)
    assert none.tokens == 0 and all(r.score == 0 for r in empty.collect())
    assert suffix_tree_lm.score_texts(docs.limit(0), docs, most_sent=0)[0].collect() == []


def test_what_the_model_learns_grows_with_the_corpus(spark):
    """Grams seen four times are learned however many other tokens there are."""
    rare = [(i, "red fox runs") for i in range(4)] + [(10 + i, "blue owl") for i in range(3)]
    rows = rare + [(100 + i, "the of and to " * 5000) for i in range(60)]
    _, model = suffix_tree_lm.score_texts(*[spark.createDataFrame(rows, "doc_id bigint, text string")] * 2)
    assert 5e-6 * model.tokens > 5
    import xxhash

    at = {int(h): i for i, h in enumerate(model.frequent)}
    number = lambda w: at.get(xxhash.xxh64_intdigest(w.encode()))
    assert number("fox") is not None and number("owl") is None
    code = number("red") * len(model.frequent) + number("fox")
    assert code in model.levels[0] and int(model.levels[0].searchsorted(code)) * len(model.frequent) + number("runs") in model.levels[1]


def test_the_model_is_a_distribution(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a b", "b c a", "c"]) for _ in range(20))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    _, model = suffix_tree_lm.score_texts(docs, docs)
    assert any(k.any() for k in model.kept)
    for history in ("", "a", "b", "a b", "b c", "c a"):
        ends = [(i, f"{history} {w}".strip()) for i, w in enumerate(["a", "b", "c", "unknown"])]
        probe = spark.createDataFrame([*ends, (9, history)], "doc_id bigint, text string")
        run = suffix_tree_lm.Run()
        for key, text in [(r.doc_id, r.text) for r in probe.collect()]:
            run.add(key, text)
        numbers, before = run.close()
        mine = run.ids.array()
        counts = {h: n for h, n in zip(model.frequent.tolist(), [])}
        import numpy as np

        base = Counter(x for _, t in rows for x in suffix_tree_lm.symbols(t) + [suffix_tree_lm.END])
        names = {h: w for w, h in zip(run.ids, mine.tolist())}
        n_of = np.array([base.get(names[h], 0) for h in mine.tolist()])
        _, score, _ = model.score(numbers, before, mine, n_of)
        depth = len(history.split()) + 1
        total = 0.0
        for k in range(5):
            start = int(run.starts[k])
            total += math.exp(score[start + depth])
        assert total == pytest.approx(1.0, abs=1e-9), (history, counts)


def lines_gone(texts):
    """Line numbers that go, by document, by all earlier places and all lengths: texts are in the order of their documents."""
    lines = {d: (t or "").split("\n") for d, t in texts}
    size = lambda x: len([w for w in re.split("[\x20\x09-\x0d]+", x) if w])
    seen, gone = defaultdict(list), defaultdict(set)
    for d, own in lines.items():
        n = [size(x) for x in own]
        for i, line in enumerate(own):
            best = 0
            for e, j in seen[line]:
                other, k = lines[e], 0
                while i + k < len(own) and j + k < len(other) and own[i + k] == other[j + k]:
                    k += 1
                best = max(best, k)
            if sum(n[i : i + best]) >= 10:
                gone[d].update(range(i, i + best))
            seen[line].append((d, i))
    return lines, gone


def test_small_levels_move_no_rows(spark, docs):
    """Line dedup's exchanges do not grow with the length of its runs, and few or many partitions give the same runs."""
    text = "\n".join(f"line number {i} of a long text" for i in range(64))
    long = spark.createDataFrame([(i, text) for i in range(3)], "doc_id bigint, text string").select(line_dedup.row_key("doc_id", "text").alias("key"), "text")
    levels = line_dedup.levels_of(*[long.select("key", F.posexplode(F.split("text", "\n")).alias("pos", "id")).withColumns({"pos": F.col("pos").cast("bigint"), "words": F.lit(7).cast("bigint")})] * 2)
    assert len(levels) == 7 and all(small for _, small in levels)
    runs = levels[3][0].filter(F.col("name") < line_dedup.place()).select("key", "pos", F.lit(8).cast("bigint").alias("n"), "words", F.col("name").alias("first"))
    found, moved = line_dedup.longer(runs, levels[2][0], 4, True), line_dedup.longer(runs.repartition(4), levels[2][0].repartition(4), 4, False)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert found.count() == moved.count() > 0 and exchanges(found) == 0 < exchanges(moved)
    own = docs.select(line_dedup.row_key("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    few, many = (sorted(map(str, line_dedup.repeated_runs(own, most_in_one=n).collect())) for n in (100_000, -1))
    assert few == many and few


def test_line_dedup(docs, rows):
    kept = line_dedup.drop_repeated_lines(clashing(docs))
    got = {r.doc_id: r for r in kept.collect()}
    lines, gone = lines_gone([r[:2] for r in sorted(rows)])
    for d, t, *_ in rows:
        assert got[d].removed_lines == sorted(gone[d])
        assert got[d].text == (t if not gone[d] else "\n".join(x for i, x in enumerate(lines[d]) if i not in gone[d]))
    assert sum(map(len, gone.values())) > 50
    assert line_dedup.drop_repeated_lines(docs.limit(0)).collect() == []
    assert set(docs.columns) < set(kept.columns)


def test_line_runs_of_every_length_go(spark):
    """Short lines that only together have enough words, in runs of many lengths, nested and overlapping ones too."""
    rng = random.Random(21)
    texts = []
    for d in range(60):
        own = [f"{d} {i} {rng.random()}" for i in range(3)] + ["", "a b", "c"] * rng.randint(0, 2)
        if texts:
            for _ in range(rng.randint(1, 3)):
                other = rng.choice(texts)[1].split("\n")
                i = rng.randrange(len(other))
                own += other[i : i + rng.randint(1, 14)] + [f"own {d}"] * rng.randint(0, 1)
        texts.append((d, "\n".join(own)))
    texts += [(100, "x y\n" * 40), (101, "one two three four\nfive six seven eight\nnine ten eleven twelve"), (102, "one two three four\nfive six seven eight\nnine ten eleven twelve\nmore"), (103, "one two three four\nfive six seven eight")]
    _, gone = lines_gone(texts)
    got = {r.doc_id: r.removed_lines for r in line_dedup.drop_repeated_lines(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {d: sorted(gone[d]) for d, _ in texts}
    assert got[102] == [0, 1, 2] and got[103] == []


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_packing(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: ids_of(t, text) for d, text, *_ in rows}
    pieces = packing.pack_documents(spark, clashing(docs)).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for d, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        at = 0
        for p in own:
            assert p.start == at and p.doc_tokens == len(want[d])
            assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in want[d][at : at + p.length]))
            at += p.length
        assert at == len(want[d])
    for own in by_seq.values():
        own.sort(key=lambda p: p.offset)
        ends = [p.offset + p.length for p in own]
        assert [p.offset for p in own] == [0, *ends[:-1]]
        assert ends[-1] <= 2048 and (ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0)
    assert packing.pack_documents(spark, docs.limit(0)).collect() == []


def test_the_curve_goes_from_neighbour_to_neighbour(monkeypatch):
    import numpy as np

    monkeypatch.setattr(packing, "BITS", 3)
    grid = np.array(np.meshgrid(*[range(8)] * 3, indexing="ij")).reshape(3, -1).T
    keys = packing.hilbert_keys(grid)
    assert sorted(keys.tolist()) == list(range(512))
    assert np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1).max() == 1


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    labelled(spark, rows).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[30][1].split()[:15]))], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    left = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, left, d).write.parquet(f"{d}/{n}")
        left = spark.read.parquet(f"{d}/{n}")
        seen[name] = {r.doc_id for r in left.select("doc_id").distinct().collect()}
        if name != names[-1]:
            assert left.columns == docs.columns
            assert left.filter("doc_id < 1000 AND n_chars <> 1 AND n_chars <> length(text)").count() == 0
    assert len(names) == 5 and 17 not in seen[names[0]] and 30 not in seen[names[3]]
    for a, b in zip(names, names[1:]):
        assert seen[b] <= seen[a]
    assert seen[names[3]] == seen[names[4]]
    one = corpus_pipeline.run(spark, d).agg(F.sum("length"), F.count_distinct("doc_id")).first()
    two = left.agg(F.sum("length"), F.count_distinct("doc_id")).first()
    assert tuple(one) == tuple(two)



def test_pipeline_keeps_one_of_repeated_rows(spark, tmp_path):
    """Three documents given twice, two texts with one id, and tables without rows."""
    import corpus_pipeline

    rng, d = random.Random(4), str(tmp_path)
    rows = [(i, "\n".join(prose(rng, 12) for _ in range(8)), "en", "s", 1) for i in range(3)] * 2 + [(7, prose(rng, 90), "en", "s", 1), (7, prose(rng, 90), None, None, None), (None, prose(rng, 80), "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[1][1].split()[:15]))], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    got = corpus_pipeline.run(spark, d).filter("start = 0").collect()
    assert sorted(str(r.doc_id) for r in got) == ["0", "2", "7", "7", "None"]
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).collect() == []
