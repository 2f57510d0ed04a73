"""Rules of the catalog on rows made for them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import guard, markdown, scalars, source_spec, text
from tessera.operators import ai_search, facets, filters, history, joins, query_language, retrieval, scoring, sorting
from tessera.schema import DAY_MS, HOUR_MS, MmrConfig, TrendConfig
from tessera.sources import catalog_files, notes, vector_file
from tessera.streaming import trends

NOW = 1_790_000_000_000


def one(spark, column, **values):
    kinds = {int: "bigint", float: "double", str: "string", type(None): "string", list: "array<string>"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def items(spark, rows, fields="id string, name string, description string, author string, category string, tags array<string>, downloads double, updated bigint, ord bigint"):
    return spark.createDataFrame(rows, fields)


# the query language


@pytest.mark.parametrize(
    "query, terms, groups, excludes",
    [
        ("a b", ["a", "b"], [], []),
        ("a|b c", ["c"], [["a", "b"]], []),
        ("a OR b | c d", ["d"], [["a", "b", "c"]], []),
        ("| a", [], [["a"]], []),
        ("a | -b", [], [["a"]], ["b"]),
        ('"a b" -"c d"', ["a b"], [], ["c d"]),
        ('-""', [], [], [""]),
        ("a | author: b", [], [["a", "b"]], []),
        ("x　y", ["x", "y"], [], []),
        ('say"a b"c', ['say"a b"c'], [], []),
    ],
)
def test_parse(query, terms, groups, excludes):
    q = query_language.parse(query)
    values = lambda ts: [t.value for t in ts]
    assert (values(q.terms), [values(g) for g in q.or_groups], values(q.excludes)) == (terms, groups, excludes)


def test_fields_need_a_known_name_before_the_quote():
    t = query_language.term
    assert t("author:X") == query_language.Term("x", "author")
    assert t('"author:x"') == query_language.Term("author:x")
    assert t("http://x") == query_language.Term("http://x")
    assert not query_language.parse("").advanced and query_language.parse("a-b").advanced and not query_language.parse("ab").advanced


def test_percent_is_no_wildcard(spark):
    df = spark.createDataFrame([("50% off",), ("500 off",)], "any string")
    assert [r.any for r in df.filter(query_language.text_filter("50%", {"any": F.col("any")})).collect()] == ["50% off"]


def test_blob_keeps_place_of_missing_fields(spark):
    assert one(spark, query_language.search_blob("a", "b", "c"), a="X", b=None, c="y") == "x  y"


@pytest.mark.parametrize("q, yes", [("abc", False), ("123456", False), ("怎么管理任务", True), ("a very long query", True), ("a b c d e", True), ("kanban", False)])
def test_semantic_queries(spark, q, yes):
    assert one(spark, query_language.is_semantic_query(F.col("q")), q=q) is yes


# functions


@pytest.mark.parametrize("a, b, want", [("v1.2", "1.2.0", 0), ("1.10", "1.9", 1), ("1.x", "1.0", 0), ("", "0", 0), ("2", "10", -1), ("1.0-beta", "1.0", 0)])
def test_versions(spark, a, b, want):
    assert one(spark, scalars.compare_versions(F.col("a"), F.col("b")), a=a, b=b) == want


@pytest.mark.parametrize("n, want", [(999.0, "999"), (1000.0, "1k"), (1250.0, "1.3k"), (1_200_000.0, "1.2M"), (2_000_000.0, "2M")])
def test_downloads(spark, n, want):
    assert one(spark, scalars.format_downloads(F.col("n")), n=n) == want


@pytest.mark.parametrize("age, want", [(-1, ""), (30_000, "now"), (5 * 60_000, "5min"), (3 * HOUR_MS, "3h"), (29 * DAY_MS, "29d"), (30 * DAY_MS, "1mo"), (800 * DAY_MS, "2y")])
def test_ages(spark, age, want):
    assert one(spark, scalars.relative_time(F.col("t"), NOW), t=NOW - age) == want


def test_han_spaces_and_cjk(spark):
    assert one(spark, scalars.clean_han_spaces(F.col("t")), t="思 维 导  图 map  a") == "思维导图 map a"
    assert one(spark, scalars.has_cjk(F.col("t")), t="ａ") and not one(spark, scalars.has_cjk(F.col("t")), t="a")
    assert one(spark, scalars.char_classes(F.col("t")), t="a1 看.") == ["cjk", "digit", "latin", "punctuation", "space"]


def test_links_and_urls(spark):
    page = "![a](./x.png) [b](y.md) [c](#z) [d](https://e) <img src='q'> ![f](//g)"
    got = one(spark, scalars.absolute_links(F.col("t"), "o/r"), t=page)
    assert "![a](https://raw.githubusercontent.com/o/r/HEAD/x.png)" in got and "[b](https://github.com/o/r/blob/HEAD/y.md)" in got and "[c](#z)" in got and "[d](https://e)" in got and "![f](//g)" in got
    assert one(spark, scalars.error_kind(F.col("t")), t="Request ETIMEDOUT 404") == "timeout"
    assert [one(spark, scalars.repo_part(F.col("t"), w), t="https://github.com/a-b/c.d.git") for w in ("owner", "name")] == ["a-b", "c.d"]


def test_hash_and_letters(spark):
    h = 5381
    for c in "ab\u001fc":
        h = (h * 33 + ord(c)) & 0xFFFFFFFF
    assert one(spark, scalars.content_hash(F.col("a"), F.col("b")), a="ab", b="c") == f"{h:x}"
    assert [one(spark, scalars.first_letter(F.col("t"), {"欧阳": "O", "李": "L"}), t=t) for t in ("李四", "欧阳一", "bob", "1")] == ["L", "O", "B", "#"]
    assert one(spark, scalars.highlighted(F.col("t"), ["ab", "abc"]), t="xABCab") == "x<mark>ABC</mark><mark>ab</mark>"


def test_staleness(spark):
    s = lambda t: one(spark, scalars.is_stale(F.col("t"), NOW, 10), t=t)
    assert s(0) and s(-5) and not s(NOW + 5) and not s(NOW - 10) and s(NOW - 11)


@pytest.mark.parametrize("t, want", [("思维导图", ["思维", "维导", "导图", "思维导", "维导图"]), ("看板", ["看板"]), ("番茄钟", ["番茄钟"]), ("My_Tool v2-x, 看板", ["my_tool", "v2-x", "看板"]), ("a\U0001f600b", ["a", "\U0001f600", "b"]), ("", [])])
def test_search_tokens(spark, t, want):
    assert one(spark, text.search_tokens(F.col("t")), t=t) == want


def test_description_tokens(spark):
    assert one(spark, text.description_tokens(F.col("t")), t="The Kanban board, 看板任务 and 图 of it") == ["kanban", "board", "看板", "板任", "任务", "图"]


def test_jaro():
    assert text.jaro("abcdef", "bcadef") == pytest.approx(0.9166667, abs=1e-6)
    assert text.jaro_winkler("abcd", "axyd") == pytest.approx(0.70, abs=1e-9)
    assert text.jaro("", "") == 0 and text.jaro("a", "a") == 1 and text.jaro("a", "b") == 0


def test_simplified(spark):
    assert [one(spark, text.simplified(F.col("t"), "數據庫", "数据库"), t=t) for t in ("數據庫 db", "plain")] == ["数据库 db", "plain"]


# sources


def test_stats_map(spark):
    df = spark.createDataFrame([('{"a": {"downloads": 5, "updated": 7}, "b": {"updated": 1}, "c": "x", "d": {"downloads": 0}}',), ("[1]",), (None,)], "json string")
    assert sorted(map(tuple, catalog_files.parse_stats(df).collect())) == [("a", 5.0, 7), ("d", 0.0, None)]


def test_catalog_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"id": "b", "name": "B"}, {"name": "no id"}, {"id": "a", "downloads": 3}]')
    got = catalog_files.read_catalog(spark, str(tmp_path / "c.json")).select("id", "list_index", "downloads").collect()
    assert sorted(map(tuple, got)) == [("a", 2, 3.0), ("b", 0, None)]
    assert catalog_files.replace_table(spark.range(4), str(tmp_path / "t"), 10) is False
    assert catalog_files.replace_table(spark.range(5), str(tmp_path / "t"), 10) is True


def test_review_notes(spark, tmp_path):
    e = {"id": "x:1", "name": 'A "q"', "status": "using", "rating": 4, "verdict": ["slow", "big"], "install_count": 2, "enabled": True, "updated": 9, "note": "text\nmore"}
    got = notes.parse_review(notes.render_review(e))
    names = [c.split()[0] for c in notes.REVIEW.split(", ")]
    assert {k: v for k, v in zip(names, got) if v is not None} == e
    assert notes.parse_review("﻿---\r\nid: a\r\nrating: 4.5\r\n---\r\n") is None
    assert notes.parse_review("---\nid: a\nrating: 7\n---\nhi")[3] is None
    assert notes.parse_review("no front matter") is None and notes.parse_review("---\nname: a\n---\nhi") is None
    (tmp_path / "a.md").write_text(notes.render_review(e))
    assert notes.read_review_notes(spark, str(tmp_path)).first().note == "text\nmore"


def test_memory_notes():
    e = {"id": "a", "name": "N: x", "description": "d", "source": "human", "status": "approved", "confidence": 0.5, "created": 3}
    assert notes.parse_memory(notes.render_memory(e))[:7] == ("a", "N: x", "d", "human", "approved", 0.5, 3)


def test_vector_file(spark, tmp_path):
    rng = random.Random(1)
    v = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(5)]
    data = vector_file.encode(list("abcde"), v, "m", "h", "s")
    ids, got, model, digest, schema = vector_file.decode(data)
    assert (ids, model, digest, schema) == (list("abcde"), "m", "h", "s")
    assert max(abs(x - y) for a, b in zip(v, got) for x, y in zip(a, b)) < 2 / 254
    for bad in (b"NOPE" + data[4:], data[:4] + b"\x09" + data[5:], data[:-1]):
        with pytest.raises(ValueError):
            vector_file.decode(bad)
    (tmp_path / "i.bin").write_bytes(data)
    assert vector_file.read_index(spark, str(tmp_path)).count() == 5


def test_source_specs():
    p = source_spec.parse
    assert p("o/r@latest").release and p("https://github.com/o/r/releases/tag/v1").tag == "v1" and p("github.com/o/r").repo == "r"
    assert p("https://x.y/a/manifest.json").root == "https://x.y/a/" and p("http://localhost:80/z").root == "http://localhost:80/z/"
    for bad in ("http://x.y/z", "just words", "https://github.com/o"):
        with pytest.raises(ValueError):
            p(bad)


# markdown and guards


PAGE = "# Title\n\nText with `code` and [link](u) ![i](p)\n\n```py\nx = 1\n```\n> quote\n- item <b>x</b>\n\n    indented\n| a | b |\n|---|---|\n"


def test_pages_are_cut_without_loss(spark):
    b = markdown.blocks(PAGE)
    assert "".join(t for _, t in b) == PAGE and all(x[0] != y[0] for x, y in zip(b, b[1:]))
    assert not any("x = 1" in t for keep, t in b if not keep)
    df = spark.createDataFrame([("1", PAGE)], "id string, text string")
    assert "`code`" in markdown.translate_pages(df, str.upper).first().text and "TEXT WITH" in markdown.translate_pages(df, str.upper).first().text


@pytest.mark.parametrize("limit", [1, 3, 10, 50, 1000])
def test_batches_join_to_the_text(limit):
    t = "para one\n\npara two is longer\n \n\nthree\n\n" + "x" * 60
    parts = markdown.batches(t, limit)
    assert markdown.joined(parts) == t and all(len(b) <= limit for b, _ in parts)


def test_lines_in_one_call():
    assert markdown.translate_lines(["a", "b"], str.upper) == ["A", "B"]
    for lines, ask in [(["a", " "], str.upper), (["a\nb"], str.upper), (["a"], lambda t: t), (["a", "b"], lambda t: "x"), (["x" * 2001], str.upper)]:
        assert markdown.translate_lines(lines, ask) is None


def test_breaker():
    b = guard.Breaker(2, 100, 1000)
    b.failure(0)
    assert not b.is_open(1)
    b.failure(1)
    assert b.is_open(50) and not b.is_open(101)
    b.failure(200, fatal=True)
    assert b.is_open(1100) and not b.is_open(1200) and guard.is_fatal("HTTP 429") and not guard.is_fatal("timeout")


# scores


def test_quality_factors(spark):
    r = lambda days: one(spark, scoring.recency_factor(F.col("t"), NOW), t=NOW - days * DAY_MS)
    assert r(60) == pytest.approx(math.exp(-60 / 730)) and r(1500) == 0.85 and r(-3) == 1.0
    p = lambda d: one(spark, scoring.popularity_factor(F.col("d"), F.lit(4e6)), d=d)
    assert p(4e6) == pytest.approx(1.15) and p(0.0) == 1.0 and p(float("nan")) == 1.0 and p(-5.0) == 1.0


def test_trend(spark):
    t0 = 10**12
    df = spark.createDataFrame([("a", t0, 1.0), ("a", t0 + DAY_MS, 1000.0), ("b", t0, 1.0), ("b", t0 + HOUR_MS // 2, 9.0), ("c", t0, 1.0), ("d", t0, 5.0), ("d", t0 + DAY_MS, 1.0)], "id string, ts bigint, downloads double")
    got = {r.id: r.trend for r in scoring.trend_scores(df).collect()}
    assert got == {"a": pytest.approx(0.75), "b": 0.5, "c": 0.5, "d": 0.0}


def test_global_rank_is_row_number(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(20)) for i in range(500)]
    got = {r.id: r.rank for r in scoring.global_rank(spark.createDataFrame(rows, "id bigint, v bigint").repartition(7), [F.col("v").desc(), F.col("id").asc()], "rank").collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}


def test_signals(spark):
    rows = [(str(i), "n", "d", "a", "c", [], float(100 - i), NOW - (1 if i < 50 else 60 if i < 60 else 400) * DAY_MS, i) for i in range(100)]
    got = {r.id: r.signals for r in scoring.smart_signals(items(spark, rows), NOW).collect()}
    assert got["0"] == ["top1", "recentActive", "recentUpdate"] and got["1"][0] == "top5" and got["5"][0] == "hot10" and got["55"] == ["recentActive"] and got["99"] == []


def test_diverse_order(spark):
    pool = spark.createDataFrame([("f", "a", 1.0, "X", [], 0), ("f", "b", 0.9, "X", [], 1), ("f", "c", 0.8, "X", [], 2), ("f", "d", 0.1, "Y", [], 3)], "feed string, id string, score double, category string, tags array<string>, ord bigint")
    got = [r.id for r in scoring.diverse(pool, MmrConfig(1.0, 4, 2)).orderBy("position").collect()]
    assert got == ["a", "b", "d", "c"]


def test_featured_falls_back(spark):
    rows = [(str(i), 90.0 - i, f"c{i}", [], i) for i in range(3)]
    df = spark.createDataFrame(rows, "id string, score double, category string, tags array<string>, ord bigint")
    ids = lambda installed: [r.id for r in scoring.featured(df, spark.createDataFrame([(i,) for i in installed], "id string"), ["x", "y", "z", "w"]).orderBy("position").collect()]
    assert ids([]) == ["0", "1", "2"] and ids(["0"]) == ["1", "2"] and ids(["0", "1"]) == ["x", "y", "z"]


def test_rrf_ties(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "id string, rank int")
    b = spark.createDataFrame([("y", 1), ("x", 2)], "id string, rank int")
    got = scoring.rrf([(a, 1.0), (b, 1.0)]).orderBy(F.col("score").desc(), "first_path", "first_rank").collect()
    assert [r.id for r in got] == ["x", "y", "z"]
    with pytest.raises(ValueError):
        scoring.rrf([(a, 0.0)])


def test_similar_without_tags_looks_at_all(spark):
    rows = [("a", "n", "kanban board", "x", None, None, 1.0, 1, 0), ("b", "n", "kanban tool", "x", "c", ["t"], 1.0, 1, 1), ("c", "n", "weather", "x", "c", [], 1.0, 1, 2)]
    i = items(spark, rows).withColumn("tokens", text.description_tokens(F.col("description")))
    got = {(r.source_id, r.id): r.score for r in scoring.similar_pairs(i, i).collect()}
    assert got[("a", "b")] == pytest.approx(2 / 3) and ("a", "c") not in got and got[("b", "c")] == 4.0


# retrieval


def corpus(spark, n=80):
    rng = random.Random(7)
    rows = [(str(i), i, " ".join(rng.choice(["note", "task", "看板任务", "graph", "sync", "x"]) for _ in range(rng.randint(1, 12)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id string, ord bigint, text string")


def test_bm25_is_that_of_a_plain_scan(spark):
    rows, df = corpus(spark)
    pieces = {i: one(spark, text.search_tokens(F.col("t")), t=t) for i, _, t in rows}
    n, avgdl = len(rows), sum(map(len, pieces.values())) / len(rows)
    q = ["note", "note", "看板", "graph"]
    want = {}
    for i, p in pieces.items():
        s = 0.0
        for t in q:
            d = sum(t in x for x in pieces.values())
            s += math.log((n - d + 0.5) / (d + 0.5) + 1) * p.count(t) * 2.5 / (p.count(t) + 1.5 * (0.25 + 0.75 * len(p) / avgdl))
        if s > 0:
            want[i] = round(s, 6)
    queries = spark.createDataFrame([("q", "note NOTE 看板 graph")], "qid string, text string")
    index = retrieval.build_index(df)
    assert {r.id: round(r.score, 6) for r in retrieval.bm25(index, queries).collect()} == want
    some = spark.createDataFrame([("3",), ("5",)], "id string")
    assert {r.id: round(r.score, 6) for r in retrieval.bm25(index, queries, allowed=some).collect()} == {k: v for k, v in want.items() if k in ("3", "5")}


def test_scope_is_chosen_before_the_top(spark):
    rows = [(str(i), i, [1.0, 0.0]) for i in range(601)]
    v = spark.createDataFrame(rows, "id string, ord bigint, vec array<float>")
    got = retrieval.vector_top(v, [1.0, 0.0], 300, 0.3, spark.createDataFrame([("600",)], "id string")).collect()
    assert [r.id for r in got] == ["600"]
    assert [r.id for r in retrieval.vector_top(v, [1.0, 0.0], 3).collect()] == ["0", "1", "2"]
    with pytest.raises(Exception, match="another length"):
        retrieval.vector_top(v, [1.0], 3).collect()


def test_fuzzy_titles(spark):
    df = spark.createDataFrame([("a", 0, "Pomodoro Timer", None), ("b", 1, "Kanban Board", "看板"), ("c", 2, "Notion", "打印"), ("d", 3, "x", "打卡钟")], "id string, ord bigint, name string, name_zh string")
    ids = lambda q: [r.id for r in retrieval.fuzzy_titles(df, q).collect()]
    assert ids("pomodoro timr")[0] == "a" and ids("打卡") == ["d"] and ids("看板") == ["b"] and ids("") == []


def test_intents():
    p = [retrieval.Profile("git", "Git", ("git",), ("git",)), retrieval.Profile("ai", "AI", ("ai",), ("ai",))]
    i = lambda q: retrieval.parse_intent(q, p)
    assert i("digital daily").profiles == [] and [x.key for x in i("ai助手 git").profiles] == ["git", "ai"]
    assert i("不要导出 notes").negative == ["导出"] and i("notes without pdf").negative == ["pdf"] and i("-x").pure_negative
    assert i('"exact words" a').phrases == ["exact words"] and not i("notes").pure_negative
    assert retrieval.expand("ai助手", {"ai": ["ml"]}) == "ai助手 ml" and retrieval.expand("daily", {"ai": ["ml"]}) == "daily"


def test_rerank_is_bounded(spark):
    df = spark.createDataFrame([("a", 1.0, "small ring widget"), ("b", 1.0, "other")], "id string, score double, t string")
    intent = retrieval.parse_intent('"small ring" without widget')
    got = {r.id: r["rerank"] for r in retrieval.rerank(df, intent, F.col("t")).collect()}
    assert got == {"a": pytest.approx(0.82), "b": 1.0}


def test_codec_and_index_changes(spark):
    q = retrieval.quantised(F.array(F.lit(-1.0), F.lit(0.25), F.lit(1.0)))
    back = spark.range(1).select(retrieval.restored(q).alias("x")).first().x
    assert back == pytest.approx([-1.0, 0.25, 1.0], abs=2 / 254)
    a = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "id string, hash string")
    b = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], "id string, hash string")
    assert {r.id: r.action for r in retrieval.index_changes(a, b).collect()} == {"a": "remove", "b": "reuse", "c": "embed", "d": "embed"}
    assert {r.action for r in retrieval.index_changes(b, b, rebuild=True).collect()} == {"embed"}


@pytest.mark.parametrize("answer, want", [('{"indices": [1, 0, 9]}', ["b", "a"]), ('```json\n{"ids": ["b", "b", "zz"]}\n```', ["b"]), ("sure: [\"a\"]", ["a"]), ("｛“ranking”：[1，0]｝", ["b", "a"]), ('{"plugins": [{"id": "b"}, {"index": 0}]}', ["b", "a"]), ('{"indices": [], "ids": ["a"]}', ["a"])])
def test_rankers_answers(answer, want):
    assert ai_search.read_ranking(answer, ["a", "b"]) == want


def test_bad_answers():
    for bad in ("no json", "{}", '{"ids": ["x"]}'):
        with pytest.raises(ValueError):
            ai_search.read_ranking(bad, ["a"])


# joins, filters, orders, histories


def test_dependency_states(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    e = spark.createDataFrame([("s", d, "required", m) for d, m in (("u", None), ("m", None), ("d", None), ("o", "2.0"), ("k", "1.0"))], "src_id string, dep_id string, kind string, min_version string")
    installed = spark.createDataFrame([("d", "1"), ("o", "1.9"), ("k", "1.0")], "id string, version string")
    got = joins.dependency_status(e, ids("m", "d", "o", "k"), installed, ids("o", "k"))
    assert {r.dep_id: r.status for r in got.collect()} == {"u": "unknown", "m": "missing", "d": "disabled", "o": "outdated", "k": "ok"}
    assert {r.dep_id: r.action for r in joins.blocking(got).collect()} == {"u": "install", "m": "install", "d": "enable", "o": "update"}


def test_bilingual(spark):
    b = lambda en, zh: one(spark, joins.bilingual(F.col("a"), F.col("b")), a=en, b=zh)
    assert b("A", "甲") == "A（甲）" and b("Ab", "aB") == "Ab" and b("A", None) == "A" and b("", "甲") == "甲"


def test_missing_series_passes_nothing_and_old_updates(spark):
    df = spark.createDataFrame([("a", NOW - 10 * DAY_MS), ("b", NOW - 11 * DAY_MS), ("c", 0), ("d", None)], "id string, updated bigint")
    assert filters.series(df, None).count() == 0
    ids = lambda d: [r.id for r in df.filter(filters.updated_within(F.col("updated"), d, NOW)).collect()]
    assert ids(10) == ["a"] and ids(-10) == ["b"]


def test_zh_order(spark):
    df = spark.createDataFrame([("张", 0), ("安", 1), ("李", 2)], "display_name string, ord bigint")
    assert [r.display_name for r in df.orderBy(*sorting.keys("name")).collect()] == ["安", "李", "张"]


def test_ingest(spark):
    rows = [("a", 0, 5.0), ("a", HOUR_MS, 9.0), ("a", 2 * HOUR_MS, 3.0), ("a", 6 * HOUR_MS, 7.0), ("a", 13 * HOUR_MS, 8.0)]
    df = spark.createDataFrame(rows, "id string, ts bigint, downloads double")
    got = sorted(map(tuple, history.ingest(df).collect()))
    assert got == [("a", 0, 9.0), ("a", 6 * HOUR_MS, 7.0), ("a", 13 * HOUR_MS, 8.0)]
    assert trends.take_up([], [r[1:] for r in rows], TrendConfig()) == [g[1:] for g in got]
    many = spark.createDataFrame([("a", i * 6 * HOUR_MS, float(i)) for i in range(50)], "id string, ts bigint, downloads double")
    assert sorted(r.downloads for r in history.ingest(many).collect()) == [float(i) for i in range(20, 50)]


def test_installs(spark):
    cur = spark.createDataFrame([("old", "O", 1, 2, None, 1), ("gone", "G", 1, 2, None, 1), ("left", "L", 1, 2, None, 3)], "id string, name string, first_installed bigint, last_installed bigint, uninstalled bigint, install_count bigint")
    added = spark.createDataFrame([("new", "N"), ("old", "O")], "id string, name string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {r.id: r for r in history.merge_installs(cur, added, ids("gone", "never"), ids("new", "old"), ids("new"), 99).collect()}
    assert (got["new"].first_installed, got["new"].install_count, got["new"].currently_enabled) == (99, 1, True)
    assert (got["old"].first_installed, got["old"].last_installed, got["old"].install_count) == (1, 99, 2)
    assert (got["gone"].uninstalled, got["gone"].currently_installed) == (99, False) and got["left"].uninstalled == 99 and "never" not in got


def test_totals_and_buckets(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "grp string")
    assert {r.grp: r.n for r in facets.with_total(df, "grp").collect()} == {"a": 2, "b": 1, "all": 3}
    assert one(spark, facets.update_bucket(F.lit(True), F.lit(True), F.lit(False))) == "outdated"


# streams


def stream(spark, df, folder, build, name):
    path = f"{folder}/{name}"
    df.repartition(3).write.parquet(path)
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = build(src).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streamed_ingest(spark, tmp_path):
    rows = [(k, i * 4 * HOUR_MS, float(i)) for i in range(9) for k in ("a", "b")]
    df = spark.createDataFrame(rows, "id string, ts bigint, downloads double")
    path = f"{tmp_path}/in"
    df.coalesce(1).write.parquet(path)
    q = trends.ingest_stream(spark.readStream.schema(df.schema).parquet(path)).writeStream.format("memory").queryName("kept").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("kept").collect())) == sorted(map(tuple, history.ingest(df).collect()))


def test_streamed_installs_and_windows(spark, tmp_path):
    df = spark.createDataFrame([("a", "install", 1), ("a", "uninstall", 2), ("a", "install", 3), ("b", "install", 5)], "id string, kind string, ts bigint")
    last = stream(spark, df, str(tmp_path), trends.installs_stream, "ledger").groupBy("id").agg(F.max("install_count").alias("n")).collect()
    assert {r.id: r.n for r in last} == {"a": 2, "b": 1}
    ev = spark.createDataFrame([(1, "x"), (2, "x"), (4000, "y")], "s bigint, event_type string").select(F.timestamp_seconds("s").alias("ts"), "event_type")
    got = stream(spark, ev, str(tmp_path), lambda s: trends.windowed_counts(s), "hours").groupBy("event_type").agg(F.max("n").alias("n")).collect()
    assert {r.event_type: r.n for r in got} == {"x": 2, "y": 1}


def test_active_filters_keep_a_fixed_order():
    from tessera.functions import labels

    order, neutral = ["search", "source", "category"], {"source": "all"}
    state = {"category": ["a", "b"], "source": "all", "search": "ring"}
    assert labels.active_filters(state, order, neutral) == [("search", "ring"), ("category", "a, b")]
    assert labels.filter_signature(state, order, neutral) == labels.filter_signature({**state, "source": None}, order, neutral)
    assert labels.filter_signature(state, order, neutral) != labels.filter_signature({**state, "source": "ai"}, order, neutral)


def test_query_vectors_are_remembered():
    from tessera.functions import labels

    asked = []
    embed = labels.remembered(lambda t: asked.append(t) or [1.0], most=2)
    assert embed("a") == embed("a") == (1.0,)
    embed("b"), embed("c"), embed("a")
    assert asked == ["a", "b", "c", "a"]


def test_signatures_see_order_and_fields(spark):
    from tessera.functions.notice import ordered_signatures

    def sign(rows):
        df = spark.createDataFrame(rows, "ord bigint, id string, name string, category string")
        return ordered_signatures(df, "ord", ["id", "name"], ["category"], "v1").first()

    now = sign([(1, "a", "x", "c"), (2, "b", None, "c")])
    assert now == sign([(2, "b", None, "c"), (1, "a", "x", "c")])
    assert now.text_index != sign([(2, "a", "x", "c"), (1, "b", None, "c")]).text_index
    other = sign([(1, "a", "x", "d"), (2, "b", None, "c")])
    assert now.text_index == other.text_index and now.fields != other.fields


def test_marks_made_during_a_failed_write_stay(spark):
    marks = spark.createDataFrame([("a", 5), ("b", 5), ("c", 9)], "id string, ts bigint")
    writes = spark.createDataFrame([("a", 6, True), ("b", 6, False), ("c", 6, True)], "id string, ts bigint, ok boolean")
    assert sorted(tuple(r) for r in history.still_dirty(marks, writes).collect()) == [("b", 5), ("c", 9)]


def test_flushes_come_after_many_changes_or_a_pause(spark):
    rows = [("a", t, n) for n, t in enumerate([0, 1, 2, 3, 50, 51])]
    df = spark.createDataFrame(rows, "id string, ts bigint, ord bigint")
    got = {r.ord: r.flush for r in history.flushes(df, 3, 10).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 3, 5: 3}
    assert sorted(r.ord for r in history.debounced(df, 10).collect()) == [3, 5]


def test_odd_capitals_are_cut_as_before(spark):
    from tessera.functions.text import search_tokens

    assert one(spark, search_tokens(F.col("t")), t="aKb İI Ab-C") == ["a", "b", "i", "ab-c"]
    assert one(spark, search_tokens(F.col("t")), t="ÉtÉ \U0001f600x") == ["t", "\U0001f600", "x"]


def test_an_index_of_wanted_terms_has_the_statistics_of_the_whole(spark):
    docs = spark.createDataFrame([("a", 1, "red ring red"), ("b", 2, "ring"), ("c", 3, "")], "id string, ord bigint, text string")
    q = spark.createDataFrame([("q", "red thing")], "qid string, text string")
    whole, part = retrieval.build_index(docs), retrieval.build_index(docs, retrieval.query_terms(q))
    assert part.totals.collect() == whole.totals.collect()
    assert [tuple(r) for r in part.terms.collect()] == [tuple(r) for r in whole.terms.filter("term = 'red'").collect()]
    assert retrieval.bm25(part, q).collect() == retrieval.bm25(whole, q).collect()
