"""Queries: index, BM25, vectors, fuzzy titles, intents, fused search, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import description_tokens, jaro_winkler_column, search_tokens
from tessera.operators import query_language, retrieval as R
from tessera.plans.bindings import NOW_MS
from tessera.plans.catalog import query

TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9_-]+'), lambda x: lower(x))"
INDEX = f"t AS (SELECT id, ord, {TOKENS.format('text')} AS tokens FROM {{docs}}), c AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM t), p AS (SELECT term, id, ord, dl, count(*) AS tf FROM (SELECT id, ord, len(tokens) AS dl, unnest(tokens) AS term FROM t) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term)"
IDF = "ln(((SELECT n FROM c) - df + 0.5) / (df + 0.5) + 1)"
WEIGHT = "tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (SELECT avgdl FROM c)))"


@query("G1_search_tokens", f"SELECT id, len({TOKENS.format('text')}) AS n, md5(array_to_string({TOKENS.format('text')}, ' ')) AS digest FROM {{docs}}")
def _(v):
    t = v("docs").select("id", search_tokens(F.col("text")).alias("t"))
    return t.select("id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("G3_description_tokens", "SELECT id, len(list_filter(string_split(description, ' '), lambda x: length(x) >= 3 AND regexp_full_match(x, '[A-Za-z0-9_.-]+'))) AS n FROM {items}")
def _(v):
    return v("items").select("id", F.size(description_tokens(F.col("description"))).cast("bigint").alias("n"))


@query("G4_simplified", "SELECT id, CASE WHEN ord % 2 = 0 THEN translate(text, '數據庫', '数据库') || '数据库简' ELSE text END AS text FROM {docs}")
def _(v):
    from tessera.functions.text import simplified

    text = F.when(F.col("ord") % 2 == 0, F.concat("text", F.lit("數據庫简"))).otherwise(F.col("text"))
    return v("docs").select("id", simplified(text, "數據庫", "数据库").alias("text"))


@query("G5_expand_query", "SELECT item_id, text || CASE WHEN regexp_matches(lower(text), '\\bdata\\b') THEN ' records tables' ELSE '' END || CASE WHEN regexp_matches(lower(text), '\\bthe\\b') THEN ' that' ELSE '' END AS expanded FROM {benchmark}")
def _(v):
    from tessera.functions.labels import expanded

    return v("benchmark").select("item_id", expanded(F.col("text"), {"data": ["records", "tables"], "the": ["that"], "数据": ["data"]}).alias("expanded"))


@query("G6_index", f"WITH {INDEX} SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM p GROUP BY term")
def _(v):
    i = R.build_index(v("docs"))
    return i.postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query("G7_idf", f"WITH {INDEX} SELECT term, df, round({IDF}, 6) AS idf FROM f")
def _(v):
    return R.build_index(v("docs")).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("G8_G9_term_weights", f"WITH {INDEX} SELECT id, round(sum({WEIGHT}), 4) AS weight FROM p GROUP BY id")
def _(v):
    i = R.build_index(v("docs"))
    w = i.postings.crossJoin(F.broadcast(i.totals)).withColumn("w", R.term_weight(F.col("tf"), R.length_norm(F.col("dl"), F.col("avgdl"))))
    return w.groupBy("id").agg(F.round(F.sum("w"), 4).alias("weight"))


BM25_SQL = f"WITH {INDEX}, q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT CAST(item_id AS STRING) AS qid, unnest({TOKENS.format('text')}) AS term FROM {{benchmark}}) GROUP BY ALL), s AS (SELECT q.qid, p.id, p.ord, round(sum(qtf * {IDF} * {WEIGHT}), 9) AS score FROM q JOIN f ON q.term = f.term JOIN p ON p.term = q.term {{0}} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank FROM s WHERE score > 0)"


def bm25_top(v, k, allowed=None):
    from pyspark.sql import Window

    queries = v("benchmark").select(F.col("item_id").cast("string").alias("qid"), "text")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("ord").asc())
    return R.bm25(R.build_index(v("docs"), R.query_terms(queries)), queries, allowed=allowed).withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


@query("G10_D12_bm25_recall", BM25_SQL.replace("{0}", "") + " SELECT qid, rank, id, round(score, 4) AS score FROM r WHERE rank <= 500")
def _(v):
    return bm25_top(v, 500).select("qid", "rank", "id", F.round("score", 4).alias("score"))


@query("G26_category_scope", BM25_SQL.replace("{0}", "WHERE p.id IN (SELECT id FROM {docs} WHERE lang = 'fr')") + " SELECT qid, rank, id, round(score, 4) AS score FROM r WHERE rank <= 20")
def _(v):
    return bm25_top(v, 20, v("docs").filter("lang = 'fr'")).select("qid", "rank", "id", F.round("score", 4).alias("score"))


@query("G12_jaro_winkler")
def _(v):
    i = v("items").select("id", "name")
    return i.select("id", F.round(jaro_winkler_column(F.col("name"), F.lit("small ring")), 6).alias("score"))


@query("G13_fuzzy_titles")
def _(v):
    return R.fuzzy_titles(v("items").withColumn("name_zh", F.lit(None).cast("string")), "smal rin").select("id", F.round("score", 6).alias("score"))


UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"


@query("G14_normalise", f"SELECT vec_id, round(list_sum({UNIT}), 5) AS total FROM {{embeddings}}")
def _(v):
    n = R.normalised(F.col("embedding"))
    return v("embeddings").select("vec_id", F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def index_of(v):
    return v("embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vec"), "label")


def query_vector(v):
    return [float(x) for x in v("embeddings").orderBy("vec_id").select("embedding").first()[0]]


COSINE = "SELECT CAST(e.vec_id AS STRING) AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM {embeddings} e, (SELECT embedding FROM {embeddings} ORDER BY vec_id LIMIT 1) q WHERE round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) >= 0.3"


@query("G15_G16_vector_recall", COSINE + " ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id LIMIT 300")
def _(v):
    return R.vector_top(index_of(v), query_vector(v)).select("id", F.round("score", 5).alias("score"))


@query("D13_scope_before_top", COSINE + " AND e.label = 3 ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id LIMIT 10")
def _(v):
    return R.vector_top(index_of(v), query_vector(v), 10, 0.3, index_of(v).filter("label = 3")).select("id", F.round("score", 5).alias("score"))


@query("A13_int8_codec", "WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_min(embedding)::DOUBLE AS low, list_max(embedding)::DOUBLE AS high FROM {embeddings}), s AS (SELECT vec_id, x, (high - low) / 254 AS scale, -low / ((high - low) / 254) - 127 AS zero FROM q) SELECT vec_id, round(scale, 8) AS scale, CAST(list_sum(list_transform(x, lambda e: greatest(-127, least(127, floor(e / scale + zero + 0.5))))) AS BIGINT) AS total FROM s")
def _(v):
    q = v("embeddings").select("vec_id", R.quantised(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.round("q.scale", 8).alias("scale"), F.aggregate("q.codes", F.lit(0).cast("bigint"), lambda a, c: a + c).alias("total"))


@query("G17_embedding_text", "SELECT id, substring(concat_ws(chr(10), '分类：' || category, name, description, '标签：' || array_to_string(tags, '、')), 1, 512) AS text FROM {items}")
def _(v):
    text = F.concat_ws("\n", F.concat(F.lit("分类："), "category"), "name", "description", F.concat(F.lit("标签："), F.array_join("tags", "、")))
    return v("items").select("id", F.substring(text, 1, 512).alias("text"))


CHANGES = "SELECT coalesce(b.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'remove' WHEN b.id IS NOT NULL AND a.name = b.name THEN 'reuse' ELSE 'embed' END AS action FROM {memory} b FULL JOIN {dictionary} a ON a.id = b.id"


@query("G18_incremental_index", CHANGES)
def _(v):
    return R.index_changes(v("memory").select("id", F.md5("name").alias("hash")), v("dictionary").select("id", F.md5("name").alias("hash")))


@query("G19_persistence_diff", f"SELECT action, count(*) AS n FROM ({CHANGES}) GROUP BY action")
def _(v):
    return R.index_changes(v("memory").select("id", F.md5("name").alias("hash")), v("dictionary").select("id", F.md5("name").alias("hash"))).groupBy("action").agg(F.count("*").alias("n"))


@query("G20_hash_embedding")
def _(v):
    from tessera.functions.embed import hash_embedding

    return v("items").select("id", hash_embedding(F.col("description"), 16).alias("vec"))


@query("G21_index_key", "SELECT id, CASE WHEN size % 3 = 0 THEN 'local|' || CASE WHEN size % 2 = 0 THEN 'small' ELSE category END WHEN size % 3 = 1 THEN 'api@https://' || lower(category) || '.example|' || category ELSE category END AS key FROM {items}")
def _(v):
    from tessera.functions.labels import index_key

    size = F.col("size")
    base = F.when(size % 3 == 1, F.concat(F.lit(" https://"), F.lower("category"), F.lit(".example// ")))
    model = F.when((size % 3 == 0) & (size % 2 == 0), F.lit(" ")).otherwise(F.col("category"))
    return v("items").select("id", index_key(F.when(size % 3 == 0, "local").otherwise("api"), base, model, "small").alias("key"))


@query("G23_G24_intents")
def _(v):
    profiles = [R.Profile("batch", "batch work", ("batch processing", "bulk edit"), ("batch", "bulk"))]
    rows = []
    for q in ("bulk edit without images", "notes -pdf", 'find "exact words" no ads', "-x"):
        i = R.parse_intent(q, profiles)
        rows.append((q, i.recall, i.positive, i.negative, i.phrases, [p.key for p in i.profiles], i.pure_negative))
    return v.spark.createDataFrame(rows, "query string, recall string, positive array<string>, negative array<string>, phrases array<string>, profiles array<string>, pure_negative boolean")


@query("G25_term_hits", "SELECT id, contains(lower(description), 'widget') OR contains(lower(description), 'bolt') AS hit, regexp_matches(lower(description), '(^|[^a-z0-9])red($|[^a-z0-9])') AS short_hit FROM {items}")
def _(v):
    t = F.lower("description")
    return v("items").select("id", R.term_hit(t, "widget", ["bolt"]).alias("hit"), R.term_hit(t, "red").alias("short_hit"))


def searchable(v):
    return v("items").join(v("translations").filter("source <> 'original'").select("id", F.col("translated_name").alias("name_zh"), F.col("translated_desc").alias("desc_zh")), "id", "left")


@query("G27_local_search")
def _(v):
    return R.local_search(searchable(v), "small ring without widget", NOW_MS, index_of(v), query_vector(v))


@query("F20_pure_negative")
def _(v):
    return R.local_search(searchable(v), "-ring", NOW_MS)


@query("F19_rerank", "WITH p AS (SELECT id, lower(description) AS t, coalesce(downloads, 0) / 1000 AS score FROM {items}) SELECT id, round(score * greatest(0.3, least(1.4, 1 + 0.12 * contains(t, 'small ring')::INT - 0.3 * contains(t, 'widget')::INT)), 6) AS rerank FROM p")
def _(v):
    intent = R.parse_intent('"small ring" without widget')
    pool = v("items").select("id", "description", (F.coalesce("downloads", F.lit(0.0)) / 1000).alias("score"))
    return R.rerank(pool, intent, F.col("description")).select("id", F.round("rerank", 6).alias("rerank"))


@query("G28_reranked_search")
def _(v):
    from tessera.operators.ai_search import reranked

    found = R.local_search(searchable(v), "small ring", NOW_MS)
    return reranked(found, searchable(v).select("id", "name"), lambda q, rows: [r["id"] for r in reversed(rows)], "small ring")


RANK = "r AS (SELECT CAST(source AS STRING) AS qid, CAST(doc_id AS STRING) AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM {documents})"


@query(
    "G31_metrics",
    f"WITH {RANK}, n AS (SELECT qid, bucket, count(*) AS wanted FROM {{gold}} GROUP BY ALL), h AS (SELECT g.qid, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, min(rank) AS best FROM {{gold}} g JOIN r ON g.qid = r.qid AND g.id = r.id GROUP BY g.qid) SELECT bucket, count(*) AS queries, round(avg(coalesce(h5, 0) / wanted), 6) AS recall_5, round(avg(coalesce(h10, 0) / wanted), 6) AS recall_10, round(avg(coalesce(1 / best, 0)), 6) AS mrr, round(avg(coalesce(h10, 0) / 10), 6) AS precision_10 FROM n LEFT JOIN h ON n.qid = h.qid GROUP BY bucket",
)
def _(v):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.col("n_chars").desc(), F.col("doc_id").asc())
    ranking = v("documents").select(F.col("source").alias("qid"), F.col("doc_id").cast("string").alias("id"), F.row_number().over(w).alias("rank"))
    return R.retrieval_metrics(ranking, v("gold"))


@query("I14_negative_hits", f"WITH {RANK} SELECT r.qid, count(*) FILTER (contains(lower(d.text), 'licensed')) AS hits FROM r JOIN {{docs}} d ON r.id = d.id WHERE rank <= 10 GROUP BY r.qid")
def _(v):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.col("n_chars").desc(), F.col("doc_id").asc())
    top = v("documents").withColumn("rank", F.row_number().over(w)).filter("rank <= 10")
    return top.groupBy(F.col("source").alias("qid")).agg(F.count(F.when(query_language.contains(F.col("text"), "licensed"), 1)).alias("hits"))
