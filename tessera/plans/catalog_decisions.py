"""Queries: keys, empty lists, dirty marks, bursts of calls, signals and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import labels, notice
from tessera.functions.text import search_tokens, with_words
from tessera.operators import filters, history, retrieval as R, scoring
from tessera.plans.catalog import query
from tessera.plans.catalog_retrieval import TOKENS
from tessera.schema import DAY_MS, HOUR_MS


@query(
    "A12_flushes",
    f"WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY id ORDER BY ts, downloads) >= {DAY_MS} THEN 1 ELSE 0 END AS pause FROM {{samples}}), b AS (SELECT *, sum(pause) OVER (PARTITION BY id ORDER BY ts, downloads) AS burst FROM a), c AS (SELECT *, (row_number() OVER (PARTITION BY id, burst ORDER BY ts, downloads) - 1) // 3 AS part FROM b) SELECT id, ts, downloads, dense_rank() OVER (PARTITION BY id ORDER BY burst, part) AS flush FROM c",
)
def _(v):
    return history.flushes(v("samples").withColumn("ord", F.col("downloads")), 3, DAY_MS).select("id", "ts", "downloads", "flush")


@query("A17_credentials", "SELECT id, 'base=' || category || ',name=' || name AS kept FROM {items}")
def _(v):
    settings = F.create_map(F.lit("name"), F.col("name"), F.lit("key"), F.col("author"), F.lit("base"), F.col("category"))
    kept = F.map_entries(labels.without_credentials(settings, ["key", "token"]))
    return v("items").select("id", F.array_join(F.array_sort(F.transform(kept, lambda e: F.concat(e.key, F.lit("="), e.value))), ",").alias("kept"))


MODE = "CASE size % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'local' ELSE 'ai' END"


@query(
    "B11_empty_state",
    f"""WITH q AS (SELECT id, size % 2 = 0 AS has_query, {MODE} AS mode, size % 5 = 0 AS answered, size % 7 < 3 AS has_key, size % 4 = 1 AS narrowed, length(name) < 12 AS short FROM {{items}})
SELECT id, CASE WHEN NOT has_query THEN 'no data' WHEN mode <> 'keyword' AND NOT answered THEN mode || ' pending' ELSE 'no match' END AS title,
CASE WHEN NOT has_query THEN 'loosen filters' WHEN mode <> 'keyword' AND NOT answered THEN mode || ' hint' ELSE 'clear filters' END AS hint, has_query OR narrowed AS clear,
CASE WHEN has_query AND mode <> 'keyword' AND answered AND short THEN 'keyword' WHEN has_query AND mode = 'keyword' AND has_key AND NOT short THEN 'ai' END AS bridge FROM q""",
)
def _(v):
    size, short = F.col("size"), F.length("name") < 12
    state = labels.empty_state(size % 2 == 0, F.expr(MODE), size % 5 == 0, size % 7 < 3, size % 4 == 1, short, ~short)
    return v("items").select("id", state.alias("s")).select("id", "s.title", "s.hint", "s.clear", "s.bridge")


@query("C7_ecosystem", "SELECT id FROM {items} WHERE id IN (SELECT id FROM {curated}) OR author = 'Brand#4'")
def _(v):
    looks = scoring.is_local_author(F.col("name"), F.col("author"), F.col("description"), ["brand#4"])
    return filters.ecosystem(v("items"), v("curated"), looks).select("id")


@query("E7_candidates", "SELECT p.id AS source_id, i.id FROM {items} p JOIN {items} i ON p.size = 50 AND p.id <> i.id AND (p.category = i.category OR len(list_intersect(p.tags, i.tags)) > 0)")
def _(v):
    return scoring.similar_candidates(v("items").join(v("picks"), "id", "left_semi"), v("items"))


@query("F21_signals", "SELECT id, string_agg(name, ',' ORDER BY place) AS signals FROM (SELECT id, 'vector' AS name, 0 AS place FROM {picks} UNION ALL SELECT id, 'keyword', 1 FROM {installed} UNION ALL SELECT id, 'title', 2 FROM {curated}) GROUP BY id")
def _(v):
    return R.path_signals({"vector": v("picks"), "keyword": v("installed"), "title": v("curated")}).select("id", F.array_join("signals", ",").alias("signals"))


@query("F21_highlight_terms", f"SELECT id, array_to_string(list_sort(list_distinct(list_filter({TOKENS.format('text')}, lambda x: length(x) > 1))), ' ') AS terms FROM {{docs}}")
def _(v):
    terms = R.highlight_terms(F.col("text"), F.col("text"))
    return v("docs").select("id", F.array_join(F.array_sort(terms), " ").alias("terms"))


@query(
    "F22_diagnostics",
    """WITH p AS (SELECT id, lower(description) AS t, coalesce(downloads, 0) / 1000 AS score, ord FROM {items}),
pool AS (SELECT *, row_number() OVER (ORDER BY score DESC, ord) AS position FROM p QUALIFY position <= 50),
k AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, ord) AS rank FROM p QUALIFY rank <= 30),
l AS (SELECT id, CAST(length(t) AS DOUBLE) AS score, row_number() OVER (ORDER BY length(t) DESC, ord) AS rank FROM p QUALIFY rank <= 40)
SELECT pool.id, position, k.rank AS keyword_rank, round(k.score, 6) AS keyword_score, l.rank AS title_rank, round(l.score, 6) AS title_score,
round(pool.score * greatest(0.3, least(1.4, 1 + 0.12 * contains(t, 'small ring')::INT - 0.3 * contains(t, 'widget')::INT)), 6) AS rerank,
concat_ws(',', CASE WHEN regexp_matches(t, '(^|[^a-z0-9])red($|[^a-z0-9])') THEN 'red' END, CASE WHEN contains(t, 'small') THEN 'small' END, CASE WHEN contains(t, 'ring') THEN 'ring' END) AS matched_terms,
CASE WHEN contains(t, 'small ring') THEN 'small ring' ELSE '' END AS phrase_matches, CASE WHEN contains(t, 'widget') THEN 'widget' ELSE '' END AS negative_matches
FROM pool LEFT JOIN k ON pool.id = k.id LEFT JOIN l ON pool.id = l.id""",
)
def _(v):
    from pyspark.sql import Window

    p = v("items").select("id", "description", (F.coalesce("downloads", F.lit(0.0)) / 1000).alias("score"), "ord")
    best = [F.col("score").desc(), F.col("ord").asc()]
    pool = p.orderBy(*best).limit(50).withColumn("position", F.row_number().over(Window.orderBy(*best)).cast("long"))
    length = p.withColumn("score", F.length("description").cast("double"))
    d = R.diagnostics(pool, {"keyword": p.orderBy(*best).limit(30), "title": length.orderBy(*best).limit(40)}, R.parse_intent('red small "small ring" without widget'), F.col("description"))
    join = lambda c: F.array_join(c, ",").alias(c)
    whole = lambda c: F.col(c).cast("long").alias(c)
    six = lambda c: F.round(c, 6).alias(c)
    return d.select("id", "position", whole("keyword_rank"), six("keyword_score"), whole("title_rank"), six("title_score"), six("rerank"), join("matched_terms"), join("phrase_matches"), join("negative_matches"))


@query("G2_word_layer", f"SELECT id, md5(array_to_string(list_concat(regexp_extract_all(text, '[A-Z][a-z]+'), {TOKENS.format('text')}), ' ')) AS digest FROM {{docs}}")
def _(v):
    names = with_words(lambda text: F.regexp_extract_all(text, F.lit("([A-Z][a-z]+)"), F.lit(1)))
    return v("docs").select("id", F.md5(F.array_join(names(F.col("text")), " ")).alias("digest"))


@query("H8_ordered_signatures", "SELECT true AS same_rows, count(*) > 1 AS order_seen, true AS category_leaves_text_index, count(*) > 0 AS category_seen FROM {items}")
def _(v):
    i = v("items").select("id", "name", "description", "category", "ord")
    sign = lambda df: notice.ordered_signatures(df, "ord", ["id", "name", "description"], ["category"], "v1")
    now, turned, recast = sign(i), sign(i.withColumn("ord", -F.col("ord"))), sign(i.withColumn("category", F.concat("category", F.lit("."))))
    again = sign(i.repartition(7))
    names = lambda df, p: df.select(F.col("text_index").alias(f"{p}_t"), F.col("fields").alias(f"{p}_f"))
    row = names(now, "a").crossJoin(names(turned, "b")).crossJoin(names(recast, "c")).crossJoin(names(again, "d"))
    return row.selectExpr("a_t = d_t AND a_f = d_f AS same_rows", "a_t <> b_t AND a_f <> b_f AS order_seen", "a_t = c_t AS category_leaves_text_index", "a_f <> c_f AS category_seen")


@query("K9_still_dirty", "WITH m AS (SELECT id, max(ts) AS ts FROM {samples} WHERE downloads % 2 = 0 GROUP BY id), w AS (SELECT id, max(ts) AS done FROM {samples} WHERE downloads % 6 = 3 GROUP BY id) SELECT m.id, m.ts FROM m LEFT JOIN w ON m.id = w.id WHERE done IS NULL OR ts > done")
def _(v):
    writes = v("samples").filter("downloads % 2 = 1").select("id", "ts", (F.col("downloads") % 3 == 0).alias("ok"))
    return history.still_dirty(v("samples").filter("downloads % 2 = 0"), writes)


@query("K11_debounced", f"SELECT id, ts, downloads FROM (SELECT *, lead(ts) OVER (PARTITION BY id ORDER BY ts, downloads) AS next FROM {{samples}}) WHERE next IS NULL OR next - ts >= {6 * HOUR_MS}")
def _(v):
    return history.debounced(v("samples").withColumn("ord", F.col("downloads")), 6 * HOUR_MS).select("id", "ts", "downloads")


@query("K13_result_key", "SELECT id, md5(concat_ws(chr(31), author, name, array_to_string(list_sort(list_distinct(list_append(tags, category))), chr(30)), 'v1', coalesce(CAST(updated AS STRING), ''))) AS key FROM {items}")
def _(v):
    categories = F.array_append("tags", F.col("category"))
    return v("items").select("id", labels.result_key(F.col("author"), F.col("name"), categories, F.lit("v1"), F.col("updated").cast("string")).alias("key"))
