"""Queries: the query language, filter dimensions, orders, facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import facets, filters, query_language, sorting
from tessera.operators.joins import with_stats
from tessera.plans.bindings import NOW_MS
from tessera.plans.catalog import query
from tessera.schema import DAY_MS

BLOB = "lower(concat_ws(' ', coalesce(name, ''), coalesce(id, ''), coalesce(description, ''), coalesce(author, '')))"
FIELDS = {"name": F.col, "id": F.col, "author": F.col, "description": F.col}


def fields() -> dict:
    return {k: F.col(k) for k in FIELDS} | {"any": query_language.search_blob("name", "id", "description", "author")}


def searched(v, text: str):
    return v("items").filter(query_language.text_filter(text, fields())).select("id", "name", "author")


@query("B1_search_blob", f"SELECT id, {BLOB} AS blob FROM {{items}}")
def _(v):
    return v("items").select("id", query_language.search_blob("name", "id", "description", "author").alias("blob"))


for _name, _text, _where in [
    ("B4_and", "red widget", f"contains({BLOB}, 'red') AND contains({BLOB}, 'widget')"),
    ("B5_or", "red|small ring | widget", f"(contains({BLOB}, 'red') OR contains({BLOB}, 'small')) AND (contains({BLOB}, 'ring') OR contains({BLOB}, 'widget'))"),
    ("B6_exclude", "ring -small", f"contains({BLOB}, 'ring') AND NOT contains({BLOB}, 'small')"),
    ("B7_field_scope", "name:ring author:brand#1", "contains(lower(name), 'ring') AND contains(lower(author), 'brand#1')"),
    ("B8_phrase", '"small ring"', f"contains({BLOB}, 'small ring')"),
    ("B9_plain_text", "econ", f"contains({BLOB}, 'econ')"),
    ("B5_or_before_exclude", "red | -small", f"contains({BLOB}, 'red') AND NOT contains({BLOB}, 'small')"),
    ("B6_empty_exclude", '-""', "false"),
    ("C15_text_last", "desc:promo ring", f"contains(lower(description), 'promo') AND contains({BLOB}, 'ring')"),
]:
    query(_name, f"SELECT id, name, author FROM {{items}} WHERE {_where}")(lambda v, t=_text: searched(v, t))


@query("B10_semantic_query", "WITH t AS (SELECT conv_id, turn, trim(text) AS x FROM {conversations}) SELECT conv_id, turn, CASE WHEN length(x) <= 3 THEN false WHEN regexp_full_match(x, '[0-9]+') THEN false WHEN length(x) > 15 THEN true ELSE len(string_split_regex(x, '[ \\t\\n\\x0b\\f\\r]+')) >= 5 END AS semantic FROM t")
def _(v):
    return v("conversations").select("conv_id", "turn", query_language.is_semantic_query(F.col("text")).alias("semantic"))


SOURCE = "SELECT i.id FROM {items} i LEFT JOIN {translations} t ON i.id = t.id WHERE "


def with_source(v):
    return v("items").join(v("translations").select("id", "source"), "id", "left")


@query("C1_translated", SOURCE + "coalesce(t.source, 'original') <> 'original'")
def _(v):
    return with_source(v).filter(filters.translated(F.col("source"))).select("id")


@query("C2_never_translated", SOURCE + "coalesce(t.source, 'original') = 'original' AND i.id NOT IN (SELECT id FROM {memory} UNION ALL SELECT id FROM {dictionary})")
def _(v):
    return filters.untranslated_ever(with_source(v), v("memory"), v("dictionary")).select("id")


for _state, _where in [("installed", "id IN (SELECT id FROM {installed})"), ("enabled", "id IN (SELECT id FROM {enabled})"), ("installedNotEnabled", "id IN (SELECT id FROM {installed}) AND id NOT IN (SELECT id FROM {enabled})")]:
    query(f"C3_{_state.lower()}", f"SELECT id, name FROM {{items}} WHERE {_where}")(lambda v, s=_state: filters.install_state(v("items"), s, v("installed"), v("enabled")).select("id", "name"))


@query("C4_author", "SELECT id FROM {items} WHERE author = 'Brand#3'")
def _(v):
    return v("items").filter(F.col("author") == "Brand#3").select("id")


for _name, _view, _wanted in [("C5_recommended_only", "curated", True), ("C6_favorited", "favorites", True), ("C6_unfavorited", "favorites", False), ("C8_series", "picks", True), ("C9_tried", "history", True)]:
    query(_name, f"SELECT id FROM {{items}} WHERE id {'' if _wanted else 'NOT '}IN (SELECT id FROM {{{_view}}})")(lambda v, t=_view, w=_wanted: filters.members(v("items"), v(t), w).select("id"))


@query("C8_series_missing", "SELECT id FROM {items} WHERE false")
def _(v):
    return filters.series(v("items"), None).select("id")


@query("C10_abandoned", "SELECT id FROM {items} WHERE id IN (SELECT id FROM {reviews} WHERE status = 'abandoned')")
def _(v):
    return filters.members(v("items"), v("reviews").filter("status = 'abandoned'")).select("id")


@query("C11_verdict", "SELECT id FROM {items} WHERE id IN (SELECT id FROM {reviews} WHERE list_contains(verdict, 'slow'))")
def _(v):
    return filters.members(v("items"), v("reviews").filter(F.array_contains("verdict", "slow"))).select("id")


@query("C12_new_within", f"SELECT id FROM {{items}} WHERE first_listed_at > 0 AND {NOW_MS} - first_listed_at <= {120 * DAY_MS}")
def _(v):
    return v("items").filter(filters.new_within(F.col("first_listed_at"), 120, NOW_MS)).select("id")


for _days, _test in [(90, f"<= {90 * DAY_MS}"), (-90, f"> {90 * DAY_MS}")]:
    query(f"C13_updated_{'within' if _days > 0 else 'before'}_90", f"SELECT id FROM {{items}} WHERE updated > 0 AND {NOW_MS} - updated {_test}")(lambda v, d=_days: v("items").filter(filters.updated_within(F.col("updated"), d, NOW_MS)).select("id"))


@query("C14_categories", "SELECT id FROM {items} WHERE category IN ('PROMO', 'ECONOMY')")
def _(v):
    return v("items").filter(filters.in_categories(F.col("category"), ["PROMO", "ECONOMY"])).select("id")


@query("C16_manage_filter", "SELECT id FROM {managed} WHERE (contains(lower(name), 'ring') OR contains(lower(author), 'ring') OR contains(lower(remark), 'ring')) AND grp = 'work' AND enabled")
def _(v):
    return v("managed").filter(filters.manage_filter("Ring", "work", "enabled")).select("id")


@query("C16_empty_remark", "SELECT id FROM {managed} WHERE trim(remark) = ''")
def _(v):
    return v("managed").filter(filters.manage_filter("???")).select("id")


@query("C17_journal_filter", "SELECT id FROM {reviews} WHERE status = 'abandoned' AND list_contains(verdict, 'slow') AND contains(lower(concat_ws(' ', name, id, note)), 'red')")
def _(v):
    return v("reviews").filter(filters.journal_filter("abandoned", "slow", "Red")).select("id")


@query("C17_journal_tried", "SELECT id FROM {reviews} WHERE status IS NULL")
def _(v):
    return v("reviews").filter(filters.journal_filter("tried")).select("id")


@query("C18_favorites_bucket", "SELECT f.id FROM {favorites} f JOIN {items} i ON f.id = i.id WHERE f.grp IS NULL AND contains(lower(i.name), 'ring')")
def _(v):
    return v("favorites").filter("grp IS NULL").join(v("items"), "id").filter(query_language.contains(F.col("name"), "ring")).select("id")


@query("C19_ranked_membership", "WITH r AS (SELECT CAST(doc_id AS STRING) AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM {documents}) SELECT r.rank, i.id, i.name FROM r JOIN {items} i ON r.id = i.id")
def _(v):
    from tessera.operators.scoring import global_rank

    r = global_rank(v("documents"), [F.col("n_chars").desc(), F.col("doc_id").asc()], "rank").select(F.col("doc_id").cast("string").alias("id"), (F.col("rank") + 1).alias("rank"))
    return r.join(v("items"), "id").select("rank", "id", "name")


def sortable(v):
    flag = lambda t, name: v(t).select("id", F.lit(True).alias(name))
    i = v("items").join(flag("installed", "installed"), "id", "left").join(flag("favorites", "favorite"), "id", "left").join(flag("picks", "pick"), "id", "left")
    return i.withColumns({"display_name": F.col("name"), "trending": F.col("size") / 50, "recommended": F.when(F.col("size") > 3, F.col("size").cast("double")), "at_risk": F.col("updated") < NOW_MS - 365 * DAY_MS})


SORTABLE = "(SELECT *, id IN (SELECT id FROM {installed}) AS installed, id IN (SELECT id FROM {favorites}) AS favorite, id IN (SELECT id FROM {picks}) AS pick, size / 50 AS trending, CASE WHEN size > 3 THEN CAST(size AS DOUBLE) END AS recommended, coalesce(updated < " + str(NOW_MS - 365 * DAY_MS) + ", false) AS at_risk FROM {items}) s"
for _name, _order, _sql in [
    ("D1_relevance", "relevance", "ord"),
    ("D2_downloads", "downloads", "coalesce(downloads, 0) DESC, ord"),
    ("D3_updated", "updated", "updated DESC NULLS LAST, ord"),
    ("D4_published", "published", "list_index DESC NULLS LAST, ord"),
    ("D5_name", "name", "name, ord"),
    ("D6_popular", "popular", "installed, coalesce(downloads, 0) DESC, updated DESC NULLS LAST, ord"),
    ("D7_trending", "trending", "coalesce(trending, 0) DESC, ord"),
    ("D8_recommended", "recommended", "coalesce(recommended, 0) DESC, ord"),
]:

    def _ordered(v, o=_order):
        from tessera.operators.scoring import global_rank

        return global_rank(sortable(v), sorting.keys(o), "position").select("id", (F.col("position") + 1).alias("position"))

    query(_name, f"SELECT id, row_number() OVER (ORDER BY {_sql}) AS position FROM {SORTABLE}")(_ordered)


@query("D9_D10_D11_overlays", f"SELECT id, row_number() OVER (ORDER BY at_risk, pick DESC, favorite DESC, coalesce(downloads, 0) DESC, ord) AS position FROM {SORTABLE}")
def _(v):
    from tessera.operators.scoring import global_rank

    return global_rank(sortable(v), sorting.overlays(sorting.keys("downloads")), "position").select("id", (F.col("position") + 1).alias("position"))


@query("D14_top_fused", "SELECT id, coalesce(downloads, 0) AS score FROM {items} ORDER BY score DESC, ord LIMIT 25")
def _(v):
    return sorting.top_k(v("items").withColumn("score", F.coalesce("downloads", F.lit(0.0))), 25).select("id", "score")


for _by, _sql in [("rating", "coalesce(rating, 0) DESC, lower(name) DESC, id DESC"), ("status", "CASE status WHEN 'using' THEN 0 WHEN 'abandoned' THEN 1 WHEN 'watching' THEN 2 ELSE 3 END DESC, lower(name) DESC, id DESC")]:

    def _journal(v, by=_by):
        from tessera.operators.scoring import global_rank

        return global_rank(v("reviews").withColumn("last_active", F.col("updated")), sorting.journal_keys(by, True), "position").select("id", (F.col("position") + 1).alias("position"))

    query(f"D15_journal_by_{_by}", f"SELECT id, row_number() OVER (ORDER BY {_sql}) AS position FROM {{reviews}}")(_journal)


@query("D16_window", "SELECT id, name FROM {items} ORDER BY coalesce(downloads, 0) DESC, ord LIMIT 16 OFFSET 17")
def _(v):
    return sorting.page(v("items"), sorting.keys("downloads"), 40, 800, 400).select("id", "name")


@query("I1_category_counts", "SELECT category, count(*) AS n FROM {items} GROUP BY category")
def _(v):
    return facets.counts(v("items"), "category")


@query("I2_categories", "SELECT DISTINCT category FROM {items}")
def _(v):
    return v("items").filter("category <> ''").select("category").distinct()


@query("I3_tag_counts", "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM {items}) GROUP BY tag")
def _(v):
    return facets.tag_counts(v("items"))


@query("I4_ids_by_tag", "SELECT id FROM {items} WHERE list_contains(tags, 'size3') AND category = 'PROMO'")
def _(v):
    return v("items").filter(F.array_contains("tags", "size3") & (F.col("category") == "PROMO")).select("id")


@query("I5_author_facet", "SELECT author, count(*) AS n, CASE WHEN regexp_matches(author, '^[A-Za-z]') THEN upper(author[1]) ELSE '#' END AS letter FROM {items} GROUP BY author HAVING count(*) >= 2")
def _(v):
    return facets.author_facet(v("items"), {})


@query("I6_coverage", "WITH h AS (SELECT i.id, i.id IN (SELECT id FROM {memory} WHERE status = 'approved' AND trim(name) <> '') AS m, i.id IN (SELECT id FROM {translations} WHERE source <> 'original') AS c FROM {items} i) SELECT count(*) AS total, count(*) FILTER (m) AS bulk_hits, count(*) FILTER (c AND NOT m) AS cache_hits, count(*) FILTER (c OR m) AS covered, round(count(*) FILTER (c OR m) / count(*), 6) AS coverage FROM h")
def _(v):
    return facets.coverage(v("items"), v("memory"), v("translations"))


@query("I7_coverage_history", "WITH h AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS version, sum(o_totalprice) AS total FROM {orders} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY date DESC) AS n FROM h) SELECT CAST(date AS STRING) AS date, version, round(total, 2) AS total FROM r WHERE n = 1 ORDER BY r.date DESC, version DESC LIMIT 12")
def _(v):
    from tessera.operators.history import latest_versions

    h = v("orders").groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("version")).agg(F.sum("o_totalprice").alias("total"))
    return latest_versions(h).select(F.col("date").cast("string").alias("date"), "version", F.round("total", 2).alias("total"))


@query("I8_review_stats", "SELECT count(*) FILTER (status = 'using') AS \"using\", count(*) FILTER (status = 'abandoned') AS abandoned, count(*) FILTER (status = 'watching') AS watching, count(*) FILTER (status IS NULL) AS tried, count(rating) AS rated, round(count(*) FILTER (status = 'abandoned') / count(status), 6) AS abandon_rate, CAST(sum(install_count) AS BIGINT) AS installs FROM {reviews}")
def _(v):
    return facets.review_stats(v("reviews"))


@query("I8_top_verdicts", "SELECT verdict, count(*) AS n FROM (SELECT unnest(verdict) AS verdict FROM {reviews}) GROUP BY verdict ORDER BY n DESC, verdict LIMIT 5")
def _(v):
    return facets.top_verdicts(v("reviews"))


@query("I9_verdict_ids", "SELECT verdict, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM (SELECT id, unnest(verdict) AS verdict FROM {reviews}) GROUP BY verdict")
def _(v):
    return facets.verdict_ids(v("reviews")).select("verdict", F.array_join("ids", ",").alias("ids"))


@query("I10_group_counts", "SELECT coalesce(grp, 'all') AS grp, count(*) AS n FROM {managed} WHERE enabled AND contains(lower(concat_ws(chr(10), name, author, remark)), 'ring') GROUP BY GROUPING SETS ((grp), ())")
def _(v):
    return facets.with_total(v("managed").filter(filters.manage_filter("ring", "", "enabled")), "grp")


@query("I11_group_members", "SELECT coalesce(grp, 'all') AS grp, count(*) AS n FROM {managed} GROUP BY GROUPING SETS ((grp), ())")
def _(v):
    return facets.with_total(v("managed"), "grp")


@query("I12_status_buckets", "SELECT CASE WHEN size IN (2, 3) THEN 'outdated' WHEN size = 50 THEN 'pinned' WHEN size > 7 THEN 'disabled' ELSE 'latest' END AS bucket, count(*) AS n FROM {items} GROUP BY 1")
def _(v):
    return v("items").groupBy(facets.update_bucket(F.col("size").isin(2, 3), F.col("size") == 50, F.col("size") <= 7).alias("bucket")).agg(F.count("*").alias("n"))


GROUPS = [("home", 0), ("archive", 1), ("work", 2)]


@query("I13_favorite_buckets", "SELECT g.grp, count(f.id) AS n, g.position FROM (VALUES ('home', 0::BIGINT), ('archive', 1), ('work', 2)) AS g(grp, position) LEFT JOIN {favorites} f ON f.grp = g.grp GROUP BY g.grp, g.position UNION ALL SELECT '__none__', count(*), 1000000 FROM {favorites} WHERE grp IS NULL")
def _(v):
    return facets.favorite_buckets(v("favorites"), v.spark.createDataFrame(GROUPS, "grp string, position bigint"))


@query("I15_class_distribution", "SELECT category, count(*) AS n FROM (SELECT CASE WHEN contains(lower(name), 'ring') THEN 'jewellery' WHEN contains(lower(name), 'widget') THEN 'parts' ELSE 'other' END AS category FROM {items}) GROUP BY category")
def _(v):
    from tessera.operators.batch import classify

    return facets.counts(classify(v("items"), [("jewellery", 1.0, ["ring"]), ("parts", 1.0, ["widget"])], F.col("name")), "category")


@query("I16_first_seen", "SELECT id, min(ts) AS ts FROM {samples} GROUP BY id")
def _(v):
    return v("samples").groupBy("id").agg(F.min("ts").alias("ts"))


@query("E1_with_stats", "SELECT i.id, coalesce(s.downloads, i.downloads) AS downloads, coalesce(s.updated, i.updated) AS updated FROM {items} i LEFT JOIN {stats} s ON i.id = s.id")
def _(v):
    return with_stats(v("items"), v("stats")).select("id", "downloads", "updated")
