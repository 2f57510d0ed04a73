"""Queries: scores, signals, trends, similarity, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import description_tokens
from tessera.operators import history, scoring
from tessera.plans.bindings import EVENTS_NOW_MS, NOW_MS
from tessera.plans.catalog import query
from tessera.schema import DAY_MS, HOUR_MS

RECENCY = f"CASE WHEN updated IS NULL OR updated <= 0 OR updated > {NOW_MS} THEN 1.0 ELSE greatest(0.85, exp(-(({NOW_MS} - updated) / {DAY_MS}.0) / 730)) END"
POPULAR = "CASE WHEN downloads > 0 THEN 1 + 0.15 * least(1, log10(1 + downloads) / log10(1 + (SELECT max(downloads) FROM {items}))) ELSE 1.0 END"


@query("F1_recency", f"SELECT id, round({RECENCY}, 6) AS factor FROM {{items}}")
def _(v):
    return v("items").select("id", F.round(scoring.recency_factor(F.col("updated"), NOW_MS), 6).alias("factor"))


@query("F2_popularity", f"SELECT id, round({POPULAR}, 6) AS factor FROM {{items}}")
def _(v):
    i = scoring.with_scalars(v("items"), most=F.max("downloads"))
    return i.select("id", F.round(scoring.popularity_factor(F.col("downloads"), F.col("most")), 6).alias("factor"))


@query("F3_quality", f"SELECT r.id, round(r.score * coalesce(q.f, 1), 6) AS score FROM (SELECT CAST(doc_id AS STRING) AS id, n_chars / 1000.0 AS score FROM {{documents}}) r LEFT JOIN (SELECT id, {RECENCY} * {POPULAR} AS f FROM {{items}}) q ON r.id = q.id")
def _(v):
    r = v("documents").select(F.col("doc_id").cast("string").alias("id"), (F.col("n_chars") / 1000).alias("score"))
    return scoring.apply_quality(r, v("items"), NOW_MS).select("id", F.round("score", 6).alias("score"))


VELOCITY = "l AS (SELECT i.id, log10(i.downloads * 2 - i.downloads + 1) AS x FROM {items} i WHERE i.downloads > 0 AND i.size < 40 AND i.downloads IS NOT NULL), z AS (SELECT id, CASE WHEN (SELECT stddev_pop(x) FROM l) > 1e-12 THEN 1 / (1 + exp(-(x - (SELECT avg(x) FROM l)) / (SELECT stddev_pop(x) FROM l))) ELSE 0 END AS v FROM l)"


def velocity(v):
    now = v("items").filter("size < 40").select("id", (F.col("downloads") * 2).alias("downloads"))
    return scoring.velocity_scores(now, v("items"))


@query("F5_velocity", f"WITH {VELOCITY} SELECT id, round(v, 6) AS velocity FROM z")
def _(v):
    return velocity(v).select("id", F.round("velocity", 6).alias("velocity"))


@query(
    "F4_smart_signals",
    f"WITH {VELOCITY}, r AS (SELECT id, updated, row_number() OVER (ORDER BY coalesce(downloads, 0) DESC, ord) - 1 AS k, count(*) OVER () AS n FROM {{items}}) SELECT r.id, array_to_string(list_filter([CASE WHEN k < greatest(1, ceil(n * 0.01)) THEN 'top1' WHEN k < greatest(1, ceil(n * 0.05)) THEN 'top5' WHEN k < greatest(1, ceil(n * 0.1)) THEN 'hot10' END, CASE WHEN updated > {NOW_MS - 90 * DAY_MS} THEN 'recentActive' END, CASE WHEN updated > {NOW_MS - 30 * DAY_MS} THEN 'recentUpdate' END, CASE WHEN coalesce(z.v, 0) > 0.5 THEN 'velocityRising' END], lambda x: x IS NOT NULL)[1:3], ',') AS signals FROM r LEFT JOIN z ON r.id = z.id",
)
def _(v):
    s = scoring.smart_signals(v("items"), NOW_MS, velocity(v))
    return s.select("id", F.array_join("signals", ",").alias("signals"))


@query(
    "F6_F7_recommend",
    f"WITH r AS (SELECT id, downloads, updated, size, row_number() OVER (ORDER BY coalesce(downloads, 0) DESC, ord) - 1 AS k, count(*) OVER () AS n, greatest(1, max(downloads) OVER ()) AS most FROM {{items}}) SELECT id, CAST(floor(least(1, greatest(0, 0.3 * (1 - k / n) + 0.3 * log10(coalesce(downloads, 0) + 1) / log10(most + 1) + 0.1 * CASE WHEN updated > {NOW_MS - 90 * DAY_MS} THEN 1 ELSE 0 END + 0.2 * size / 50.0)) * 100 + 0.5) AS BIGINT) AS recommended FROM r",
)
def _(v):
    return scoring.recommend_scores(v("items"), F.col("updated") > NOW_MS - 90 * DAY_MS, F.col("size") / 50).select("id", "recommended")


@query("F8_health", f"SELECT id, CASE WHEN updated IS NULL OR updated <= 0 THEN 'aging' WHEN floor(({NOW_MS} - updated) / {DAY_MS}) <= 120 THEN 'healthy' WHEN floor(({NOW_MS} - updated) / {DAY_MS}) <= 365 THEN 'aging' ELSE 'at-risk' END AS health FROM {{items}}")
def _(v):
    return v("items").select("id", scoring.health(F.col("updated"), NOW_MS).alias("health"))


@query("F9_local_author", "SELECT id, author IN ('Brand#1', 'Brand#2') AS local FROM {items}")
def _(v):
    return v("items").select("id", scoring.is_local_author(F.col("name"), F.col("author"), F.col("description"), ["brand#1", "brand#2"]).alias("local"))


@query("F10_is_new", f"SELECT id, coalesce(first_listed_at > 0 AND {NOW_MS} - first_listed_at <= {120 * DAY_MS}, false) AS is_new FROM {{items}}")
def _(v):
    return v("items").select("id", scoring.is_new(F.col("first_listed_at"), NOW_MS, 120).alias("is_new"))


TREND = f"w AS (SELECT s.* FROM {{samples}} s JOIN (SELECT id, max(ts) AS m FROM {{samples}} GROUP BY id) l ON s.id = l.id AND s.ts >= l.m - {30 * DAY_MS}), e AS (SELECT id, arg_max(downloads, ts) AS d1, arg_min(downloads, ts) AS d0, max(ts) AS t1, min(ts) AS t0, count(*) AS n FROM w GROUP BY id), t AS (SELECT id, CASE WHEN n < 2 OR t1 - t0 < {HOUR_MS} THEN 0.5 WHEN d1 <= d0 THEN 0 ELSE least(1, log10((d1 - d0) / ((t1 - t0) / {DAY_MS}.0) + 1) / 4) END AS trend, CASE WHEN n >= 2 THEN d1 - d0 END AS delta FROM e)"


@query("F11_trend", f"WITH {TREND} SELECT id, round(trend, 6) AS trend FROM t")
def _(v):
    return scoring.trend_scores(v("samples")).select("id", F.round("trend", 6).alias("trend"))


@query("F12_batch_trend", f"WITH {TREND}, r AS (SELECT i.id, coalesce(t.trend, 0.5) AS x FROM {{items}} i LEFT JOIN t ON i.id = t.id), s AS (SELECT avg(x) AS m, stddev_pop(x) AS d FROM r) SELECT id, round(CASE WHEN d > 1e-12 THEN 1 / (1 + exp(-(x - m) / d)) ELSE 0.5 END, 6) AS trend FROM r, s")
def _(v):
    return scoring.batch_trend(v("items"), scoring.trend_scores(v("samples"))).select("id", F.round("trend", 6).alias("trend"))


@query("F13_delta", f"WITH {TREND} SELECT id, delta FROM t")
def _(v):
    return scoring.trend_scores(v("samples")).select("id", "delta")


@query("F14_sparkline", "WITH p AS (SELECT id, list(downloads ORDER BY ts, downloads) AS v FROM {samples} GROUP BY id HAVING count(*) >= 2) SELECT id, len(v) AS points FROM p")
def _(v):
    return scoring.sparkline(v("samples")).select("id", F.size(F.split("path", " ")).cast("bigint").alias("points"))


STOP = "('the', 'a', 'an', 'is', 'are', 'was', 'were', 'be', 'been', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'and', 'or', 'it', 'its', 'this', 'that', 'you', 'your', 'can', 'will', 'not', 'no', 'has', 'have', 'had', 'do', 'does', 'did', 'from', 'by', 'as', 'but', 'all', 'so', 'we', 'our')"


@query(
    "F15_similar",
    f"WITH s AS (SELECT id, ord, category, tags, list_filter(list_transform(string_split(description, ' '), lambda x: lower(x)), lambda x: length(x) >= 3 AND x NOT IN {STOP} AND regexp_full_match(x, '[a-z0-9_.-]+')) AS tokens FROM {{items}}), p AS (SELECT a.id AS source_id, b.id, b.ord, a.category = b.category AS same, len(list_intersect(a.tags, b.tags)) AS shared, len(list_intersect(list_distinct(a.tokens), list_distinct(b.tokens))) AS i, len(list_distinct(list_concat(a.tokens, b.tokens))) AS u FROM s a JOIN s b ON a.id <> b.id AND (a.category = b.category OR list_has_any(a.tags, b.tags)) WHERE a.id IN (SELECT id FROM {{picks}})), q AS (SELECT *, CASE WHEN same THEN 4.0 ELSE 0.0 END + 2.0 * shared + 2.0 * i / u AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(score, 9) DESC, ord) AS position FROM q WHERE score > 0) SELECT source_id, id, round(score, 6) AS score, shared AS shared_tags, position FROM r WHERE position <= 5",
)
def _(v):
    i = v("items").withColumn("tokens", description_tokens(F.col("description")))
    s = scoring.similar_pairs(i.join(v("picks"), "id", "left_semi"), i)
    return s.select("source_id", "id", F.round("score", 6).alias("score"), "shared_tags", "position")


@query("F16_diverse")
def _(v):
    pool = v("items").select(F.col("category").alias("feed"), "id", (F.coalesce("downloads", F.lit(0.0)) / 1000).alias("score"), F.col("author").alias("category"), "tags", "ord")
    from pyspark.sql import Window

    w = Window.partitionBy("feed").orderBy(F.col("score").desc(), "ord")
    top = pool.withColumn("k", F.row_number().over(w)).filter("k <= 60").drop("k")
    return scoring.diverse(top)


@query("F17_featured")
def _(v):
    i = v("items").withColumn("score", F.coalesce("downloads", F.lit(0.0)))
    return scoring.featured(i, v("installed"), ["1", "2", "3"])


@query(
    "F18_rrf",
    "WITH a AS (SELECT id, row_number() OVER (ORDER BY coalesce(downloads, 0) DESC, ord) AS rank FROM {items}), b AS (SELECT id, row_number() OVER (ORDER BY updated DESC NULLS LAST, ord) AS rank FROM {items}) SELECT a.id, round(1.0 / (60 + a.rank) + 0.5 / (60 + b.rank), 6) AS score FROM a JOIN b ON a.id = b.id",
)
def _(v):
    one = lambda o: scoring.global_rank(v("items"), o, "k").select("id", (F.col("k") + 1).alias("rank"))
    a, b = one([F.coalesce("downloads", F.lit(0.0)).desc(), F.col("ord").asc()]), one([F.col("updated").desc_nulls_last(), F.col("ord").asc()])
    return scoring.rrf([(a, 1.0), (b, 0.5), (a, 0.0)]).select("id", F.round("score", 6).alias("score"))


@query("J1_rank_map", "SELECT id, row_number() OVER (PARTITION BY category ORDER BY coalesce(downloads, 0) DESC, ord) AS rank FROM {items}")
def _(v):
    from pyspark.sql import Window

    w = Window.partitionBy("category").orderBy(F.coalesce("downloads", F.lit(0.0)).desc(), F.col("ord").asc())
    return v("items").select("id", F.row_number().over(w).cast("bigint").alias("rank"))


@query("J2_keep_last", "SELECT id, ts, downloads FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS n FROM {samples}) WHERE n <= 30")
def _(v):
    return history.keep_last(v("samples"), 30)


@query("J3_last_sample", "SELECT id, arg_max(downloads, ts) AS downloads, max(ts) AS ts FROM {samples} GROUP BY id")
def _(v):
    return history.last_sample(v("samples"))


@query(
    "K1_trend_ingest",
    f"""WITH RECURSIVE c AS (SELECT CAST(user_id AS STRING) AS id, TIME_MS(ts) AS ts, CAST(event_id AS DOUBLE) AS downloads, row_number() OVER (PARTITION BY user_id ORDER BY TIME_MS(ts), event_id) AS n FROM {{events}}),
s AS (SELECT id, n, [{{'ts': ts, 'downloads': downloads}}] AS k FROM c WHERE n = 1 UNION ALL
SELECT c.id, c.n, CASE WHEN c.ts - s.k[-1].ts < {6 * HOUR_MS} THEN list_append(s.k[:-2], {{'ts': s.k[-1].ts, 'downloads': greatest(s.k[-1].downloads, c.downloads)}}) ELSE list_append(s.k, {{'ts': c.ts, 'downloads': c.downloads}})[-30:] END FROM s JOIN c ON c.id = s.id AND c.n = s.n + 1)
SELECT id, p.ts AS ts, p.downloads AS downloads FROM (SELECT id, unnest(arg_max(k, n)) AS p FROM s GROUP BY id)""",
)
def _(v):
    return history.ingest(v("samples"))


@query("K2_prune", f"SELECT id, ts, downloads FROM {{samples}} WHERE ts >= {EVENTS_NOW_MS - 20 * DAY_MS}")
def _(v):
    return history.prune(v("samples"), EVENTS_NOW_MS, 20)
