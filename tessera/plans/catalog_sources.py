"""Queries: files of the catalog, notes, codecs, exports, markdown, streams' windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import history
from tessera.plans.bindings import NOW_MS
from tessera.plans.catalog import query
from tessera.schema import DAY_MS
from tessera.sources import catalog_files, exports, notes, vector_file


def as_map(df, value):
    """A JSON object by id for each author, as files hold them."""
    return df.groupBy("author").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", value)))).alias("json"))


@query("A1_catalog_scan", "SELECT id, name, list_index FROM {items}")
def _(v):
    rows = v("items").select(F.to_json(F.array(F.struct("id", "name"))).alias("value"), "list_index")
    parsed = rows.select("list_index", F.inline(F.from_json("value", "array<struct<id:string,name:string>>")))
    return parsed.filter("id IS NOT NULL").select("id", "name", "list_index")


@query("A2_parse_stats", "SELECT id, downloads, updated FROM {items} WHERE downloads IS NOT NULL")
def _(v):
    return catalog_files.parse_stats(as_map(v("items"), F.struct("downloads", "updated")))


@query("A3_tag_index", "SELECT id, category, array_to_string(tags, ',') AS tags FROM {items}")
def _(v):
    return catalog_files.parse_tags(as_map(v("items"), F.struct("category", "tags"))).withColumn("tags", F.array_join("tags", ","))


@query("A4_release_dates", "SELECT id, updated AS released_at FROM {items} WHERE updated IS NOT NULL")
def _(v):
    return catalog_files.parse_release_dates(as_map(v("items"), F.col("updated") / 1000))


@query("A5_id_sets", "SELECT id FROM {curated}")
def _(v):
    return catalog_files.parse_id_set(as_map(v("items"), F.col("category") == "PROMO"))


@query("A6_fresh_cache", f"SELECT id FROM {{items}} WHERE {NOW_MS} - updated <= {60 * DAY_MS}")
def _(v):
    return catalog_files.fresh_cache(v("items"), NOW_MS, 60 * DAY_MS, "updated").select("id")


@query("A8_shrink_guard", "SELECT category, count(*) AS loaded, count(*) FILTER (size > 25) AS fresh, count(*) FILTER (size > 25) >= count(*) * 0.5 AS replaced FROM {items} GROUP BY category")
def _(v):
    n = v("items").groupBy("category").agg(F.count("*").alias("loaded"), F.count(F.when(F.col("size") > 25, 1)).alias("fresh"))
    return n.withColumn("replaced", history.safe_to_replace(F.col("fresh"), F.col("loaded")))


@query("A9_memory_notes", "SELECT id, name, description, source, status FROM {memory}")
def _(v):
    head = [F.lit("---\nid: "), F.to_json(F.array("id")), F.lit("\nname: "), F.to_json(F.array("name")), F.lit("\ndescription: "), F.to_json(F.array("description")), F.lit("\nsource: "), F.col("source"), F.lit("\nstatus: "), F.col("status"), F.lit("\n---\n\nbody")]
    bare = [F.regexp_replace(h, r'^\[|\]$', "") if i % 2 and i < 6 else h for i, h in enumerate(head)]
    return notes.parsed(v("memory").select(F.concat(*bare).alias("value")), notes.parse_memory, notes.MEMORY).select("id", "name", "description", "source", "status")


@query("A10_review_notes", "SELECT id, status, CASE WHEN rating BETWEEN 1 AND 5 THEN rating END AS rating, array_to_string(verdict, ',') AS verdict, note FROM {reviews}")
def _(v):
    text = F.concat(F.lit("﻿---\r\nid: "), "id", F.lit("\r\nstatus: "), F.coalesce("status", F.lit("odd")), F.lit("\r\nrating: "), F.coalesce(F.col("rating").cast("string"), F.lit("4.5")), F.lit("\r\nverdict: ["), F.array_join("verdict", ", "), F.lit("]\r\n---\r\n\r\n"), "note", F.lit("\r\n"))
    got = notes.parsed(v("reviews").select(text.alias("value")), notes.parse_review, notes.REVIEW)
    return got.select("id", "status", F.col("rating").cast("bigint").alias("rating"), F.array_join("verdict", ",").alias("verdict"), "note")


@query("A14_index_file")
def _(v):
    def run(frames):
        import pandas as pd

        for pdf in frames:
            ids, vectors, *_ = vector_file.decode(vector_file.encode([str(i) for i in pdf["vec_id"]], list(pdf["embedding"]), "m", "h"))
            yield pd.DataFrame({"id": ids, "total": [round(sum(x), 4) for x in vectors]})

    return v("embeddings").select("vec_id", "embedding").mapInPandas(run, "id string, total double")


@query("A15_comparison", "SELECT id, '## ' || name || chr(10) || chr(10) || description || chr(10) || chr(10) || '- common: ' || author || chr(10) || '- only: ' || category || chr(10) AS section FROM {items}")
def _(v):
    tags = v("items").select("id", F.array("author").alias("common"), F.array("category").alias("only"))
    return exports.comparison(v("items").select("id", "name", "description"), tags)


@query("A16_review_table", "SELECT id, '| ' || concat_ws(' | ', name, coalesce(status, 'tried'), repeat('★', coalesce(rating, 0)), array_to_string(verdict, ', '), substring(note, 1, 60)) || ' |' AS line FROM {reviews}")
def _(v):
    return exports.review_rows(v("reviews"))


@query("A18_insight_cache", "SELECT CASE WHEN category < author THEN category || '|' || author ELSE author || '|' || category END AS key, id AS body FROM {items} WHERE size = 2")
def _(v):
    return catalog_files.insight_cache(v("items").select(F.array("author", "category").alias("ids"), F.col("size").alias("v"), F.col("id").alias("body")))


@query("A19_trend_history", "SELECT id, ts, downloads FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, downloads DESC) AS n FROM {samples}) WHERE n <= 30")
def _(v):
    rows = v("samples").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("ts").alias("timestamp"), "downloads"))).alias("s"))
    return catalog_files.parse_trend_history(rows.select(F.to_json(F.create_map("id", "s")).alias("json")))


@query("H6_strip_notice", "SELECT id, description AS text FROM {items}")
def _(v):
    from tessera.functions.notice import strip_notice

    return v("items").select("id", strip_notice(F.concat("description", F.lit("。此插件尚未经过 X 团队的人工审核。"))).alias("text"))


@query("H8_table_signature")
def _(v):
    from tessera.functions.notice import table_signature

    return table_signature(v("items"), ["id", "name", "description"], "v1")


SPEC = "concat('o', id, '/r', id)"


@query("H15_source_specs", f"SELECT id, 'o' || id AS owner, 'r' || id AS repo, size % 3 = 1 AS release, CASE WHEN size % 3 = 1 THEN 'v' || size END AS tag FROM {{items}}")
def _(v):
    from tessera.functions import source_spec

    text = F.expr(f"CASE size % 3 WHEN 0 THEN {SPEC} WHEN 1 THEN concat('https://github.com/', {SPEC}, '/releases/tag/v', size) ELSE concat('https://github.com/', {SPEC}, '/tree/dev/x') END")
    return source_spec.parsed(v("items").select("id", text.alias("text"))).select("id", "owner", "repo", "release", "tag")


@query("H20_H21_pages", "SELECT page_id AS id, md5(html) AS digest FROM {pages}")
def _(v):
    from tessera.functions.markdown import translate_pages

    same = translate_pages(v("pages").select(F.col("page_id").cast("string").alias("id"), F.col("html").alias("text")), lambda t: t, 500)
    return same.select(F.col("id").cast("bigint").alias("id"), F.md5("text").alias("digest"))


@query("H22_lines", "SELECT id, CASE WHEN size NOT IN (11, 12, 13) THEN upper(name) || '|' || upper(description) END AS lines FROM {items}")
def _(v):
    from tessera.functions.markdown import translate_groups

    second = F.expr("CASE size WHEN 11 THEN ' ' WHEN 12 THEN concat('a', chr(10), description) WHEN 13 THEN repeat('x', 2001) ELSE description END")
    told = translate_groups(v("items").select("id", F.array(F.col("name"), second).alias("lines")), str.upper)
    return told.select("id", F.when(F.col("lines").isNotNull(), F.array_join("lines", "|")).alias("lines"))


@query(
    "K12_breaker",
    f"""WITH RECURSIVE c AS (SELECT CAST(user_id AS STRING) AS id, TIME_MS(ts) AS ts, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY TIME_MS(ts), event_id) AS n FROM {{events}}),
s AS (SELECT DISTINCT id, 0::BIGINT AS n, 0::BIGINT AS f, 0::BIGINT AS u, 0::BIGINT AS refused FROM c UNION ALL
SELECT id, n, CASE WHEN u > 0 THEN f WHEN bad THEN f + 1 ELSE 0 END, CASE WHEN u > 0 THEN u WHEN bad AND f + 1 >= 2 THEN ts + {3 * DAY_MS} ELSE 0 END, refused + CASE WHEN u > 0 THEN 1 ELSE 0 END
FROM (SELECT c.id, c.n, c.ts, c.bad, CASE WHEN s.u > 0 AND c.ts >= s.u THEN 0 ELSE s.f END AS f, CASE WHEN c.ts >= s.u THEN 0 ELSE s.u END AS u, s.refused FROM s JOIN c ON c.id = s.id AND c.n = s.n + 1))
SELECT id, max(n) AS calls, max(refused) AS refused, arg_max(u, n) AS open_until FROM s GROUP BY id""",
)
def _(v):
    def run(key, pdf):
        import pandas as pd

        from tessera.functions.guard import Breaker

        b, refused = Breaker(2, 3 * DAY_MS), 0
        for ts, _, kind in sorted(zip(pdf["ts"], pdf["event_id"], pdf["event_type"])):
            if b.is_open(int(ts)):
                refused += 1
            elif kind == "error":
                b.failure(int(ts))
            else:
                b.success()
        return pd.DataFrame({"id": [key[0]], "calls": [len(pdf)], "refused": [refused], "open_until": [b.until]})

    calls = v("events").join(v("samples").select(F.col("downloads").cast("bigint").alias("event_id"), F.col("ts").alias("at")), "event_id")
    calls = calls.select(F.col("user_id").cast("string").alias("id"), F.col("at").alias("ts"), "event_id", "event_type")
    return calls.groupBy("id").applyInPandas(run, "id string, calls bigint, refused bigint, open_until bigint")


@query("S1_windowed_counts", "SELECT event_type, (epoch_us(ts) // 3600000000) * 3600 AS start, count(*) AS n FROM {events} GROUP BY ALL")
def _(v):
    from tessera.streaming.trends import windowed_counts

    w = windowed_counts(v("events"))
    start = F.datediff(F.to_date("window.start"), F.lit("1970-01-01").cast("date")) * 86400 + F.hour("window.start") * 3600
    return w.select("event_type", start.cast("bigint").alias("start"), "n")


@query("S2_session_counts", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM {events}), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS n FROM s GROUP BY user_id")
def _(v):
    from tessera.streaming.trends import session_counts

    return session_counts(v("events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("H31_note_names", "SELECT id, replace(author, '#', '_') || '.md' AS file FROM {items}")
def _(v):
    return v("items").select("id", notes.note_name(F.col("author")).alias("file"))


