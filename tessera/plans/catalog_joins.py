"""Queries: lookups, dependencies, translations, installs, overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import history, joins
from tessera.plans.bindings import NOW_MS
from tessera.plans.catalog import query


@query("E2_search_rows", "SELECT i.id, i.name, i.description, t.translated_name AS name_zh, t.translated_desc AS desc_zh FROM {items} i LEFT JOIN (SELECT * FROM {translations} WHERE source <> 'original') t ON i.id = t.id")
def _(v):
    return joins.search_rows(v("items"), v("translations")).drop("ord")


@query("E3_view_rows", "SELECT i.id, coalesce(nullif(t.translated_name, ''), i.name) AS display_name, coalesce(nullif(t.translated_desc, ''), i.description) AS display_desc, coalesce(t.source, 'original') AS source, i.category FROM {items} i LEFT JOIN {translations} t ON i.id = t.id")
def _(v):
    return joins.view_rows(v("items"), v("translations"), v("items"))


@query("E4_ranking_join", "WITH r AS (SELECT CAST(vec_id AS STRING) AS id, label + 1 AS bonus FROM {embeddings}) SELECT r.id, r.bonus, i.name FROM r JOIN {items} i ON r.id = i.id")
def _(v):
    return v("embeddings").select(F.col("vec_id").cast("string").alias("id"), (F.col("label") + 1).alias("bonus")).join(v("items").select("id", "name"), "id")


@query("E5_journal_rows", "SELECT r.id, r.status, h.install_count, coalesce(h.uninstalled, h.last_installed) AS last_active FROM {reviews} r LEFT JOIN {history} h ON r.id = h.id")
def _(v):
    return joins.journal_rows(v("reviews").drop("install_count"), v("history")).select("id", "status", "install_count", "last_active")


@query("E6_bilingual", "SELECT i.id, CASE WHEN nullif(trim(t.translated_name), '') IS NULL THEN i.name WHEN lower(i.name) = lower(t.translated_name) THEN i.name ELSE i.name || '（' || t.translated_name || '）' END AS shown FROM {items} i LEFT JOIN {translations} t ON i.id = t.id")
def _(v):
    return v("items").join(v("translations").select("id", "translated_name"), "id", "left").select("id", joins.bilingual(F.col("name"), F.col("translated_name")).alias("shown"))


@query("E8_dependents", "SELECT dep_id, array_to_string(list_sort(list(DISTINCT src_id)), ',') AS dependents FROM {edges} GROUP BY dep_id")
def _(v):
    return joins.dependents(v("edges")).select("dep_id", F.array_join("dependents", ",").alias("dependents"))


STATUS = "s AS (SELECT e.src_id, e.dep_id, e.kind, CASE WHEN i.id IS NULL AND t.id IS NULL THEN 'unknown' WHEN t.id IS NULL THEN 'missing' WHEN n.id IS NULL THEN 'disabled' WHEN e.min_version IS NOT NULL AND CAST(split_part(t.version, '.', 2) AS INTEGER) < 8 THEN 'outdated' ELSE 'ok' END AS status FROM {edges} e LEFT JOIN {items} i ON e.dep_id = i.id LEFT JOIN {installed} t ON e.dep_id = t.id LEFT JOIN {enabled} n ON e.dep_id = n.id)"


@query("E9_dependency_status", f"WITH {STATUS} SELECT src_id, dep_id, kind, status FROM s")
def _(v):
    return joins.dependency_status(v("edges"), v("items"), v("installed"), v("enabled")).select("src_id", "dep_id", "kind", "status")


@query("E10_blocking", f"WITH {STATUS} SELECT src_id, dep_id, CASE WHEN status IN ('unknown', 'missing') THEN 'install' WHEN status = 'disabled' THEN 'enable' ELSE 'update' END AS action FROM s WHERE kind = 'required' AND status <> 'ok'")
def _(v):
    return joins.blocking(joins.dependency_status(v("edges"), v("items"), v("installed"), v("enabled"))).select("src_id", "dep_id", "action")


CURATED = "SELECT id AS src_id, CAST(ord + 1 AS STRING) AS dep_id, 'optional' AS kind FROM {items} WHERE size = 4"


@query("E11_curated_edges", f"WITH c AS ({CURATED}) SELECT src_id, dep_id, kind, confidence FROM {{edges}} e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.src_id = e.src_id AND c.dep_id = e.dep_id) UNION ALL SELECT src_id, dep_id, kind, 1.0 FROM c")
def _(v):
    curated = v("items").filter("size = 4").select(F.col("id").alias("src_id"), (F.col("ord") + 1).cast("string").alias("dep_id"), F.lit("optional").alias("kind"))
    return joins.curated_edges(v("edges").select("src_id", "dep_id", "kind", F.col("confidence").cast("double").alias("confidence")), curated)


@query("E12_outdated", "SELECT l.id, l.version AS local_version, '1.' || (i.size + CASE WHEN i.size > 5 THEN 2 ELSE 0 END) AS remote_version FROM {installed} l JOIN {items} i ON l.id = i.id WHERE i.size > 5 AND l.id NOT IN (SELECT id FROM {favorites})")
def _(v):
    remote = v("items").select("id", F.concat(F.lit("1."), F.col("size") + F.when(F.col("size") > 5, 2).otherwise(0)).alias("version"))
    return joins.outdated(v("installed"), remote, v("favorites"))


@query("E13_E20_overlaid", "SELECT id, name FROM {memory} WHERE id NOT IN (SELECT id FROM {dictionary}) UNION ALL SELECT id, name FROM {dictionary}")
def _(v):
    return joins.overlaid(v("memory").select("id", "name"), v("dictionary").select("id", "name"))


@query("E14_new_items", "SELECT count(*) AS total, count(*) FILTER (id NOT IN (SELECT id FROM {reviews})) AS fresh, count(*) FILTER (id IN (SELECT id FROM {translations} WHERE source <> 'original')) AS translated FROM {items}")
def _(v):
    seen = v("reviews").select("id", F.lit(1).alias("seen")).distinct()
    done = v("translations").filter("source <> 'original'").select("id", F.lit(1).alias("done"))
    return v("items").join(seen, "id", "left").join(done, "id", "left").agg(F.count("*").alias("total"), F.count(F.when(F.col("seen").isNull(), 1)).alias("fresh"), F.count("done").alias("translated"))


@query("E15_dictionary_delta", "SELECT id, name FROM {items} WHERE id NOT IN (SELECT id FROM {translations}) AND id NOT IN (SELECT id FROM {memory})")
def _(v):
    return v("items").join(v("translations").select("id").union(v("memory").select("id")), "id", "left_anti").select("id", "name")


@query("E16_tag_sets", "WITH i AS (SELECT id, unnest(tags) AS tag FROM {items} WHERE size >= 49), n AS (SELECT count(DISTINCT id) AS n FROM i), k AS (SELECT tag, count(DISTINCT id) AS k FROM i GROUP BY tag) SELECT i.id, coalesce(array_to_string(list_sort(list(DISTINCT i.tag) FILTER (k = n AND n >= 2)), ','), '') AS common, coalesce(array_to_string(list_sort(list(DISTINCT i.tag) FILTER (k = 1 AND n >= 2)), ','), '') AS only FROM i JOIN k ON i.tag = k.tag, n GROUP BY i.id")
def _(v):
    return joins.tag_sets(v("items").filter("size >= 49")).select("id", F.array_join("common", ",").alias("common"), F.array_join("only", ",").alias("only"))


@query("E17_prune_meta", "SELECT id FROM {managed} WHERE id IN (SELECT id FROM {installed})")
def _(v):
    return v("managed").join(v("installed").select("id"), "id", "left_semi").select("id")


@query("E18_first_candidate", "SELECT conv_id, arg_min(text, turn) AS text, min(turn) AS turn FROM {conversations} GROUP BY conv_id")
def _(v):
    return joins.first_by(v("conversations"), ["conv_id"], [F.col("turn").asc()]).select("conv_id", "text", "turn")


@query("E19_versions", "SELECT version, min(id) AS id FROM {installed} GROUP BY version")
def _(v):
    return joins.first_by(v("installed"), ["version"], [F.col("id").asc()]).select("version", "id")


@query("E21_profile_switch", "SELECT id, 'enable' AS action FROM {favorites} WHERE id NOT IN (SELECT id FROM {enabled}) AND id IN (SELECT id FROM {installed}) AND id <> '7' UNION ALL SELECT id, 'disable' FROM {enabled} WHERE id NOT IN (SELECT id FROM {favorites}) AND id <> '7'")
def _(v):
    return joins.profile_switch(v("favorites"), v("enabled"), v("installed"), "7")


RESOLVED = """r AS (SELECT i.id, CASE WHEN t.id IS NOT NULL THEN t.translated_name WHEN m.id IS NOT NULL THEN coalesce(nullif(trim(m.name), ''), i.name) WHEN a.id IS NOT NULL THEN coalesce(nullif(a.name, ''), i.name) ELSE i.name END AS translated_name,
CASE WHEN t.id IS NOT NULL THEN t.translated_desc WHEN m.id IS NOT NULL THEN coalesce(nullif(trim(m.description), ''), i.description) WHEN a.id IS NOT NULL THEN coalesce(nullif(a.description, ''), i.description) ELSE i.description END AS translated_desc,
CASE WHEN t.id IS NOT NULL THEN CASE WHEN t.source = 'original' AND t.translated_name <> i.name THEN 'bulk' ELSE t.source END WHEN m.id IS NOT NULL THEN CASE WHEN m.source = 'human' THEN 'custom' ELSE m.source END WHEN a.id IS NOT NULL THEN 'ai' ELSE 'original' END AS source
FROM {items} i LEFT JOIN (SELECT * FROM {translations} WHERE source <> 'online') t ON i.id = t.id LEFT JOIN (SELECT * FROM {memory} WHERE status = 'approved') m ON i.id = m.id LEFT JOIN {dictionary} a ON i.id = a.id)"""


def resolved(v):
    return joins.resolve_offline(v("items"), v("translations").filter("source <> 'online'"), v("memory"), v("dictionary"))


@query("P1_P2_resolve_offline", f"WITH {RESOLVED} SELECT id, translated_name, translated_desc, source, source = 'original' AS pending FROM r")
def _(v):
    return resolved(v)


# Confidence in the providers of translations.
CONFIDENCE = {"llm": 0.60, "self-hosted": 0.55, "baidu": 0.52, "transmart": 0.50, "google": 0.48, "mymemory": 0.40}


@query("P3_confidence", "SELECT DISTINCT category, CASE category WHEN 'PROMO' THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence FROM {items}")
def _(v):
    table = F.create_map(*(F.lit(x) for p in CONFIDENCE.items() for x in p))
    provider = F.when(F.col("category") == "PROMO", "llm").otherwise("unknown")
    return v("items").select("category", F.coalesce(F.try_element_at(table, provider), F.lit(0.5)).alias("confidence")).distinct()


@query("P4_promote", "SELECT id, translated_name AS name FROM {translations} WHERE source = 'online' AND id NOT IN (SELECT id FROM {memory} WHERE status = 'approved')")
def _(v):
    return v("translations").filter("source = 'online'").join(v("memory").filter("status = 'approved'").select("id"), "id", "left_anti").select("id", F.col("translated_name").alias("name"))


@query("P5_upsert_not_human", "WITH n AS (SELECT id, name FROM {dictionary} WHERE id NOT IN (SELECT id FROM {memory} WHERE source = 'human')) SELECT id, name FROM {memory} WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, name FROM n")
def _(v):
    fresh = v("dictionary").select("id", "name").join(v("memory").filter("source = 'human'").select("id"), "id", "left_anti")
    return history.upsert(v("memory").select("id", "name"), fresh)


@query("P6_online_chain")
def _(v):
    from tessera.functions.translate import translate_pending

    table = {"small": "petit", "red": "rouge", "ring": "anneau", "widget": "gadget"}
    pending = resolved(v).filter("pending").select("id", F.col("translated_name").alias("text"))
    return translate_pending(pending, [("words", lambda t: " ".join(table.get(w, w) for w in t.split()))])


@query("P7_startup_cache", "SELECT id, source FROM {translations} WHERE id NOT IN (SELECT id FROM {memory})")
def _(v):
    return v("translations").join(v("memory").select("id"), "id", "left_anti").select("id", "source")


MERGED = f"""m AS (SELECT coalesce(h.id, a.id) AS id, coalesce(h.name, a.name) AS name, h.id AS h, a.id AS a, r.id AS r, n.id AS n, e.id AS e, h.first_installed, h.last_installed, h.uninstalled, h.install_count FROM {{history}} h FULL JOIN (SELECT id, name FROM {{items}} WHERE size BETWEEN 3 AND 5 OR size = 30) a ON h.id = a.id LEFT JOIN (SELECT id FROM {{items}} WHERE size BETWEEN 8 AND 9) r ON coalesce(h.id, a.id) = r.id LEFT JOIN {{installed}} n ON coalesce(h.id, a.id) = n.id LEFT JOIN {{enabled}} e ON coalesce(h.id, a.id) = e.id)"""


@query(
    "K3_install_merge",
    f"WITH {MERGED} SELECT id, name, CASE WHEN a IS NOT NULL THEN coalesce(first_installed, {NOW_MS}) ELSE first_installed END AS first_installed, CASE WHEN a IS NOT NULL THEN {NOW_MS} ELSE last_installed END AS last_installed, CASE WHEN r IS NOT NULL THEN {NOW_MS} WHEN a IS NOT NULL THEN NULL WHEN n IS NULL AND uninstalled IS NULL THEN {NOW_MS} ELSE uninstalled END AS uninstalled, CASE WHEN a IS NOT NULL THEN coalesce(install_count, 0) + 1 ELSE install_count END AS install_count, CASE WHEN r IS NOT NULL THEN false WHEN a IS NOT NULL THEN true ELSE n IS NOT NULL END AS currently_installed, r IS NULL AND e IS NOT NULL AS currently_enabled FROM m",
)
def _(v):
    added = v("items").filter("size BETWEEN 3 AND 5 OR size = 30").select("id", "name")
    removed = v("items").filter("size BETWEEN 8 AND 9").select("id")
    return history.merge_installs(v("history"), added, removed, v("installed"), v("enabled"), NOW_MS).drop("estimated")


@query("K4_estimated_times", f"SELECT id, least(first_listed_at, updated) AS stamp_first, greatest(first_listed_at, updated) AS stamp_last, true AS estimated FROM {{items}} WHERE updated > 0 AND first_listed_at > 0")
def _(v):
    stamps = v("items").filter("updated > 0 AND first_listed_at > 0").select("id", F.col("updated").alias("dir_ctime"), F.col("first_listed_at").alias("manifest_mtime"))
    return history.estimated_times(stamps, NOW_MS)


@query("K5_snapshot_diff", "SELECT id, 'added' AS change FROM {installed} WHERE id NOT IN (SELECT id FROM {favorites}) UNION ALL SELECT id, 'removed' FROM {favorites} WHERE id NOT IN (SELECT id FROM {installed})")
def _(v):
    return history.snapshot_diff(v("favorites"), v("installed"))


@query("K6_backfill", "SELECT id FROM {installed} WHERE id NOT IN (SELECT id FROM {history})")
def _(v):
    return v("installed").join(v("history").select("id"), "id", "left_anti").select("id")


@query("K7_overlay", "SELECT id, name, status FROM (SELECT id, name, status FROM {memory} WHERE id NOT IN (SELECT id FROM {dictionary}) AND id NOT IN (SELECT id FROM {picks}) UNION ALL SELECT id, name, 'approved' FROM {dictionary} WHERE id NOT IN (SELECT id FROM {picks})) WHERE status = 'approved'")
def _(v):
    ups = v("dictionary").select("id", "name", F.lit("approved").alias("status"))
    return history.overlay(v("memory").select("id", "name", "status"), ups, v("picks"))


@query("K8_table_changes", "SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT id, name FROM {memory}) b FULL JOIN (SELECT id, name FROM {dictionary}) a ON a.id = b.id WHERE b.id IS NULL OR a.id IS NULL OR a.name <> b.name")
def _(v):
    return history.table_changes(v("memory").select("id", "name"), v("dictionary").select("id", "name"), ["name"])


@query("K10_first_seen", f"SELECT i.id, coalesce(h.first_installed, CASE WHEN t.id IS NOT NULL THEN 0 END, {NOW_MS}) AS seen_at FROM {{items}} i LEFT JOIN {{history}} h ON i.id = h.id LEFT JOIN {{translations}} t ON i.id = t.id")
def _(v):
    return history.first_seen(v("items"), v("history").select("id", F.col("first_installed").alias("seen_at")), v("translations"), NOW_MS)


@query("A11_upsert", "SELECT id, source FROM {memory} WHERE id NOT IN (SELECT id FROM {translations}) UNION ALL SELECT id, source FROM {translations}")
def _(v):
    return history.upsert(v("memory").select("id", "source"), v("translations").select("id", "source"))


@query("O3_keep_classified", "SELECT i.id, coalesce(f.grp, i.category) AS category FROM {items} i LEFT JOIN {favorites} f ON i.id = f.id")
def _(v):
    from tessera.operators.batch import keep_classified

    return keep_classified(v("favorites").select("id", F.col("grp").alias("category")), v("items"))


@query("O4_official_tags", "SELECT id, len(list_distinct(list_concat(tags, [author, 'new']))) AS n FROM {items}")
def _(v):
    return v("items").select("id", F.size(F.array_union("tags", F.array("author", F.lit("new")))).cast("bigint").alias("n"))


@query("O6_admission", "SELECT src_id, dep_id, CASE WHEN confidence >= 0.7 THEN 'edge' ELSE 'candidate' END AS goes FROM {edges} WHERE confidence >= 0.4")
def _(v):
    from tessera.operators.batch import admitted

    return admitted(v("edges")).select("src_id", "dep_id", "goes")


@query("O7_author_contains", "SELECT id FROM {items} WHERE contains(lower(author), 'brand#2')")
def _(v):
    return v("items").filter(F.contains(F.lower("author"), F.lit("brand#2"))).select("id")


RULES = [("jewellery", 1.0, ["ring"]), ("parts", 2.0, ["widget", "bolt"]), ("small goods", 1.0, ["small", "economy"])]
POINTS = {"jewellery": "2 * contains(t, 'ring')::INT", "parts": "3 * contains(t, 'widget')::INT + 3 * contains(t, 'bolt')::INT", "small goods": "2 * contains(t, 'small')::INT + 2 * contains(t, 'economy')::INT"}


@query("O1_classify", f"SELECT id, CASE WHEN greatest(a, b, c) = 0 THEN 'other' WHEN a = greatest(a, b, c) THEN 'jewellery' WHEN b = greatest(a, b, c) THEN 'parts' ELSE 'small goods' END AS category FROM (SELECT id, {POINTS['jewellery']} AS a, {POINTS['parts']} AS b, {POINTS['small goods']} AS c FROM (SELECT id, lower(description) AS t FROM {{items}}))")
def _(v):
    from tessera.operators.batch import classify

    return classify(v("items").drop("category"), RULES, F.col("description")).select("id", "category")


@query("O2_vocabulary_tags", "WITH w AS (SELECT ['Brand', 'ring', 'PROMO', 'small', 'red', 'STANDARD'] AS v) SELECT id, array_to_string(CASE WHEN len(f) + len(g) = 0 THEN [category] ELSE list_concat(f, list_filter(g, lambda x: NOT list_contains(f, x)))[1:4] END, ',') AS tags FROM (SELECT id, category, list_filter(v, lambda x: contains(substring(description, 1, 24), x)) AS f, list_filter(v, lambda x: contains(description, x)) AS g FROM {items}, w)")
def _(v):
    from tessera.operators.batch import vocabulary_tags

    return v("items").select("id", F.array_join(vocabulary_tags(F.col("description"), ["Brand", "ring", "PROMO", "small", "red", "STANDARD"], F.col("category")), ",").alias("tags"))


@query("O5_detect_dependencies", "SELECT src_id, dep_id, max(c) AS confidence, 'required' AS kind FROM (SELECT src_id, dep_id, 0.7::DOUBLE AS c FROM {edges} UNION ALL SELECT src_id, dep_id, 0.9::DOUBLE FROM {edges} WHERE kind = 'required' UNION ALL SELECT src_id, dep_id, 0.85::DOUBLE FROM {edges} WHERE min_version IS NOT NULL) WHERE src_id <> dep_id AND dep_id IN (SELECT id FROM {items}) GROUP BY ALL")
def _(v):
    from tessera.operators.batch import detect_dependencies

    names = v("items").select("id", F.concat(F.lit("n"), "id").alias("name"))
    texts = v("edges").select("src_id", F.concat(F.lit("It requires n"), "dep_id", F.lit(". See also n1.")).alias("text"))
    return detect_dependencies(v("edges").filter("kind = 'required'").select("src_id", "dep_id"), texts, names, code=v("edges").filter("min_version IS NOT NULL"))


@query("O8_ecosystem", "SELECT id FROM {items} WHERE author = 'Brand#4' OR regexp_matches(name, '[一-鿿]')")
def _(v):
    from tessera.operators.scoring import is_local_author

    return v("items").filter(is_local_author(F.col("name"), F.col("author"), F.col("description"), ["brand#4"])).select("id")
