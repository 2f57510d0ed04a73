"""Queries: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators.blocks import blocks, unfolded
from tessera.plans.bindings import NOW_MS
from tessera.plans.catalog import query
from tessera.schema import DAY_MS, HOUR_MS

PARTS = "list_transform(string_split(regexp_replace(trim({0}), '^[vV]', ''), '.'), lambda p: coalesce(TRY_CAST(nullif(regexp_extract(p, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0))"
ADDRESSES = ["owner/name", "https://github.com/o-1/r_2.git", "https://github.com/a/b/", "bad", ""]


@query(
    "H1_compare_version",
    "WITH p AS (SELECT a.id AS a, b.id AS b, " + PARTS.format("concat('v1.', a.version)") + " AS x, " + PARTS.format("concat(b.version, '.', b.id)") + " AS y FROM {installed} a JOIN {installed} b ON a.version = b.version OR a.id = '1')"
    " SELECT a, b, coalesce(list_filter(list_transform(range(1, greatest(len(x), len(y)) + 1), lambda i: CAST(sign(coalesce(x[i], 0) - coalesce(y[i], 0)) AS BIGINT)), lambda s: s <> 0)[1], 0) AS cmp FROM p",
)
def _(v):
    a, b = (v("installed").select(F.col("id").alias(n), F.col("version").alias(f"v{n}")) for n in ("a", "b"))
    cmp = lambda va: S.compare_versions(F.concat(F.lit("v1."), va), F.concat_ws(".", "vb", "b")).cast("bigint")
    # of equal versions the answer is that of b alone, so it is found before they meet
    left, right = blocks(a, "va", F.col("a"), "a"), blocks(b.withColumn("cmp", cmp("vb")), "vb", F.struct("b", "cmp"), "right")
    same = unfolded(left.join(right, F.col("va") == F.col("vb")), ["va"], "a", "right").select("a", "right.b", "right.cmp")
    one = a.filter("a = '1'").join(b, F.col("va") != F.col("vb")).select("a", "b", cmp("va").alias("cmp"))
    return same.union(one)


@query("H2_format_downloads", "SELECT id, CASE WHEN d >= 1000000 THEN regexp_replace(printf('%.1f', floor(d / 1000000 * 10 + 0.5) / 10), '\\.0$', '') || 'M' WHEN d >= 1000 THEN regexp_replace(printf('%.1f', floor(d / 1000 * 10 + 0.5) / 10), '\\.0$', '') || 'k' ELSE CAST(CAST(floor(d) AS BIGINT) AS STRING) END AS shown FROM (SELECT id, downloads * 37 AS d FROM {items})")
def _(v):
    return v("items").select("id", S.format_downloads(F.col("downloads") * 37).alias("shown"))


@query("H3_format_month", f"SELECT id, CASE WHEN updated > 0 THEN strftime(DATE '1970-01-01' + CAST(updated // {DAY_MS} AS INTEGER), '%Y-%m') ELSE '' END AS month FROM {{items}}")
def _(v):
    return v("items").select("id", S.format_month(F.col("updated")).alias("month"))


@query("H4_relative_time", f"SELECT id, CASE WHEN updated IS NULL OR updated <= 0 OR d < 0 THEN '' WHEN d < 60000 THEN 'now' WHEN d < {HOUR_MS} THEN (d // 60000) || 'min' WHEN d < {DAY_MS} THEN (d // {HOUR_MS}) || 'h' WHEN d < {30 * DAY_MS} THEN (d // {DAY_MS}) || 'd' WHEN d < {365 * DAY_MS} THEN (d // {30 * DAY_MS}) || 'mo' ELSE (d // {365 * DAY_MS}) || 'y' END AS age FROM (SELECT id, updated, {NOW_MS - 60 * DAY_MS} - updated AS d FROM {{items}})")
def _(v):
    return v("items").select("id", S.relative_time(F.col("updated"), NOW_MS - 60 * DAY_MS).alias("age"))


@query("H5_clean_spaces", "SELECT id, trim(regexp_replace(text, '[ \\t\\r\\n\\f\\x0b　 ﻿]+', ' ', 'g')) AS clean FROM {docs}")
def _(v):
    return v("docs").select("id", S.clean_han_spaces(F.col("text")).alias("clean"))


@query("H7_content_hash", "SELECT id, lower(to_hex(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(concat(name, chr(31), author), ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (a * 33 + c) & 4294967295))) AS hash FROM {items}")
def _(v):
    return v("items").select("id", S.content_hash(F.col("name"), F.col("author")).alias("hash"))


@query("H9_md5", "SELECT id, md5(text) AS md5 FROM {docs}")
def _(v):
    return v("docs").select("id", F.md5("text").alias("md5"))


@query("H10_repo_parts", "SELECT page_id, nullif(split_part(split_part(url, '://', 2), '.', 1), '') AS owner, 'pages' AS name FROM {pages}")
def _(v):
    address = F.concat(F.split(F.split("url", "://")[1], r"\.")[0], F.lit("/pages.git"))
    return v("pages").select("page_id", S.repo_part(address, "owner").alias("owner"), S.repo_part(address, "name").alias("name"))


RAW_SQL = "'https://raw.githubusercontent.com/' || author || '/' || replace(name, ' ', '-') || '/HEAD/' || category || '.md'"
for _mirror, _sql in [
    ("jsdelivr", "'https://cdn.jsdelivr.net/gh/' || author || '/' || replace(name, ' ', '-') || '@HEAD/' || category || '.md'"),
    ("ghproxy", "'https://gh-proxy.com/' || " + RAW_SQL),
    ("custom", "'https://m.example/' || author || '/' || replace(name, ' ', '-') || '/HEAD/' || category || '.md'"),
    ("github", RAW_SQL),
]:

    def _mirrored(v, m=_mirror):
        url = F.concat(F.lit("https://raw.githubusercontent.com/"), "author", F.lit("/"), F.replace(F.col("name"), F.lit(" "), F.lit("-")), F.lit("/HEAD/"), "category", F.lit(".md"))
        return v("items").select("id", S.mirrored(url, m, "https://m.example/").alias("url"))

    query(f"H11_mirror_{_mirror}", f"SELECT id, {_sql} AS url FROM {{items}}")(_mirrored)


@query("H12_raw_urls", "SELECT id, 'https://raw.githubusercontent.com/' || category || '/' || replace(name, ' ', '-') || '/HEAD/README.md' AS url FROM {items}")
def _(v):
    return v("items").select("id", S.raw_file_url(F.concat("category", F.lit("/"), F.replace(F.col("name"), F.lit(" "), F.lit("-"))), "README.md").alias("url"))


@query("H13_absolute_links", "SELECT id, '![x](https://raw.githubusercontent.com/o/r/HEAD/img/' || author || '.png) [t](https://github.com/o/r/blob/HEAD/docs/' || category || '.md) [a](https://x.y/z) <img src=\"https://raw.githubusercontent.com/o/r/HEAD/i.png\">' AS page FROM {items}")
def _(v):
    page = F.concat(F.lit("![x](./img/"), "author", F.lit(".png) [t](docs/"), "category", F.lit('.md) [a](https://x.y/z) <img src="/i.png">'))
    return v("items").select("id", S.absolute_links(page, "o/r").alias("page"))


@query("H14_error_kinds", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'timeout' WHEN event_type = 'click' THEN 'dns' WHEN event_type = 'purchase' THEN 'blocked' WHEN event_type = 'signup' THEN 'http' ELSE 'unknown' END AS kind FROM {events}")
def _(v):
    say = F.create_map(*(F.lit(x) for x in ("error", "ETIMEDOUT 404", "click", "getaddrinfo failed", "purchase", "got 403", "signup", "HTTP 500", "view", "odd")))
    return v("events").select("event_id", S.error_kind(say[F.col("event_type")]).alias("kind"))


@query("H16_release_urls", "SELECT id, list_transform(list_distinct_in_order, lambda t: 'https://github.com/o/r/releases/download/' || t || '/main.js')[1] AS first, len(list_distinct_in_order) AS n FROM (SELECT id, ['v' || version, version] AS list_distinct_in_order FROM {installed})")
def _(v):
    urls = S.release_urls(F.lit("o/r"), F.concat(F.lit("v"), "version"), "main.js")
    return v("installed").select("id", urls[0].alias("first"), F.size(urls).cast("bigint").alias("n"))


@query("H17_commands", "SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)[1:40]) AS n, array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)[1:40], ' ') AS links, contains(html, '<article') AS has_article FROM {pages}")
def _(v):
    links = F.slice(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), 1, 40)
    return v("pages").select("page_id", F.size(links).cast("bigint").alias("n"), F.array_join(links, " ").alias("links"), F.contains("html", F.lit("<article")).alias("has_article"))


@query("H18_first_letter", "SELECT s_suppkey, upper(s_name[1]) AS letter FROM {supplier}")
def _(v):
    return v("supplier").select("s_suppkey", S.first_letter(F.col("s_name"), {}).alias("letter"))


@query("H19_tag_display", "SELECT DISTINCT category, CASE category WHEN 'PROMO' THEN '促销(PROMO)' ELSE category END AS shown FROM {items}")
def _(v):
    table = F.create_map(F.lit("PROMO"), F.lit("促销"))
    name = F.try_element_at(table, F.col("category"))
    return v("items").select("category", F.coalesce(F.concat(name, F.lit("("), "category", F.lit(")")), F.col("category")).alias("shown")).distinct()


@query("H23_hosts", "SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1) AS host, regexp_replace(trim(url), '/+$', '') AS base, false AS local FROM {pages}")
def _(v):
    return v("pages").select("page_id", S.host_of(F.col("url")).alias("host"), S.base_url(F.col("url")).alias("base"), S.is_local_url(F.col("url")).alias("local"))


@query("H24_query_shape", "SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) <= 4 THEN '1-4' WHEN length(text) <= 8 THEN '5-8' WHEN length(text) <= 16 THEN '9-16' ELSE '17+' END AS bucket, regexp_matches(text, '[0-9]') AS digit, regexp_matches(text, '[A-Za-z]') AS latin FROM {conversations}")
def _(v):
    kinds = S.char_classes(F.col("text"))
    return v("conversations").select("conv_id", "turn", S.length_bucket(F.col("text")).alias("bucket"), F.array_contains(kinds, "digit").alias("digit"), F.array_contains(kinds, "latin").alias("latin"))


@query("H25_safe_names", "SELECT page_id, regexp_replace(url, '[\\\\/:*?\"<>|]', '-', 'g') AS safe, false AS is_id FROM {pages}")
def _(v):
    return v("pages").select("page_id", S.safe_name(F.col("url")).alias("safe"), S.is_safe_id(F.col("url")).alias("is_id"))


@query("H26_has_cjk", "SELECT id, regexp_matches(text, '[㐀-䶿一-鿿＀-￯]') AS cjk FROM {docs}")
def _(v):
    return v("docs").select("id", S.has_cjk(F.col("text")).alias("cjk"))


@query("H27_highlight", "SELECT id, regexp_replace(name, '(widget|ring)', '<mark>\\1</mark>', 'gi') AS shown FROM {items}")
def _(v):
    return v("items").select("id", S.highlighted(F.col("name"), ["ring", "widget"]).alias("shown"))


@query("H28_translation_problem", "SELECT t.id, CASE WHEN trim(t.translated_name) = '' THEN 'empty' WHEN lower(trim(i.name)) = lower(trim(t.translated_name)) THEN 'echo' ELSE 'ok' END AS problem FROM {translations} t JOIN {items} i ON t.id = i.id")
def _(v):
    return v("translations").join(v("items").select("id", "name"), "id").select("id", S.translation_problem(F.col("name"), F.col("translated_name")).alias("problem"))


@query("H29_groups", "SELECT g AS grp, row_number() OVER (ORDER BY k, g) AS position FROM (SELECT 'all' AS g, 0 AS k UNION ALL SELECT DISTINCT grp, CASE WHEN grp = 'other' THEN 2 ELSE 1 END FROM {managed})")
def _(v):
    from pyspark.sql import Window

    g = v("managed").select("grp").distinct().select("grp", F.when(F.col("grp") == "other", 2).otherwise(1).alias("k"))
    g = g.union(v.spark.createDataFrame([("all", 0)], "grp string, k int"))
    return g.select("grp", F.row_number().over(Window.orderBy("k", "grp")).cast("bigint").alias("position"))


@query("H30_meta_defaults", "SELECT i.id, coalesce(m.grp, 'other') AS grp, coalesce(m.remark, '') AS remark FROM {items} i LEFT JOIN (SELECT * FROM {managed} WHERE enabled) m ON i.id = m.id")
def _(v):
    m = v("managed").filter("enabled").select("id", "grp", "remark")
    return v("items").select("id").join(m, "id", "left").select("id", F.coalesce("grp", F.lit("other")).alias("grp"), F.coalesce("remark", F.lit("")).alias("remark"))


@query("A7_is_stale", f"SELECT id, CASE WHEN updated IS NULL OR updated <= 0 THEN true WHEN updated > {NOW_MS - 100 * DAY_MS} THEN false ELSE {NOW_MS - 100 * DAY_MS} - updated > {7 * DAY_MS} END AS stale FROM {{items}}")
def _(v):
    return v("items").select("id", S.is_stale(F.col("updated"), NOW_MS - 100 * DAY_MS, 7 * DAY_MS).alias("stale"))
