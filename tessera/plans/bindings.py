"""The catalog's inputs over the driver's tables: one SQL text each, read by Spark and, as a WITH clause, by DuckDB.

Roles such as installed or favorite follow from attributes of the rows, so that every
query runs over whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: After the last ship date, and after the last event.
NOW_MS = 1_009_843_200_000
EVENTS_NOW_MS = 1_706_745_600_000

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
VIEWS = {
    "sales": "SELECT l_partkey, sum(l_quantity) AS downloads, max(DAY_MS(l_shipdate)) AS updated FROM {lineitem} GROUP BY l_partkey",
    "items": """SELECT CAST(p_partkey AS STRING) AS id, p_name AS name, concat(p_name, ' ', p_brand, ' ', p_type) AS description, p_brand AS author, p_type AS category, LIST(p_brand, concat('size', CAST(CAST(floor(p_size / 10) AS BIGINT) AS STRING))) AS tags, p_size AS size,
CASE WHEN p_size = 13 THEN NULL ELSE downloads END AS downloads, CASE WHEN p_size = 17 THEN NULL ELSE updated END AS updated, CASE WHEN p_size = 9 THEN NULL ELSE updated - CAST(p_size AS BIGINT) * 86400000 END AS first_listed_at, p_partkey AS list_index, p_partkey AS ord FROM {part} LEFT JOIN {sales} ON p_partkey = l_partkey""",
    "stats": "SELECT id, downloads * 2 AS downloads, CASE WHEN size BETWEEN 20 AND 25 THEN NULL ELSE updated + 86400000 END AS updated FROM {items} WHERE size >= 5 AND downloads IS NOT NULL",
    "translations": "SELECT id, CASE WHEN size = 11 THEN '' ELSE upper(name) END AS translated_name, CASE WHEN size = 12 THEN '' ELSE upper(description) END AS translated_desc, CASE WHEN size < 20 THEN 'original' WHEN size < 28 THEN 'bulk' WHEN size < 36 THEN 'online' WHEN size < 44 THEN 'ai' ELSE 'custom' END AS source FROM {items} WHERE size > 8",
    "installed": "SELECT id, concat('1.', CAST(size AS STRING), '.0') AS version FROM {items} WHERE size <= 14",
    "enabled": "SELECT id FROM {items} WHERE size <= 7",
    "favorites": "SELECT id, CASE WHEN size < 20 THEN 'work' WHEN size < 40 THEN 'home' END AS grp FROM {items} WHERE author IN ('Brand#1', 'Brand#7', 'Brand#12')",
    "picks": "SELECT id FROM {items} WHERE size = 50",
    "curated": "SELECT id FROM {items} WHERE category = 'PROMO'",
    "memory": "SELECT id, CASE WHEN size = 30 THEN ' ' ELSE concat('M ', name) END AS name, concat('M ', description) AS description, CASE WHEN size < 25 THEN 'human' ELSE 'bulk' END AS source, CASE WHEN size > 33 THEN 'suggested' ELSE 'approved' END AS status FROM {items} WHERE size BETWEEN 3 AND 35",
    "dictionary": "SELECT id, concat('D ', name) AS name, CASE WHEN size = 2 THEN '' ELSE concat('D ', description) END AS description FROM {items} WHERE size <= 6",
    "reviews": "SELECT id, name, CASE WHEN size <= 10 THEN 'using' WHEN size <= 20 THEN 'abandoned' WHEN size <= 30 THEN 'watching' END AS status, CASE WHEN size <= 25 THEN CAST(floor(size / 6) AS BIGINT) + 1 END AS rating, CASE WHEN size <= 20 THEN LIST('slow', category) ELSE LIST(category) END AS verdict, CAST(size AS BIGINT) AS install_count, author AS note, updated FROM {items} WHERE size <= 40",
    "history": "SELECT id, name, first_listed_at AS first_installed, updated AS last_installed, CASE WHEN size BETWEEN 12 AND 24 THEN updated + 86400000 END AS uninstalled, CAST(size AS BIGINT) AS install_count FROM {items} WHERE size <= 24 AND updated IS NOT NULL AND first_listed_at IS NOT NULL",
    "edges": "SELECT id AS src_id, CASE WHEN size = 5 THEN concat('x', id) ELSE CAST(ord + 1 AS STRING) END AS dep_id, CASE WHEN size < 8 THEN 'required' ELSE 'optional' END AS kind, CASE WHEN size IN (3, 6, 9) THEN '1.8' END AS min_version, round(size / 16.0, 4) AS confidence FROM {items} WHERE size <= 16",
    "samples": "SELECT CAST(user_id AS STRING) AS id, TIME_MS(ts) AS ts, CAST(event_id AS DOUBLE) AS downloads FROM {events}",
    "managed": "SELECT id, name, author, CASE WHEN size < 5 THEN '' ELSE category END AS remark, CASE WHEN size < 20 THEN 'work' WHEN size < 35 THEN 'home' ELSE 'other' END AS grp, size <= 7 AS enabled FROM {items}",
    "gold": "SELECT CAST(d.source AS STRING) AS qid, CAST(d.doc_id AS STRING) AS id, d.lang AS bucket FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.quality = 1",
    "docs": "SELECT CAST(doc_id AS STRING) AS id, doc_id AS ord, text, lang, source FROM {documents}",
}
SPARK = {r"DAY_MS\((\w+)\)": r"(datediff(to_date(\1), DATE'1970-01-01') * 86400000L)", r"TIME_MS\((\w+)\)": r"(datediff(to_date(\1), DATE'1970-01-01') * 86400000L + hour(\1) * 3600000L + minute(\1) * 60000L + cast(floor(extract(SECOND FROM \1) * 1000) as bigint))", r"\bLIST\(": "array("}
DUCK = {r"DAY_MS\((\w+)\)": r"(datediff('day', DATE '1970-01-01', CAST(\1 AS DATE)) * 86400000)", r"TIME_MS\((\w+)\)": r"(epoch_us(\1) // 1000)", r"\bLIST\(": "list_value("}


def spelled(sql: str, dialect: dict) -> str:
    for a, b in dialect.items():
        sql = re.sub(a, b, sql)
    return sql


def parts(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Inputs:
    """The views over one folder of tables, each made once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in TABLES:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = spelled(VIEWS[name], SPARK)
                self.made[name] = self.spark.sql(sql, **{p: self(p) for p in parts(sql)})
        return self.made[name]


def duckdb(sql: str) -> str:
    """SQL over the views and tables in braces as one DuckDB statement."""
    order: list[str] = []

    def visit(text):
        for p in parts(text):
            if p in VIEWS and p not in order:
                visit(VIEWS[p])
                order.append(p)

    visit(sql)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", spelled(s, DUCK))
    heads = [f"{v} AS ({plain(VIEWS[v])})" for v in order]
    body = plain(sql).strip()
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(heads)}, {body[5:]}" if heads else body
    return (f"WITH {', '.join(heads)} " if heads else "") + body
