"""Markdown notes with front matter: translation memory and reviews, read whole, and written back."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ("using", "abandoned", "watching")
MEMORY = "id string, name string, description string, source string, status string, confidence double, created bigint, promoted bigint, flagged boolean"
REVIEW = "id string, name string, status string, rating int, verdict array<string>, first_installed bigint, last_installed bigint, uninstalled bigint, install_count bigint, enabled boolean, updated bigint, note string"


def front_matter(text: str) -> tuple[dict[str, str], str] | None:
    """Keys and values between the dashes, and what follows; byte order marks and CRLF do not matter."""
    lines = text.lstrip("﻿").lstrip().replace("\r\n", "\n").split("\n")
    if lines[0].rstrip() != "---" or "---" not in lines[1:]:
        return None
    end = lines.index("---", 1)
    found = {}
    for line in lines[1:end]:
        key, colon, value = line.partition(":")
        if colon and key.strip():
            value = value.strip()
            if len(value) > 1 and value[0] == value[-1] == '"':
                try:
                    value = json.loads(value)
                except ValueError:
                    pass
            found[key.strip()] = value
    return found, "\n".join(lines[end + 1 :])


def number(value: str | None) -> float | None:
    try:
        x = float(value)
    except (TypeError, ValueError):
        return None
    return x if abs(x) < float("inf") else None


def whole(value: str | None) -> int | None:
    x = number(value)
    return None if x is None else int(x)


def parse_memory(text: str) -> tuple | None:
    """A translation memory note, None without id and name."""
    parsed = front_matter(text)
    if not parsed or not parsed[0].get("id") or "name" not in parsed[0]:
        return None
    k = parsed[0]
    return k["id"], k["name"], k.get("description", ""), k.get("source", "human"), k.get("status", "approved"), number(k.get("confidence")) or 0.0, whole(k.get("created")), whole(k.get("promoted")), k.get("flagged") == "true"


def render_memory(e: dict) -> str:
    quoted = lambda x: json.dumps(x or "", ensure_ascii=False)
    head = [f"{k}: {quoted(e[k])}" for k in ("id", "name", "description")] + [f"{k}: {e[k]}" for k in ("source", "status", "confidence", "created")]
    if e.get("promoted"):
        head.append(f"promoted: {e['promoted']}")
    return "\n".join(["---", *head, "---", "", f"# {e['name']}", "", e["description"]])


def parse_review(text: str) -> tuple | None:
    """A review note; None without an id, or without status, rating, verdict and text. A rating is a whole number from 1 to 5."""
    parsed = front_matter(text)
    if not parsed or not parsed[0].get("id"):
        return None
    k, body = parsed[0], parsed[1].strip()
    r = number(k.get("rating"))
    rating = int(r) if r is not None and r == int(r) and 1 <= r <= 5 else None
    verdict = [v.strip().strip("\"'") for v in re.sub(r"^\[|\]$", "", k.get("verdict", "")).split(",")]
    verdict = [v for v in verdict if v] or None
    status = k.get("status") if k.get("status") in STATUSES else None
    if not (status or rating or verdict or body):
        return None
    return (k["id"], k.get("name", k["id"]), status, rating, verdict, *(whole(k.get(n)) for n in ("firstInstalled", "lastInstalled", "uninstalled", "installCount")), {"true": True, None: None}.get(k.get("enabled"), False), whole(k.get("updated")), body)


def render_review(e: dict) -> str:
    lines = [f"id: {json.dumps(e['id'], ensure_ascii=False)}", f"name: {json.dumps(e['name'], ensure_ascii=False)}"]
    shown = {"status": "status", "rating": "rating", "firstInstalled": "first_installed", "lastInstalled": "last_installed", "uninstalled": "uninstalled", "installCount": "install_count"}
    for key, name in shown.items():
        if e.get(name):
            lines.append(f"{key}: {e[name]}")
        if name == "rating" and e.get("verdict"):
            lines.append(f"verdict: [{', '.join(e['verdict'])}]")
    if e.get("enabled") is not None:
        lines.append(f"enabled: {str(e['enabled']).lower()}")
    lines.append(f"updated: {e.get('updated') or 0}")
    return "\n".join(["---", *lines, "---", ""]) + (f"\n{e['note']}\n" if e.get("note") else "\n")


def parsed(notes: DataFrame, parse, schema: str, text: str = "value") -> DataFrame:
    """Rows of the notes that parse, batch by batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [r for t in batch.column(0).to_pylist() if (r := parse(t or ""))]
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], arrow)

    return notes.select(text).mapInArrow(run, schema)


def read_memory_notes(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path, wholetext=True), parse_memory, MEMORY)


def read_review_notes(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path, wholetext=True), parse_review, REVIEW)


def note_name(column) -> F.col:
    """File name of a note for an id: marks that files cannot have become underscores."""
    return F.concat(F.regexp_replace(column, r"[\\/:#^|\[\]]", "_"), F.lit(".md"))
