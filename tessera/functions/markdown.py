"""Markdown cut into parts to keep and parts to translate, texts cut into batches and put together again without loss."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

# What of a page is never translated.
KEPT = [
    r"```[^\n]*[\s\S]*?```",
    r"(?:^|\n)(?: {4}|\t)[^\n]*(?:\n(?: {4}|\t)[^\n]*)*",
    r"`[^`\n]+`",
    r"^\s*\|?[\s:|-]+\|\s*$",
    r"!\[[^\]]*\]\([^)]*\)",
    r"!\[[^\]]*\]\[[^\]]*\]",
    r"^\s*\[[^\]\n]+\]:\s*\S.*$",
    r"\[[^\]]*\]\([^)]*\)",
    r"</?[a-zA-Z][^>]*>|<!--[\s\S]*?-->",
    r"^\s*#{1,6}\s+",
    r"^\s*>\s*",
    r"^\s*(?:[-*+]\s+|\d+\.\s+)",
]
KEEP = re.compile("|".join(f"(?:{p})" for p in KEPT), re.M)


def blocks(page: str) -> list[tuple[bool, str]]:
    """(keep, text) parts that alternate and join to the page."""
    out: list[tuple[bool, str]] = []

    def put(keep, text):
        if text:
            out[-1:] = [(keep, out[-1][1] + text)] if out and out[-1][0] == keep else [*out[-1:], (keep, text)]

    at = 0
    for m in KEEP.finditer(page):
        put(False, page[at : m.start()])
        put(True, m[0])
        at = m.end()
    put(False, page[at:])
    return out


def batches(text: str, limit: int) -> list[tuple[str, str]]:
    """(batch, separator after it) pairs of at most `limit` characters; paragraphs stay whole where they fit; all joined is the text."""
    pieces = re.split(r"(\n\s*\n)", text)
    units = []
    for p, sep in zip(pieces[::2], [*pieces[1::2], ""]):
        cuts = [p[i : i + limit] for i in range(0, len(p), limit)] or [""]
        units += [(c, "") for c in cuts[:-1]] + [(cuts[-1], sep)]
    out: list[tuple[str, str]] = []
    for unit, sep in units:
        if out and out[-1][1] and len(out[-1][0]) + len(out[-1][1]) + len(unit) <= limit:
            out[-1] = (out[-1][0] + out[-1][1] + unit, sep)
        else:
            out.append((unit, sep))
    return out


def joined(parts: list[tuple[str, str]]) -> str:
    return "".join(a + b for a, b in parts)


def translate_lines(lines: list[str], ask: Callable[[str], str], limit: int = 2000) -> list[str] | None:
    """All lines by one call, or None where that can't be trusted: blank or broken lines, too long, unchanged, another number of lines."""
    if not lines or any(not x.strip() or "\n" in x for x in lines):
        return None
    text = "\n".join(lines)
    if len(text) > limit:
        return None
    said = ask(text)
    back = [x.strip() for x in said.split("\n")]
    return None if said == text or len(back) != len(lines) or not all(back) else back


def translate_pages(pages: DataFrame, ask: Callable[[str], str], limit: int = 2000) -> DataFrame:
    """(id, text): pages with everything but what is kept translated, batch by batch on the executors."""

    def run(frames):
        for pdf in frames:
            done = ["".join(t if keep else joined([(ask(b) if b.strip() else b, s) for b, s in batches(t, limit)]) for keep, t in blocks(page or "")) for page in pdf["text"]]
            yield pdf.assign(text=done)[["id", "text"]]

    return pages.select("id", "text").mapInPandas(run, "id string, text string")


def translate_groups(groups: DataFrame, ask: Callable[[str], str], limit: int = 2000) -> DataFrame:
    """(id, lines): the lines of each row by one call on the executors, null where the answer can't be trusted."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "lines": [translate_lines(list(x), ask, limit) if x is not None else None for x in pdf["lines"]]})

    return groups.select("id", "lines").mapInPandas(run, "id string, lines array<string>")
