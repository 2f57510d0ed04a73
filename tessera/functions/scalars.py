"""Scalar functions as Columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.schema import DAY_MS, HOUR_MS

HAN = "一-鿿"


def version_parts(version: Column) -> Column:
    """Numbers of a version's segments; a segment without a leading number counts 0."""
    parts = F.split(F.regexp_replace(F.trim(F.coalesce(version, F.lit(""))), r"^[vV]", ""), r"\.")
    return F.transform(parts, lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^\s*([+-]?[0-9]+)", 1), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint")))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1, segment by segment; missing segments count 0."""
    x, y = version_parts(a), version_parts(b)
    steps = F.filter(F.zip_with(x, y, lambda p, q: F.signum(F.coalesce(p, F.lit(0)) - F.coalesce(q, F.lit(0))).cast("int")), lambda s: s != 0)
    return F.coalesce(F.try_element_at(steps, F.lit(1)), F.lit(0))


def trimmed(number: Column, suffix: str) -> Column:
    """One decimal, halves up, without a trailing .0, and a suffix."""
    return F.concat(F.regexp_replace(F.format_string("%.1f", F.floor(number * 10 + 0.5) / 10), r"\.0$", ""), F.lit(suffix))


def format_downloads(n: Column) -> Column:
    return F.when(n >= 1_000_000, trimmed(n / 1_000_000, "M")).when(n >= 1000, trimmed(n / 1000, "k")).otherwise(F.floor(n).cast("string"))


def format_month(ms: Column) -> Column:
    """YYYY-MM of epoch milliseconds, in UTC whatever the session's zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / DAY_MS).cast("int"))
    return F.when(ms > 0, F.date_format(day, "yyyy-MM")).otherwise("")


def relative_time(ms: Column, now_ms: int) -> Column:
    """Age as just now, minutes, hours, days, months or years; empty for the future and for no time."""
    d = F.lit(now_ms) - ms
    say = lambda size, unit: F.concat(F.floor(d / size).cast("string"), F.lit(unit))
    out = F.when(ms.isNull() | (ms <= 0) | (d < 0), "").when(d < 60_000, "now").when(d < HOUR_MS, say(60_000, "min")).when(d < DAY_MS, say(HOUR_MS, "h"))
    return out.when(d < 30 * DAY_MS, say(DAY_MS, "d")).when(d < 365 * DAY_MS, say(30 * DAY_MS, "mo")).otherwise(say(365 * DAY_MS, "y"))


def clean_han_spaces(text: Column) -> Column:
    """Without spaces between Han characters; other runs of white space become one space."""
    space = "[\\s　 ﻿]+"
    between = f"([{HAN}]){space}(?=[{HAN}])"
    return F.trim(F.regexp_replace(F.regexp_replace(text, between, "$1"), space, " "))


def content_hash(*columns: Column) -> Column:
    """The djb2 hash of the fields, one control character between them, as unsigned 32-bit hex."""
    text = F.concat_ws("\u001f", *(F.coalesce(c, F.lit("")) for c in columns))
    codes = F.transform(F.split(text, ""), F.ascii)
    h = F.aggregate(codes, F.lit(5381).cast("bigint"), lambda a, c: ((a * 33) + c).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.hex(h))


def repo_part(url: Column, which: str) -> Column:
    """Owner or name of a repository given as owner/name or as a URL."""
    pattern = r"^(?:https?://(?:www\.)?github\.com/)?([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$"
    return F.nullif(F.regexp_extract(F.trim(url), pattern, 1 if which == "owner" else 2), F.lit(""))


RAW = r"^https://raw\.githubusercontent\.com/([^/]+)/([^/]+)/([^/]+)/(.+)$"


def mirrored(url: Column, mirror: str, base: str = "") -> Column:
    """A raw file's URL at a mirror; other URLs stay."""
    to = {"jsdelivr": "https://cdn.jsdelivr.net/gh/$1/$2@$3/$4", "ghproxy": "https://gh-proxy.com/$0", "custom": base.rstrip("/") + "/$1/$2/$3/$4" if base else "$0"}.get(mirror, "$0")
    return F.regexp_replace(url, RAW, to)


def raw_file_url(repo: Column, file: str, ref: str = "HEAD") -> Column:
    owner, name = repo_part(repo, "owner"), repo_part(repo, "name")
    return F.coalesce(F.concat(F.lit("https://raw.githubusercontent.com/"), owner, F.lit("/"), name, F.lit(f"/{ref}/{file}")), F.lit(""))


def absolute_links(markdown: Column, repo: str) -> Column:
    """Relative image and link targets of a page made absolute: images to raw files, links to the repository's view."""
    relative = r"(?!(?:https?:)?//|#|(?i:mailto:|data:))\.?/?"
    raw, blob = f"https://raw.githubusercontent.com/{repo}/HEAD/", f"https://github.com/{repo}/blob/HEAD/"
    out = F.regexp_replace(markdown, r"(!\[[^\]]*\]\()" + relative + r"([^)\s]+\))", f"$1{raw}$2")
    out = F.regexp_replace(out, r"((?<!!)\[[^\]]*\]\()" + relative + r"([^)\s]+\))", f"$1{blob}$2")
    return F.regexp_replace(out, r'(?i)(<img[^>]*\ssrc=")' + relative + r'([^"]+")', f"$1{raw}$2")


# Kinds of network errors by what their messages hold, first match first.
ERRORS = {
    "timeout": "timeout|etimedout|超时",
    "dns": "enotfound|eai_again|dns|getaddrinfo",
    "blocked": r"403|404|blocked|被墙|network|raw\.githubusercontent",
    "json": "json|unexpected token|syntaxerror",
    "http": r"http\s*[0-9]{3}|status\s*[0-9]{3}",
}


def error_kind(message: Column) -> Column:
    out = None
    for kind, pattern in ERRORS.items():
        test = F.lower(message).rlike(pattern)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("unknown")


def release_urls(repo: Column, tag: Column, file: str) -> Column:
    """Candidate download URLs of a release file: the tag as it is, then with and without its v."""
    bare = F.regexp_replace(tag, "^v", "")
    tags = F.array_distinct(F.array(tag, bare, F.concat(F.lit("v"), bare)))
    return F.transform(tags, lambda t: F.concat(F.lit("https://github.com/"), repo, F.lit("/releases/download/"), t, F.lit(f"/{file}")))


def first_letter(name: Column, surnames: dict[str, str]) -> Column:
    """The letter a name is listed under: its own if Latin, that of the surname, two characters before one, else #."""
    t = F.trim(F.coalesce(name, F.lit("")))
    out = F.when(t.rlike("^[A-Za-z]"), F.upper(F.substring(t, 1, 1)))
    if surnames:
        table = F.create_map(*(F.lit(x) for p in surnames.items() for x in p))
        out = F.coalesce(out, F.try_element_at(table, F.substring(t, 1, 2)), F.try_element_at(table, F.substring(t, 1, 1)))
    return F.coalesce(out, F.lit("#"))


def base_url(url: Column) -> Column:
    """Without white space around and slashes behind."""
    return F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "/+$", "")


def is_local_url(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike(r"^https?://(localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\])(:[0-9]+)?(/|$)"), F.lit(False))


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)


def length_bucket(text: Column) -> Column:
    n = F.length(text)
    return F.when(n == 0, "empty").when(n <= 4, "1-4").when(n <= 8, "5-8").when(n <= 16, "9-16").otherwise("17+")


def char_classes(text: Column) -> Column:
    """Sorted names of the kinds of characters that a text has."""
    kinds = {"cjk": r"\p{IsHan}", "digit": "[0-9]", "latin": "[A-Za-z]", "punctuation": r"\p{P}", "space": "[\\s　 ﻿]", "other": r"[^\p{IsHan}0-9A-Za-z\p{P}\s" + "　 ﻿]"}
    return F.array_sort(F.array_compact(F.array(*(F.when(text.rlike(p), k) for k, p in kinds.items()))))


def safe_name(text: Column) -> Column:
    """A file name of a text: path marks become dashes, dots in front go."""
    return F.regexp_replace(F.regexp_replace(text, r'[\\/:*?"<>|\x00-\x1f]', "-"), r"^\.+", "")


def is_safe_id(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$") & ~text.rlike(r"\.\."), F.lit(False))


def has_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike("[㐀-䶿一-鿿＀-￯]"), F.lit(False))


def highlighted(text: Column, terms: list[str]) -> Column:
    """The text with every term, the longest first, marked."""
    import re

    wanted = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not wanted:
        return text
    return F.regexp_replace(text, "(?i)(" + "|".join(map(re.escape, wanted)) + ")", "<mark>$1</mark>")


def translation_problem(source: Column, target: Column) -> Column:
    """empty, echo, quota or ok."""
    same = F.lower(F.trim(source)) == F.lower(F.trim(target))
    return F.when(F.trim(F.coalesce(target, F.lit(""))) == "", "empty").when(same, "echo").when(F.upper(target).rlike("QUERY LENGTH LIMIT|QUOTA|MYMEMORY WARNING"), "quota").otherwise("ok")


def is_stale(last: Column, now_ms: int, ttl_ms: int) -> Column:
    """Never fetched counts as stale, a clock set back as fresh."""
    return F.when(last.isNull() | F.isnan(last.cast("double")) | (last <= 0), True).when(last > now_ms, False).otherwise(F.lit(now_ms) - last > ttl_ms)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")
