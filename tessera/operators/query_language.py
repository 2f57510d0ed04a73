"""The boolean query language: text to a small syntax tree on the driver, tree to one Column that Catalyst can push and prune."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field names and their aliases.
FIELDS = {"name": "name", "title": "name", "id": "id", "author": "author", "by": "author", "desc": "description", "description": "description"}

#: White space of the query language, the ideographic space among it.
SPACE = "\\s\u3000\u00a0\ufeff"
TOKEN = re.compile(f'(?:"[^"]*"?|[^{SPACE}"])+')
OR = object()


@dataclass(frozen=True)
class Term:
    value: str
    field: str = "any"


@dataclass
class Query:
    terms: list[Term] = field(default_factory=list)
    or_groups: list[list[Term]] = field(default_factory=list)
    excludes: list[Term] = field(default_factory=list)
    advanced: bool = False


def is_advanced(text: str) -> bool:
    """Whether the text needs the language at all: white space, exclusion, field, phrase or alternative."""
    return bool(re.search(f'[{SPACE}\\-:"|]', text.strip()))


def tokens(text: str) -> list:
    """Words, with spaces inside quotes kept; bars outside of quoted words stand alone as OR."""
    out: list = []
    for token in TOKEN.findall(text):
        pieces = [token] if '"' in token else re.split(r"(\|)", token)
        out += [OR if p == "|" or p.lower() == "or" else p for p in pieces if p]
    return out


def term(token: str) -> Term:
    head, colon, tail = token.partition(":")
    name = FIELDS.get(head.lower()) if colon and '"' not in head else None
    rest = tail if name else token
    if rest.startswith('"'):
        rest = rest[1:-1] if len(rest) > 1 and rest.endswith('"') else rest[1:]
    return Term(rest.lower().strip(), name or "any")


def parse(text: str) -> Query:
    """The tree of a query.

    Words are joined by AND; words around OR form a group, of which one must match; a
    leading OR opens an empty group; an exclusion closes a group that is open; words
    without a value are passed over and leave a group open.
    """
    query = Query(advanced=bool(text.strip()) and is_advanced(text))
    group: list[Term] | None = None
    wanted = False  # whether the group waits for its next member
    items = tokens(text.strip())

    def close():
        nonlocal group, wanted
        if group:
            query.or_groups.append(group)
        group, wanted = None, False

    for at, item in enumerate(items):
        if item is OR:
            if group is None:
                group = [query.terms.pop()] if query.terms else []
            wanted = True
        elif item.startswith("-") and len(item) > 1:
            query.excludes.append(term(item[1:]))
            close()
        elif (t := term(item)).value:
            if group is None or not wanted:
                query.terms.append(t)
                continue
            group.append(t)
            wanted = False
            if items[at + 1 : at + 2] != [OR]:
                close()
    close()
    return query


def contains(column: Column, value: str) -> Column:
    """Whether the lower-cased column holds the value; a null column holds nothing but the empty value."""
    return F.lit(True) if value == "" else F.coalesce(F.instr(F.lower(column), value) > 0, F.lit(False))


def search_blob(*columns) -> Column:
    """All given columns in lower case with spaces between, missing ones empty."""
    return F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns)))


def matches(query: Query, fields: dict[str, Column]) -> Column:
    """The query as a predicate over columns by field name; `any` is the field of words without one."""
    one = lambda t: contains(fields[t.field], t.value)
    every = [~one(t) for t in query.excludes] + [one(t) for t in query.terms] + [reduce(lambda a, b: a | b, map(one, g)) for g in query.or_groups]
    return reduce(lambda a, b: a & b, every, F.lit(True))


def text_filter(text: str, fields: dict[str, Column]) -> Column:
    """What a search box means by the text: everything if blank, a substring if plain, else the language."""
    if not text.strip():
        return F.lit(True)
    query = parse(text)
    return matches(query, fields) if query.advanced else contains(fields["any"], text.strip().lower())


def is_semantic_query(column: Column) -> Column:
    """Whether a text reads like a question for semantic search rather than a keyword."""
    t = F.trim(column)
    return (
        F.when(F.length(t) <= 3, False)
        .when(t.rlike(r"^[0-9]+$"), False)
        .when(F.regexp_count(t, F.lit("[\u4e00-\u9fff]")) >= 4, True)
        .when(F.length(t) > 15, True)
        .otherwise(F.size(F.split(t, r"\s+")) >= 5)
    )
