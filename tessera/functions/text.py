"""Tokenizers as Columns, and Jaro-Winkler as an Arrow function."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "㐀-鿿豈-﫿"
OTHERS = "[A-Za-z0-9_-]+|[\\x{10000}-\\x{10FFFF}]"
PIECES = f"[{CJK}]+|{OTHERS}"
#: The characters beyond ASCII that become ASCII letters in lower case.
ODD = "\u212a\u0130"


def ngrams(run: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substring(run, i, F.lit(n)))


def search_tokens(text: Column) -> Column:
    """Tokens of the index: runs of CJK characters whole up to three, else all pairs and triples; words of ASCII in lower case; characters beyond the BMP alone."""
    text = F.coalesce(text, F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(f"({PIECES})"), F.lit(1))
    cut = lambda p: F.when(~p.rlike(f"^[{CJK}]"), F.array(F.lower(p))).when(F.length(p) <= 3, F.array(p)).otherwise(F.concat(ngrams(p, 2), ngrams(p, 3)))
    # texts without CJK characters, the most by far, are cut by one pattern and need no function a token
    plain = F.regexp_extract_all(F.lower(text), F.lit(f"({OTHERS})"), F.lit(1))
    return F.when(text.rlike(f"[{CJK}{ODD}]"), F.flatten(F.transform(pieces, cut))).otherwise(plain)


def with_words(segmenter: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A tokenizer with the words of a segmenter (a Column of a text to its words) before the tokens of the index."""
    return lambda text: F.concat(F.coalesce(segmenter(text), F.array().cast("array<string>")), search_tokens(text))


# Words that tell descriptions apart no better than chance.
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "in", "on", "at", "to", "for", "of", "with", "and", "or",
    "it", "its", "this", "that", "you", "your", "can", "will", "not", "no", "has", "have", "had", "do", "does", "did",
    "from", "by", "as", "but", "all", "so", "we", "our",
]


def description_tokens(text: Column) -> Column:
    """Tokens of the similarity of descriptions: ASCII words of three characters or more without stop words, pairs of Han characters, single ones alone."""
    segments = F.split(F.trim(F.coalesce(text, F.lit(""))), "[\\]\\s　,，。；;、!！?？·\\[()（）“”‘’\"']+")
    words = lambda s: F.when((F.length(s) >= 3) & ~F.lower(s).isin(STOP_WORDS), F.array(F.lower(s))).otherwise(F.array().cast("array<string>"))
    han = lambda s: F.flatten(F.transform(F.regexp_extract_all(s, F.lit("([一-鿿㐀-䶿]+)"), F.lit(1)), lambda h: F.when(F.length(h) >= 2, ngrams(h, 2)).otherwise(F.array(h))))
    return F.flatten(F.transform(segments, lambda s: F.when(s == "", F.array().cast("array<string>")).when(s.rlike(r"^[A-Za-z0-9_.-]+$"), words(s)).otherwise(han(s))))


def simplified(text: Column, traditional: str, simple: str) -> Column:
    """Characters of a table replaced one by one; texts without Han characters stay as they are."""
    return F.when(text.rlike("[一-鿿]"), F.translate(text, traditional, simple)).otherwise(text)


def jaro(a: str, b: str) -> float:
    """Jaro similarity; transpositions count by halves."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not used[j] and b[j] == c), None)
        if j is not None:
            used[j] = True
            left.append(c)
    m = len(left)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(left, (c for c, u in zip(b, used) if u))) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro with a bonus for up to four equal characters in front, whatever the similarity."""
    j = jaro(a, b)
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(len(a), len(b), 4))
    return j + same * 0.1 * (1 - j)


def jaro_winkler_column(a: Column, b: Column) -> Column:
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler(s or "", t or "") for s, t in zip(x, y)], dtype="float64")

    return F.pandas_udf(score, "double")(a, b)
