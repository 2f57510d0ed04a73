"""Secret scans: known patterns, and strings in a sensitive context that zstandard can't shorten.

A candidate's novelty is its marginal compressed size over its length: what the text
around it takes with the candidate, less what it takes without it, by a compressor
primed with a dictionary of common identifiers. Words, names and repeated strings are
found in that history and cost little; keys and passwords cost about as many bytes as
they have.
"""

from __future__ import annotations

import bisect
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_rows, texts

# The kinds of the base patterns in their order, and the patterns.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "novel")
LEAST_ASSIGNED = 6

#: Words that make what follows them sensitive.
SENSITIVE = r"key|secret|token|passw|passwd|pwd|passphrase|auth|bearer|credential|private|login|session|signature|cookie|salt|akia"
#: A string that may be a secret: 16 characters or more, among them a digit and a letter.
CANDIDATE = r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=.-]*[0-9])(?=[0-9+/_=.-]*[A-Za-z])[A-Za-z0-9+/_=.-]{16,}"

#: History for the compressor: identifiers and words that code and its settings use.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
    "password passwd secret token api_key apikey access_token refresh_token client_id client_secret private_key public_key "
    "authorization bearer basic credential credentials username user login session session_id cookie signature salt hash "
    "aws_access_key_id aws_secret_access_key database_url connection_string localhost 127.0.0.1 example.com https://www. "
    "config settings environment variable default value string number boolean integer function return import from class "
    "const let var def public static void null none true false undefined self this request response header content-type "
    "application/json text/html utf-8 version release development production staging test debug error warning info "
    "2020-01-01T00:00:00Z 00000000-0000-0000-0000-000000000000 sha256 md5 base64 id_rsa.pub ssh-rsa"
)
FINDINGS = "findings array<struct<kind:string,start:bigint,end:bigint,novel_bytes:bigint,novelty:double>>"


def scanner(around: int, reach: int, least_novelty: float):
    """A function that gives the findings of one text."""
    import zstandard

    assign, access, hexes = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX)
    sensitive, candidate = re.compile(SENSITIVE, re.I | re.A), re.compile(CANDIDATE)
    primed = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)

    def cost(text: str, start: int, end: int) -> int:
        """Bytes that the string adds to what stands around it."""
        before, after = text[max(0, start - around) : start], text[end : end + around]
        size = lambda s: len(primed.compress(s.encode()))
        return max(0, size(before + text[start:end] + after) - size(before + after))

    def scan(text: str) -> list[dict]:
        found = []
        if ":" in text or "=" in text:
            found += [(m.start(), 0, m.end(), m.start(2)) for m in assign.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end(), m.start()) for m in access.finditer(text)]
        found += [(m.start(), 2, m.end(), m.start()) for m in hexes.finditer(text)]
        out = []
        for start, kind, end, value in found:
            n = cost(text, value, end)
            out.append((start, kind, end, n, n / (end - value)))
        candidates = list(candidate.finditer(text))
        if not candidates:
            return [{"kind": KINDS[k], "start": s, "end": e, "novel_bytes": n, "novelty": v} for s, k, e, n, v in sorted(out)]
        begin, end = [], []  # of what the base spans cover, disjoint and in order
        for s, e in sorted((s, e) for s, _, e, _ in found):
            if end and s <= end[-1]:
                end[-1] = max(end[-1], e)
            else:
                begin.append(s)
                end.append(e)
        words = [m.end() for m in sensitive.finditer(text)]
        lines = [m.end() for m in re.finditer("\n", text)]
        last = lambda places, at: places[i - 1] if (i := bisect.bisect_right(places, at)) else 0
        for m in candidates:
            whole, e = m.span()
            value = text.rfind("=", whole, whole + len(m[0].rstrip("="))) + 1
            for s in (value, whole) if value and candidate.fullmatch(text[value:e]) else (whole,):
                i = bisect.bisect_right(end, s)
                if i < len(begin) and begin[i] < e:
                    continue
                if last(words, s) > max(last(lines, s), s - reach) and (n := cost(text, s, e)) >= least_novelty * (e - s):
                    out.append((s, 3, e, n, n / (e - s)))
                    break
        return [{"kind": KINDS[k], "start": s, "end": e, "novel_bytes": n, "novelty": v} for s, k, e, n, v in sorted(out)]

    return scan


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", around: int = 1024, reach: int = 1024, least_novelty: float = 0.8) -> DataFrame:
    """(doc_id, findings) for every row: what each text holds that looks secret, by place and kind.

    Kinds assign, access and hex are patterns; novel are the other strings of 16
    characters or more with a letter and a digit that stand within `reach` characters
    after a sensitive word on the same line, and of whose length zstandard saves less
    than 1 - least_novelty with `around` characters of context on either side. Places
    are code points, ends exclusive. Each finding has the bytes that it adds.
    What follows the last = in such a string, padding aside, is tried before the whole.

    One pass without a shuffle; a row is handled alone, at any length, in time that
    grows with it. Null and empty texts have no findings; ids may be of any type, null
    or repeated, each row is scanned; other columns are left out; no rows give no rows.
    """

    def run(batches):
        import pyarrow as pa

        scan, schema = scanner(around, reach, least_novelty), None
        for batch in batches:
            ids, found = batch.column(0), [scan(t) for _, t in as_rows(batch, "doc_id", "text")]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novel_bytes", pa.int64()), ("novelty", pa.float64())]))
            schema = schema or pa.schema([("doc_id", ids.type), ("findings", kind)])
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, kind)], schema=schema)

    docs = texts(df, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {FINDINGS}")


def op1_secret_scan(spark, sf_dir) -> DataFrame:
    """The findings of every document, as counts, digest and spans."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spelled = lambda c: F.array_join(F.transform(c, lambda f: F.concat_ws(":", f.kind, f.start, f.end)), ",")
    count = lambda kind: F.size(F.filter("findings", lambda f: f.kind == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(spelled(F.filter("findings", lambda f: f.kind != "novel")), 256).alias("base_sha256"),
        spelled("findings").alias("spans"),
        count("novel").alias("n_novel"),
        F.coalesce(F.aggregate("findings", F.lit(0).cast("long"), lambda a, f: a + f.novel_bytes), F.lit(0)).alias("novel_bytes"),
    )
