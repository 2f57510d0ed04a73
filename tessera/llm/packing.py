"""Packing along a Hilbert curve: documents that lie close together share training sequences.

A document's strings of four bytes are hashed into a signed count vector, which fixed random
directions project to DIMS numbers; the Hilbert key of that point orders the documents.
They are dealt by ranges of the key, so neighbours on the curve meet in a task, which
lays their tokens end to end and cuts sequences of the full length. What remains at the
end of a task's range is cut into powers of two and needs no padding.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, as_rows, table, texts

LENGTH, END_ID = 2048, 1
#: Bytes of text in a range of the curve, about: what a task sorts and packs.
RANGE_BYTES = 24_000_000
#: Of the hashed vector, of the curve, and bits of a coordinate.
HASHED, DIMS, BITS = 256, 3, 12


def directions():
    import numpy as np

    return np.random.RandomState(20).standard_normal((HASHED, DIMS))


def hilbert_keys(points):
    """Place on the Hilbert curve of each row of whole coordinates below 2**BITS: the axes are turned and flipped from the highest bit down, then Gray-decoded, and their bits dealt together."""
    import numpy as np

    x = points.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (BITS - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            up = (x[:, i] & q) != 0
            t = (x[:, 0] ^ x[:, i]) & low
            x[:, 0] = np.where(up, x[:, 0] ^ low, x[:, 0] ^ t)
            if i:
                x[:, i] = np.where(up, x[:, i], x[:, i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (BITS - 1)
    while q > 1:
        t = np.where(x[:, n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(BITS - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def hashed(text: str):
    """Counts of all strings of four bytes of a text, by a hash, with a sign by another bit of it."""
    import numpy as np

    raw, counts = text.encode().translate(LOWER), np.zeros(2 * HASHED, np.int64)
    for k in range(min(4, max(0, len(raw) - 3))):
        fours = np.frombuffer(raw, "<u4", (len(raw) - k) // 4, k)
        counts += np.bincount((fours * np.uint32(0x9E3779B1)) >> np.uint32(32 - (2 * HASHED - 1).bit_length()), minlength=2 * HASHED)
    return counts[:HASHED] - counts[HASHED:]


def keys_of(vectors):
    """Hilbert keys of hashed vectors: square roots of the counts, length one, projected, each coordinate spread evenly."""
    import numpy as np

    v = np.sign(vectors) * np.sqrt(np.abs(vectors))
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    even = 1 / (1 + np.exp(-1.702 * (v @ directions())))
    return hilbert_keys(np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def with_keys(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            vectors = np.zeros((batch.num_rows, HASHED))
            for i, (text,) in enumerate(as_rows(batch, "text")):
                vectors[i] = hashed(text)
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(vectors), pa.int64()), batch.column(0), batch.column(1)], ["key", "doc_id", "text"])

    return docs.mapInArrow(run, f"key bigint, doc_id {dict(docs.dtypes)['doc_id']}, text string")


def vocabulary_of(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(ranks, added): the byte strings and the added tokens of a byte-level tokenizer file, by id.

    Such files spell a byte that is no printable Latin-1 character as the next free
    code point from 256 on.
    """
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    added = {t["content"]: t["id"] for t in read["added_tokens"]}
    return {bytes(byte[c] for c in token): n for token, n in read["model"]["vocab"].items() if token not in added}, added


def encoder(vocabulary: tuple[dict[bytes, int], dict[str, int]], pattern: str):
    """A function from a text to its ids; added tokens are found in a text before it is cut into words."""
    import tiktoken

    ranks, added = vocabulary
    coder = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: coder.encode_to_numpy(text, allowed_special="all")


def powers(n: int):
    """n as a sum of powers of two, the largest first."""
    while n:
        p = 1 << (n.bit_length() - 1)
        yield p
        n -= p


class Packer:
    """Lays documents end to end; give it ids, take the pieces of the sequences that are full."""

    def __init__(self, first: int, length: int):
        self.next, self.length, self.open, self.held = first, length, [], 0

    def cut(self, lengths):
        """Pieces of the open documents for sequences of the given lengths, which sum to what is held."""
        out, at = [], 0
        todo = list(self.open)
        for n in lengths:
            offset = 0
            while offset < n:
                doc, start, data, total = todo[at]
                take = min(len(data) // 4, n - offset)
                out.append((doc, start, take, zlib.crc32(data[: 4 * take]), total, self.next, offset, n))
                offset += take
                if 4 * take < len(data):
                    todo[at] = (doc, start + take, data[4 * take :], total)
                else:
                    at += 1
            self.next += 1
        self.open, self.held = [], 0
        return out

    def add(self, doc, ids):
        data, total, start, out = memoryview(ids.astype("<u4").tobytes()), len(ids), 0, []
        while start < total:
            take = min(total - start, self.length - self.held)
            self.open.append((doc, start, data[4 * start : 4 * (start + take)], total))
            self.held += take
            start += take
            if self.held == self.length:
                out += self.cut([self.length])
        return out


PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length bigint"


def pack(df: DataFrame, vocabulary: tuple[dict[bytes, int], dict[str, int]], pattern: str, id_col="doc_id", text_col="text", length: int = LENGTH, end_id: int = END_ID, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of all documents in sequences of at most `length` tokens, documents along the curve.

    A document's ids are those of its text by the vocabulary, its added tokens
    included, then end_id, so every document has one at least; null texts are empty.
    Each id lies in one piece. A sequence is full, or a power of two long.

    Ranges hold about range_bytes of text at any size of the input. Ids of sequences
    have the number of their range in the upper bits; order within a range is by key,
    id and text, so a range that is made anew, after the loss of an executor, gives the
    same ones. Equal keys, such as those of copies, are split by document id and text,
    so no group of copies lands in one task. Repeated rows are each packed; null ids
    come first among equal keys; other columns are left out; no rows give no pieces.
    """
    docs = texts(df, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    keyed = with_keys(docs).withColumn("tie", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(max(1, -(-size // range_bytes)), "key", "doc_id", "tie").sortWithinPartitions("key", "doc_id", "tie", "text")
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, packer, id_type = encoder(sent.value, pattern), Packer(TaskContext.get().partitionId() << 40, length), None

        def as_batch(pieces):
            columns = list(zip(*pieces)) or [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, id_type if i == 0 else pa.int64()) for i, c in enumerate(columns)], ["doc_id", *(x.split()[0] for x in PIECE.split(", "))])

        for batch in batches:
            id_type, out = batch.column(1).type, []
            for doc, text in as_rows(batch, "doc_id", "text"):
                out += packer.add(doc, np.append(encode(text), np.uint32(end_id)))
            yield as_batch(out)
        if packer.held:
            yield as_batch(packer.cut(list(powers(packer.held))))

    return dealt.select("key", "doc_id", "text").mapInArrow(run, f"doc_id {dict(keyed.dtypes)['doc_id']}, {PIECE}")


def pack_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """pack() with the public byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return pack(docs, vocabulary_of(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN)


def op10_packing(spark, sf_dir) -> DataFrame:
    """The pieces of all documents."""
    return pack_documents(spark, table(spark, sf_dir, "documents"))
