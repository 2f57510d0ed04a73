"""The one-file binary format of a vector index: a header, ids, one scale and zero for all, a byte a number."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession

# The format's mark and version.
MAGIC, VERSION = b"PVIX", 1


def pack_text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack("<H", len(raw)) + raw


def encode(ids: list[str], vectors, model: str = "", digest: str = "", schema: str | None = None) -> bytes:
    import numpy as np

    v = np.asarray(vectors, np.float64).reshape(len(ids), -1)
    low, high = (float(v.min()), float(v.max())) if v.size else (0.0, 0.0)
    scale = (high - low) / 254 or 1.0
    zero = -low / scale - 127 if high > low else 0.0
    head = MAGIC + struct.pack("<BII", VERSION, v.shape[1] if v.size else 0, len(ids)) + pack_text(model) + pack_text(digest)
    head += b"\x01" + pack_text(schema) if schema else b"\x00"
    codes = np.clip(np.floor(v / scale + zero + 0.5), -128, 127).astype(np.int8)
    return head + b"".join(map(pack_text, ids)) + struct.pack("<ff", scale, zero) + codes.tobytes()


def decode(data: bytes) -> tuple[list[str], list[list[float]], str, str, str | None]:
    """(ids, vectors, model, digest, schema); ValueError for another mark or version and for data that ends early."""
    import numpy as np

    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("the data ends early")
        at += n
        return data[at - n : at]

    def text() -> str:
        return take(struct.unpack("<H", take(2))[0]).decode()

    if take(4) != MAGIC:
        raise ValueError("not a vector index")
    version, dims, count = struct.unpack("<BII", take(9))
    if version != VERSION:
        raise ValueError(f"unknown version {version}")
    model, digest = text(), text()
    schema = text() if take(1) == b"\x01" else None
    ids = [text() for _ in range(count)]
    scale, zero = struct.unpack("<ff", take(8))
    codes = np.frombuffer(take(count * dims), np.int8).reshape(count, dims)
    return ids, ((codes - zero) * scale).tolist(), model, digest, schema


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, ord, vec) of all index files under a path; a file is read by one task."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for data in pdf["content"]:
                ids, vectors, *_ = decode(bytes(data))
                yield pd.DataFrame({"id": ids, "ord": range(len(ids)), "vec": vectors})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id string, ord bigint, vec array<float>")
