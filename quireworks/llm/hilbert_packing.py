"""Packing along a space-filling curve.

Each document's token ids are hashed into a vector, the vector is projected to a few dimensions, and the projections,
scaled by their mean and deviation over all documents, give a Hilbert key. A range sort by (key, doc_id) puts
similar documents side by side, and each range is packed by cutting its stream of ids every 1024: nothing is padded but
the end of a range's last sequence.

The encoded documents are written to the shared folder before the sort, for the sampling of splitters would otherwise encode them
twice. doc_id is part of the sort key, so many documents with one key are dealt over ranges like any others.

Defined cases: a null text counts as empty (its only id is the end id); a null doc_id sorts first; rows repeated with one doc_id
are packed each, ordered by content; an empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import materialised, or_empty, pieces_for, rows_of, table, to_batches, total_bytes
from quireworks.llm.tokens import ByteEncoder, encoder

SEQUENCE = 1024
#: Buckets that ids are hashed to, dimensions they are projected to, and bits of each in the key.
BUCKETS, DIMS, BITS = 256, 4, 12
RANGE_BYTES = 24 << 20


def _projection() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, BUCKETS, 1 << 16), rng.standard_normal((BUCKETS, DIMS))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys of points (n x d unsigned integers of `bits` bits) along the Hilbert curve, by Skilling's transform over whole columns."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), *[(f"v{i}", pa.float64()) for i in range(DIMS)]])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'double' if f.type == pa.float64() else 'binary' if f.type == pa.binary() else 'bigint'}" for f in schema)


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, ids (compressed 16-bit integers, the end id last) and the projections v0, v1, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (bucket, matrix) = encoder(ByteEncoder, path), _projection()
        end = np.array([end_id], "<u2").tobytes()
        packer = zstandard.ZstdCompressor(level=1)

        def rows():
            for batch in batches:
                for d, x in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                    raw = x + end
                    ids = np.frombuffer(raw, "<u2")
                    v = np.bincount(bucket[ids], minlength=BUCKETS).astype(np.float64)
                    v = np.round((v / np.sqrt(v @ v)) @ matrix, 6)
                    yield d, len(ids), packer.compress(raw), *v.tolist()

        yield from to_batches(rows(), _ENCODED)

    return docs.select("doc_id", or_empty("text").alias("text")).mapInArrow(run, _ddl(_ENCODED))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with the Hilbert key of their projections; mean and deviation are over all rows."""
    of = rows.agg(*[f(f"v{i}").alias(f"{n}{i}") for i in range(DIMS) for n, f in (("m", F.mean), ("s", F.stddev_pop))]).first()
    mean = np.array([of[f"m{i}"] or 0.0 for i in range(DIMS)])
    dev = np.array([of[f"s{i}"] or 1.0 for i in range(DIMS)])

    @F.pandas_udf("bigint")
    def key(*v: pd.Series) -> pd.Series:
        z = (np.column_stack([x.to_numpy() for x in v]) - mean) / (3 * dev)
        return pd.Series(hilbert(np.clip(np.floor((z + 1) / 2 * (1 << BITS)), 0, (1 << BITS) - 1)))

    return rows.withColumn("curve_key", key(*[f"v{i}" for i in range(DIMS)]))


def pack(docs: DataFrame, path: str, end_id: int, length: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of a document in a sequence. sequence_id holds the range in its upper 32 bits."""
    n_ranges = pieces_for(total_bytes(docs), RANGE_BYTES)
    keyed = _keyed(materialised(encoded(docs, path, end_id), "encoded"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32

        def rows():
            at = 0
            for d, blob in rows_of(batches, "doc_id", "ids"):
                ids = np.frombuffer(zstandard.decompress(blob), "<u2").astype("<u4")
                n, start = len(ids), 0
                raw = memoryview(ids).cast("B")
                while start < n:
                    take = min(n - start, length - at % length)
                    part = raw[4 * start : 4 * (start + take)]
                    yield d, start, take, zlib.crc32(part), n, first + at // length, at % length, bytes(part) if keep_ids else b""
                    start += take
                    at += take

        yield from to_batches(rows(), _PIECES)

    ordered = keyed.select("doc_id", "ids", "curve_key").repartitionByRange(n_ranges, "curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id", "ids")
    out = ordered.mapInArrow(run, _ddl(_PIECES))
    return out if keep_ids else out.drop("ids")


def op9_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)
