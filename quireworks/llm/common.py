"""What the operators share: tables in the shared folder, parts of the input, Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.shared import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Deletes the files of materialised DataFrames that nothing will read again."""
    for df in written:
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of a text column over all rows."""
    return int(docs.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0)


def pieces_for(n_bytes: int, each: int, least: int = 12) -> int:
    """How many partitions hold n_bytes at about `each` bytes: it follows the data, so a partition's size doesn't."""
    return max(least, -(-n_bytes // each))


def or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values, few at a time: a batch may hold ten thousand whole texts."""
    for batch in batches:
        for a in range(0, len(batch), 256):
            few = batch.slice(a, 256)
            yield from zip(*(few.column(few.schema.get_field_index(n)).to_pylist() for n in names))


def release_memory() -> None:
    """Gives what a task has freed back to the machine. Workers live on between tasks and would keep each stage's peak beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def to_batches(rows: Iterator[tuple], schema: pa.Schema, max_rows: int = 4096, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows packed into Arrow batches of bounded size."""
    kept: list[tuple] = []
    size = 0
    for row in rows:
        kept.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str))) + 64
        if len(kept) >= max_rows or size >= max_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema=schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema=schema)
    del kept
    release_memory()


#: Bytes of text of a part of the input, and of those packed together, about.
PART_BYTES, PACK_BYTES = 24 << 20, 1 << 20
PACKED = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("blob", pa.binary())])


def parts_of(docs: DataFrame, size: int) -> tuple[DataFrame, int, int]:
    """Rows (partition, then docs' columns), the partitions of their scan, and partitions enough for their parts, given the bytes of all texts."""
    rows = docs.select(F.spark_partition_id().alias("partition"), "*")
    n_scan = max(1, rows.rdd.getNumPartitions())
    return rows, n_scan, n_scan * max(1, -(-size // (n_scan * PART_BYTES)))


def packs(batches: Iterator[pa.RecordBatch], n_scan: int) -> Iterator[tuple[int, int, pa.Array, pa.Array]]:
    """(part, number, doc_ids, texts) of about PACK_BYTES each, from batches of (partition, doc_id, text). A partition of the scan is cut
    into parts of about PART_BYTES, numbered alike each time it is read, so no table of a part grows with the scan's partitions."""
    number, size, sub = 0, 0, 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False))
        a = 0
        while a < len(batch):
            before = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + PACK_BYTES, "right")))
            if size and size + int(ends[b - 1]) - before > PART_BYTES:
                sub, size = sub + 1, 0
            size += int(ends[b - 1]) - before
            yield batch.column(0)[a].as_py() + sub * n_scan, number, batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)
            number += 1
            a = b


def flat_of(ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids (0 for null), which are null, all bytes, the end of each text."""
    raw = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), raw, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)


def packed(n_scan: int):
    """Documents as PACKED, for batches of (partition, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, seq, ids, texts in packs(batches, n_scan):
            d, null, raw, ends = flat_of(ids, texts)
            blob = pack(d.astype("<i8").tobytes(), null.astype("u1").tobytes(), ends.astype("<i8").tobytes(), raw.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, seq, blob), PACKED.types)], schema=PACKED)

    return run


PACKED_DDL = "part int, seq bigint, blob binary"


def opened_flat(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids (0 for null), which are null, all bytes, the end of each text of packed documents."""
    ids, null, ends, raw = unpack(blob)
    return np.frombuffer(ids, "<i8"), np.frombuffer(null, "u1").astype(bool), np.frombuffer(raw, np.uint8), np.frombuffer(ends, "<i8")


def opened_arrays(blob: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """doc_ids (0 for null), which are null, and the texts of packed documents."""
    ids, null, raw, ends = opened_flat(blob)
    offsets = np.concatenate([[0], ends]).astype("<i4").tobytes()
    return ids, null, pa.StringArray.from_buffers(len(ids), pa.py_buffer(offsets), pa.py_buffer(raw.tobytes()))


def pack(*fields: bytes, level: int = 3) -> bytes:
    """Byte strings as one compressed one."""
    sizes = np.array([len(fields), *map(len, fields)], "<i8").tobytes()
    return zstandard.compress(sizes + b"".join(fields), level)


def unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ends = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i8", n, 8))])
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
