"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A file holds the documents of a stretch of doc_ids, ascending over all files. Each document's ids are one zstandard frame,
so a short document is read by its offset without touching its neighbours, and the dictionary, trained on serialised id
arrays, gives the frames the context that they lack by being short.

    magic 8 bytes | header length u32 | header JSON | doc_ids i64[n] | null flags u8[n] | tokens u32[n] | offsets u64[n+1] | frames | end mark

The header has n, the range's number, the number within it, bytes an id, and the SHA-256 of the dictionary, which a reader
must hold. Spark's text writer commits the files (one row a file, the end mark as its line end), so a lost
executor leaves no half-written file behind, and any store that Spark writes to will do.

Defined cases: a null text counts as empty (its only id is the end id); a null doc_id sorts first; rows repeated with one doc_id
are all kept, ordered by text; an empty table gives no file. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireworks.llm.common import or_empty, pieces_for, rows_of, scratch, table, to_batches, total_bytes
from quireworks.llm.tokens import WordEncoder, encoder, portions

MAGIC = b"QWIDS\x001\n"
END = "\nQWIDS-END\n"
#: Bytes of text in a range, and of ids in a file, about.
RANGE_BYTES = 24 << 20
FILE_BYTES = 8 << 20
#: Ranges whose starts are summed together.
BLOCK = 4096
#: Documents that the dictionary is trained on, at most about; ids of each training sample; bytes of all; size of the dictionary.
SAMPLE_DOCS, SAMPLE_IDS, SAMPLE_BYTES, DICT_BYTES = 2000, 512, 4 << 20, 64 << 10
LEVEL = 3


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> bytes:
    """A dictionary from a bounded sample, chosen by a hash of doc_id; b"" where there is too little to train on."""
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(n, 1))
    few = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id", or_empty("text").alias("text"))

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(WordEncoder, path)
        for batch in batches:
            ids = enc.encode(batch.column(1))
            step = 2 * SAMPLE_IDS
            cut = [x[k : k + step] for x in ids for k in range(0, len(x), step)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x in cut if len(x) >= 16], pa.binary())], names=["s"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for (s,) in rows_of(batches, "s"):
            if size < SAMPLE_BYTES:
                kept.append(s)
                size += len(s)
        try:
            got = zstandard.train_dictionary(min(DICT_BYTES, max(1024, size // 8)), kept, k=256, d=8, level=LEVEL).as_bytes() if len(kept) >= 16 else b""
        except zstandard.ZstdError:  # samples that have nothing in common
            got = b""
        yield pa.RecordBatch.from_arrays([pa.array([got], pa.binary())], names=["dictionary"])

    got = few.mapInArrow(samples, "s binary").repartition(1).mapInArrow(train, "dictionary binary").collect()
    return bytes(got[0]["dictionary"]) if got else b""


def write_ids(docs: DataFrame, path: str, end_id: int, to: str, dictionary: bytes) -> None:
    """Encode docs(doc_id, text) with the tokenizer file at `path`, append end_id to each and write the files to `to`."""
    rows = docs.select("doc_id", or_empty("text").alias("text"))
    n_ranges = pieces_for(total_bytes(docs), RANGE_BYTES)
    digest = hashlib.sha256(dictionary).hexdigest()
    end = np.array([end_id], "<u2").tobytes()

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(WordEncoder, path)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        at, number = TaskContext.get().partitionId(), 0
        ids: list = []
        frames: list[bytes] = []
        counts: list[int] = []
        size = 0

        def done() -> pa.RecordBatch:
            n = len(ids)
            head = json.dumps({"n": n, "range": at, "number": number, "width": 2, "dictionary": digest, "tokens": sum(counts)}).encode()
            offsets = np.concatenate([[0], np.cumsum(list(map(len, frames)))]).astype("<u8")
            body = [MAGIC, np.array([len(head)], "<u4").tobytes(), head, np.array([d or 0 for d in ids], "<i8").tobytes(), np.array([d is None for d in ids], "u1").tobytes(), np.array(counts, "<u4").tobytes(), offsets.tobytes(), *frames]
            return pa.RecordBatch.from_arrays([pa.array([b"".join(body)], pa.binary())], names=["file"])

        for batch in batches:
            for a, b in portions(batch.column(1)):
                for d, x in zip(batch.column(0).slice(a, b - a).to_pylist(), enc.encode(batch.column(1).slice(a, b - a))):
                    raw = x + end
                    frames.append(packer.compress(raw))
                    ids.append(d)
                    counts.append(len(raw) // 2)
                    size += len(frames[-1])
                if size >= FILE_BYTES:
                    yield done()
                    number += 1
                    ids, frames, counts, size = [], [], [], 0
        if ids:
            yield done()

    ordered = rows.repartitionByRange(n_ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(files, "file binary").select(F.col("file").cast("string").alias("value"))
    made.write.option("maxRecordsPerFile", 1).option("lineSep", END).text(to)


def _header(raw: bytes) -> tuple[dict, int]:
    if raw[:8] != MAGIC or not raw.endswith(END.encode()):
        raise ValueError("not a token-id file, or cut short")
    n = int(np.frombuffer(raw, "<u4", 1, 8)[0])
    return json.loads(raw[12 : 12 + n]), 12 + n


class IdFile:
    """One file's documents by position; a frame is decompressed only when asked for."""

    def __init__(self, raw: bytes, dictionary: bytes) -> None:
        self.head, at = _header(raw)
        if self.head["dictionary"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError("the file was written with another dictionary")
        n = self.head["n"]
        self.doc_ids = [None if z else d for d, z in zip(np.frombuffer(raw, "<i8", n, at).tolist(), np.frombuffer(raw, "u1", n, at + 8 * n).tolist())]
        self.counts = np.frombuffer(raw, "<u4", n, at + 9 * n)
        self.offsets = np.frombuffer(raw, "<u8", n + 1, at + 13 * n).tolist()
        self.frames = memoryview(raw)[at + 13 * n + 8 * (n + 1) :]
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> np.ndarray:
        return np.frombuffer(self.unpack.decompress(self.frames[self.offsets[k] : self.offsets[k + 1]]), "<u2")


def read_ids(spark: SparkSession, at: str, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit) from the files at `at`."""
    if spark.read.format("binaryFile").load(at).select("path").limit(1).count() == 0:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    files = spark.read.format("binaryFile").load(at).select("content")
    out = pa.schema([("range", pa.int64()), ("number", pa.int64()), ("tokens", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    ddl = "range bigint, number bigint, tokens bigint, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (raw,) in rows_of(batches, "content"):
                f = IdFile(raw, dictionary)
                before = 0
                for k, d in enumerate(f.doc_ids):
                    ids = f.ids(k)
                    yield f.head["range"], f.head["number"], f.head["tokens"], d, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                    before += len(ids)

        yield from to_batches(rows(), out)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_header(raw)[0] for (raw,) in rows_of(batches, "content")]
        yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in found], pa.int64()) for k in ("range", "number", "tokens")], names=["range", "number", "tokens"])

    # Tokens before each file: over blocks of ranges, over the ranges of a block, over the files of a range.
    tops = files.mapInArrow(heads, "range bigint, number bigint, tokens bigint")
    of_range = Window.partitionBy("range").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = tops.groupBy("range", F.floor(F.col("range") / BLOCK).alias("block")).agg(F.sum("tokens").alias("t"))
    blocks = ranges.groupBy("block").agg(F.sum("t").alias("t")).select("block", before(Window.orderBy("block")).alias("block_start"))
    ranges = ranges.select("range", "block", before(Window.partitionBy("block").orderBy("range")).alias("in_block")).join(blocks, "block")
    starts = tops.select("range", "number", F.coalesce(F.sum("tokens").over(of_range), F.lit(0)).alias("file_start")).join(ranges.select("range", (F.col("block_start") + F.col("in_block")).alias("range_start")), "range")
    return files.mapInArrow(documents, ddl).join(starts, ["range", "number"]).select("doc_id", (F.col("range_start") + F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    dictionary = train_dictionary(docs, path, 1)
    to = scratch(spark, "token-ids")
    write_ids(docs, path, 1, to, dictionary)
    return read_ids(spark, to, dictionary)
