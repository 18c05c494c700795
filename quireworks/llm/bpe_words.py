"""BPE encoding and decoding by a distinct-word table.

Words (runs without white space, which no token of such a tokenizer crosses) are split off in Spark. Each part of the
input gives its distinct words once, letters and the signs after them apart; they are dealt out by hash, each distinct word is
encoded once, and its ids go back to the parts that hold it. The ids that a part uses are joined with the id-to-piece table,
and the part joins ids and pieces back by position, which encodes and decodes its documents.

A part is a partition of the scan, or a stretch of one. Only distinct words and ids cross the network besides the documents, so a word of a third of all rows
costs one row a part. The table of a bucket holds the distinct words of 1/n of the hash space and n follows the input; the piece
table has as many rows as the vocabulary has entries, whatever the input.

Defined cases: a null text counts as empty and gives no ids, an empty decoded text and the digests of the empty string;
very long texts are one row each and processed whole; rows repeated with one doc_id are each returned. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import PACKED_DDL, materialised, opened_arrays, or_empty, pack, packed, packs, parts_of, pieces_for, rows_of, table, to_batches, total_bytes, unpack
from quireworks.llm.tokens import WordEncoder, cut_words, encoder, gathered, strings, word_parts

#: Text, before compression, of which one bucket of the word table holds the words on average.
BUCKET_BYTES = 24 << 20

_ROW = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int8()), ("blob", pa.binary())])
_ROW_DDL = "part int, bucket int, kind tinyint, blob binary"


def _distinct(n_buckets: int, n_scan: int):
    """The distinct words of this part, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part, own in groupby(packs(batches, n_scan), key=lambda x: x[0]):
                seen: set[str] = set()
                for _, _, _, texts in own:
                    for found in word_parts(cut_words(texts).flatten().unique(), True):
                        seen.update(strings(found.dictionary, " "))
                seen.discard("")
                by: dict[int, list[bytes]] = defaultdict(list)
                while seen:
                    w = seen.pop().encode()
                    by[zlib.crc32(w) % n_buckets].append(w)
                yield from ((part, b, 0, pack(b"\n".join(sorted(ws)))) for b, ws in by.items())

        yield from to_batches(rows(), _ROW)

    return run


def _encoded(path: str):
    """Rows of one bucket after another: each distinct word is encoded once, then each part gets the ids of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(WordEncoder, path)

        def rows():
            for bucket, own in groupby(rows_of(batches, "bucket", "part", "blob"), key=lambda r: r[0]):
                lists = [(p, blob) for _, p, blob in own]
                distinct: set[str] = set()
                for _, blob in lists:
                    distinct.update(unpack(blob)[0].decode().split("\n"))
                words = list(distinct)
                flat, sizes = enc.ids_of(words)
                number = dict(zip(words, range(len(words))))
                del distinct, words
                for p, blob in lists:
                    raw = unpack(blob)[0]
                    mine = np.fromiter(map(number.__getitem__, raw.decode().split("\n")), np.int64)
                    yield p, bucket, 0, pack(raw, sizes[mine].astype("<i4").tobytes(), gathered(flat, sizes, mine)[0].astype("<u2").tobytes())

        yield from to_batches(rows(), _ROW)

    return run


_IDS = pa.schema([("part", pa.int32()), ("ids", pa.binary())])


def _ids_of_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct ids of each row of words, as one value."""
    yield from to_batches(((part, np.unique(np.frombuffer(unpack(blob)[2], "<u2")).tobytes()) for part, blob in rows_of(batches, "part", "blob")), _IDS)


def _used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct ids of each part, whose rows come one after another, from one bucket each."""
    for part, own in groupby(rows_of(batches, "part", "ids"), key=lambda r: r[0]):
        seen = np.zeros(1 << 16, bool)
        for _, ids in own:
            seen[np.frombuffer(ids, "<u2")] = True
        ids = np.flatnonzero(seen).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(ids)], names=["part", "id"])


def used_ids(ids: DataFrame, n_parts: int) -> DataFrame:
    """part, id: each id that a part uses, once, so no part has more rows than the vocabulary has entries, whatever the number of buckets."""
    of_rows = ids.select("part", "blob").mapInArrow(_ids_of_row, "part int, ids binary")
    return of_rows.repartitionById(n_parts, "part").sortWithinPartitions("part").mapInArrow(_used, "part int, id int")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("decoded", pa.string())])


class _Part:
    """A part's words with their ids, and its ids' pieces."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.flat: list[bytes] = []
        self.sizes: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.pieces: dict[int, str] = {}

    def learn(self, blob: bytes) -> None:
        words, sizes, flat = unpack(blob)
        own = words.decode().split("\n")
        self.number.update(zip(own, range(len(self.number), len(self.number) + len(own))))
        self.sizes.append(np.frombuffer(sizes, "<i4").astype(np.int64))
        self.flat.append(flat)

    def done(self) -> None:
        self.all_ids, self.all_sizes = np.frombuffer(b"".join(self.flat), "<u2"), np.concatenate(self.sizes)
        self.shown = pa.array([str(i) for i in range(max(self.pieces, default=0) + 1)])
        self.told = pa.array([self.pieces.get(i) for i in range(len(self.shown))], pa.string())

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin."""
        cut = cut_words(texts)
        numbered = cut.flatten().dictionary_encode()
        base, tail = word_parts(numbered.dictionary, True)
        at = [np.fromiter(map(self.number.__getitem__, strings(x.dictionary, " ")), np.int64)[x.indices.to_numpy()] for x in (base, tail)]
        flat, ends = gathered(self.all_ids, self.all_sizes, np.column_stack(at).ravel())
        ids, ends = gathered(flat, np.diff(ends[::2]), numbered.indices.to_numpy())
        offsets = cut.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]

    def joined(self, strings_of: pa.Array, ids: np.ndarray, at: np.ndarray) -> list[str]:
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), strings_of.take(pa.array(ids, pa.int32())))
        return pc.binary_join(lists, " ").to_pylist()


def _joined(keep: bool):
    """Rows of one part after another, its words and pieces first: ids by position, pieces by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for _, own in groupby(rows_of(batches, "part", "kind", "blob"), key=lambda r: r[0]):
                part, open_ = _Part(), True
                for _, kind, blob in own:
                    if kind == 0:
                        part.learn(blob)
                    elif kind == 1:
                        ids, flat = unpack(blob)
                        part.pieces.update(zip(np.frombuffer(ids, "<i4").tolist(), flat.decode().split("\n")))
                    else:
                        if open_:
                            part.done()
                            open_ = False
                        yield from documents(part, blob)

        def documents(part: _Part, blob: bytes):
            doc_ids, null, texts = opened_arrays(blob)
            docs = [None if z else d for d, z in zip(doc_ids.tolist(), null.tolist())]
            ids, at = part.texts(texts)
            shown, told, raw, cuts = part.joined(part.shown, ids, at), part.joined(part.told, ids, at), ids.tobytes(), at.tolist()
            for k, d in enumerate(docs):
                sha = [hashlib.sha256(x.encode()).hexdigest() for x in (shown[k], told[k])]
                yield d, cuts[k + 1] - cuts[k], raw[2 * cuts[k] : 2 * cuts[k + 1]] if keep else b"", *sha, told[k] if keep else ""

        yield from to_batches(rows(), _OUT)

    return run


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """id, piece: one row for each entry of the vocabulary."""
    pieces = WordEncoder(path).pieces
    return spark.createDataFrame(list(enumerate(pieces)), "id int, piece string")


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined pieces packed by part; batches come sorted by part."""
    for part, own in groupby(rows_of(batches, "part", "id", "piece"), key=lambda r: r[0]):
        _, ids, pieces = zip(*own)
        yield from to_batches(iter([(part, -1, 1, pack(np.array(ids, "<i4").tobytes(), "\n".join(pieces).encode()))]), _ROW)


def encode(docs: DataFrame, path: str, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 16-bit), digests of the decimal ids and of the decoded text, and that text.

    docs must give the same rows in the same partitions each time it is read, as tables do; a word without ids is an error.
    """
    spark = docs.sparkSession
    size = total_bytes(docs)
    rows, n_scan, n_parts = parts_of(docs.select("doc_id", or_empty("text").alias("text")), size)
    n_buckets = pieces_for(size, BUCKET_BYTES)
    words = rows.mapInArrow(_distinct(n_buckets, n_scan), _ROW_DDL)
    ids = materialised(words.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_encoded(path), _ROW_DDL), "word-ids")
    # The piece table has a row for each entry of the vocabulary, so it may be broadcast whatever the input.
    pieces = used_ids(ids, n_parts).join(F.broadcast(piece_table(spark, path)), "id").sortWithinPartitions("part").mapInArrow(_piece_rows, _ROW_DDL)
    both = ids.unionByName(pieces).unionByName(rows.mapInArrow(packed(n_scan), PACKED_DDL).select("part", F.lit(-1).alias("bucket"), F.lit(2).cast("tinyint").alias("kind"), "blob"))
    joined = both.repartitionById(n_parts, "part").sortWithinPartitions("part", "kind")
    return joined.mapInArrow(_joined(keep), "doc_id bigint, n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string, decoded string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded from doc_id, ids array<int>: ids joined with their pieces and put together in order."""
    pieces = piece_table(encoded.sparkSession, path)
    placed = encoded.select("doc_id", F.posexplode("ids").alias("at", "id"))
    found = placed.join(F.broadcast(pieces), "id")  # as many rows as the vocabulary has entries
    whole = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"))
    said = whole.select("doc_id", F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("decoded"))
    return encoded.select("doc_id").distinct().join(said, "doc_id", "left").withColumn("decoded", or_empty("decoded"))


def op10_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
