"""Fuzzy line dedup: near-equal lines are found by SimHash and edit similarity, and one occurrence of each group stays.

Lines are normalised (A-Z in lower case, white space collapsed and trimmed, digits as 0) and equal ones collapse first. A distinct line gets a
SimHash of BLOCKS x 16 bits over its distinct words. Lines that agree in a block of 16 bits meet; those at most NEAR bits apart are
candidates, which is every pair at most BLOCKS - 1 bits apart (pigeonhole) and most of the others. Candidates of an edit similarity of SIMILAR
or more are linked, and connected lines form a group. The occurrence with the smallest (doc_id, line number)
stays, all others go. Lines without a word are left alone.

SimHash finds nearly all lines that differ in few of their words and few of those that differ in many: see the README for the measured recall by
similarity. The input is read once, into the shared folder; lines travel as ids and hashes, and texts are fetched from their documents once, for candidates only. In a first round each line is held
against the nearest few and the first of those it meets, which joins a group of thousands at a cost that follows its size. In a second one, for the
block values where some line meets more than that, every line, linked or not, is held against all that it meets in other groups, so no candidate is left out. A block value of very many
lines is dealt out in pieces, each two of which meet in a task. What is near and first doesn't depend on how rows arrive.

Defined cases: null and empty texts have no lines and stay empty; rows repeated with one doc_id have equal lines, of which none is
second to itself, so both rows keep them; a null doc_id sorts after all others; very long lines are compared whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import discard, flat_of, materialised, or_empty, pack, packs, parts_of, release_memory, rows_of, table, to_batches, unpack
from quireworks.llm.components import connected
from quireworks.llm.shingles import span_hashes
from quireworks.llm.tokens import strings

#: Blocks of the SimHash, of 16 bits each; bits that candidates may be apart; edit similarity, as a share of the longer line that may stay.
BLOCKS, NEAR, SIMILAR = 6, 14, 0.8
#: Lines that each line is held against in the first round; lines of a block value in a piece; rows, words and bytes taken at once; lines of a small group; rows compared at once.
NEAREST, PIECE, TILE, WORDS, BYTES, FEW, ROWS = 3, 4096, 1024, 1 << 13, 1 << 16, 64, 1 << 16
_LAST = (1 << 63) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[49:58] = 48
_LOWER[[9, 11, 12, 13]] = 32
_MIX = np.random.default_rng(64).integers(1, 1 << 62, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The bits of a byte, a byte each, so eight are added at once.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)).view(np.uint64)


def cut_lines(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Normalised lines of the texts, numbered, and where each text's begin (and the last one's end)."""
    lists = pc.split_pattern(texts, "\n")
    flat = lists.flatten()
    offsets, data = flat.buffers()[1:]
    if data is not None:
        flat = pa.StringArray.from_buffers(len(flat), offsets, pa.py_buffer(_LOWER[np.frombuffer(data, np.uint8)].tobytes()), offset=flat.offset)
    double = pc.match_substring(flat, "  ")
    if pc.any(double).as_py():
        flat = pc.replace_with_mask(flat, double, pc.replace_substring_regex(flat.filter(double), " {2,}", " "))
    at = lists.offsets.to_numpy()
    return pc.ascii_trim(flat, " ").dictionary_encode(), at - at[0]


def line_ids(lines: list[str]) -> np.ndarray:
    """64 bits that name a line; 0 for the empty one."""
    return np.frombuffer(b"".join(hashlib.blake2b(x.encode(), digest_size=8).digest() if x else bytes(8) for x in lines), np.int64)


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """The hashes of words, those of some bytes at a time."""
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + BYTES)))
        at = starts[a]
        yield span_hashes(raw[at : ends[b - 1]], starts[a:b] - at, ends[a:b] - at)
        a = b


def simhashes(lines: pa.Array) -> np.ndarray:
    """Of each normalised line BLOCKS numbers of 16 bits: bit by bit the majority over the hashes of its distinct words."""
    n_words = np.where(pc.binary_length(lines).to_numpy() > 0, pc.count_substring(lines, " ").to_numpy() + 1, 0)
    out = np.zeros((len(lines), 2 * BLOCKS), np.uint8)
    full = np.flatnonzero(n_words)
    if not len(full):
        return out.view(">u2").astype(np.uint16)
    raw = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), " ")[0].as_buffer(), np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(raw))
    starts, ends = starts[ends > starts], ends[ends > starts]  # an empty line has no word
    numbered = pa.array(np.concatenate(list(_hashes(raw, starts, ends)))).dictionary_encode()
    h = numbered.dictionary.to_numpy()
    bits = _SPREAD.take(np.stack([h * m ^ (h >> np.uint64(29)) for m in _MIX], axis=1).view(np.uint8)[:, : 2 * BLOCKS])
    # Each word once a line: else the frequent words of a language make all its longer lines alike.
    shift = len(h).bit_length()
    once = np.sort(np.repeat(np.arange(len(full)) << shift, n_words[full]) | numbered.indices.to_numpy())
    once = once[np.concatenate([[True], once[1:] != once[:-1]])]
    of, codes = once >> shift, once & ((1 << shift) - 1)
    at = np.searchsorted(of, np.arange(len(full) + 1))
    a = 0
    while a < len(full):  # some lines at a time
        b = max(a + 1, int(np.searchsorted(at, at[a] + WORDS, "right")) - 1)
        begin, n = at[a:b] - at[a], np.diff(at[a : b + 1])
        gathered = bits.take(codes[at[a] : at[b]], axis=0, mode="clip")
        if n.max() < 256:
            counts = np.add.reduceat(gathered, begin).view(np.uint8)
        else:
            pieces = -(-n // 255)  # of 255 words at most, which a byte can count
            first = np.cumsum(pieces) - pieces
            starts = np.repeat(begin, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
            counts = np.add.reduceat(np.add.reduceat(gathered, starts).view(np.uint8), first, dtype=np.int32)
        out[full[a:b]] = np.packbits(counts > (n // 2).astype(counts.dtype)[:, None], axis=1)
        a = b
    return out.view(">u2").astype(np.uint16)


_SEEN = pa.schema([("part", pa.int32()), *((c, pa.int64()) for c in ("lid", "high", "low", "doc_id", "line_no", "n", "seq")), ("blob", pa.binary())])
_SEEN_DDL = "part int, lid bigint, high bigint, low bigint, doc_id bigint, line_no bigint, n bigint, seq bigint, blob binary"


def _seen(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in _SEEN], schema=_SEEN)


def _distinct(n_scan: int):
    """The distinct lines of a part, by id and hash (four blocks in high, the others in low), with their first occurrence and count; and its documents, with
    the ids of all their lines, as rows of seq and blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in groupby(packs(batches, n_scan), key=lambda x: x[0]):
            kept: list[tuple] = []
            for _, seq, ids, texts in own:
                numbered, at = cut_lines(texts)
                lid = line_ids(strings(numbered.dictionary, "\n"))
                lids = lid[numbered.indices.to_numpy()]
                d, null, raw, ends = flat_of(ids, texts)
                blob = pack(d.astype("<i8").tobytes(), null.astype("u1").tobytes(), ends.astype("<i8").tobytes(), raw.tobytes(), lids.astype("<i8").tobytes(), level=1)
                yield _seen(1, part=pa.array([part], pa.int32()), seq=pa.array([seq], pa.int64()), blob=pa.array([blob], pa.binary()))
                of = np.repeat(np.arange(len(texts)), np.diff(at))
                doc = ids.fill_null(_LAST).to_numpy()[of]
                kept.append(_first(lids, doc, np.arange(len(of)) - at[of], np.ones(len(of), np.int64)) + (lid, simhashes(numbered.dictionary)))
            lid, doc, line, n = _first(*(np.concatenate([k[i] for k in kept]) for i in range(4)))
            all_lids, sims = np.concatenate([k[4] for k in kept]), np.concatenate([k[5] for k in kept])
            by = np.argsort(all_lids, kind="stable")
            sim = sims[by[np.searchsorted(all_lids, lid, sorter=by)]]
            high, low = np.ascontiguousarray(sim[:, :4]).view(np.int64).ravel(), np.ascontiguousarray(sim[:, 4:]).view(np.uint32).ravel().astype(np.int64)
            columns = {"part": np.full(len(lid), part, np.int32), "lid": lid, "high": high, "low": low, "doc_id": doc, "line_no": line, "n": n}
            for a in range(0, len(lid), 1 << 16):
                few = {k: pa.array(v[a : a + (1 << 16)]) for k, v in columns.items()}
                yield _seen(len(few["lid"]), **few)

    return run


def _first(lid: np.ndarray, doc: np.ndarray, line: np.ndarray, n: np.ndarray) -> tuple:
    """Each distinct line but the empty one: its id, first (doc, line) and count."""
    by = np.lexsort((line, doc, lid))
    by = by[lid[by] != 0]
    new = np.flatnonzero(np.concatenate([[True], lid[by][1:] != lid[by][:-1]])[: len(by)])
    return lid[by[new]], doc[by[new]], line[by[new]], np.add.reduceat(n[by], new) if len(new) else n[:0]


_PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def near(words: np.ndarray, first: np.ndarray, size: np.ndarray, differ: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates (place, earlier place, bits apart) among lines that share a block value, which lie side by side from `first` on; all of a place
    come together. differ: only lines with different values there count. Groups of FEW or less are compared at once, each line with the one s before it."""
    few = size <= FEW
    at = np.where(np.repeat(few, size), np.arange(len(words)) - np.repeat(first, size), -1)
    left, right = np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1])
    rows, s, found = np.flatnonzero(at > 0), 1, []
    while len(rows):
        to = rows - s
        apart = np.bitwise_count(left[rows] ^ left[to])
        some = np.flatnonzero(apart <= NEAR)
        if len(some):  # few as a rule
            a, b = rows[some], to[some]
            apart = apart[some] + np.bitwise_count(right[a] ^ right[b])
            hit = apart <= NEAR
            for x in differ:
                hit &= x[a] != x[b]
            found.append((a[hit], b[hit], apart[hit].astype(np.int64)))
        s += 1
        rows = rows[at[rows] >= s]
    if found:
        yield tuple(np.concatenate(x) for x in zip(*found))
    for f, n in zip(first[~few].tolist(), size[~few].tolist()):
        for i in range(f, f + n, TILE):
            found = []
            for j in range(f, i + 1, TILE):
                some = np.bitwise_count(left[i : min(f + n, i + TILE), None] ^ left[None, j : min(f + n, j + TILE)]) <= NEAR
                a, b = np.nonzero(some)
                a, b = a + i, b + j
                apart = np.bitwise_count(left[a] ^ left[b]) + np.bitwise_count(right[a] ^ right[b])
                hit = (apart <= NEAR) & (b < a)
                for x in differ:
                    hit &= x[a] != x[b]
                found.append((a[hit], b[hit], apart[hit].astype(np.int64)))
            yield tuple(np.concatenate(x) for x in zip(*found))


def nearest(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place the nearest few candidates and the first; the places that have more."""
    by = np.lexsort((b, apart, a))
    a, b = a[by], b[by]
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])[: len(a)])
    n = np.diff(np.concatenate([start, [len(a)]]))
    rank = np.arange(len(a)) - np.repeat(start, n)
    keep = rank < NEAREST
    if len(a):
        keep |= b == np.repeat(np.minimum.reduceat(b, start), n)
    return a[keep], b[keep], a[~keep]


_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int32())])


def blocks_of(lines: DataFrame) -> DataFrame:
    """key, lid, high, low of lines(lid, high, low): a row for each block of the SimHash."""
    values = [F.shiftrightunsigned("high" if k < 4 else "low", 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF)).cast("int") + (k << 16) for k in range(BLOCKS)]
    return lines.select("lid", "high", "low", F.explode(F.array(*values)).alias("key"))


#: Bits of a piece's number in a tile's: key, a piece, the same or a later one.
_PIECE_BITS = 22


def candidates(blocks: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Distinct candidates (u, v) among blocks(key, lid, high, low): of each line the nearest few and the first of those before it, rows without u and v
    for each key where some line has more, and (u, u) for lines that are left out there and in no candidate with that key. With labels(lid, label) all that
    have another label (a line without one has its own), and no such rows."""
    # No more keys than BLOCKS << 16, whatever the input.
    sizes = blocks.groupBy("key").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")).filter("pieces > 1")
    dealt = blocks.join(F.broadcast(sizes), "key", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("lid"), "pieces").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    x, y = (f("piece", "other").cast("bigint") for f in (F.least, F.greatest))
    tile = F.shiftleft(F.col("key").cast("bigint"), 2 * _PIECE_BITS).bitwiseOR(F.shiftleft(x, _PIECE_BITS)).bitwiseOR(y)
    # Where two pieces meet, the lines of the second have a bit more.
    later = F.when(F.col("piece") > F.col("other"), F.lit(1 << 32)).otherwise(F.lit(0))
    tiles = dealt.select(tile.alias("tile"), "lid", "high", (F.col("low") + later).alias("low"))
    if labels is not None:
        tiles = tiles.join(labels, "lid", "left").select("tile", "lid", "high", "low", F.coalesce("label", "lid").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, tile, lid, high, low, *label in grouped(batches):
            size = np.diff(np.append(first, len(lid)))
            own = np.where(tile & ((1 << _PIECE_BITS) - 1) == tile >> _PIECE_BITS & ((1 << _PIECE_BITS) - 1), np.arange(len(lid)), -1 - (low >> 32))
            words = np.stack([high, low & 0xFFFFFFFF], axis=1).view(np.uint64)
            for a, b, apart in near(words, first, size, [own, *label]):
                if not label:
                    alone = np.zeros(len(lid), bool)
                    alone[b] = True
                    a, b, more = nearest(a, b, apart)
                    alone[a] = alone[b] = False
                    out, short = lid[alone], np.unique(tile[more] >> 2 * _PIECE_BITS)
                    if len(out) or len(short):
                        u = pa.array(np.append(out, short), mask=np.arange(len(out) + len(short)) >= len(out))
                        key = pa.array(np.append(out * 0, short).astype(np.int32), mask=np.arange(len(out) + len(short)) < len(out))
                        yield pa.RecordBatch.from_arrays([u, u, key], schema=_FOUND)
                u, v = lid[a], lid[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.nulls(len(u), pa.int32())], schema=_FOUND)

    # Sorted by one number, which Spark does fast; the lines of a tile are put in order where they are compared.
    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "u bigint, v bigint, key int").distinct()


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Starts of whole runs of equal tiles, about ROWS rows of them at a time, and the columns tile, lid and so on, in order of (tile, lid); a run may go on in the next batch."""

    def put(columns: list[np.ndarray]) -> list[np.ndarray]:
        by = np.lexsort((columns[1], columns[0]))
        columns = [c[by] for c in columns]
        return [np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1]])), *columns]

    kept: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        if not len(batch):
            continue
        kept.append([c.to_numpy() for c in batch.columns])
        n += len(batch)
        if n < ROWS or kept[-1][0][-1] == kept[0][0][0]:
            continue
        columns = [np.concatenate(x) for x in zip(*kept)]
        end = int(np.searchsorted(columns[0], columns[0][-1]))
        yield put([c[:end] for c in columns])
        kept, n = [[c[end:] for c in columns]], n - end
    if kept:
        yield put([np.concatenate(x) for x in zip(*kept)])


#: Words that may be skipped on either side, and how many on each, few first.
AHEAD = 3
_SKIPS = sorted(((i, j) for i in range(AHEAD + 1) for j in range(AHEAD + 1) if i or j), key=lambda s: (max(s), -min(s)))


def _shared(a: str, b: str) -> int:
    """How many characters two strings have in common at their start."""
    low, high = 0, min(len(a), len(b)) + 1  # of low characters it holds, of high it doesn't
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is `most` or less: what both share at their ends goes, then a column of the distance table is a number whose bits
    say where it rises and where it falls, so a character of the shorter string takes a few operations on such numbers."""
    if abs(len(a) - len(b)) > most:
        return False
    k = _shared(a, b)
    a, b = a[k:], b[k:]
    k = _shared(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a) <= most
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, last, distance, left = (1 << len(a)) - 1, 1 << len(a) - 1, len(a), len(b)
    rise, fall = full, 0
    for c in b:
        same = at.get(c, 0)
        diagonal = (((same & rise) + rise) ^ rise) | same
        up, down = fall | ~(diagonal | rise) & full, rise & diagonal
        distance += bool(up & last) - bool(down & last)
        left -= 1
        if distance - left > most:
            return False
        up, down, same = up << 1 | 1, down << 1, same | fall
        rise, fall = (down | ~(same | up)) & full, up & same & full
    return distance <= most


def replaced(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is surely `most` or less: words are paired from the left, at most AHEAD of them skipped on either side to where both go on
    alike, and what is skipped is counted as replaced. False says nothing."""
    x, y = (a + " ").split(" "), (b + " ").split(" ")  # each word with a space after it; the last ones are empty and equal
    i = j = cost = 0
    n, m = len(x) - 1, len(y) - 1
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            i += 1
            j += 1
            continue
        for di, dj in _SKIPS:
            if i + di <= n and j + dj <= m and x[i + di] == y[j + dj] and (x[i + di] or (i + di, j + dj) == (n, m)):
                break
        else:
            return False
        p, q = " ".join(x[i : i + di]), " ".join(y[j : j + dj])
        if di and dj and len(p) == len(q):
            cost += sum(map(str.__ne__, p, q))
        else:
            cost += max(len(p) + (di > 0), len(q) + (dj > 0))
        if cost > most:
            return False
        i += di
        j += dj
    return True


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are similar: the lengths first, then the edit distance as far as it may go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [replaced(x, y, n) or within(x, y, n) for x, y, n in rows_of([batch], "x", "y", "most")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=_PAIR).filter(pa.array(ok, pa.bool_()))
        release_memory()

    side = lambda i, t: texts.select(F.col("lid").alias(i), F.col("norm").alias(t))
    both = pairs.join(side("u", "x"), "u").join(side("v", "y"), "v")
    most = F.floor((1 - SIMILAR) * F.greatest(F.length("x"), F.length("y")) + 1e-9).cast("int")
    sized = both.withColumn("most", most).filter(F.abs(F.length("x") - F.length("y")) <= F.col("most"))
    return sized.select("u", "v", "x", "y", "most").mapInArrow(run, "u bigint, v bigint")


_NOTE = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("seq", pa.int64()), ("blob", pa.binary())])
_NOTE_DDL = "part int, kind tinyint, seq bigint, blob binary"


def _notes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, numbers) as one note for each part of a batch."""
    for batch in batches:
        part, *rest = (c.to_numpy() for c in batch.columns)
        for p in np.unique(part).tolist():
            blob = pack(*(c[part == p].astype("<i8").tobytes() for c in rest))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((p, 0, 0, blob), _NOTE.types)], schema=_NOTE)


def _with_documents(notes: DataFrame, documents: DataFrame, n_parts: int) -> DataFrame:
    """Each part's notes, then its documents."""
    said = notes.sortWithinPartitions("part").mapInArrow(_notes, _NOTE_DDL)
    read = documents.select("part", F.lit(1).cast("tinyint").alias("kind"), "seq", "blob")
    return said.unionByName(read).repartitionById(n_parts, "part").sortWithinPartitions("part", "kind", "seq")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], Iterator[bytes]]]:
    """Of each part the columns of its notes, sorted by the first, and the blobs of its documents."""
    for _, own in groupby(rows_of(batches, "part", "kind", "blob"), key=lambda r: r[0]):
        notes, blobs = [], []
        rest = iter(own)
        for _, kind, blob in rest:
            if kind:
                blobs = [blob]
                break
            notes.append([np.frombuffer(x, "<i8") for x in unpack(blob)])
        columns = [np.concatenate(x) for x in zip(*notes)]
        if columns:
            by = np.argsort(columns[0], kind="stable")
            columns = [c[by] for c in columns]

        def documents(first=blobs, rest=rest):
            yield from first
            for _, _, blob in rest:
                yield blob

        yield columns, documents()


def _document(blob: bytes) -> tuple[np.ndarray, ...]:
    """doc_ids (0 for null), which are null, all bytes, the ids of all lines, where each begins and ends, where each text's lines begin (and the last one's end)."""
    ids, null, ends, raw, lids = unpack(blob)
    raw, ends = np.frombuffer(raw, np.uint8), np.frombuffer(ends, "<i8")
    end = np.concatenate([ends, np.flatnonzero(raw == 10)])
    by = np.argsort(end, kind="stable")  # a text's end comes before a line's at the same place, which is the next text's
    end, inner = end[by], by >= len(ends)
    start = np.concatenate([[0], (end + inner)[:-1]])
    return np.frombuffer(ids, "<i8"), np.frombuffer(null, bool), raw, np.frombuffer(lids, "<i8"), start, end, np.append(0, np.flatnonzero(~inner) + 1)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that the notes (lid) ask for, once each."""

    def rows():
        for columns, blobs in _opened(batches):
            asked = np.unique(columns[0]) if columns else np.zeros(0, np.int64)
            for blob in blobs:
                if not len(asked):
                    continue
                _, _, raw, lids, start, end, _ = _document(blob)
                hit, first = np.unique(lids, return_index=True)
                is_asked = np.isin(hit, asked, assume_unique=True)
                hit, first = hit[is_asked], first[is_asked]
                asked = np.setdiff1d(asked, hit, assume_unique=True)
                whole = raw.tobytes()
                numbered, _ = cut_lines(pa.array([whole[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist())], pa.string()))
                yield from zip(hit.tolist(), numbered.cast(pa.string()).to_pylist())

    yield from to_batches(rows(), pa.schema([("lid", pa.int64()), ("norm", pa.string())]))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def _cut(keep_text: bool):
    """Documents without the lines of which the notes (lid, doc, line) name another occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for columns, blobs in _opened(batches):
                known, doc, line = columns or [np.zeros(0, np.int64)] * 3
                for blob in blobs:
                    ids, null, raw, lid, start, end, at = _document(blob)
                    of = np.repeat(np.arange(len(ids)), np.diff(at))
                    k = np.minimum(np.searchsorted(known, lid), max(len(known) - 1, 0))
                    gone = (known[k] == lid) & ((doc[k] != np.where(null, _LAST, ids)[of]) | (line[k] != np.arange(len(of)) - at[of])) if len(known) else np.zeros(len(of), bool)
                    n = np.concatenate([[0], np.cumsum(lid != 0)])
                    dropped = np.concatenate([[0], np.cumsum(gone)])
                    whole, starts, ends = raw.tobytes(), start.tolist(), end.tolist()
                    for j, (a, b, n_lines, n_removed) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), (n[at[1:]] - n[at[:-1]]).tolist(), (dropped[at[1:]] - dropped[at[:-1]]).tolist())):
                        if n_removed:
                            text = b"\n".join([whole[starts[i] : ends[i]] for i in range(a, b) if not gone[i]])
                        else:
                            text = whole[starts[a] : ends[b - 1]]
                        yield None if null[j] else int(ids[j]), n_lines, n_removed, hashlib.sha256(text).hexdigest(), text.decode() if keep_text else ""

        yield from to_batches(rows(), _OUT)

    return run


def _texts_of(pairs: DataFrame, lines: DataFrame, documents: DataFrame, n_parts: int) -> DataFrame:
    """lid, norm of the lines in pairs(u, v), from the part of the first that has each."""
    asked = pairs.select(F.col("u").alias("lid")).union(pairs.select("v")).distinct().join(lines.select("lid", "part"), "lid")
    return _with_documents(asked.select("part", "lid"), documents, n_parts).mapInArrow(_texts, "lid bigint, norm string")


def _joined(labels: DataFrame, rest: DataFrame, texts: DataFrame) -> DataFrame:
    """labels(node, component) with the groups joined that similar ones of the pairs rest(u, v) link."""
    more = materialised(verified(rest, texts), "passed")
    if more.isEmpty():
        return labels
    new = more.select(F.col("u").alias("node")).union(more.select("v")).distinct().join(labels, "node", "left_anti")
    known = labels.unionByName(new.withColumn("component", F.col("node")))
    side = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    top = materialised(connected(more.join(side("u"), "u").join(side("v"), "v").select(F.col("of_u").alias("u"), F.col("of_v").alias("v"))), "groups")
    return known.join(top.select(F.col("node").alias("component"), F.col("component").alias("_top")), "component", "left").select("node", F.coalesce("_top", "component").alias("component"))


def dedup_lines(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, kept_sha256 and the kept text for each row of docs(doc_id, text).

    The input is read once: its documents are kept in the shared folder, beside what is seen of their lines."""
    rows, n_scan, _ = parts_of(docs.select("doc_id", or_empty("text").alias("text")), 0)
    stored = materialised(rows.mapInArrow(_distinct(n_scan), _SEEN_DDL), "seen")
    seen, documents = stored.filter("lid is not null").drop("seq", "blob"), stored.filter("seq is not null").select("part", "seq", "blob")
    n_parts = n_scan * max(1, -(-documents.agg(F.countDistinct("part")).first()[0] // n_scan))
    # A part has sent each line once, so a line has no more rows here than there are parts.
    lines = materialised(seen.groupBy("lid").agg(F.min("high").alias("high"), F.min("low").alias("low"), F.sum("n").alias("n"), F.min("part").alias("part")), "lines")
    found = materialised(candidates(blocks_of(lines)), "pairs")
    asked, short = found.filter("key is null").select("u", "v"), found.filter("key is not null").select("key").distinct()
    pairs = asked.filter("u <> v")
    # All that a second round may find is asked for here, too.
    texts = materialised(_texts_of(asked, lines, documents, n_parts), "texts")
    links = materialised(verified(pairs, texts), "passed")
    groups = labels = materialised(connected(links), "labels")
    if not short.isEmpty():
        # No more keys than BLOCKS << 16, whatever the input.
        again = blocks_of(lines).join(F.broadcast(short), "key", "left_semi")
        named = labels.select(F.col("node").alias("lid"), F.col("component").alias("label"))
        rest = materialised(candidates(again, named).select("u", "v").join(pairs, ["u", "v"], "left_anti"), "pairs")
        groups = _joined(labels, rest, texts)
        discard(rest)
    groups = groups.withColumnRenamed("node", "lid")
    discard(found, texts, links)
    of = lines.select("lid", "n").join(groups, "lid", "left").filter("n > 1 or component is not null").select("lid", F.coalesce("component", "lid").alias("component"))
    held = materialised(seen.select("lid", "part", "doc_id", "line_no").join(of, "lid"), "held")
    keep = materialised(held.groupBy("component").agg(F.min(F.struct("doc_id", "line_no")).alias("keep")), "keep")
    notes = held.select("part", "lid", "component").join(keep, "component").select("part", "lid", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.line_no").alias("keep_line"))
    done = _with_documents(notes, documents, n_parts).mapInArrow(_cut(keep_text), "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string, kept string")
    return done if keep_text else done.drop("kept")


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), keep_text=False)
