"""Exact substring dedup with a run-length index.

A byte goes if a 50-byte string covering it also starts in a document with a smaller doc_id.

1. Anchors. Winnowing picks 20-byte strings so that every 50-byte string holds one, picked the same way wherever the string stands.
   Each part of the input sends its distinct anchors by a mixed hash; anchors of one document only go no further.
2. Passages. Each 50-byte string belongs to one of its anchors, the first with the least hash, so equal strings belong to equal anchors. Each anchor
   left gives the bytes of its own strings, at most 30 before to 30 after it; a string is then looked at once, not with every anchor in it.
   Equal passages of a part are one row with their smallest doc_id. Passages meet by their anchor. An anchor that
   very many documents hold gives its 50-byte strings one by one instead, dealt out by their own hash, so a
   common line's many surroundings don't meet in one task.
3. Index. Of the passages around one anchor, those of the smaller documents become a run-compressed Burrows-Wheeler transform with suffix
   samples at both ends of each run, and the others are streamed against it from their ends: where the next byte isn't the row's, the
   row moves to the nearer run of that byte, and the samples tell how much of the match is left. Where the match is 50 bytes or longer
   and the rows of that string hold a smaller document, the string goes. Either half is then dealt with alone in the same way, so
   a passage has met all those of smaller documents after as many rounds as the number of passages around an anchor has bits.
   Two passages with 50 bytes in common have the anchor with one of five stretches of bytes around it in common (44 or 45 bytes); passages
   without a partner in that sense share no string and stay out of the round.
4. The answers go back to the parts, which mark, cut and digest their documents.

No step holds more than a part of the input (common.PART_BYTES, or one text if that is longer) or a bucket, whose number follows the input.

Defined cases: null and empty texts are empty byte strings, with nothing removed; texts under 50 bytes keep everything; rows repeated with one
doc_id don't remove each other's bytes; rows with a null doc_id are returned as they are and remove nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import PACKED_DDL, flat_of, opened_flat, or_empty, pack, packed, packs, parts_of, pieces_for, rows_of, table, to_batches, total_bytes, unpack
from quireworks.llm.shingles import mix

#: Length of a match, of an anchor, anchor starts in a window of that length, and most bytes of a passage.
MATCH, ANCHOR = 50, 20
WINDOW, PASSAGE = MATCH - ANCHOR + 1, 2 * MATCH - ANCHOR
#: Bytes of text for which there is one bucket of anchors, one of passages.
ANCHOR_BYTES, PASSAGE_BYTES = 24 << 20, 4 << 20
#: Anchor starts that are looked at together.
CHUNK = 1 << 18
#: Documents from which on an anchor's 50-byte strings are dealt out one by one; the place that marks such a string.
HOT_DOCS, ALONE = 20_000, 255

#: Bytes before and after the anchor: MATCH bytes with the anchor cover one of these stretches.
STRETCHES = ((0, 25), (6, 19), (12, 13), (18, 7), (24, 0))
#: Passages that are indexed and streamed together, about (a group stays whole).
TOGETHER = 1 << 15

_rng = np.random.default_rng(50)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_MUL = [np.uint64(int(x) * 2 + 1) for x in _rng.integers(1, 1 << 62, 16, dtype=np.uint64)]
_POWER = np.multiply.accumulate(np.full(PASSAGE + 1, _MUL[14]))
_TABLE = _rng.integers(0, 1 << 63, (2, PASSAGE, 256), dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, (2, PASSAGE, 256), dtype=np.uint64)


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    k = 1
    while k * 2 <= width:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def _hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each start on."""
    n = len(b) - ANCHOR + 1
    h1 = _BYTE[b]
    h2 = h1[:-1] * _MUL[0] + h1[1:]
    h4 = h2[:-2] * _MUL[1] + h2[2:]
    h8 = h4[:-4] * _MUL[2] + h4[4:]
    h16 = h8[:-8] * _MUL[3] + h8[8:]
    h = h16[:n] * _MUL[4] + h4[16 : 16 + n]
    h = (h ^ (h >> np.uint64(29))) * _MUL[6]
    return h ^ (h >> np.uint64(32))


def _chunks(flat: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For CHUNK after CHUNK of the texts that lie one after another in flat, each up to its end: (first byte, hashes from there on, the anchors'
    places from there on, where their texts begin, the first and the last start of the MATCH-byte strings that are theirs, all from the first byte
    of flat on). An anchor is the least of some WINDOW neighbours of its text; of a string's anchors the first with the least hash has it."""
    starts = np.concatenate([[0], ends[:-1]])
    for a in range(0, len(flat), CHUNK):
        lo, hi = max(0, a - 2 * MATCH), min(len(flat), a + CHUNK + 2 * MATCH)
        if hi - lo < MATCH:
            continue
        h = _hashes(flat[lo:hi])
        n = len(h) - WINDOW + 1
        k = np.arange(int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(starts, hi, "left")))
        of = np.repeat(k, np.minimum(ends[k], hi) - np.maximum(starts[k], lo))
        low = np.zeros(len(h) + WINDOW - 1, np.uint64)
        inside = np.arange(lo, lo + n) + MATCH <= ends[of[:n]]
        low[WINDOW - 1 : WINDOW - 1 + n][inside] = _sliding(h, WINDOW, np.minimum)[inside]
        at = np.flatnonzero(_sliding(low, WINDOW, np.maximum)[: len(h)] == h)
        at = at[at + lo + ANCHOR <= ends[of[at]]]
        x, t = h[at], of[at]
        start = starts[t]
        # Of two neighbours the first has all strings that hold it, unless the second is less and has all that hold it.
        first, last = start.copy(), ends[t] - MATCH
        pair = np.flatnonzero(t[1:] == t[:-1])
        first[pair + 1] = np.where(x[pair] <= x[pair + 1], at[pair] + 1, at[pair + 1] - WINDOW + 1) + lo
        first = np.maximum(first, start)
        # A lesser one may take those of several before it that have one hash.
        last[:-1] = np.minimum(last[:-1], np.minimum.accumulate(first[::-1])[::-1][1:] - 1)
        own = np.flatnonzero((at + lo >= a) & (at + lo < a + CHUNK))
        yield lo, h, at[own], start[own], first[own], last[own]


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the anchors of one text."""
    found = [(h[at], at + lo) for lo, h, at, *_ in _chunks(np.frombuffer(raw, np.uint8), np.array([len(raw)]))]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end."""
    padded = np.concatenate([raw, np.zeros(PASSAGE + 8, np.uint8)])
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))


class RunLengthIndex:
    """A run-compressed BWT of passages (rows of a matrix, cut to their lengths), each ended by a separator.

    Kept: symbols and starts of the runs, LF at the run starts, the suffixes at both ends of each run, the starts of the row
    intervals of equal MATCH-byte prefixes and the smallest document of each.
    """

    def __init__(self, matrix: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> None:
        m = len(lengths)
        wide = np.zeros((m, PASSAGE + 1), np.int64)
        inside = np.arange(PASSAGE + 1) < lengths[:, None]
        wide[:, :PASSAGE] = matrix
        flat = np.where(inside, wide + 1, 0)[np.arange(PASSAGE + 1) <= lengths[:, None]]
        ends = np.cumsum(lengths + 1) - 1
        size = len(flat)
        of = np.repeat(np.arange(m), lengths + 1)
        left = ends[of] - np.arange(size)  # symbols before the separator
        self.left, self.eight = left, _words(np.where(flat > 0, flat - 1, 0).astype(np.uint8))
        order, rank, depth = self._suffixes(flat, of, left, m)
        bwt = flat[order - 1]
        bwt[order == 0] = 0
        starts = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.run_start, self.run_symbol = starts, bwt[starts]
        sizes = np.diff(np.concatenate([starts, [size]]))
        self.run_last = starts + sizes - 1
        self.run_of = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)  # of each row; as long as the passages are at hand this saves a search in run_start
        self.start_sample, self.end_sample = order[starts], order[self.run_last]
        by = np.argsort(self.run_symbol, kind="stable")
        self.run_lf = np.empty(len(starts), np.int64)
        self.run_lf[by] = np.concatenate([[0], np.cumsum(sizes[by])[:-1]])
        self.by, self.by_key = by, self.run_symbol[by] * len(starts) + by
        # Rows whose suffix has MATCH bytes, in runs of equal ones: the first `depth` and the last `depth` of these are equal.
        rows = np.flatnonzero(left[order] >= MATCH)
        a, b = rank[order[rows]], rank[order[rows] + MATCH - depth]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(rows)]
        self.group_row = rows[new]
        self.group_doc = np.minimum.reduceat(docs[of[order[rows]]], np.flatnonzero(new)) if len(rows) else np.zeros(0, np.int64)

    @property
    def text(self) -> np.ndarray:
        """The symbols: a byte as its number and one, a separator as 0."""
        return np.where(self.left > 0, (self.eight[: len(self.left)] & np.uint64(255)).astype(np.int64) + 1, 0)

    @staticmethod
    def _suffixes(flat: np.ndarray, of: np.ndarray, left: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The suffix array by doubling, and the ranks at a depth of MATCH / 2 to MATCH. Separators are ordered by passage."""
        size = len(flat)
        there = np.bincount(flat, minlength=257) > 0
        used, dense = np.flatnonzero(there), (np.cumsum(there) - 1)[flat]
        depth = max(2, int(62 * math.log(2) / math.log(len(used) + 1)))
        key = np.zeros(size, np.int64)
        padded = np.concatenate([dense, np.zeros(depth, np.int64)])
        open_ = np.ones(size, bool)
        for k in range(depth):
            key = key * (len(used) + 1) + np.where(open_, padded[k : k + size], 0)
            open_ &= left > k
        order = np.argsort(key)
        s = key[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        rank = np.empty(size, np.int64)  # where the suffixes that are equal so far begin in the order
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        tied = ~new | ~np.concatenate([new[1:], [True]])
        kept = None
        while True:
            if MATCH <= 2 * depth <= 2 * MATCH:
                kept = rank.copy(), depth
            if not tied.any() or depth >= PASSAGE:
                return order, *(kept or (rank, MATCH // 2))  # without ties equal ranks are one suffix, whatever the depth
            at = np.flatnonzero(tied)
            some = order[at]
            second = np.where(left[some] >= depth, rank[np.minimum(some + depth, size - 1)] + m, of[some])
            key = rank[some] * (size + m + 1) + second
            by = np.argsort(key)
            s, some = key[by], some[by]
            new = np.concatenate([[True], s[1:] != s[:-1]])
            order[at] = some
            rank[some] = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
            tied[at] = ~new | ~np.concatenate([new[1:], [True]])
            depth *= 2

    def _common(self, at: np.ndarray, eight: np.ndarray, begin: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes of the text from `at` on equal those of another from `begin` on, up to `most` and the separator: eight at a time."""
        most = np.minimum(most, self.left[at])
        differ = self.eight[at] ^ eight[begin]
        out = (np.bitwise_count(~differ & (differ - np.uint64(1))) >> 3).astype(np.int64)
        go = np.flatnonzero((out == 8) & (most > 8))
        while len(go):
            differ = self.eight[at[go] + out[go]] ^ eight[begin[go] + out[go]]
            n = np.bitwise_count(~differ & (differ - np.uint64(1))) >> 3
            out[go] += n
            go = go[(n == 8) & (out[go] < most[go])]
        return np.minimum(out, most)

    def matches(self, matrix: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """For each of the passages, as bits by start: whether the MATCH bytes from there on stand in the index under a smaller document.

        All passages are streamed together, byte by byte from their ends. A row's suffix is a longest match of what a passage has
        streamed so far, and its statistic is how long that match is."""
        raw = np.ascontiguousarray(matrix, np.uint8).ravel()
        flat, eight = raw.astype(np.int64) + 1, _words(raw)
        found = np.zeros(len(lengths), np.int64)
        live = np.arange(len(lengths))  # passages that can still come to a match of MATCH bytes
        row, size = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        n_runs = len(self.run_start)
        for k in range(1, PASSAGE + 1):
            ahead = lengths[live] - k
            may = (ahead >= 0) & (size + 1 + ahead >= MATCH)
            if not may.all():
                live, row, size, ahead = live[may], row[may], size[may], ahead[may]
            if not len(live):
                break
            here = live * PASSAGE + ahead
            c = flat[here]
            run = self.run_of[row].astype(np.int64)
            lost = np.flatnonzero(self.run_symbol[run] != c)
            if len(lost):
                j = np.searchsorted(self.by_key, c[lost] * n_runs + run[lost])
                up, down = self.by[np.maximum(j - 1, 0)], self.by[np.minimum(j, n_runs - 1)]
                has_up, has_down = (j > 0) & (self.run_symbol[up] == c[lost]), (j < n_runs) & (self.run_symbol[down] == c[lost])
                most = np.concatenate([np.where(has_up, size[lost], 0), np.where(has_down, size[lost], 0)])
                u, d = self._common(np.concatenate([self.end_sample[up], self.start_sample[down]]), eight, np.tile(here[lost] + 1, 2), most).reshape(2, -1)
                go_up = has_up & (~has_down | (u >= d))
                run[lost] = np.where(go_up, up, np.where(has_down, down, run[lost]))
                row[lost] = np.where(go_up, self.run_last[up], np.where(has_down, self.run_start[down], 0))
                size[lost] = np.where(go_up, u, np.where(has_down, d, -1))
            # A byte that the index doesn't hold starts anew, at any row.
            row = np.where(size < 0, 0, self.run_lf[run] + row - self.run_start[run])
            size += 1
            if k >= MATCH and len(self.group_row):
                long = np.flatnonzero(size >= MATCH)
                least = self.group_doc[np.searchsorted(self.group_row, row[long], "right") - 1]
                hit = long[least < docs[live[long]]]
                found[live[hit]] |= np.int64(1) << ahead[hit]
        return found


def _around(matrix: np.ndarray, lengths: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """A hash of each passage's anchor, and hashes of the STRETCHES around it (0 where the passage ends before)."""
    anchor, out = np.empty(len(lengths), np.uint64), [np.zeros(len(lengths), np.uint64) for _ in STRETCHES]
    for a in range(0, len(lengths), 4096):
        some = slice(a, a + 4096)
        sums = np.zeros((len(lengths[some]), PASSAGE + 1), np.uint64)
        np.cumsum(_BYTE[matrix[some]] * _POWER[:PASSAGE], axis=1, out=sums[:, 1:])
        rows, at, n = np.arange(len(sums)), place[some], lengths[some]
        hashed = lambda begin, end: (sums[rows, end] - sums[rows, begin]) * _POWER[PASSAGE - begin]  # noqa: E731, B023
        anchor[some] = mix(hashed(at, at + ANCHOR))
        for x, (before, after) in zip(out, STRETCHES):
            inside = (at >= before) & (at + ANCHOR + after <= n)
            x[some] = np.where(inside, mix(hashed(np.maximum(at - before, 0), np.minimum(at + ANCHOR + after, PASSAGE))) | np.uint64(1), 0)
    return anchor, out


def _meet(keys: list[np.ndarray], at: np.ndarray, g: np.ndarray, late: np.ndarray | None = None) -> np.ndarray:
    """Which passages have one of their stretches in common with another of their group (of its other half, if late tells the halves)."""
    out = np.zeros(len(at), bool)
    for key in keys:
        own = np.flatnonzero(key[at] != 0)
        k = mix(key[at[own]] + g[own].astype(np.uint64) * _MUL[15])
        by = np.argsort(k)
        first = np.flatnonzero(np.concatenate([[True], k[by][1:] != k[by][:-1]])[: len(by)])
        n = np.diff(np.concatenate([first, [len(by)]]))
        if late is None:
            both = n > 1
        elif len(first):
            n_late = np.add.reduceat(late[own[by]].astype(np.int64), first)
            both = (n_late > 0) & (n_late < n)
        else:
            continue
        out[own[by[np.repeat(both, n)]]] = True
    return out


def smaller_elsewhere(matrix: np.ndarray, lengths: np.ndarray, docs: np.ndarray, group: np.ndarray, keys: list[np.ndarray] | None = None) -> np.ndarray:
    """For each of distinct passages, as bits by start: whether the MATCH bytes from there on also stand in a passage of its group with a
    smaller document. A group shares an anchor; its earlier half is indexed, its later half streamed, then each half is a group.
    With keys, the hashes of STRETCHES, passages that have no stretch in common with another of their group can't hold such bytes and are left out."""
    found = np.zeros(len(lengths), np.int64)
    at = np.lexsort((docs, group))
    if keys is not None:
        at = at[_meet(keys, at, group[at])]
    g = group[at]
    edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]])) if len(g) else np.zeros(1, np.int64)
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + TOGETHER, "right")) - 1)
        _by_halves(matrix, lengths, docs, keys, found, at[edges[a] : edges[b]], g[edges[a] : edges[b]])
        a = b
    return found


def _by_halves(matrix: np.ndarray, lengths: np.ndarray, docs: np.ndarray, keys: list[np.ndarray] | None, found: np.ndarray, at: np.ndarray, g: np.ndarray) -> None:
    """Adds to found for the passages at `at`, which lie by group g and document."""
    full = (np.int64(1) << (lengths - MATCH + 1)) - 1
    while True:
        first = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
        begin = np.flatnonzero(first)
        n = np.diff(np.concatenate([begin, [len(g)]]))
        several = np.repeat(n > 1, n)
        if not several.any():
            return
        late = (np.arange(len(g)) - np.repeat(begin, n) >= np.repeat((n + 1) // 2, n))[several]
        at, g = at[several], np.cumsum(first[several])
        met = np.ones(len(at), bool) if keys is None else _meet(keys, at, g, late)
        old, new = at[met & ~late], at[met & late]
        if len(new):
            found[new] |= RunLengthIndex(matrix[old], lengths[old], docs[old]).matches(matrix[new], lengths[new], docs[new])
        # What a passage found whole could still tell others, the index has told them as well.
        stay = ~late | (found[at] != full[at])
        at, g = at[stay], (2 * g + late)[stay]
        order = np.argsort(g, kind="stable")
        at, g = at[order], g[order]
        if keys is not None:
            some = _meet(keys, at, g)
            at, g = at[some], g[some]


_ROW = pa.schema([("part", pa.int32()), ("bucket", pa.int64()), ("kind", pa.int8()), ("seq", pa.int64()), ("blob", pa.binary())])
_ROW_DDL = "part int, bucket bigint, kind tinyint, seq bigint, blob binary"


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers as differences, byte by byte: of sorted or small ones the upper bytes are nearly all zero and vanish in compression."""
    return np.diff(x.view(np.uint64), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _anchor_rows(n_buckets: int, n_scan: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part_rows(part: int, found: list[np.ndarray]):
            """Anchors with the number of texts that hold them."""
            h, count = np.unique(np.concatenate(found), return_counts=True)
            bucket = (mix(h) % np.uint64(n_buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                own = by[edges[b] : edges[b + 1]]
                yield part, b, 0, 0, pack(_planes(h[own]), count[own].astype("<u4").tobytes())

        def rows():
            for part, own in groupby(packs(batches, n_scan), key=lambda x: x[0]):
                found = []
                for _, _, ids, texts in own:
                    _, null, raw, ends = flat_of(ids, texts)
                    for lo, h, at, start, *_ in _chunks(raw, ends):
                        x, of = h[at], np.searchsorted(ends, start, "right")
                        x, of = x[~null[of]], of[~null[of]]
                        by = np.lexsort((of, x))
                        x, of = x[by], of[by]
                        found.append(x[np.concatenate([[True], (x[1:] != x[:-1]) | (of[1:] != of[:-1])])[: len(x)]])  # once a text
                if found:
                    yield from part_rows(part, found)

        yield from to_batches(rows(), _ROW)

    return run


def _repeated(hot_docs: int):
    """Of each part's anchors those that two documents or more hold, and whether very many do."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for bucket, parts in groupby(rows_of(batches, "bucket", "part", "blob"), key=lambda r: r[0]):
            own = [(p, *unpack(blob)) for _, p, blob in parts]
            hs = [_from_planes(h) for _, h, _ in own]
            every, where = np.unique(np.concatenate(hs), return_inverse=True)
            total = np.bincount(where, weights=np.concatenate([np.frombuffer(c, "<u4") for _, _, c in own]))
            at = 0
            for (p, _, _), h in zip(own, hs):
                t = total[where[at : at + len(h)]]
                at += len(h)
                if (t > 1).any():
                    yield p, bucket, 0, 0, pack(_planes(h[t > 1]), (t[t > 1] >= hot_docs).astype("u1").tobytes())

    return lambda batches: to_batches(rows(batches), _ROW)


class _Passages:
    """The passages around a part's repeated anchors."""

    def __init__(self, n_buckets: int) -> None:
        self.n = np.uint64(n_buckets)
        self.hashes: list[np.ndarray] = []
        self.flags: list[np.ndarray] = []

    def learn(self, blob: bytes) -> None:
        h, hot = unpack(blob)
        self.hashes.append(_from_planes(h))
        self.flags.append(np.frombuffer(hot, "u1"))

    def done(self) -> None:
        h = np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)
        by = np.argsort(h)
        # Most anchors aren't repeated: their first bits tell that without a search.
        self.shift = np.uint64(64 - max(10, min(26, int(8 * len(h) + 1).bit_length())))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[h >> self.shift] = True
        self.known, self.hot = h[by], (np.concatenate(self.flags) if self.flags else np.zeros(0, "u1"))[by].astype(bool)

    def of(self, flat: np.ndarray, ends: np.ndarray, null: np.ndarray) -> Iterator[tuple]:
        """Arrays of start, size, the anchor's place in the passage, two hashes that name the passage, its bucket, its text."""
        if not len(self.known):
            return
        for lo, h, at, start, first, last in _chunks(flat, ends):
            some = np.flatnonzero(self.maybe[h[at] >> self.shift] & (first <= last))
            at, start, s, e = at[some], start[some], first[some] - lo, last[some] - lo + MATCH
            of = np.searchsorted(ends, start, "right")
            k = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
            hit = (self.known[k] == h[at]) & ~null[of]
            at, s, e, of, hot = at[hit], s[hit], e[hit], of[hit], self.hot[k[hit]]
            w = np.flatnonzero(~hot)
            if len(w):
                four = h[s[w]], h[s[w] + ANCHOR], h[e[w] - 2 * ANCHOR], h[e[w] - ANCHOR], (e[w] - s[w]).astype(np.uint64)
                yield s[w] + lo, e[w] - s[w], at[w] - s[w], *(mix(sum(x * m for x, m in zip(four, _MUL[i : i + 5]))) for i in (7, 10)), h[at[w]] % self.n, of[w]
            w = np.flatnonzero(hot)
            if len(w):
                n = e[w] - s[w] - MATCH + 1
                one = np.repeat(s[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                three = h[one], h[one + ANCHOR], h[one + MATCH - ANCHOR]
                name, again = (mix(sum(x * m for x, m in zip(three, _MUL[i : i + 3]))) for i in (7, 10))
                yield one + lo, np.full(len(one), MATCH), np.full(len(one), ALONE), name, again, name % self.n, np.repeat(of[w], n)


def _first_of_each(name: np.ndarray, again: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the distinct names first stand, in their order, and the smallest document of each."""
    by = np.argsort(name, kind="stable")
    new = np.concatenate([[True], name[by][1:] != name[by][:-1]])[: len(by)]
    first = np.flatnonzero(new)
    if (again[by] != np.repeat(again[by][first], np.diff(np.concatenate([first, [len(by)]])))).any():
        raise RuntimeError("two passages have one name")
    return by[first], np.minimum.reduceat(doc[by], first) if len(first) else doc[:0]


def _passage_rows(n_buckets: int):
    """A part's repeated anchors (kind 0), then its documents (kind 2): its distinct passages by bucket, with their smallest doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part, own in groupby(rows_of(batches, "part", "kind", "blob"), key=lambda r: r[0]):
                seen, open_ = _Passages(n_buckets), True
                kept: list[tuple] = []
                for _, kind, blob in own:
                    if kind == 0:
                        seen.learn(blob)
                        continue
                    if open_:
                        seen.done()
                        open_ = False
                    ids, null, flat, ends = opened_flat(blob)
                    for s, n, place, name, again, bucket, of in seen.of(flat, ends, null):
                        if len(s):
                            at, doc = _first_of_each(name, again, ids[of])
                            j = np.arange(PASSAGE)
                            text = np.where(j < n[at, None], flat[np.minimum(s[at, None] + j, len(flat) - 1)], 0).astype(np.uint8)
                            kept.append((name[at], again[at], doc, bucket[at].astype(np.int64), n[at].astype("u1"), place[at].astype("u1"), text))
                            if sum(len(x[0]) for x in kept) > 1 << 19 and len(kept) > 8:
                                kept = [merged(kept)]
                if kept:
                    name, _, doc, bucket, n, place, text = merged(kept)
                    by = np.argsort(bucket, kind="stable")
                    edges = np.flatnonzero(np.concatenate([[True], bucket[by][1:] != bucket[by][:-1]]))
                    for x in np.split(by, edges[1:]):
                        yield part, int(bucket[x[0]]), 1, 0, pack(_planes(name[x]), n[x].tobytes(), _planes(doc[x]), place[x].tobytes(), text[x].tobytes())

        def merged(kept: list[tuple]) -> tuple:
            name, again, doc, *rest = (np.concatenate(x) for x in zip(*kept))
            at, least = _first_of_each(name, again, doc)
            return name[at], again[at], least, *(x[at] for x in rest)

        yield from to_batches(rows(), _ROW)

    return run


def _named(matrix: np.ndarray, lengths: np.ndarray, begin: np.ndarray | None = None, width: int = PASSAGE) -> list[np.ndarray]:
    """Two hashes of each row's bytes, or of `width` bytes from `begin` on."""
    out = [lengths.astype(np.uint64) * _MUL[0], lengths.astype(np.uint64) * _MUL[1]]
    for j in range(width):
        c = matrix[:, j] if begin is None else matrix[np.arange(len(matrix)), np.minimum(begin + j, PASSAGE - 1)]
        for x, t in zip(out, _TABLE):
            x += t[j][c]
    return out


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's passages the smallest document, and which of their strings a smaller one holds elsewhere, for each part that has them."""

    def rows():
        for bucket, parts in groupby(rows_of(batches, "bucket", "part", "blob"), key=lambda r: r[0]):
            own = [(p, *unpack(blob)) for _, p, blob in parts]
            n = np.concatenate([np.frombuffer(x[2], "u1") for x in own]).astype(np.int64)
            doc = np.concatenate([_from_planes(x[3]).view(np.int64) for x in own])
            place = np.concatenate([np.frombuffer(x[4], "u1") for x in own]).astype(np.int64)
            text = np.concatenate([np.frombuffer(x[5], np.uint8).reshape(-1, PASSAGE) for x in own])
            name, again = _named(text, n + 256 * place)
            _, at, of = np.unique(name, return_index=True, return_inverse=True)
            if (again != again[at][of]).any():
                raise RuntimeError("two passages have one name")
            least = np.full(len(at), np.iinfo(np.int64).max)
            np.minimum.at(least, of, doc)
            found = np.zeros(len(at), np.int64)
            some = np.flatnonzero(place[at] != ALONE)
            if len(some):
                x = at[some]
                anchor, stretches = _around(text[x], n[x], place[x])
                found[some] = smaller_elsewhere(text[x], n[x], least[some], np.unique(anchor, return_inverse=True)[1], stretches)
            a = 0
            for p, names, *_ in own:
                mine = of[a : a + len(names) // 8]
                a += len(mine)
                yield p, bucket, 1, 0, pack(names, _planes(least[mine]), found[mine].astype("<u4").tobytes())

    yield from to_batches(rows(), _ROW)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _marked(n_buckets: int, keep_bytes: bool):
    """A part's repeated anchors (0), the answers for its passages (1), then its documents (2): what is left of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for _, own in groupby(rows_of(batches, "part", "kind", "blob"), key=lambda r: r[0]):
                seen, answers, open_ = _Passages(n_buckets), [], True
                for _, kind, blob in own:
                    if kind == 0:
                        seen.learn(blob)
                    elif kind == 1:
                        names, least, found = unpack(blob)
                        answers.append((_from_planes(names), _from_planes(least).view(np.int64), np.frombuffer(found, "<u4").astype(np.int64)))
                    else:
                        if open_:
                            seen.done()
                            answers = [np.concatenate(x) for x in zip(*answers)] or [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
                            by = np.argsort(answers[0])
                            answers = [x[by] for x in answers]
                            open_ = False
                        yield from cut(seen, answers, *opened_flat(blob))

        def cut(seen: _Passages, answers: list[np.ndarray], ids: np.ndarray, null: np.ndarray, flat: np.ndarray, ends: np.ndarray):
            names, least, found = answers
            change = np.zeros(len(flat) + 1, np.int32)
            for s, n, _, name, _, _, of in seen.of(flat, ends, null):
                k = np.searchsorted(names, name)
                if len(k) and not (k < len(names)).all() or (names[k] != name).any():
                    raise RuntimeError("a partition of the input differs between two reads")
                whole = least[k] < ids[of]
                np.add.at(change, s[whole], 1)
                np.add.at(change, s[whole] + n[whole], -1)
                part = ~whole & (found[k] != 0)
                s, bits = s[part], found[k[part]]
                for i in range(WINDOW):
                    on = s[(bits >> i) & 1 == 1] + i
                    np.add.at(change, on, 1)
                    np.add.at(change, on + MATCH, -1)
            gone = np.cumsum(change[:-1]) > 0
            left = flat[~gone].tobytes()
            before = np.concatenate([[0], np.cumsum(gone)])
            begins = gone & ~np.concatenate([[False], gone[:-1]])
            starts = np.concatenate([[0], ends[:-1]])
            begins[starts[starts < len(flat)]] = gone[starts[starts < len(flat)]]
            spans = np.concatenate([[0], np.cumsum(begins)])
            for d, z, a, b in zip(ids.tolist(), null.tolist(), starts.tolist(), ends.tolist()):
                raw = left[a - before[a] : b - before[b]]
                yield None if z else d, b - a, int(before[b] - before[a]), int(spans[b] - spans[a]), hashlib.sha256(raw).hexdigest(), raw if keep_bytes else b""

        yield from to_batches(rows(), _OUT)

    return run


def dedup(docs: DataFrame, keep_bytes: bool = True, hot_docs: int = HOT_DOCS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes for each row of docs(doc_id, text).

    docs must give the same rows in the same partitions each time it is read, as tables do; a passage without an answer is an error.
    """
    size = total_bytes(docs)
    n_anchor, n_passage = pieces_for(size, ANCHOR_BYTES), pieces_for(size, PASSAGE_BYTES)
    rows, n_scan, n_parts = parts_of(docs.select("doc_id", or_empty("text").alias("text")), size)
    documents = rows.mapInArrow(packed(n_scan), PACKED_DDL).select("part", F.lit(-1).cast("long").alias("bucket"), F.lit(2).cast("tinyint").alias("kind"), "seq", "blob")
    repeated = rows.mapInArrow(_anchor_rows(n_anchor, n_scan), _ROW_DDL).repartition(n_anchor, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated(hot_docs), _ROW_DDL)
    parts = repeated.unionByName(documents).repartitionById(n_parts, "part")
    passages = parts.sortWithinPartitions("part", "kind", "seq", "bucket").mapInArrow(_passage_rows(n_passage), _ROW_DDL)
    answers = passages.repartition(n_passage, "bucket").sortWithinPartitions("bucket").mapInArrow(_indexed, _ROW_DDL)
    whole = repeated.unionByName(documents).unionByName(answers).repartitionById(n_parts, "part").sortWithinPartitions("part", "kind", "seq", "bucket")
    out = whole.mapInArrow(_marked(n_passage, keep_bytes), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return out if keep_bytes else out.drop("kept")


def op1_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), keep_bytes=False)
