"""Self-join of documents by n-gram Jaccard similarity with signature trees.

1. A document's set: distinct hashes of its word shingles. Documents of equal sets form one class, led by the smallest doc_id.
2. Two sets of similarity t share one of their first n - ceil(t n) + 1 hashes, in any order that is the same for all. The hashes that many
   documents of a sample hold come last, the most frequent at the very end, so a passage in many documents brings few of these together; the
   sample decides the order only, which changes no result. Classes that
   share such a hash form a list, cut where, in the order of sizes, one is too small for the next; equal lists count once.
3. Star rounds: each list's members are held against its leader; the leader is the smallest doc_id, for copies mostly follow
   what they copy, then the least by a hash. Links that
   pass the exact test merge components, so a group of thousands of near copies costs about one test a member and round.
4. Lists that still span components go to the tree, very long ones in pieces, each two of which meet in a task: leaves of documents ordered by size, nodes with OR-combined bitmaps
   of hashes and size ranges. A dual traversal drops node pairs whose largest possible overlap is too small and
   document pairs already in one component; what is left is tested on wider bitmaps and then exactly. So no link between components is missed.

Every candidate is tested on the full sets, rebuilt from the whole texts. Copies are never expanded to pairs.

Defined cases: null and empty texts, and texts without words, have empty sets, link with nothing and are their own component;
rows repeated with one doc_id are one document each, with one component; a null doc_id takes no part and keeps a null component. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import discard, materialised, or_empty, rows_of, table, to_batches
from quireworks.llm.components import connected
from quireworks.llm.shingles import mix, shingle_set

WIDTH, PERCENT = 4, 85
STAR_ROUNDS = 2
#: Members of a leader that one task tests.
SALTS = 16
#: Rows of a tree's leaf; lists of no more than SMALL rows need no tree. A tree's bitmaps have 1/FOLD of the bits.
LEAF, SMALL, FOLD = 64, 16, 4
#: Rows of a list that one task holds twice at most.
PIECE = 4096
#: Documents in the sample that tells frequent hashes: this share of all, or this many; how many hold such a hash, and hashes at most.
SAMPLE_SHARE, SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 1 / 16, 20_000, 3, 200_000


def enough(inter: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def bitmap(h: np.ndarray) -> np.ndarray:
    """Eight bits a hash or more, as bytes; the width is a power of two, so a wider bitmap folds onto a narrower one."""
    bits = min(1 << 18, max(256, 1 << int(8 * len(h) - 1).bit_length()))
    out = np.zeros(bits, bool)
    out[(mix(h) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def _bound(pa_: np.ndarray, na: int, pb: np.ndarray, nb: int) -> int:
    """The most hashes that two sets can share, from their bitmaps: each bit of one that the other lacks is a hash it lacks."""
    size = min(len(pa_), len(pb))
    x, y = folded(pa_, size), folded(pb, size)
    return min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))


class SignatureTree:
    """Documents (id, size, bitmap, component) of one list, ordered by size; `pairs` runs the dual traversal of the tree with itself."""

    def __init__(self, rows: list[tuple], percent: int = PERCENT) -> None:
        self.rows = rows = sorted(rows, key=lambda r: (r[1], r[0]))
        self.comp = np.array([r[3] for r in rows])
        width = min(len(r[2]) for r in rows)
        self.sizes = np.array([r[1] for r in rows])
        self.bits = np.stack([folded(r[2], width) for r in rows]).view(np.uint64)
        self.slack = self.sizes - np.bitwise_count(self.bits).sum(1)
        self.percent, self.share = percent, percent / (100 + percent)
        # A node: first, end, least size, most size, most slack, OR of bitmaps, one component or None, children.
        level = [self._node(i, min(i + LEAF, len(rows))) for i in range(0, len(rows), LEAF)]
        while len(level) > 1:
            level = [self._join(level[i : i + 4]) for i in range(0, len(level), 4)]
        self.root = level[0]

    def _node(self, a: int, b: int) -> tuple:
        comps = set(self.comp[a:b].tolist())
        return a, b, self.sizes[a], self.sizes[b - 1], self.slack[a:b].max(), np.bitwise_or.reduce(self.bits[a:b]), comps.pop() if len(comps) == 1 else None, ()

    @staticmethod
    def _join(some: list[tuple]) -> tuple:
        comps = {n[6] for n in some}
        return some[0][0], some[-1][1], some[0][2], some[-1][3], max(n[4] for n in some), np.bitwise_or.reduce([n[5] for n in some]), comps.pop() if len(comps) == 1 else None, tuple(some)

    def _apart(self, x: tuple, y: tuple) -> bool:
        if x[6] is not None and x[6] == y[6]:
            return True
        if x is y:
            return False
        if 100 * x[3] < self.percent * y[2] or 100 * y[3] < self.percent * x[2]:
            return True
        return max(x[4], y[4]) + int(np.bitwise_count(x[5] & y[5]).sum()) < math.ceil(self.share * (x[2] + y[2]) - 1e-9)

    def pairs(self) -> Iterator[tuple]:
        todo = [(self.root, self.root)]
        while todo:
            x, y = todo.pop()
            if self._apart(x, y):
                continue
            if not x[7] and not y[7]:
                yield from self._leaves(x, y)
            elif x is y:
                todo.extend((a, b) for i, a in enumerate(x[7]) for b in x[7][i:])
            else:
                todo.extend((a, b) for a in x[7] or (x,) for b in y[7] or (y,))

    def _leaves(self, x: tuple, y: tuple) -> Iterator[tuple]:
        p, q = slice(*x[:2]), slice(*y[:2])
        common = np.bitwise_count(self.bits[p, None] & self.bits[None, q]).sum(2, dtype=np.int64)
        hit = common + np.minimum(self.slack[p, None], self.slack[None, q]) >= self.share * (self.sizes[p, None] + self.sizes[None, q]) - 1e-9
        hit &= self.comp[p, None] != self.comp[None, q]
        at, to = np.nonzero(np.triu(hit, 1) if x is y else hit)
        for i, j in zip((at + x[0]).tolist(), (to + y[0]).tolist()):
            yield self.rows[i][0], self.rows[j][0]


def leaf_pairs(rows: list[tuple], percent: int) -> Iterator[tuple]:
    """The same for a list that is less than one leaf, each row held against the others."""
    rows = sorted(rows, key=lambda r: r[1])
    bits = [int.from_bytes(r[2].tobytes(), "little") for r in rows]

    def fold(k: int, size: int) -> int:
        x, have = bits[k], len(rows[k][2])
        while have > size:
            have //= 2
            x = (x >> 8 * have) | (x & ((1 << 8 * have) - 1))
        return x

    for i, r in enumerate(rows):
        for j in range(i + 1, len(rows)):
            o = rows[j]
            if 100 * r[1] < percent * o[1]:
                break  # sizes rise
            if r[3] == o[3]:
                continue
            size = min(len(r[2]), len(o[2]))
            x, y = fold(i, size), fold(j, size)
            slack = min(r[1] - x.bit_count(), o[1] - y.bit_count())
            if (100 + percent) * ((x & y).bit_count() + slack) >= percent * (r[1] + o[1]):
                yield r[0], o[0]


def list_pairs(rows: list[tuple], percent: int = PERCENT) -> Iterator[tuple]:
    """Pairs of one list's rows from a tree for each width of bitmap, and one for each two neighbouring widths.

    One tree for all would fold the bitmaps of large sets to the width of the smallest, where they tell nothing apart."""
    if len(rows) <= SMALL:
        yield from leaf_pairs(rows, percent)
        return
    by: dict[int, list[tuple]] = {}
    for r in rows:
        by.setdefault(len(r[2]), []).append(r)
    widths = sorted(by)
    for w in widths:
        yield from SignatureTree(by[w], percent).pairs()
    for k, w in enumerate(widths):
        for v in widths[k + 1 :]:
            least, most = min(r[1] for r in by[v]), max(r[1] for r in by[w])
            low = [r for r in by[w] if 100 * r[1] >= percent * least]
            high = [r for r in by[v] if percent * r[1] <= 100 * most]
            if low and high:
                small = {r[0] for r in low}
                yield from (p for p in SignatureTree(low + high, percent).pairs() if (p[0] in small) != (p[1] in small))


def frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that many documents of a sample hold, sorted, and the place of each in the order of their counts. As many as MOST_FREQUENT."""
    n = docs.count()
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_DOCS / max(n, 1)))
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t.encode(), width) for (t,) in rows_of([batch], "text")]
            h, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], schema=schema)

    some = docs.sample(share, 7).select(or_empty("text").alias("text")).mapInArrow(counted, "h bigint, n bigint")
    top = some.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.col("n").desc(), "h").limit(MOST_FREQUENT).collect()
    h = np.array([r["h"] for r in reversed(top)], np.int64).view(np.uint64)
    by = np.argsort(h)
    return h[by], by + 1


def prefix_of(h: np.ndarray, often: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The first hashes of a set, of which two sets that link share one: those not known as frequent, in their order, then the rarest of the others."""
    known, place = often
    if len(known):
        k = np.minimum(np.searchsorted(known, h), len(known) - 1)
        h = h[np.argsort(np.where(known[k] == h, place[k], 0), kind="stable")]
    return h[: len(h) - -(-percent * len(h) // 100) + 1]


def shingled(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, h1, h2 (128 bits that name the set), bits, the same folded for the trees, prefix (its first hashes) for docs(doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bits", pa.binary()), ("narrow", pa.binary()), ("prefix", pa.binary())])
    often = docs.sparkSession.sparkContext.broadcast(frequent(docs, width))  # bounded by MOST_FREQUENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for d, t in rows_of(batches, "doc_id", "text"):
                h = shingle_set(t.encode(), width)
                n = len(h)
                if not n:
                    yield d, 0, 0, 0, b"", b"", b""
                    continue
                name = np.array([mix(h).sum(), mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum()]).view(np.int64)
                bits = bitmap(h)
                yield d, n, int(name[0]), int(name[1]), bits.tobytes(), folded(bits, max(32, len(bits) // FOLD)).tobytes(), prefix_of(h, often.value, percent).tobytes()

        yield from to_batches(rows(), schema)

    return docs.select("doc_id", or_empty("text").alias("text")).mapInArrow(run, "doc_id bigint, n bigint, h1 bigint, h2 bigint, bits binary, narrow binary, prefix binary")


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """list, id: classes that share a prefix hash and whose sizes, in order, are near enough; equal lists once."""
    posting = pa.schema([("token", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])
    found = pa.schema([("list", pa.int64()), ("id", pa.int64())])

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns, prefix = (batch.column(k).to_pylist() for k in range(3))
            sizes = [len(p) // 8 for p in prefix]
            tokens = np.frombuffer(b"".join(prefix), np.int64)
            for a in range(0, len(tokens), 1 << 18):
                rep = slice(a, a + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(tokens[rep]), pa.array(np.repeat(np.array(ids, np.int64), sizes)[rep]), pa.array(np.repeat(np.array(ns, np.int64), sizes)[rep])], schema=posting)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal tokens, of two classes or more. A run may go on in the next batch, so the last one waits."""
        rest_t, rest_i, rest_n = (np.zeros(0, np.int64) for _ in range(3))

        def emit(t: np.ndarray, i: np.ndarray, n: np.ndarray):
            if not len(t):
                return
            # Sizes rise within a token: where one is too small for the next, no pair across can link.
            start = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (100 * n[:-1] < percent * n[1:])]))
            size = np.diff(np.concatenate([start, [len(t)]]))
            keep = np.repeat(size > 1, size)
            if not keep.any():
                return
            # A list's name is a hash of its members, which no order changes.
            name = np.add.reduceat(mix(i.view(np.uint64)), start)
            name = mix(name + size.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[keep].view(np.int64)), pa.array(i[keep])], schema=found)

        for batch in batches:
            t = np.concatenate([rest_t, batch.column(0).to_numpy()])
            i = np.concatenate([rest_i, batch.column(1).to_numpy()])
            n = np.concatenate([rest_n, batch.column(2).to_numpy()])
            if not len(t):
                continue
            cut = int(np.searchsorted(t, t[-1]))
            yield from emit(t[:cut], i[:cut], n[:cut])
            rest_t, rest_i, rest_n = t[cut:], i[cut:], n[cut:]
        yield from emit(rest_t, rest_i, rest_n)

    rows = classes.filter("n > 0").select("id", "n", "prefix").mapInArrow(postings, "token bigint, id bigint, n bigint")
    together = rows.repartition("token").sortWithinPartitions("token", "n")
    return together.mapInArrow(groups, "list bigint, id bigint").distinct()


def _tested(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the exact test on sets(id, h). Members of one leader a are dealt over SALTS tasks."""
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            at, lead = None, None
            for a, salt, b, h in rows_of(batches, "a", "salt", "b", "h"):
                if b is None:
                    at, lead = (a, salt), np.frombuffer(h, np.uint64)
                    continue
                x = np.frombuffer(h, np.uint64)
                if at == (a, salt) and enough(len(np.intersect1d(lead, x, assume_unique=True)), len(lead), len(x), percent):
                    yield a, b

        yield from to_batches(rows(), out)

    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    members = salted.join(sets.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "h")
    leaders = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(None).cast("bigint").alias("b"), "h")
    return members.unionByName(leaders).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(run, "u bigint, v bigint")


def components_of(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text)."""
    info = materialised(shingled(docs, width, percent), "shingled")
    named = info.filter("n > 0 and doc_id is not null")
    classes = named.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("id"))
    lead = named.join(classes.select("h1", "h2", "n", "id"), ["h1", "h2", "n"]).filter("doc_id = id").select("id", "n", "bits", "narrow", "prefix").dropDuplicates(["id"])
    lists = materialised(_lists(lead, percent), "lists")
    signs = materialised(lead.select("id", "n", "bits", "narrow").join(lists.select("id").distinct(), "id", "left_semi"), "signs")

    def sets_of(ids: DataFrame) -> DataFrame:
        """id, h for the classes asked for, from their leaders' whole texts."""
        schema = pa.schema([("id", pa.int64()), ("h", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from to_batches(((d, shingle_set(t.encode(), width).tobytes()) for d, t in rows_of(batches, "doc_id", "text")), schema)

        wanted = docs.select("doc_id", or_empty("text").alias("text")).join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        return wanted.mapInArrow(run, "id bigint, h binary").dropDuplicates(["id"])

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and bitmaps allow the similarity."""
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for a, na, x, b, nb, y in rows_of(batches, "a", "na", "x", "b", "nb", "y"):
                    if 100 * min(na, nb) >= percent * max(na, nb) and enough(_bound(np.frombuffer(x, np.uint8), na, np.frombuffer(y, np.uint8), nb), na, nb, percent):
                        yield a, b

            yield from to_batches(rows(), schema)

        sign = lambda i, n, s: signs.select(F.col("id").alias(i), F.col("n").alias(n), F.col("bits").alias(s))
        return pairs.join(sign("a", "na", "x"), "a").join(sign("b", "nb", "y"), "b").mapInArrow(run, "a bigint, b bigint")

    links, labels, done = None, None, []
    for k in range(STAR_ROUNDS):
        at = lists if labels is None else _spanning(lists, labels)
        order = F.xxhash64("id", F.lit(k)) if k else F.col("id")
        leader = at.groupBy("list").agg(F.min_by("id", order).alias("a"))
        star = at.join(leader, "list").filter("a <> id").select("a", F.col("id").alias("b")).distinct()
        pairs = materialised(possible(star), "pairs")
        done.append(pairs)
        if k == 0:
            wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
            sets = materialised(sets_of(wanted), "sets")
        passed = materialised(_tested(pairs, sets, percent), "passed")
        links = passed if links is None else links.unionByName(passed)
        labels = materialised(connected(links), "labels")
        done.append(labels)
    spanning = _spanning(lists, labels)
    # A list of several pieces meets piece by piece: a row goes to every pair of pieces that its own is one of.
    pieces = spanning.groupBy("list").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    signed = spanning.join(signs.select("id", "n", "narrow"), "id").join(labels.select(F.col("node").alias("id"), "component"), "id", "left")
    dealt = signed.join(pieces, "list").select("list", "id", "n", "narrow", F.coalesce("component", "id").alias("component"), F.pmod(F.xxhash64("id"), "pieces").cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    left = dealt.select("list", F.least("piece", "other").alias("x"), F.greatest("piece", "other").alias("y"), "piece", "id", "n", "narrow", "component")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (_, x, y), own in groupby(rows_of(batches, "list", "x", "y", "piece", "id", "n", "narrow", "component"), key=lambda r: r[:3]):
                own = list(own)
                pairs = list_pairs([(i, n, np.frombuffer(bits, np.uint8), comp) for *_, i, n, bits, comp in own], percent)
                if x == y:
                    yield from pairs
                else:
                    piece = {r[4]: r[3] for r in own}
                    yield from (p for p in pairs if piece[p[0]] != piece[p[1]])

        yield from to_batches(((min(p), max(p)) for p in rows()), pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    rest = materialised(possible(left.repartition("list", "x", "y").sortWithinPartitions("list", "x", "y").mapInArrow(traverse, "a bigint, b bigint").distinct()), "pairs")
    more = rest.select(F.col("a").alias("id")).union(rest.select("b")).distinct().join(sets.select("id"), "id", "left_anti")
    passed = _tested(rest, sets.unionByName(materialised(sets_of(more), "sets")), percent)
    labels = connected(links.unionByName(passed))
    discard(*done, lists, signs, sets, rest)
    of_class = classes.join(labels.withColumnRenamed("node", "id"), "id", "left").select("h1", "h2", "n", F.coalesce("component", "id").alias("component"))
    return info.select("doc_id", "n", "h1", "h2").join(of_class, ["h1", "h2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _spanning(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists whose members are not all in one component."""
    named = lists.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").select("list", "id", F.coalesce("component", "id").alias("c"))
    open_ = named.groupBy("list").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select("list")
    return lists.join(open_, "list", "left_semi")


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs without the rows that follow another in their component: one document of each group of near copies stays."""
    follow = components_of(docs.select("doc_id", "text"), width, percent).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(follow, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "documents"))
