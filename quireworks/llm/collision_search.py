"""Nearest neighbours by collision-counting hashing.

Vectors lie in blocks of about BLOCK. Of a block each of PROJECTIONS random directions gives one array of its vectors sorted by their
projection. A query opens a window around its own projection in every array. Windows widen with the radius (virtual rehashing: one set of
arrays serves every radius), only what a widening adds is walked, and a vector that lies in SHARE of the windows is verified against the
original vectors. A query ends in a block as soon as its k-th best verified vector is within the radius; the next radius is that one's
distance where it is smaller. No cap on what is verified: windows that cover a block verify all of it.

Largest inner product becomes smallest distance by one more component: sqrt(M^2 - |x|^2) for vectors, M the largest norm, 0 for queries,
which are scaled to norm M. Directions come in orthogonal sets, which counts collisions more evenly than independent ones.

Equal vectors are one class, known by its TOP + 1 smallest ids, which are all that can be in a result; equal queries are searched once.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null vec_id, take no part; a query meets
vectors of its own length only; a row that comes twice counts once; one vec_id with two vectors is a candidate, and a query, for each; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireworks.llm.common import discard, materialised, release_memory, table

TOP = 20
BLOCK = 8192
PROJECTIONS = 64
#: Half of a window's width for radius 1, and the share of windows that a vector has to lie in. A vector at the radius lies in 0.87 of them on average.
HALF, SHARE = 1.5, 0.82
#: The first radius, as a share of the k-th nearest distance of a block's own vectors (the median over TRIED of them), and what it grows by.
START, GROWTH, TRIED = 0.92, 1.1, 32


@lru_cache(maxsize=8)
def directions(n_dims: int, n: int) -> np.ndarray:
    """n directions (rows) in orthogonal sets, each so long that a unit vector's projections have a variance of 1."""
    rng, rows = np.random.default_rng(20_011 + n_dims), []
    while sum(map(len, rows)) < n:
        q, r = np.linalg.qr(rng.standard_normal((n_dims, n_dims)))
        rows.append((q * np.sign(np.diag(r))).T * math.sqrt(n_dims))
    return np.concatenate(rows)[:n]


class Block:
    """The sorted arrays of some vectors of one length; scale and norm as in `search`."""

    def __init__(self, vectors: np.ndarray, first_ids: np.ndarray, scale: float, norm: float, k: int, n_projections: int = PROJECTIONS) -> None:
        self.vectors, self.first_ids, self.scale, self.norm = vectors, first_ids, scale, norm
        x = vectors / scale
        extra = np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))
        self.directions = directions(vectors.shape[1] + 1, n_projections)
        values = self.directions[:, :-1] @ x.T + self.directions[:, -1:] * extra
        order = np.argsort(values, axis=1, kind="stable")
        values = np.take_along_axis(values, order, axis=1)
        self.order = order.astype(np.uint16 if len(vectors) <= 1 << 16 else np.int64).ravel()
        # one sorted array after another in one: a search for all windows is one call
        self.gap = 4 * norm * math.sqrt(vectors.shape[1] + 1) + 1
        self.offset = np.arange(n_projections) * self.gap
        self.values = (values + self.offset[:, None]).ravel()
        self.least = math.ceil(SHARE * n_projections)
        tried = x[:: max(1, len(x) // TRIED)][:TRIED]
        products = np.sort((tried / np.maximum(np.sqrt((tried * tried).sum(axis=1, keepdims=True)), 1e-300)) @ x.T, axis=1)[:, -min(k, len(x))]
        self.first_radius = max(START * math.sqrt(max(0.0, float(np.median(2 * norm * (norm - products))))), 0.01 * norm)

    def _walk(self, parts: list[tuple[int, int]]) -> np.ndarray:
        """How often each vector lies in these parts of the sorted arrays."""
        found = [self.order[a:b] for a, b in parts if a < b]
        return np.bincount(np.concatenate(found), minlength=len(self.vectors)) if found else np.zeros(len(self.vectors), np.int64)

    def nearest(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places in the block and inner products of about the k best, best first, and how many were verified."""
        n, walked = len(self.vectors), self.order
        q = query / self.scale
        size = math.sqrt(float((q * q).sum()))
        stretch = self.norm / size if size else 0.0
        at = self.directions[:, :-1] @ (q * stretch)
        reach = self.gap / 2 - 1e-3 * self.gap
        low = high = np.searchsorted(self.values, at + self.offset)
        counts, verified = np.zeros(n, np.int64), np.zeros(n, bool)
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        radius = before = self.first_radius
        while True:
            half = min(HALF * radius, reach)
            to_low, to_high = np.searchsorted(self.values, at + self.offset - half), np.searchsorted(self.values, at + self.offset + half, "right")
            if low is high and 2 * int((to_high - to_low).sum()) > len(walked):  # the first windows cover most of the arrays: what lies outside is walked
                ends = range(0, len(walked) + 1, n)
                counts += len(at) - self._walk([*zip(ends, to_low.tolist()), *zip(to_high.tolist(), ends[1:])])
            else:
                counts += self._walk([*zip(to_low.tolist(), low.tolist()), *zip(high.tolist(), to_high.tolist())])
            low, high = to_low, to_high
            new = np.flatnonzero((counts >= self.least) & ~verified)
            if len(new):
                verified[new] = True
                places = np.concatenate([places, new])
                scores = np.concatenate([scores, self.vectors[new] @ query])
                if len(scores) > 4 * k:
                    near = np.argpartition(-scores, k)
                    near = np.flatnonzero(scores >= scores[near[k]])
                    places, scores = places[near], scores[near]
                best = np.lexsort((self.first_ids[places], -scores))[:k]
                places, scores = places[best], scores[best]
            if half == reach or verified.all():
                break
            before, radius = radius, radius * GROWTH
            if len(places) >= k:
                cosine = float(((self.vectors[places[-1]] / self.scale) * q).sum()) * stretch
                distance = math.sqrt(max(0.0, 2 * (self.norm * self.norm - cosine)))
                if distance <= before:
                    break
                radius = min(radius, distance)
        scores = (self.vectors[places] * query).sum(axis=1)  # summed alike wherever a vector lies
        best = np.lexsort((self.first_ids[places], -scores))
        return places[best], scores[best], int(verified.sum())


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles), a, b (v's two hashes) of the rows that take part."""
    v = F.transform(F.col("embedding"), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    sound = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("v", lambda x: x != 0)  # NaN is above infinity in Spark
    return x.filter(F.coalesce(sound, F.lit(False))).withColumns({"a": F.xxhash64("v"), "b": F.xxhash64(F.lit(1), "v")})


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """a, b, v, ids: each distinct vector with its k smallest vec_ids in order."""
    first = Window.partitionBy("a", "b").orderBy("vec_id")
    some = rows.groupBy("a", "b", "vec_id").agg(F.first("v").alias("v")).withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= k)
    return some.groupBy("a", "b").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
FOUND_DDL = "a bigint, b bigint, ids array<bigint>, score double"


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components, and each vector's end."""
    return column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())


def block_search(scale: float, norm: float, k: int, n_projections: int):
    """For batches (kind, a, b, ids, v, block) in the order of block and kind: a block's vectors (kind 0) and then the queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, list[int]]]] = {}
        blocks: dict[int, tuple[Block, list[list[int]]]] = {}
        now = None
        for batch in batches:
            kinds, block = batch.column(0).to_pylist(), batch.column(5).to_pylist()
            a, b, ids = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            flat, ends = _flat(batch.column(4))
            out: list[tuple] = []
            for i, kind in enumerate(kinds):
                if block[i] != now:
                    now, held, blocks = block[i], {}, {}
                vector = flat[ends[i - 1] if i else 0 : ends[i]]
                if kind == 0:
                    held.setdefault(len(vector), []).append((vector.copy(), ids[i]))
                    continue
                if held:
                    for n_dims, own in held.items():
                        blocks[n_dims] = (Block(np.array([x for x, _ in own]), np.array([x[0] for _, x in own]), scale, norm, k, n_projections), [x for _, x in own])
                    held = {}
                if len(vector) in blocks:
                    index, names = blocks[len(vector)]
                    places, scores, _ = index.nearest(vector, k)
                    out += [(a[i], b[i], names[p], s) for p, s in zip(places.tolist(), scores.tolist())]
                if len(out) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), FOUND.types)], schema=FOUND)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), FOUND.types)], schema=FOUND)
        release_memory()

    return run


def search(vectors: DataFrame, is_query: Column, top: int = TOP, block: int = BLOCK, n_projections: int = PROJECTIONS) -> DataFrame:
    """query_id, rank, vec_id, score: for each of vectors(vec_id, embedding) where is_query holds, its `top` nearest others that were found."""
    rows = usable(vectors)
    spark, k = vectors.sparkSession, top + 1
    classes = materialised(classes_of(rows, k), "classes")
    scale = classes.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    if scale is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / scale) * (x / scale)))
    n, norm = classes.agg(F.count("*"), F.max(size)).first()
    n_blocks = -(-n // block)
    queries = rows.filter(is_query).select("vec_id", "a", "b", "v")
    asked = queries.groupBy("a", "b").agg(F.first("v").alias("v"))
    everywhere = asked.select(F.lit(1).alias("kind"), "a", "b", F.array().cast("array<bigint>").alias("ids"), "v", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    here = classes.select(F.lit(0).alias("kind"), "a", "b", "ids", "v", F.pmod(F.col("b"), F.lit(n_blocks)).cast("int").alias("block"))
    dealt = here.unionByName(everywhere).repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block", "kind")
    found = materialised(dealt.mapInArrow(block_search(scale, norm, k, n_projections), FOUND_DDL), "found")
    discard(classes)
    best = Window.partitionBy("a", "b").orderBy(F.desc("score"), F.col("ids")[0])
    named = found.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= k).select("a", "b", "score", F.explode("ids").alias("vec_id"))
    order = [F.desc("score"), F.asc("vec_id")]
    named = named.withColumn("_k", F.row_number().over(Window.partitionBy("a", "b").orderBy(*order))).filter(F.col("_k") <= k).drop("_k")
    each = queries.select(F.col("vec_id").alias("query_id"), "a", "b").distinct().join(named, ["a", "b"]).filter("query_id <> vec_id")
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "a", "b").orderBy(*order))).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op13_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
