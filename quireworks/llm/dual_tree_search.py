"""Ranked lexical search of many items at once: a tree over items and trees over documents, walked in pairs.

One scan turns each whole text into a sparse vector over the items' terms, with its number of terms. Documents lie in trees of about
TREE_DOCS, ordered by the terms that weigh most in them; each node holds the largest impact of every term below it, and each node of the
item tree the largest weight. The product of a pair of nodes bounds every score below it, so a pair goes as soon as its bound is under
the weakest 20th score of its items: whole batches of items meet whole batches of documents, and nothing is lost.

The scores to beat start at those of a bounded sample of documents (START_DOCS, the only use of that sample: the 20th best of some
documents is never above the 20th best of all) and rise while a task goes through its trees.

Items are taken in groups of at most GROUP_ITEMS items and GROUP_TERMS distinct terms or, where a single item has more, that item alone;
each group is one scan, and what is broadcast is one group's terms. Item rows are collected a group at a time.

Defined cases: a null or empty text has no terms, and such a document is in no result and not counted in N; an item without terms, or
without a document that scores above 0, gives no rows; an item row that comes twice gives its rows twice; a null item_id stays null;
repeated documents are ranked each on its own, null doc_ids after all others; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireworks.llm.common import discard, materialised, release_memory, table

TOP = 20
TREE_DOCS, LEAF_DOCS, FAN = 8192, 16, 8
GROUP_ITEMS, GROUP_TERMS = 4096, 16384
#: Documents that the first scores to beat come from, about.
START_DOCS = 20_000
#: No document, in place of a null doc_id within a task.
NO_ID = np.iinfo(np.int64).max

#: Bytes of terms as they are, A-Z in lower case, all others a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The maximal runs of ASCII letters and digits and all other characters above U+007F."""
    return text.translate(_FOLD).split()


def item_groups(items: DataFrame, group_items: int = GROUP_ITEMS, group_terms: int = GROUP_TERMS) -> Iterator[list[tuple[int | None, Counter]]]:
    """Lists of (item_id, its terms with their counts), in an order of their own."""
    group: list[tuple[int | None, Counter]] = []
    seen: set[bytes] = set()
    for row in items.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        own = Counter(terms_of(bytes(row["text"] or b"")))
        if not own:
            continue
        if group and (len(group) >= group_items or len(seen | own.keys()) > group_terms):
            yield group
            group, seen = [], set()
        group.append((row["item_id"], own))
        seen |= own.keys()
    if group:
        yield group


VECTORS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])
VECTORS_DDL = "doc_id bigint, n bigint, terms binary, counts binary"
#: n of the one row of a partition that holds in how many of its documents each term is; doc_id has their number, the next row all their terms.
DF_ROW, N_ROW = -1, -2


def document_vectors(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """A row for each document with terms, and two rows for each partition with its sums; see DF_ROW."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        df, n_docs, n_terms = np.zeros(len(number), np.int64), 0, 0
        out: list[tuple] = []
        for batch in batches:
            for a in range(0, len(batch), 256):
                few = batch.slice(a, 256)
                for doc_id, text in zip(few.column(0).to_pylist(), few.column(1)):
                    if not text.is_valid:
                        continue
                    words = terms_of(text.as_buffer().to_pybytes())
                    if not words:
                        continue
                    n_docs += 1
                    n_terms += len(words)
                    own = np.fromiter((number[w] for w in words if w in number), np.int64)
                    at, tf = np.unique(own, return_counts=True)
                    df[at] += 1
                    out.append((doc_id, len(words), at.astype("<i4").tobytes(), tf.astype("<i4").tobytes()))
                if len(out) >= 2048:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), VECTORS.types)], schema=VECTORS)
                    out = []
        at = np.flatnonzero(df)
        out += [(n_docs, DF_ROW, at.astype("<i4").tobytes(), df[at].astype("<i8").tobytes()), (n_terms, N_ROW, b"", b"")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), VECTORS.types)], schema=VECTORS)
        release_memory()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, VECTORS_DDL)


def _summed(rows: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and each term's df from the partitions' rows; terms are summed by Spark, and there are GROUP_TERMS of them at most, or one item's."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(at, "<i4").astype(np.int64)), pa.array(np.frombuffer(n, "<i8"))], names=["term", "n"])

    total = rows.filter(F.col("n") < 0).agg(*[F.coalesce(F.sum(F.when(F.col("n") == k, F.col("doc_id"))), F.lit(0)).alias(name) for k, name in ((DF_ROW, "docs"), (N_ROW, "terms"))]).first()
    df = np.zeros(n_terms, np.int64)
    for r in rows.filter(F.col("n") == DF_ROW).select("terms", "counts").mapInArrow(spread, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    return int(total["docs"]), int(total["terms"]), df


class ItemTree:
    """Items in an order of their heaviest terms, FAN to a node: levels[0] are the items, levels[-1] the root; each node a sparse row of
    the largest weights below it (terms, values)."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.order = sorted(range(len(rows)), key=lambda i: tuple(rows[i][0][np.argsort(-rows[i][1], kind="stable")[:3]].tolist()))
        self.levels = [[rows[i] for i in self.order]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([self._over(below[a : a + FAN]) for a in range(0, len(below), FAN)])

    @staticmethod
    def _over(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        at, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        terms, inverse = np.unique(at, return_inverse=True)
        most = np.zeros(len(terms), np.int64)
        np.maximum.at(most, inverse, value)
        return terms, most

    def least(self, scores: np.ndarray) -> list[np.ndarray]:
        """For the nodes of each level the smallest of the scores (in this tree's order of items) below them."""
        out = [scores]
        while len(out[-1]) > 1:
            out.append(np.minimum.reduceat(out[-1], np.arange(0, len(out[-1]), FAN)))
        return out


class DocTree:
    """Documents ordered by the terms that weigh most in them; levels[0] are the documents' impacts (terms as columns), levels[1] groups of
    LEAF_DOCS and further levels groups of FAN with the maxima of what is below."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, n_docs: int, n_all: int) -> None:
        m = 100 - 25 + (25 * n * n_docs) // n_all
        lengths = np.array([len(t) for t, _ in parts])
        row, at = np.repeat(np.arange(len(ids)), lengths), np.concatenate([t for t, _ in parts]).astype(np.int64)
        tf = np.concatenate([c for _, c in parts]).astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
        heavy = np.lexsort((at, -(impact * weight[at]), row))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        keys = [np.where(lengths > k, at[heavy[np.minimum(starts + k, len(at) - 1)]] if len(at) else 0, -1) for k in range(3)]
        order = np.lexsort((ids, *keys[::-1]))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        self.terms = np.unique(at)
        self.column = np.full(len(weight), -1, np.int64)
        self.column[self.terms] = np.arange(len(self.terms))
        leaf = np.zeros((-(-len(ids) // LEAF_DOCS), len(self.terms)), np.int32)
        np.maximum.at(leaf, (place[row] // LEAF_DOCS, self.column[at]), impact.astype(np.int32))
        by_doc = np.argsort(place[row], kind="stable")
        self.at, self.impact = self.column[at[by_doc]], impact[by_doc]
        self.ends = np.concatenate([[0], np.cumsum(lengths[order])])
        self.levels, self.first = [None, leaf], [None, np.minimum.reduceat(self.ids, np.arange(0, len(ids), LEAF_DOCS))]
        while len(self.levels[-1]) > 1:
            cuts = np.arange(0, len(self.levels[-1]), FAN)
            self.levels.append(np.maximum.reduceat(self.levels[-1], cuts, axis=0))
            self.first.append(np.minimum.reduceat(self.first[-1], cuts))

    def dense(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids and impacts (documents by terms) of a leaf."""
        a, b = leaf * LEAF_DOCS, min((leaf + 1) * LEAF_DOCS, len(self.ids))
        out = np.zeros((b - a, len(self.terms)), np.int64)
        s, e = self.ends[a], self.ends[b]
        out[np.repeat(np.arange(b - a), np.diff(self.ends[a : b + 1])), self.at[s:e]] = self.impact[s:e]
        return self.ids[a:b], out


def _bounds(node: tuple[np.ndarray, np.ndarray], tree: DocTree, level: int, nodes: np.ndarray) -> np.ndarray:
    """The largest score that an item under the node can have with a document under each of the nodes of a level."""
    column = tree.column[node[0]]
    there = column >= 0
    return tree.levels[level][np.ix_(nodes, column[there])].astype(np.int64) @ node[1][there]


class Best:
    """The TOP best documents of each item so far, in the item tree's order; none counts as score 0."""

    def __init__(self, n_items: int, scores: np.ndarray, ids: np.ndarray) -> None:
        self.kept: list[list[tuple[int, int]]] = [[] for _ in range(n_items)]
        self.score, self.id = scores.copy(), ids.copy()  # what a document has to beat: a higher score, or an equal one and a smaller or equal id

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = (scores > self.score[item]) | ((scores == self.score[item]) & (ids <= self.id[item]) & (scores > 0))
        if not keep.any():
            return
        rows = self.kept[item] + list(zip((-scores[keep]).tolist(), ids[keep].tolist()))
        rows.sort()
        self.kept[item] = rows[:TOP]
        if len(rows) >= TOP:
            score, doc = -rows[TOP - 1][0], rows[TOP - 1][1]
            if (score, -doc) > (self.score[item], -self.id[item]):
                self.score[item], self.id[item] = score, doc


def _score_leaves(items: ItemTree, docs: DocTree, best: Best, kept: dict[int, np.ndarray], bounds: dict[int, np.ndarray]) -> None:
    """Scores the documents of leaves (kept and bounds by item). Leaves with the highest bounds come first, so scores to beat rise early, and each
    leaf is tested again against what they are by then; all items that a leaf is left with are scored in one go."""
    if not kept:
        return
    item = np.repeat(np.array(list(kept)), [len(v) for v in kept.values()])
    leaf, bound = np.concatenate(list(kept.values())), np.concatenate(list(bounds.values()))
    order = np.lexsort((item, leaf))
    item, leaf, bound = item[order], leaf[order], bound[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(leaf)) + 1])
    ends = np.append(starts[1:], len(leaf))
    for k in np.argsort(-np.maximum.reduceat(bound, starts), kind="stable").tolist():
        own = item[starts[k] : ends[k]][bound[starts[k] : ends[k]] >= best.score[item[starts[k] : ends[k]]]]
        if not len(own):
            continue
        ids, impacts = docs.dense(int(leaf[starts[k]]))
        terms, weights, sizes = [items.levels[0][i][0] for i in own], [items.levels[0][i][1] for i in own], [len(items.levels[0][i][0]) for i in own]
        column = docs.column[np.concatenate(terms)]
        each = impacts[:, column] * np.where(column >= 0, np.concatenate(weights), 0)
        scores = np.add.reduceat(each, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=1)
        for i in np.flatnonzero(scores.max(axis=0) >= best.score[own]).tolist():
            best.add(int(own[i]), scores[:, i], ids)


def walk(items: ItemTree, docs: DocTree, best: Best) -> int:
    """Both trees from their roots down; returns how many pairs of nodes were looked at."""
    looked = 0
    top_i, top_d = len(items.levels) - 1, len(docs.levels) - 1
    pairs = {0: np.zeros(1, np.int64)}  # nodes of documents by node of items
    while True:
        weakest = items.least(best.score)[top_i]
        last = -items.least(-best.id)[top_i]  # a bound equal to the weakest score needs an id up to the largest to beat
        kept: dict[int, np.ndarray] = {}
        bounds: dict[int, np.ndarray] = {}
        for u, vs in pairs.items():
            bound = _bounds(items.levels[top_i][u], docs, top_d, vs)
            looked += len(vs)
            ok = (bound > 0) & ((bound > weakest[u]) | ((bound == weakest[u]) & (docs.first[top_d][vs] <= last[u])))
            if ok.any():
                kept[u], bounds[u] = vs[ok], bound[ok]
        if not top_i and top_d == 1:
            break
        if top_d > 1:
            size = len(docs.levels[top_d - 1])
            kept = {u: (below := (vs[:, None] * FAN + np.arange(FAN)).ravel())[below < size] for u, vs in kept.items()}
            top_d -= 1
        if top_i:
            size = len(items.levels[top_i - 1])
            kept = {w: vs for u, vs in kept.items() for w in range(u * FAN, min((u + 1) * FAN, size))}
            top_i -= 1
        pairs = kept
    _score_leaves(items, docs, best, kept, bounds)
    return looked


FOUND_DDL = "item int, doc_id bigint, score bigint"
FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def searched(rows: DataFrame, items, start) -> DataFrame:
    """item (its number in the tree), doc_id, score: what each task found that beats the scores of `start`. items and start are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, weight, n_docs, n_all = items.value
        best = Best(len(tree.levels[0]), *start.value)
        held: list[tuple] = []

        def flush() -> None:
            if held:
                ids, n = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
                walk(tree, DocTree(ids, n, [x[2:] for x in held], weight, n_docs, n_all), best)
                held.clear()

        for batch in batches:
            for doc_id, n, terms, counts in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((NO_ID if doc_id is None else doc_id, n, np.frombuffer(terms, "<i4"), np.frombuffer(counts, "<i4")))
                if len(held) >= TREE_DOCS:
                    flush()
        flush()
        out = [(item, None if doc == NO_ID else doc, -score) for item, rows in enumerate(best.kept) for score, doc in rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), FOUND.types)], schema=FOUND)
        release_memory()

    return rows.filter((F.col("n") > 0) & (F.length("terms") > 0)).select("doc_id", "n", "terms", "counts").mapInArrow(run, FOUND_DDL)


def ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)


def _searched_group(docs: DataFrame, group: list[tuple[int | None, Counter]], start_docs: int) -> DataFrame:
    spark = docs.sparkSession
    terms = {t: k for k, t in enumerate(sorted(set().union(*(c.keys() for _, c in group))))}
    vectors = materialised(document_vectors(docs, terms), "vectors")
    n_docs, n_all, df = _summed(vectors, len(terms))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    rows = [(np.array([terms[t] for t in c], np.int64), np.array([k * weight[terms[t]] for t, k in c.items()], np.int64)) for _, c in group]
    tree = ItemTree(rows)
    known = spark.sparkContext.broadcast((tree, weight, n_docs, n_all))
    scores, ids = np.zeros(len(group), np.int64), np.full(len(group), NO_ID, np.int64)
    every = max(1, n_docs // max(1, start_docs))
    sample = vectors.filter((F.col("n") > 0) & (F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(every)) == 0))
    for r in ranked(searched(sample, known, spark.sparkContext.broadcast((scores, ids)))).filter(F.col("rank") == TOP).collect():  # a row an item at most
        scores[r["item"]], ids[r["item"]] = r["score"], NO_ID if r["doc_id"] is None else r["doc_id"]
    found = materialised(searched(vectors, known, spark.sparkContext.broadcast((scores, ids))), "found")
    discard(vectors)
    names = spark.createDataFrame([(k, group[i][0]) for k, i in enumerate(tree.order)], "item int, item_id bigint")
    return ranked(found).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a group's items, GROUP_ITEMS at most


def search(docs: DataFrame, items: DataFrame, start_docs: int = START_DOCS, group_items: int = GROUP_ITEMS, group_terms: int = GROUP_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP best documents(doc_id, text) of each of items(item_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for group in item_groups(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), group_items, group_terms):
        one = _searched_group(docs, group, start_docs)
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")


def op11_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS t FROM documents),
c AS (SELECT (SELECT count(*) FROM d WHERE len(t) > 0)::BIGINT AS n_docs, (SELECT sum(len(t)) FROM d)::BIGINT AS n_all),
q AS (SELECT item, item_id, term, count(*) AS k FROM (SELECT item, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS t FROM benchmark)) GROUP BY ALL),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term),
s AS (SELECT item, item_id, row, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_all))))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term), c GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}"""
