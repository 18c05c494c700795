"""Secret scan: candidates by pattern, false positives removed by a random forest.

The scan takes every long run of key characters that holds a digit, every very long run, and every value, however short, that a name
with a key word assigns or that follows `bearer`. A forest over the candidate's length, character transitions, dictionary coverage, path and neighbouring words, trained from labelled findings, tells
secrets from the rest. MLlib trains it on a bounded sample of each class, drawn from the findings of all documents; its trees, bounded by their depth, then go to the tasks as arrays, so no
document is shuffled.

Defined cases: a null text has no findings; a null source counts as an empty path; very long texts are scanned whole; equal candidates
of one document are separate findings, told apart by their start; where the labelled findings of the whole table lack one of the two
classes no forest is trained and the labelling rule alone decides. Extra columns are ignored, or carried by `redact`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import materialised, or_empty, release_memory, rows_of, table, to_batches

#: A sign of assignment is no part of a candidate; one or two at its end are padding.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=\-]))?")
#: Runs without a digit are candidates only from this length on.
LONG_WORD = 32
#: Findings of a class that train the forest, at most about; trees and their depth.
PER_CLASS, TREES, DEPTH = 20_000, 20, 6
THRESHOLD = 0.5
MASK = "<secret>"

_KEY_WORDS = re.compile(r"(token|key|secret|passw|pwd|auth|credential|bearer)", re.I)
_NAME = r"(?:token|key|secret|passw|pwd|auth(?!or)|credential|bearer)[\w.\-]*"
#: name = value, "name": "value", name=value; a quoted value ends with its quote. A name with its white space has NAME_CHARS characters at most, so
#: each sign of assignment looks back a bounded way and a text of any length takes linear time. Or: bearer value.
NAME_CHARS = 96
_SIGN = re.compile(r":=|=>|[=:](?!=)")
_NAME_BEFORE = re.compile(_NAME + r"""["']?\s*\Z""", re.I)
_VALUE = re.compile(r"""\s*(?:bearer\s+)?(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>,;&]+))""", re.I)
_BEARER = re.compile(r"""\bbearer\s+["']?([A-Za-z0-9+/_.~\-]+=*)""", re.I)
_NAMED = re.compile(_NAME + r"""["']?\s*(?::=|=>|[=:])\s*(?:bearer\s+)?["']?$|\bbearer\s+["']?$""", re.I)
_PASSWORD = re.compile(r"""(?:passw|pwd|secret)[\w.\-]*["']?\s*(?::=|=|:\s*["'])\s*["']?$""", re.I)
#: Forms that tell a secret without a name: keys and tokens of known services, signed tokens.
_FORM = re.compile(r"(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abpr]-[A-Za-z0-9\-]{10,}|eyJ[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]+)*=*)")
#: A placeholder: a reference to a variable or a call, not the value itself.
_REFERENCE = re.compile(r"[$%{(\[<].*|.*\(.*|MASK|null|none|true|false".replace("MASK", MASK), re.I)
_TEST_PATH = re.compile(r"(test|example|sample|doc|fixture)", re.I)
#: Frequent words and word parts of the four languages.
FRAGMENTS = (
    "the and that with have this from tion ing ment ent ion ation able ness ous ive est ter ther ould "
    "der die und nicht sich ein eine ung lich keit heit sch ich auf gen ver "
    "les des une que pour dans eur aux eau elle tre oir ique "
    "los las con por para como ado cion mente aba ero dad"
).split()
_FRAGMENT = re.compile("|".join(sorted(FRAGMENTS, key=len, reverse=True)))
FEATURES = ("length", "digits", "uppers", "class_changes", "vowel_changes", "distinct", "entropy", "dictionary", "key_word", "assigned", "quoted", "test_path", "path_length")


def features(text: str, path: str, start: int, end: int) -> list[float]:
    c = text[start:end]
    n = len(c)
    kinds = ["d" if x.isdigit() else "u" if x.isupper() else "l" if x.islower() else "s" for x in c]
    low = c.lower()
    vowel = [x in "aeiou" for x in low]
    counts = Counter(c)
    before = text[max(0, start - 40) : start]
    return [
        float(n), kinds.count("d") / n, kinds.count("u") / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n, sum(a != b for a, b in zip(vowel, vowel[1:])) / n,
        len(counts) / n, -sum(k / n * math.log2(k / n) for k in counts.values()),
        sum(len(m) for m in _FRAGMENT.findall(low)) / n,
        float(bool(_KEY_WORDS.search(before))), float(bool(re.search(r"([=:]>?|bearer)\s*[\"']?$", before, re.I))), float(before[-1:] in ("'", '"')),
        float(bool(_TEST_PATH.search(path))), float(len(path)),
    ]


def assigned(text: str) -> list[tuple[int, int]]:
    """Spans of the values that a name with a key word assigns, or that follow `bearer`, in order and apart."""
    spans: list[tuple[int, int]] = []
    end, bearer = 0, _BEARER.search(text)

    def take_bearers(before: int) -> None:
        nonlocal end, bearer
        while bearer and bearer.start() < before:
            if bearer.start() >= end:
                spans.append(bearer.span(1))
                end = bearer.end()
            bearer = _BEARER.search(text, max(end, bearer.start() + 1))

    words, latest = _KEY_WORDS.finditer(text), -1
    word = next(words, None)
    for sign in _SIGN.finditer(text):
        while word and word.end() <= sign.start():
            latest, word = word.start(), next(words, None)
        if sign.start() < end:
            continue
        since = max(end, sign.start() - NAME_CHARS)
        name = _NAME_BEFORE.search(text, since, sign.start()) if latest >= since else None
        take_bearers(name.start() if name else sign.start())
        if name and name.start() < end:
            name = _NAME_BEFORE.search(text, min(end, sign.start()), sign.start())
        if name and sign.start() >= end and (m := _VALUE.match(text, sign.end())):
            spans.append(m.span(m.lastindex))
            end = m.end()
    take_bearers(len(text))
    return spans


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Spans in order, none over another: the assigned values, and the runs outside of them."""
    spans = assigned(text)
    k = 0
    for m in CANDIDATE.finditer(text):
        c = m[0]
        while k < len(spans) and spans[k][1] <= m.start():
            yield spans[k]
            k += 1
        if (len(c) >= LONG_WORD or any(x.isdigit() for x in c)) and (k == len(spans) or m.end() <= spans[k][0]):
            yield m.span()
    yield from spans[k:]


def evidence(text: str, start: int, end: int) -> bool:
    """Whether a candidate is a secret by its name or its form: a value with both letters and digits or mixed case of eight characters or
    more under any key word, any value but a reference under a password's, or the form of a known key."""
    c, before = text[start:end], text[max(0, start - 80) : start]
    if _FORM.fullmatch(c):
        return True
    if not _NAMED.search(before) or _REFERENCE.fullmatch(c):
        return False
    if _PASSWORD.search(before):
        return True
    mixed = any(x.isdigit() for x in c) and any(x.isalpha() for x in c)
    turns = sum(a.islower() and b.isupper() for a, b in zip(c, c[1:]))
    return len(c) >= 8 and not any(x.isspace() for x in c) and (mixed or turns >= 2)


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, evident, features for every candidate of docs(doc_id, source, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("evident", pa.bool_()), ("features", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from to_batches(((d, a, b, evidence(t, a, b), features(t, p, a, b)) for d, p, t in rows_of(batches, "doc_id", "source", "text") for a, b in candidates(t)), schema)

    return docs.select("doc_id", or_empty("source").alias("source"), or_empty("text").alias("text")).mapInArrow(run, "doc_id bigint, start bigint, end bigint, evident boolean, features array<double>")


def labelled(found: DataFrame) -> DataFrame:
    """findings with a label. The tables hold none, so a finding counts as a secret where its name or form is evidence of one; a table
    of reviewed findings takes this function's place."""
    return found.withColumn("label", F.col("evident").cast("double"))


def train(labels: DataFrame, trees: int = TREES, depth: int = DEPTH) -> list[list[tuple]] | None:
    """A forest from labelled findings (features, label), as lists of nodes (feature, threshold, left, right, share of secrets)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = labels.select("doc_id", "start", array_to_vector("features").alias("x"), "label").repartition(1).sortWithinPartitions("doc_id", "start").cache()
    try:
        if {r["label"] for r in rows.select("label").distinct().collect()} != {0.0, 1.0}:
            return None
        model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=11).fit(rows)
    finally:
        rows.unpersist()
    out = []
    for t in model.trees:
        nodes: list[tuple] = []

        def walk(node) -> int:
            at = len(nodes)
            nodes.append(())
            if hasattr(node, "leftChild") and "Internal" in node.getClass().getSimpleName():
                split = node.split()
                nodes[at] = (int(split.featureIndex()), float(split.threshold()), walk(node.leftChild()), walk(node.rightChild()), 0.0)
            else:
                stats = list(node.impurityStats().stats())
                nodes[at] = (-1, 0.0, at, at, stats[1] / max(sum(stats), 1e-12))
            return at

        walk(t._java_obj.rootNode())
        out.append(nodes)
    return out


def score(forest: list[list[tuple]] | None, x: np.ndarray) -> np.ndarray:
    """Mean share of secrets in the leaves that each row of x reaches; 0 without a forest, which leaves the labelling rule to decide."""
    if forest is None:
        return np.zeros(len(x))
    total = np.zeros(len(x))
    for nodes in forest:
        feature, threshold, left, right, share = (np.array(c) for c in zip(*nodes))
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        total += share[at]
    return total / len(forest)


def judged(forest: list[list[tuple]] | None, text: str, path: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Scores of the spans: 1 with evidence, which may be of a kind that the forest has not seen; else the forest's."""
    known = np.array([evidence(text, a, b) for a, b in spans])
    return np.round(np.where(known, 1.0, score(forest, np.array([features(text, path, a, b) for a, b in spans]))), 6)


def fitted(docs: DataFrame, per_class: int = PER_CLASS) -> list[list[tuple]] | None:
    """The forest, trained on the labelled findings of all documents: those of a class in full up to per_class, else about that
    many by a hash."""
    found = materialised(labelled(findings(docs)).select("doc_id", "start", "features", "label"), "findings")
    share = {r["label"]: min(1.0, per_class / r["n"]) for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}
    most = F.when(F.col("label") == 1.0, int(share.get(1.0, 1.0) * (1 << 30))).otherwise(int(share.get(0.0, 1.0) * (1 << 30)))
    return train(found.filter(F.pmod(F.xxhash64("doc_id", "start"), F.lit(1 << 30)) < most))


def scan(docs: DataFrame, forest: list[list[tuple]] | None) -> DataFrame:
    """doc_id, start, length, finding_sha256, score, is_secret for every finding."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("finding_sha256", pa.string()), ("score", pa.float64()), ("is_secret", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for d, p, t in rows_of(batches, "doc_id", "source", "text"):
                spans = list(candidates(t))
                if spans:
                    s = judged(forest, t, p, spans)
                    for (a, b), y in zip(spans, s.tolist()):
                        yield d, a, b - a, hashlib.sha256(t[a:b].encode()).hexdigest(), y, y >= THRESHOLD

        yield from to_batches(rows(), schema)

    return docs.select("doc_id", or_empty("source").alias("source"), or_empty("text").alias("text")).mapInArrow(run, "doc_id bigint, start bigint, length bigint, finding_sha256 string, score double, is_secret boolean")


def redact(docs: DataFrame, forest: list[list[tuple]] | None) -> DataFrame:
    """docs with each secret of its text replaced by MASK; all other text and columns stay as they are."""

    at, path_at = docs.columns.index("text"), docs.columns.index("source")

    def masked(t: str | None, p: str | None) -> str | None:
        spans = list(candidates(t)) if t is not None else []
        if spans:
            for (a, b), y in zip(reversed(spans), reversed(judged(forest, t, p or "", spans).tolist())):
                if y >= THRESHOLD:
                    t = t[:a] + MASK + t[b:]
        return t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                few = batch.slice(a, 256)
                texts = [masked(t, p) for t, p in zip(few.column(at).to_pylist(), few.column(path_at).to_pylist())]
                yield few.set_column(at, few.schema.field(at), pa.array(texts, few.schema.field(at).type))
        release_memory()

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fitted(docs))
