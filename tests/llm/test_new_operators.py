"""Dual-tree search, prefix trie and collision search against brute force: nulls, ties, repeated rows, odd texts, clashing columns, empty tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireworks.llm import collision_search, dual_tree_search, fuzzy_lines, prefix_trie, quality_rules, secret_scan

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_ranking(docs, items, top=20):
    terms = [(d, Counter(TERM.findall(lowered(t)))) for d, t in docs]
    terms = [(d, c, sum(c.values())) for d, c in terms if c]
    n_docs, n_all = len(terms), sum(n for *_, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    out = []
    for item, text in items:
        q, found = Counter(TERM.findall(lowered(text))), []
        for d, c, n in terms:
            m = 75 + (25 * n * n_docs) // n_all
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in q.items() if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        found.sort(key=lambda x: x[:3])
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(found[:top])]
    return Counter(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = ["the", "The", "of", "and", "Größe", "naïve", "x1", "42", "日本", "a_b", "don't"] + ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(k, say(rng.randint(1, 60))) for k in range(300)]
    docs += [(400 + k, docs[7][1]) for k in range(40)] + [docs[3], docs[3], (None, docs[7][1]), (None, None), (5000, None), (5001, ""), (5002, " \n\x00-!"), (5003, say(4000)), (5004, "İß ﬁ\u0085x y")]
    items = [(k, say(rng.randint(1, 12))) for k in range(30)] + [(30, docs[7][1]), (31, None), (32, ""), (33, "zzzzzz qqqqq"), (None, "the of"), (4, "the the the of"), (4, "the the the of"), (35, "İß x y")]
    return docs, items


@pytest.fixture(scope="module")
def corpus_tables(spark, corpus):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in corpus[0]], "doc_id long, text string, rank string, score int").repartition(5)
    return docs, spark.createDataFrame([(d, t, "y") for d, t in corpus[1]], "item_id long, text string, doc_id string")


def test_dual_tree_search(corpus, corpus_tables, monkeypatch):
    docs, items = corpus_tables
    want = plain_ranking(*corpus)
    got = dual_tree_search.search(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == want
    assert Counter(map(tuple, dual_tree_search.search(docs, items, start_docs=30).collect())) == want
    assert Counter(map(tuple, dual_tree_search.search(docs, items, group_items=9, group_terms=40).collect())) == want  # groups, some of one item with more terms


def test_dual_tree_search_of_nothing(spark, corpus_tables):
    docs, items = corpus_tables
    assert dual_tree_search.search(docs.limit(0), items).count() == 0
    assert dual_tree_search.search(docs, items.limit(0)).count() == 0
    assert dual_tree_search.search(docs.filter("text is null"), items).count() == 0


def test_trees_prune_and_lose_nothing(corpus):
    """Many small trees after one another in one task, and fewer pairs looked at than there are pairs of items and leaves."""
    rng = random.Random(3)
    topics = [["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(25)] for _ in range(40)]
    docs = [(k, f"topic{k % 40} " * 9 + " ".join(rng.choice(topics[k % 40]) for _ in range(40))) for k in range(4000)]
    items = [(k, f"topic{k % 40} " + " ".join(rng.choice(topics[k % 40]) for _ in range(8))) for k in range(120)]
    group = [(k, Counter(dual_tree_search.terms_of(t.encode()))) for k, t in items]
    number = {t: k for k, t in enumerate(sorted({t for _, c in group for t in c}))}
    vectors = [(d, Counter(dual_tree_search.terms_of(t.encode()))) for d, t in docs]
    df = Counter(t for _, c in vectors for t in c)
    n_all = sum(sum(c.values()) for _, c in vectors)
    weight = np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) for t in number])
    tree = dual_tree_search.ItemTree([(np.array([number[t] for t in c]), np.array([k * weight[number[t]] for t, k in c.items()])) for _, c in group])
    best, looked, leaves = dual_tree_search.Best(len(group), np.zeros(len(group), np.int64), np.full(len(group), dual_tree_search.NO_ID)), 0, 0
    for a in range(0, len(docs), 1000):
        some = [(d, {number[t]: k for t, k in c.items() if t in number}, sum(c.values())) for d, c in vectors[a : a + 1000]]
        own = dual_tree_search.DocTree(np.array([d for d, *_ in some]), np.array([n for *_, n in some]), [(np.array(sorted(c)), np.array([c[t] for t in sorted(c)])) for _, c, _ in some], weight, len(docs), n_all)
        looked += dual_tree_search.walk(tree, own, best)
        leaves += len(own.levels[1])
    got = Counter((group[tree.order[i]][0], k + 1, d, -s) for i, rows in enumerate(best.kept) for k, (s, d) in enumerate(rows))
    assert got == plain_ranking(docs, items)
    assert looked < 0.5 * leaves * len(items)


def plain_trie(paths):
    members = defaultdict(list)
    for c, turns in paths:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, d == len(turns)))
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, own in members.items():
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(own) - 1) * words
    least = {p: min(c for c, _ in own) for p, own in members.items()}
    sha = lambda own: hashlib.sha256(",".join(map(str, sorted(c for c, ends in own if ends))).encode()).hexdigest()
    return Counter((least[p], len(p), least[p[:-1]] if p else None, len(own), children[p], leaves[p], saved[p], sha(own)) for p, own in members.items())


def in_order(turns):
    key = lambda r, t: hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{t or ''}".encode()).hexdigest()[:32]
    by = defaultdict(list)
    for c, n, r, t in turns:
        if c is not None:
            by[c].append((n is not None, n or 0, key(r, t), (r or "", t or "")))
    return {c: [x[3] for x in sorted(own)] for c, own in by.items()}


def branched(turns):
    own = in_order(turns)
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return [(c, (own[c - c % 20][: h[c]] if c - c % 20 in own else []) + own[c][h[c] :]) for c in own]


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(12)
    out = []
    for c in range(300):
        if c % 40 == 20:
            continue  # a base that isn't there
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            out.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "hi there", "a b  c\nd", ""])))
    out += [(500 + c, t, "user", "the same turn") for c in range(200) for t in range(4)]  # copies of one conversation
    out += [(900, t, "user", f"very long {t % 7}") for t in range(700)] + [(901, t, "user", f"very long {t % 7}") for t in range(650)]
    return [*out, (3, None, None, None), (3, None, "user", None), (4, 1, "user", "hi"), (4, 1, "user", "hi"), (None, 0, "user", "x"), (1 << 60, 0, "user", "hi")]


@pytest.fixture(scope="module")
def turn_table(spark, turns):
    return spark.createDataFrame([(*t, 1, "z") for t in turns], "conv_id long, turn long, role string, text string, base int, depth string").repartition(4)


def test_prefix_trie(turns, turn_table):
    want, paths = plain_trie(branched(turns)), prefix_trie.branched_paths(turn_table)
    for shard_bytes, skeleton_bytes, least in ((1 << 20, 1 << 20, 1), (1 << 20, 1 << 20, 12), (2000, 1 << 20, 1), (1000, 4000, 40)):
        got = prefix_trie.trie(paths, shard_bytes, skeleton_bytes, least)
        assert got.columns == prefix_trie.OUT and Counter(map(tuple, got.collect())) == want
    plain = [(c, own) for c, own in in_order(turns).items()]
    assert Counter(map(tuple, prefix_trie.trie(prefix_trie.paths_of(turn_table)).collect())) == plain_trie(plain)


def test_prefix_trie_of_nothing(turn_table):
    assert prefix_trie.trie(prefix_trie.branched_paths(turn_table.limit(0))).count() == 0
    assert prefix_trie.trie(prefix_trie.branched_paths(turn_table.filter("conv_id is null"))).count() == 0


def test_skeleton_covers_splitters():
    k = [bytes([i]) * 16 for i in range(4)]
    own = prefix_trie.Skeleton([(k[0] + k[1], 5), (k[0] + k[1], 9), (k[0] + k[1] + k[2], 1), (k[3], 2)])
    assert [n.tolist() for n in own.nodes] == [[0, 1, 2], [0, 1, 2], [0, 1, 2, 3], [0, 4]]
    assert own.parent == [-1, 0, 1, 2, 0] and own.depth == [0, 1, 2, 3, 1]
    assert [own.shard(*x) for x in ((k[0], 1), (k[0] + k[1], 7), (k[0] + k[1] + k[1], 1), (k[3], 2), (k[3], 1))] == [0, 1, 2, 4, 3]
    assert prefix_trie._subtree_ends(np.array(own.depth)).tolist() == [5, 4, 4, 4, 5]


def plain_nearest(rows, top=20):
    """rows (vec_id, vector): {query: [(vec_id, score)]} over all others that take part."""
    own = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in own:
        if i % 20 == 0:
            found = sorted({(-float((x * q).sum()), j) for j, x in own if j != i and len(x) == len(q)})
            out[i] = [(j, -s) for s, j in found[:top]]
    return out


def test_collision_search_defined_cases(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.standard_normal(6).tolist()) for k in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(90)]  # one vector many times, queries among them
    rows += [rows[5], (200, [0.0] * 6), (201, None), (202, []), (220, [math.nan] + [1.0] * 5), (240, [None] + [1.0] * 5), (221, [math.inf] + [1.0] * 5), (None, rows[3][1]), (260, [1.0, 2.0]), (261, [2.0, 2.0]), (262, [-0.0, 0.0]), (280, [1e200] * 6)]
    table = spark.createDataFrame([(i, v, 1, "z") for i, v in rows], "vec_id long, embedding array<double>, ids int, block string").repartition(3)
    want = plain_nearest(rows)
    got = defaultdict(list)
    for r in collision_search.search(table, F.col("vec_id") % 20 == 0, block=50).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i, x in want.items() if x}
    hits = total = 0
    for i, found in got.items():
        assert [k for k, *_ in found] == list(range(1, len(want[i]) + 1)) and i not in {j for _, j, _ in found}
        assert [(-s, j) for _, j, s in found] == sorted((-s, j) for _, j, s in found)
        hits += len({j for _, j, _ in found} & {j for j, _ in want[i]})
        total += len(want[i])
    assert hits >= 0.95 * total
    alike = [j for _, j, _ in got[100] if j == 0 or 100 < j < 190]
    assert len(alike) > 5 and alike == [0, *range(101, 190)][: len(alike)]  # equal vectors by id
    assert got[260] == [(1, 261, 6.0)]
    assert collision_search.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert collision_search.search(table.filter("vec_id = 201"), F.lit(True)).count() == 0


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_collision_search_recall(spread):
    """Against all inner products, with norms all alike and far apart; less than half of the vectors are verified where norms are alike."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((6000, 64))
    x *= np.exp(spread * rng.standard_normal((6000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    norm = float(np.sqrt((x * x).sum(axis=1)).max())
    own = collision_search.Block(x, np.arange(6000), 1.0, norm, 21)
    hits = verified = 0
    for i in range(0, 6000, 200):
        places, scores, n = own.nearest(x[i], 21)
        want = np.sort(x @ x[i])[::-1][:21]
        assert np.allclose(scores, x[places] @ x[i]) and (np.diff(scores) <= 0).all()
        hits += int((scores >= want[-1] - 1e-12).sum())
        verified += n
    assert hits >= 0.9 * 30 * 21
    assert spread or verified < 0.5 * 30 * 6000


PLAIN = re.compile(
    r"""(?:token|key|secret|passw|pwd|auth(?!or)|credential|bearer)[\w.\-]*["']?\s*(?::=|=>|[=:](?!=))\s*(?:bearer\s+)?(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>,;&]+))|\bbearer\s+["']?([A-Za-z0-9+/_.~\-]+=*)""", re.I
)


def test_assigned_values_equal_one_plain_pattern():
    rng = random.Random(21)
    bits = ["key", "token", "api_key", "Author", "auth", "passwd", "bearer ", "Bearer", " ", "  ", "\n", "=", ":", ":=", "=>", "'", '"', "abc", "x1Y2", ",", ";", "a.b-c", "=="]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        want, end = [], 0
        for m in PLAIN.finditer(text):
            want.append(m.span(m.lastindex))
        assert secret_scan.assigned(text) == want, (text, secret_scan.assigned(text), want)


@pytest.mark.parametrize("unit", ["key", "key=", 'key="', "key ", "key: ' ", "bearer ", "=", "a:b ", "pwd\n="])
def test_secrets_of_long_texts_take_linear_time(unit):
    text = unit * (1_000_000 // len(unit))
    began = time.time()
    assert all(a < b for a, b in secret_scan.candidates(text))
    assert time.time() - began < 5


def test_quality_rules_beside_columns_of_any_name(spark):
    """Columns named like those made on the way, or like the counts in another case, neither clash nor change."""
    text = "the cat sat on the mat and the dog ran off with it " * 3
    plain = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    odd = plain.selectExpr("*", "7 as _w", "8 as _g", "9 as _row", "'x' as _lines", "10 as `a.b`", "11 as N_Words", "12 as _R")
    got, want = quality_rules.measures(odd), quality_rules.measures(plain)
    same = want.columns[2:]
    assert got.select("doc_id", *same).orderBy("doc_id").collect() == want.select("doc_id", *same).orderBy("doc_id").collect()
    assert [tuple(r) for r in got.select("_w", "_g", "_row", "_lines", "`a.b`", "_R").distinct().collect()] == [(7, 8, 9, "x", 10, 12)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distance_by_bits_equals_the_table():
    rng = random.Random(17)
    for _ in range(4000):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randint(0, 12)))
        b = "".join(rng.choice("abé😀") for _ in range(rng.randint(0, 12))) if rng.random() < 0.4 else "".join(rng.choice("abc") if rng.random() < 0.2 else c for c in a)
        d = edit_distance(a, b)
        assert [fuzzy_lines.within(a, b, k) for k in range(14)] == [d <= k for k in range(14)], (a, b, d)


def test_replaced_words_bound_the_edit_distance():
    rng = random.Random(17)
    told = 0
    for _ in range(3000):
        a = [rng.choice(("a", "bc", "def", "ghij")) for _ in range(rng.randint(0, 9))]
        b = [w for w in a if rng.random() < 0.9]
        for _ in range(rng.randint(0, 2)):
            b.insert(rng.randint(0, len(b)), rng.choice(("a", "xyz", "q")))
        most = rng.randint(0, 9)
        if fuzzy_lines.replaced(" ".join(a), " ".join(b), most):
            told += 1
            assert fuzzy_lines.within(" ".join(a), " ".join(b), most), (a, b, most)
    assert told > 1000 and not fuzzy_lines.replaced("a b", "c d", 1) and fuzzy_lines.replaced("", "", 0)


def test_candidates_of_small_and_large_groups(monkeypatch):
    """Many groups at once, small and large ones, give what all pairs give."""
    rng = np.random.default_rng(3)
    size = np.array([1, 5, 2, 90, 1, 30, 64, 65, 3])
    first = np.cumsum(size) - size
    base = rng.integers(0, 1 << 63, (9, 2), dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (size.sum(), 2, 4), dtype=np.uint64)
    words = np.repeat(base, size, axis=0) ^ np.bitwise_xor.reduce(flips, axis=2) ^ (flips[:, :, 0] * (rng.random((size.sum(), 2)) < 0.3))
    label = rng.integers(0, 4, size.sum())
    monkeypatch.setattr(fuzzy_lines, "TILE", 16)
    bits = lambda a, b: sum(bin(int(x)).count("1") for x in words[a] ^ words[b])
    want = {(a, b, bits(a, b)) for f, n in zip(first.tolist(), size.tolist()) for a in range(f, f + n) for b in range(f, a) if bits(a, b) <= fuzzy_lines.NEAR}
    for differ in ([], [label]):
        got = [tuple(map(int, x)) for found in fuzzy_lines.near(words, first, size, differ) for x in zip(*found)]
        assert len(got) == len(set(got)) and set(got) == {w for w in want if not differ or label[w[0]] != label[w[1]]}
    by: dict = {}
    for a, b, d in want:
        by.setdefault(a, []).append((d, b))
    for found in fuzzy_lines.near(words, first, size, []):
        a, b, more = fuzzy_lines.nearest(*found)
        for k in np.unique(found[0]).tolist():
            kept = {y for _, y in sorted(by[k])[: fuzzy_lines.NEAREST]} | {min(y for _, y in by[k])}
            assert set(b[a == k].tolist()) == kept and (k in more) == (len(kept) < len(by[k]))
