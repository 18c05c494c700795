"""Each operator against brute force on a small table with nulls, empty, short and long texts, copies, repeated rows and an extra column."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireworks.llm import bpe_words, common, components, exact_dedup, fuzzy_lines, hilbert_packing, jaccard_join, preference_format, quality_rules, run_length_index, secret_scan, shingles, token_files

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def texts():
    rng = random.Random(5)
    words = ["the", "of", "and", "Größe", "l'été", "word.", "end,", "x1", "42", "don't", "«oui»", "naïve"] + ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [say(rng.randint(20, 120)) for _ in range(12)]
    shared = say(30)
    out = [None, "", " \n\t", "one", "two words", "A B\tC\nD  E", "a b c d e", "x" * 200, "é" * 120, "\x00\x1codd\x85 text", "<|endoftext|> and <|startoftext|>x"]
    for b in base:
        near = b.split(" ")
        near[len(near) // 2] = "changed"
        out += [b, b, b.replace(" ", "\n", 3), " ".join(near), say(15) + " " + shared + " " + say(9), b + "\n" + "Same line here, 12 times\n" * 3 + "same line here, 13 times"]
    out += [say(6000), "the end. " * 700, 'key token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ok', "number 4761598977407687 here"]
    return out


@pytest.fixture(scope="module")
def rows():
    own = [(i * 3 % 1009, t) for i, t in enumerate(texts())]
    return [*own, own[15], own[1]]  # two rows come twice


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", None if d % 5 == 0 else "src", len(t or ""), "mine") for d, t in rows], SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert Counter(got) == Counter(want)


def test_exact_dedup(docs, none, rows):
    norm = [(d, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for d, t in rows]
    by = defaultdict(list)
    for d, t in norm:
        by[t].append(d)
    want = [(d, min(by[t]), len(by[t]), d == min(by[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in norm]
    same(map(tuple, exact_dedup.groups_of(docs).collect()), want)
    same(map(tuple, exact_dedup.groups_of(docs, range_bytes=2000, least_hot=1).collect()), want)  # copies dealt over ranges
    assert exact_dedup.groups_of(none).count() == 0 and exact_dedup.filter_documents(none).count() == 0
    for left in (exact_dedup.filter_documents(docs), exact_dedup.filter_documents(docs, range_bytes=2000, least_hot=1)):
        assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(map(min, by.values()))
    clash = docs.selectExpr("*", "1 as row", "2 as h", "3 as hot", "4 as norm", "5 as at", "6 as salt")
    assert exact_dedup.filter_documents(clash).columns == clash.columns


def test_exact_dedup_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a "), (None, "a"), (2, "a"), (7, "a"), (7, "a"), (None, None), (None, "")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.groups_of(docs).collect())
    assert got == {(None, 2, 5, False): 2, (None, None, 1, True): 1, (2, 2, 5, True): 1, (7, 2, 5, False): 2, (None, None, 2, True): 2}
    assert Counter((r["doc_id"], r["text"] or "") for r in exact_dedup.filter_documents(docs).collect()) == {(2, "a"): 1, (None, "a "): 1, (None, ""): 1}


def test_quality_rules(docs, none, rows):
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.apply_rules(docs.select("doc_id", "text")).collect()}
    want = set()
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want.add((d, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)))
    assert got == want
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count() and quality_rules.filter_documents(none).count() == 0


def test_bpe_words(docs, none, rows):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    enc = bpe_words.encode(docs, path)
    same((tuple(r) for r in enc.drop("ids", "decoded").collect()), want)
    assert bpe_words.encode(none, path).count() == 0
    few = docs.sparkSession.createDataFrame([(1, [320, 49407, 531]), (2, [])], "doc_id long, ids array<int>")
    assert {r[0]: r[1] for r in bpe_words.decode(few, path).collect()} == {1: tok.decode([320, 49407, 531], skip_special_tokens=False), 2: ""}


def test_bpe_words_of_many_buckets(docs, rows, monkeypatch):
    """The ids that a part uses are as many rows as it has distinct ids, however many buckets its words are dealt over."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok, spark = Tokenizer.from_file(path), docs.sparkSession
    made = spark.createDataFrame([(p, b, 0, common.pack(b"", b"", np.array([7, 300, 49000 + p, b], "<u2").tobytes())) for b in range(5) for p in (0, 1, 2)], bpe_words._ROW_DDL)
    # Counted as the tasks make them: nothing after them takes away what is double.
    same(map(tuple, bpe_words.used_ids(made, 3).collect()), [(p, i) for p in (0, 1, 2) for i in (0, 1, 2, 3, 4, 7, 300, 49000 + p)])
    monkeypatch.setattr(bpe_words, "BUCKET_BYTES", 500)
    want = [(d, len(ids), tok.decode(ids, skip_special_tokens=False)) for d, t in rows for ids in [tok.encode(t or "", add_special_tokens=False).ids]]
    same(map(tuple, bpe_words.encode(docs, path).select("doc_id", "n_tokens", "decoded").collect()), want)


def test_token_files(spark, docs, none, rows):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for source, expected in ((docs, want), (none, [])):
        dictionary = token_files.train_dictionary(source, path, 1)
        to = common.scratch(spark, "ids")
        token_files.write_ids(source, path, 1, to, dictionary)
        same(map(tuple, token_files.read_ids(spark, to, dictionary).collect()), expected)
        if expected:
            raw = bytes(spark.read.format("binaryFile").load(to).first()["content"])
            one = token_files.IdFile(raw, dictionary)
            k = len(one.doc_ids) // 2
            assert len(one.ids(k)) == one.counts[k] and one.ids(k)[-1] == 1
            with pytest.raises(ValueError):
                token_files.IdFile(raw, b"another")
            with pytest.raises(ValueError):
                token_files.IdFile(raw[:-3], dictionary)


def test_the_text_writer_carries_any_bytes(spark):
    """Token files are bytes in a string column; Spark must write them as they are."""
    raw = bytes(range(256)) + b"\xff\xfe\x00\xc3\n\r\n" + bytes(range(255, -1, -1))
    to = common.scratch(spark, "bytes")
    df = spark.createDataFrame([(bytearray(raw),)], "file binary").select(F.col("file").cast("string").alias("value"))
    df.write.option("lineSep", token_files.END).text(to)
    assert bytes(spark.read.format("binaryFile").load(to).first()["content"]) == raw + token_files.END.encode()


def test_packs_are_numbered_alike_and_bounded(spark, docs, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([3] * 40, pa.int32()), pa.array(range(40)), pa.array(["x" * (k % 7) * 10 for k in range(40)])], names=["partition", "doc_id", "text"])
    monkeypatch.setattr(common, "PART_BYTES", 300)
    monkeypatch.setattr(common, "PACK_BYTES", 100)
    packs = list(common.packs(iter([batch.slice(0, 17), batch.slice(17)]), 5))
    assert [d for _, _, ids, _ in packs for d in ids.to_pylist()] == list(range(40)) and len({p for p, *_ in packs}) > 2
    assert [p % 5 for p, *_ in packs] == [3] * len(packs) and [n for _, n, *_ in packs] == list(range(len(packs)))
    assert all(sum(map(len, t.to_pylist())) <= 100 for *_, t in packs)


def test_hilbert_packing(docs, none, rows):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = hilbert_packing.pack(docs, path, 0, length=64, keep_ids=True).collect()
    have, want = Counter(), Counter()
    for d, t in rows:
        want[d] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    ids = {d: np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for d, t in rows}
    seqs = defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and bytes(r.ids) == part.tobytes()
        have[r.doc_id] += r.length
        seqs[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert hilbert_packing.pack(none, path, 0).count() == 0
    grid = np.array([(x, y) for x in range(8) for y in range(8)])
    walk = grid[np.argsort(hilbert_packing.hilbert(grid, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()  # each step goes to a neighbour


def test_encoders_equal_the_tokenizer():
    from tokenizers import Tokenizer

    from quireworks.llm import tokens

    rng = random.Random(8)
    plain = list("aBé .,!?'_\n12$#ß(")
    odd = [*map(chr, range(0x80, 0x250)), *"\u0301\u0308\u0323\u0331", "İ", "ſ", "Σ", "ς", "ẞ", "中", "“", "”", "’", "😀", "\u200d", "\u2028", "\u3000", "\x1c", "\x00", "\x01", "<|", "<|endoftext|>", "  ", "\r\n", ". ", ", ", " İ. c", "İ, "]
    made = ["".join(rng.choice(plain) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    made += ["".join(rng.choice(plain if rng.random() < 0.5 else odd) for _ in range(rng.randint(0, 14))) for _ in range(60000)]
    made += ["a . b , c\n.\n,", "Hello!!! it's x_y_. foo_, ÜBER&&& (a) 'tis", "Ab\nCd\nÜx", "can't!'s a'!b", "x²! ½, é\u0301!! word", "“İ, c", "’ İ. c", "中 İ, c", "’ CAMİ, ve", "H\u0331a h\u0331A"]
    for kind, name in ((tokens.ByteEncoder, "byte_bpe_50k.json"), (tokens.WordEncoder, "word_bpe_49k.json")):
        tok, own = Tokenizer.from_file(P.path(name)), kind(P.path(name))
        for t, ids, want in zip(made, own.encode(made), tok.encode_batch(made, add_special_tokens=False)):
            assert np.frombuffer(ids, "<u2").tolist() == want.ids, t


def test_encoders_keep_to_their_table(monkeypatch):
    """A table that is emptied again and again gives the same ids."""
    from quireworks.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_BYTES", 5000)
    monkeypatch.setattr(tokens, "PORTION_BYTES", 300)
    own = tokens.WordEncoder(P.path("word_bpe_49k.json"))
    some = [t or "" for t in texts()]
    assert own.encode(some) == own._encode_each(some)


def test_run_length_index(docs, none, rows):
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    want = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        left = bytes(x for x, g in zip(b, gone) if not g)
        want.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    assert sum(w[2] for w in want) > 1000
    same((tuple(r) for r in run_length_index.dedup(docs).drop("kept").collect()), want)
    assert run_length_index.dedup(none).count() == 0


def test_hot_anchors_give_the_same(docs):
    plain = [tuple(r) for r in run_length_index.dedup(docs, keep_bytes=False).collect()]
    same((tuple(r) for r in run_length_index.dedup(docs, keep_bytes=False, hot_docs=3).collect()), plain)


def test_run_length_index_of_null_ids(spark):
    one, two = "x1 " * 40, "".join(map(str, range(60)))
    docs = spark.createDataFrame([(None, one + two), (None, one), (3, two), (4, "y" + two), (4, two + "z"), (5, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_bytes"]): (r["n_removed"], r["n_spans"]) for r in run_length_index.dedup(docs).collect()}
    n = len(two)
    assert got == {(None, 120 + n): (0, 0), (None, 120): (0, 0), (3, n): (0, 0), (4, n + 1): (n, 1), (5, 0): (0, 0)}


def as_matrix(passages):
    out = np.zeros((len(passages), run_length_index.PASSAGE), np.uint8)
    for row, p in zip(out, passages):
        row[: len(p)] = np.frombuffer(p, np.uint8)
    return out, np.array([len(p) for p in passages])


def repetitive(rng, n):
    """Passages cut from few strings with few letters, with single bytes changed."""
    base = [rng.integers(97, 99, 120, dtype=np.uint8) for _ in range(4)]
    out = {b"ab" * 37 + b"x", b"a" * 60, b"a" * 51, b"a" * 75}
    while len(out) < n:
        x = base[rng.integers(4)].copy()
        for _ in range(rng.integers(0, 4)):
            x[rng.integers(120)] = rng.integers(97, 102)
        a = rng.integers(0, 60)
        out.add(bytes(x[a : a + rng.integers(50, 76)]))
    return list(out)


def test_matches_tell_what_a_smaller_document_holds():
    rng = np.random.default_rng(2)
    for n in (1, 8, 120):
        inside, asked = repetitive(rng, n + 4), repetitive(rng, n + 4)
        docs, mine = rng.integers(0, 50, len(inside)), rng.integers(0, 50, len(asked))
        index = run_length_index.RunLengthIndex(*as_matrix(inside), docs)
        assert len(index.run_start) < sum(map(len, inside))  # compressed
        assert (index.text[index.end_sample - 1] == index.run_symbol).all() and (index.text[index.start_sample - 1] == index.run_symbol).all()
        least = {}
        for p, d in zip(inside, docs.tolist()):
            for i in range(len(p) - 49):
                least[p[i : i + 50]] = min(least.get(p[i : i + 50], d), d)
        want = [sum((least.get(p[i : i + 50], 99) < d) << i for i in range(len(p) - 49)) for p, d in zip(asked, mine.tolist())]
        assert index.matches(*as_matrix(asked), mine).tolist() == want and any(want)


def test_halves_of_a_group_miss_nothing():
    rng = np.random.default_rng(3)
    passages = repetitive(rng, 150)
    docs, group = rng.integers(0, 40, len(passages)), rng.integers(0, 5, len(passages))
    got = run_length_index.smaller_elsewhere(*as_matrix(passages), docs, group).tolist()
    for k, (p, d, g) in enumerate(zip(passages, docs, group)):
        for i in range(len(p) - 49):
            others = [e for q, e, f in zip(passages, docs, group) if p[i : i + 50] in q and e < d]
            own = [e for q, e, f in zip(passages, docs, group) if p[i : i + 50] in q and e < d and f == g]
            assert (got[k] >> i & 1 and others) or (not got[k] >> i & 1 and not own)


def test_each_string_lies_in_one_passage(monkeypatch):
    rng = np.random.default_rng(7)
    texts = [bytes(rng.integers(97, 100, rng.integers(0, 400), dtype=np.uint8)) for _ in range(200)] + [b"x" * 300, b"ab" * 200, b"q" * 49, b""]
    texts += [unit * 30 + bytes(rng.integers(97, 123, 90, dtype=np.uint8)) for unit in (b"-", b"ha ", b"x12; ") for _ in range(60)]  # repeats that end
    flat, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    known = np.unique(np.concatenate([run_length_index.anchors(t)[0] for t in texts]))
    want = np.zeros(len(flat), int)
    for t, e in zip(texts, ends.tolist()):
        want[e - len(t) : max(e - len(t), e - 49)] = 1
    for chunk in (run_length_index.CHUNK, 130):  # the same where a text is cut into chunks
        monkeypatch.setattr(run_length_index, "CHUNK", chunk)
        seen = run_length_index._Passages(3)
        seen.learn(common.pack(run_length_index._planes(known), np.zeros(len(known), "u1").tobytes()))
        seen.done()
        times, named = np.zeros(len(flat), int), {}
        for found in seen.of(flat, ends, np.zeros(len(ends), bool)):
            for start, n, place, name, _, _, of in zip(*(x.tolist() for x in found)):
                assert ends[of] - len(texts[of]) <= start and start + n <= ends[of] and 50 <= n <= 80 and 0 <= place <= n - 20
                times[start : start + n - 49] += 1
                assert named.setdefault(name, (flat[start : start + n].tobytes(), place)) == (flat[start : start + n].tobytes(), place)
        assert (times == want).all()


def test_passages_with_unlike_surroundings_are_not_indexed(monkeypatch):
    assert all(any(a <= left and b <= 30 - left for a, b in run_length_index.STRETCHES) for left in range(31))  # 50 bytes around an anchor cover a stretch
    rng = np.random.default_rng(8)
    anchor, other = bytes(rng.integers(97, 123, 20, dtype=np.uint8)), bytes(rng.integers(97, 123, 80, dtype=np.uint8))
    passages, place = [], []
    for k in range(31):  # these share exactly 50 bytes with one passage, at each place
        whole = bytes(rng.integers(65, 91, 30, dtype=np.uint8)) + anchor + bytes(rng.integers(65, 91, 30, dtype=np.uint8))
        passages += [whole, b"0" * k + whole[k : k + 50] + b"1" * (30 - k)]
        place += [30, 30]
    for k in range(200):  # and these share the anchor only, or 49 bytes
        whole = bytes(rng.integers(65, 91, 30, dtype=np.uint8)) + anchor + bytes(rng.integers(65, 91, 30, dtype=np.uint8))
        passages.append(whole[30 - k % 31 :])
        place.append(k % 31)
    passages, place = [*passages, other], np.array([*place, 5])
    used = []
    index = run_length_index.RunLengthIndex
    monkeypatch.setattr(run_length_index, "RunLengthIndex", lambda m, n, d: used.append(len(n)) or index(m, n, d))
    text, lengths = as_matrix(passages)
    docs = np.arange(len(passages))
    hashed, keys = run_length_index._around(text, lengths, place)
    assert len(set(hashed.tolist())) == 2
    got = run_length_index.smaller_elsewhere(text, lengths, docs, np.unique(hashed, return_inverse=True)[1], keys).tolist()
    assert got == [0 if k % 2 == 0 else 1 << k // 2 for k in range(62)] + [0] * 201
    assert max(used) <= 62


def test_anchors_cover_and_agree_wherever_a_string_stands(monkeypatch):
    rng = np.random.default_rng(5)
    shared = bytes(rng.integers(97, 105, 400, dtype=np.uint8))
    one, two = bytes(rng.integers(97, 105, 900, dtype=np.uint8)) + shared + b"xyz" * 9, b"q" * 60 + shared + bytes(rng.integers(97, 105, 700, dtype=np.uint8))
    whole = [run_length_index.anchors(t) for t in (one, two)]
    assert all((np.diff(np.concatenate([[-1], at, [len(t) - run_length_index.ANCHOR + 1]])) <= run_length_index.WINDOW).all() for t, (_, at) in zip((one, two), whole))
    a, b = ({at - t.index(shared) for at in found[1].tolist() if 25 <= at - t.index(shared) <= 350} for t, found in zip((one, two), whole))
    assert a == b and a
    monkeypatch.setattr(run_length_index, "CHUNK", 130)  # cut into chunks, a long text has the same anchors
    for t, (h, at) in zip((one, two), whole):
        again = run_length_index.anchors(t)
        assert again[0].tolist() == h.tolist() and again[1].tolist() == at.tolist()


def test_jaccard_join(docs, none, rows):
    sets = {}
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    same(map(tuple, jaccard_join.components_of(docs).collect()), [(d, len(sets[d]), find(d)) for d, _ in rows])
    assert jaccard_join.components_of(none).count() == 0
    old = jaccard_join.PIECE, jaccard_join.FREQUENT, jaccard_join.STAR_ROUNDS, jaccard_join.SMALL
    jaccard_join.PIECE, jaccard_join.FREQUENT, jaccard_join.STAR_ROUNDS, jaccard_join.SMALL = 2, 1, 1, 1  # lists in pieces, all hashes frequent
    try:
        same(map(tuple, jaccard_join.components_of(docs).collect()), [(d, len(sets[d]), find(d)) for d, _ in rows])
    finally:
        jaccard_join.PIECE, jaccard_join.FREQUENT, jaccard_join.STAR_ROUNDS, jaccard_join.SMALL = old
    left = jaccard_join.keep_one(docs)
    assert left.columns == docs.columns and left.select("doc_id").distinct().count() == len({find(d) for d in sets})


def test_pipeline_drops_copies_of_five_words_and_four_fifths(spark):
    import corpus_pipeline

    rng = random.Random(12)
    rows = []
    for k in range(30):
        w = [f"{k}w{i}" for i in range(rng.randint(60, 140))]
        rows += [" ".join(w), " ".join(w[: len(w) - rng.randint(1, 30)] + [f"{k}new"])]
    sets = [set(zip(*(t.split(" ")[i:] for i in range(n)))) for n in (4, 5) for t in rows]
    share = lambda a, b: len(a & b) / len(a | b)
    fours, fives = ([share(at[2 * k], at[2 * k + 1]) for k in range(30)] for at in (sets[:60], sets[60:]))
    assert any(x >= 0.8 and y < 0.85 for x, y in zip(fives, fours)) and any(x < 0.8 for x in fives)
    docs = spark.createDataFrame([(i, t, "en", "src", len(t), "") for i, t in enumerate(rows)], SCHEMA)
    want = {i for i in range(60) if i % 2 == 0 or fives[i // 2] < 0.8}
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()} == want


def test_pipeline_against_plain_python(spark, tmp_path):
    """Nulls, empty texts, exact and near copies, repeated rows and secrets through all stages, each held against a plain version."""
    import duckdb
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(21)
    common = "the of and to in is that it was for on with as his they be at one have this".split()
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    say = lambda n: "\n".join(" ".join(rng.choice(common if rng.random() < 0.45 else words) for _ in range(12)) + "." for _ in range(n // 12))
    base = [say(rng.randint(60, 240)) for _ in range(14)]
    texts = [None, "", " \n", "one two", "# $ % " * 60, "same line of it\n" * 40]
    for b in base:
        w = b.split(" ")
        w[len(w) // 2] = "changed"
        texts += [b, b.replace(" ", "  ", 4), " ".join(w)]
    secret = rng.randbytes(20).hex()
    texts += [say(120) + f'\ntoken = "{secret}" and more of the words', say(120) + "\nnumber 4761598977407687 is it"]
    rows = [(i * 7 % 1009, x) for i, x in enumerate(texts)]
    rows += [rows[6], rows[0], (None, base[3] + " and then some"), (None, None)]
    table = spark.createDataFrame([(d, x, "en", "src", len(x or "")) for d, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(k, x) for k, (_, x) in enumerate(rows)])  # by row: doc_ids repeat
    kept = [rows[k] for k, *_, ok in con.execute(f"SELECT doc_id, kept FROM ({quality_rules.ORACLE_SQL})").fetchall() if ok]
    assert 20 < len(kept) < len(rows)
    first = {}
    for d, x in sorted(kept, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", x), (d, x))
    left = list(first.values())
    sets = {}
    for d, x in left:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))
        sets[d] = set(zip(*(w[i:] for i in range(5))))
    stay = [(d, x) for d, x in left if d is None or not any(e is not None and e < d and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]) for e in sets)]
    assert len(left) < len(kept) and len(stay) < len(left) and any(d is None for d, _ in stay)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter({d: len(tok.encode(x.replace(secret, "<secret>"), add_special_tokens=False).ids) + 1 for d, x in stay})
    got, tokens = Counter(), {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] += r["length"]
        tokens[r["doc_id"]] = r["doc_tokens"]
    assert got == want == Counter(tokens)
    none = tmp_path / "none"
    table.limit(0).write.parquet(str(none / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(none)).count() == 0


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(200) < rng.choice([0.85, 0.97])], rng.integers(0, 1 << 62, rng.integers(0, 20), dtype=np.uint64)])) for _ in range(150)]
    rows = [(i, len(s), jaccard_join.bitmap(s), i) for i, s in enumerate(sets)]
    got = {tuple(sorted(p)) for p in jaccard_join.SignatureTree(rows).pairs()}
    for i, a in enumerate(sets):
        for j in range(i):
            if jaccard_join.enough(len(np.intersect1d(a, sets[j])), len(a), len(sets[j])):
                assert (j, i) in got


def test_trees_by_width_lose_no_pair():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 600, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.choice([20, 30, 33, 60, 64, 66, 120, 128, 140, 500, 600])], rng.integers(0, 1 << 62, rng.integers(0, 5), dtype=np.uint64)])) for _ in range(150)]
    rows = [(i, len(s), jaccard_join.bitmap(s), i) for i, s in enumerate(sets)]
    assert len({len(r[2]) for r in rows}) > 3
    got = [tuple(sorted(p)) for p in jaccard_join.list_pairs(rows)]
    assert len(got) == len(set(got))
    want = {(j, i) for i, a in enumerate(sets) for j in range(i) if jaccard_join.enough(len(np.intersect1d(a, sets[j])), len(a), len(sets[j]))}
    assert want and want <= set(got)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def alike(a, b):
    return edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)


def norm_line(line):
    return re.sub("[ \t-\r]+", " ", line).strip(" ").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"))


def lines_left(rows, linked):
    """(doc_id, lines with a word, removed, digest) of each row, where `linked` tells which normalised lines are."""
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate((t or "").split("\n")):
            if norm_line(line):
                first.setdefault(norm_line(line), (d, k))
    lines = list(first)
    root = list(range(len(lines)))
    for i, x in enumerate(lines):
        for j in range(i):
            if root[i] != root[j] and linked(x, lines[j]):
                root = [root[j] if r == root[i] else r for r in root]
    keep = {}
    for x, r in zip(lines, root):
        keep[r] = min(keep.get(r, first[x]), first[x])
    keep = {x: keep[r] for x, r in zip(lines, root)}
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        norms = [norm_line(x) for x in parts]
        left = [x for k, (x, n) in enumerate(zip(parts, norms)) if not n or keep[n] == (d, k)]
        out.append((d, sum(map(bool, norms)), len(parts) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


def test_fuzzy_lines(docs, none, rows):
    import pyarrow as pa

    def near(a, b):
        x, y = fuzzy_lines.simhashes(pa.array([a, b]))
        return (x == y).any() and np.bitwise_count(x ^ y).sum() <= fuzzy_lines.NEAR and alike(a, b)

    same((tuple(r) for r in fuzzy_lines.dedup_lines(docs, keep_text=False).collect()), lines_left(rows, near))
    assert fuzzy_lines.dedup_lines(none).count() == 0


def test_fuzzy_lines_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "Same line\nown"), (3, "same  LINE\n\n7 here"), (3, "same  LINE\n\n7 here"), (4, None), (5, "8 here")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_lines"], r["kept"]) for r in fuzzy_lines.dedup_lines(docs).collect())
    assert got == {(None, 2, "own"): 1, (3, 2, "same  LINE\n\n7 here"): 2, (4, 0, ""): 1, (5, 1, ""): 1}


def varied(rng, share, n=60):
    """Lines of about 40 words and a copy of each with a share of the words changed."""
    words = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    out = []
    for _ in range(n):
        line = [rng.choice(words) for _ in range(rng.randint(32, 48))]
        new = list(line)
        for k in rng.sample(range(len(new)), max(1, round(share * len(new)))):
            new[k] = rng.choice(words)
        out.append((" ".join(line), " ".join(new)))
    return out


def test_fuzzy_lines_finds_lines_that_differ_in_few_words(spark):
    """Recall against edit similarity alone, which doesn't know the operator's hashes."""
    pairs = varied(random.Random(11), 0.025, 400)
    assert all(alike(*p) for p in pairs)
    docs = spark.createDataFrame([(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)], "doc_id long, text string")
    got = {r["doc_id"] for r in fuzzy_lines.dedup_lines(docs).collect() if r["n_removed"]}
    assert all(d % 2 for d in got) and len(got) >= 0.9 * len(pairs)


def test_fuzzy_lines_joins_a_large_group_in_pieces(spark, monkeypatch):
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    lines = sorted({" ".join([*words[:k], "x" * rng.randint(1, 5), *words[k + 1 :]]) for k in range(60) for _ in range(3)})
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    plain = {tuple(r) for r in fuzzy_lines.dedup_lines(docs).collect()}
    monkeypatch.setattr(fuzzy_lines, "PIECE", 20)
    monkeypatch.setattr(fuzzy_lines, "TILE", 7)
    assert {tuple(r) for r in fuzzy_lines.dedup_lines(docs).collect()} == plain and sum(r[2] for r in plain) >= 0.9 * len(lines)


def test_fuzzy_lines_reads_its_input_once(spark, rows):
    """Each further reading of the documents cost CPU time: they were read up to five times."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(4, 9))) for _ in range(40)]
    near = [(10_000 + k, " ".join([*words[:k], "x", *words[k + 1 :]])) for k in range(40)]
    docs = spark.createDataFrame([(d, t) for d, t, *_ in rows] + near, "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    got = fuzzy_lines.dedup_lines(docs, keep_text=False).collect()
    assert len(got) == read.value == len(rows) + len(near) and sum(r["n_removed"] for r in got if (r["doc_id"] or 0) >= 10_000) > 30


def test_simhash_is_the_majority_of_distinct_words():
    import pyarrow as pa

    from quireworks.llm.shingles import word_hashes

    rng = random.Random(23)
    lines = ["", "one", "one two two", "", " ".join(f"w{k % 300}" for k in range(700)), *(" ".join(f"y{k}" for k in range(n)) for n in (254, 255, 256, 257)), "é ü ß é"]
    lines += [" ".join(str(rng.randint(0, 60)) for _ in range(rng.randint(1, 90))) for _ in range(300)]
    got = fuzzy_lines.simhashes(pa.array(lines))
    for line, value in zip(lines, got):
        h = word_hashes(" ".join(sorted(set(line.split()))).encode())
        bits = np.concatenate([np.unpackbits((h * m ^ (h >> np.uint64(29))).view(np.uint8).reshape(-1, 8), axis=1) for m in fuzzy_lines._MIX], axis=1)[:, : 16 * fuzzy_lines.BLOCKS]
        assert np.packbits(2 * bits.sum(0, dtype=int) > len(h)).view(">u2").tolist() == value.tolist(), line


def test_second_round_of_fuzzy_lines_needs_no_other_texts(spark, monkeypatch):
    """What the first round leaves out is named by it, with several pieces of a block value, too."""
    rng = np.random.default_rng(9)
    low = rng.integers(0, 1 << 32, 120)
    high = np.int64(77) | np.left_shift(np.bitwise_or.reduce(np.left_shift(1, rng.integers(0, 47, (120, 5))), axis=1), 16)
    lines = spark.createDataFrame([(int(k), int(h), int(w & 0xFF)) for k, h, w in zip(rng.permutation(120), high, low)], "lid long, high long, low long")
    for piece in (4096, 25):
        monkeypatch.setattr(fuzzy_lines, "PIECE", piece)
        blocks = fuzzy_lines.blocks_of(lines).filter("key = 77")
        first = fuzzy_lines.candidates(blocks).collect()
        assert {r["key"] for r in first} == {None, 77}
        asked = {x for r in first for x in (r["u"], r["v"]) if r["key"] is None}
        all_of = {(r["u"], r["v"]) for r in fuzzy_lines.candidates(blocks, spark.createDataFrame([], "lid long, label long")).collect()}
        bits = {r["lid"]: r["high"] << 32 | r["low"] for r in lines.collect()}
        assert all_of == {(u, v) for u in bits for v in bits if u < v and bin(bits[u] ^ bits[v]).count("1") <= fuzzy_lines.NEAR}
        assert {x for p in all_of for x in p} == asked and {(r["u"], r["v"]) for r in first if r["key"] is None and r["u"] != r["v"]} < all_of


def test_preference_format(spark):
    turns = [(1, 0, 10, 0, "user", "hi"), (1, 0, 10, 1, "assistant", "yes"), (1, 1, 11, 1, "assistant", "no"), (1, 1, 11, 0, "user", "hi"), (2, 0, 12, 0, None, None), (3, 0, 14, 0, "user", "a"), (3, 1, 15, 0, "user", "a")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "pair_id long, side int, conv_id long, turn long, role string, text string, prompt string")
    got = {r["pair_id"]: r for r in preference_format.format_pairs(df).collect()}
    one = got[1]
    assert one["prompt"] == "<|user|>\nhi\n" and one["chosen"] == "<|assistant|>\nyes\n" and one["rejected"] == "<|assistant|>\nno\n"
    assert [one["chosen"][s["start"] : s["end"]] for s in one["chosen_mask"]] == ["yes"]
    assert got[2]["n_chosen_turns"] == 1 and got[2]["rejected"] == "" and got[2]["n_rejected_turns"] == 0
    assert got[3]["n_prompt_turns"] == 1 and got[3]["chosen"] == "" and got[3]["rejected"] == ""
    assert preference_format.format_pairs(df.limit(0)).count() == 0


def test_secret_scan(spark, docs, none):
    rng = random.Random(9)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    made = [(i, f'some words token = "{hexa(40)}" go on' if i % 2 else f"number {rng.randint(10**15, 10**16)} stands here", "en", "src", 1, "") for i in range(400)]
    table = spark.createDataFrame(made, SCHEMA)
    forest = secret_scan.fitted(table.filter("doc_id < 200"))
    held = secret_scan.scan(table.filter("doc_id >= 200"), forest).collect()
    right = sum(r["is_secret"] == bool(r["doc_id"] % 2) for r in held)
    assert len(held) == 200 and right >= 198  # held-out accuracy
    assert secret_scan.fitted(none) is None and secret_scan.scan(none, None).count() == 0
    masked = secret_scan.redact(docs, forest)
    assert masked.columns == docs.columns
    texts = [r["text"] for r in masked.collect()]
    assert 'key token = "<secret>" ok' in texts and "number 4761598977407687 here" in texts and None in texts


SECRETS = [
    ("API_KEY={}", "24be64a1f09c7d3388aa12fe90bc4417"), ("export aws_secret_access_key={} x", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),
    ('password = "{}" then', "hunter2secret"), ("token = '{}'", "QwErTyUiOpAsDfGhJk"), ("Authorization: Bearer {}", "mF_9.B5f-4.1JqM"),
    ('{{"client_secret": "{}"}}', "Zx8kQ2pL"), ("auth_key:={};", "YWJjZGVmZ2hpamtsbW5vcDEyMw=="), ("see {} here", "AKIA" + "IOSFODNN7EXAMPLE"), ("pwd={}", "letmein"),
]
CLEAN = ["number 4761598977407687 here", "the key: words of it", "path/to/some/file_2024_01/of/data", "password = getpass()", "see id=4761598977407687 there", "token=${TOKEN_FROM_ENV}"]


def test_secret_scan_takes_unspaced_short_and_digit_free_values(spark):
    rng = random.Random(4)
    made = [(i, f'token = "{rng.randbytes(20).hex()}"' if i % 2 else f"number {rng.randint(10**15, 10**16)} stands here", "en", "src", 1, "") for i in range(100)]
    made += [(100 + i, form.format(x), "en", "src", 1, "") for i, (form, x) in enumerate(SECRETS)] + [(200 + i, t, "en", "src", 1, "") for i, t in enumerate(CLEAN)]
    table = spark.createDataFrame(made, SCHEMA)
    texts = {r["doc_id"]: r["text"] for r in secret_scan.redact(table, secret_scan.fitted(table)).collect()}
    assert [texts[100 + i] for i in range(len(SECRETS))] == [form.format("<secret>") for form, _ in SECRETS]
    assert [texts[200 + i] for i in range(len(CLEAN))] == CLEAN


def test_secret_scan_of_rare_and_absent_classes(spark):
    rng = random.Random(6)
    clean = [(i, f"number {rng.randint(10**15, 10**16)} stands here", "en", "src", 1, "") for i in range(600)]
    rare = [(1000, f'token = "{rng.randbytes(20).hex()}" x', "en", "src", 1, "")]
    table = spark.createDataFrame(clean + rare, SCHEMA)
    assert secret_scan.fitted(table, 20) is not None  # one secret in many documents is in the sample
    none = spark.createDataFrame(clean, SCHEMA)
    forest = secret_scan.fitted(none)
    assert forest is None
    assert secret_scan.scan(none, forest).filter("is_secret").count() == 0 and secret_scan.scan(table, forest).filter("is_secret").count() == 1
    assert {r["text"] for r in secret_scan.redact(none, forest).collect()} == {r[1] for r in clean}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 99), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.connected(links).collect()}
    assert got == {**{i: 0 for i in range(51)}, 99: 99, 100: 99, 101: 99}
    assert components.connected(links.limit(0)).count() == 0


def test_shingles():
    assert len(shingles.shingle_set(b"A b C d e")) == 2 and len(shingles.shingle_set(b" \n")) == 0
    assert (shingles.shingle_set(b"A b\tC d") == shingles.shingle_set(b" a  B c D ")).all()
