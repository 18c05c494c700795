"""The closed forms of the parse against a plain scan, line by line, and the parse of whole small books."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quireworks.functions import rules as R
from quireworks.functions import textcols as T
from quireworks.operators import parse as P
from quireworks.sources import corpus as S
from quireworks.streaming import streams

LINES = ["书名 作者：甲", "作者：乙", "简介：", "简介：文字", "书籍简介：开头", "第1卷 起", "第1章 始", "番外 一", "楔子", "正文甲", "正文乙", "简介"]


def scan(lines, rules):
    """One pass with flags."""
    name = author = None
    intro, collecting, done, rest = [], False, False, []
    for no, x in lines:
        m = re.search(rules.title_author, x)
        inline = m and m[1].strip() and m[2].strip()
        used = False
        if inline and (name is None or author is None):
            if name is None:
                name, used = m[1].strip(), True
            if author is None:
                author, used = m[2].strip(), True
        elif name is None:
            name, used = x, True
        elif not inline and author is None and (m := re.search(rules.author, x)) and m[1].strip():
            author, used = m[1].strip(), True
        if used:
            continue
        if not done:
            head = next((x[len(p):].strip() for p in rules.intro_prefixes if x.startswith(p)), None)
            if head is not None:
                collecting = True
                intro += [head] if head else []
                continue
            kind = kind_of(x, rules)
            if collecting and kind == "body":
                intro.append(x)
                continue
            if collecting and kind != "body":
                collecting, done = False, bool(intro)
        rest.append((no, x))
    return name, author, "\n".join(intro) or None, rest


def kind_of(x, rules):
    for k in ("volume", "chapter", "extra"):
        if re.search(getattr(rules, k), x):
            return k
    return "special" if x in rules.special_titles or x.startswith(R.SPECIAL_STARTS) else "body"


def test_closed_forms_equal_a_scan(spark):
    rng, rules = random.Random(3), R.Rules()
    books = {b: [(i, rng.choice(LINES)) for i in range(rng.randint(1, 12))] for b in range(400)}
    lines = spark.createDataFrame([(b, i, x) for b, ls in books.items() for i, x in ls], "book_id long, line_no int, line string")
    named = P.with_name_author(lines, rules)
    got = {r[0]: r[1:] for r in named.groupBy("book_id").agg(F.min("name"), F.min("author")).collect()}
    intro = P.with_intro(P.classify_lines(P.unnamed(named), rules), rules)
    said = {r[0]: r[1] for r in P.introductions(intro).collect()}
    left = {(r[0], r[1]) for r in intro.filter("not used").select("book_id", "line_no").collect()}
    for b, ls in books.items():
        name, author, text, rest = scan(ls, rules)
        assert tuple(got[b]) == (name, author), (b, ls)
        assert said.get(b) == text, (b, ls)
        assert {no for x, no in left if x == b} == {no for no, _ in rest}, (b, ls)


def parsed(spark, text, rules=R.Rules()):
    books = spark.createDataFrame([(1, text)], "book_id long, text string")
    named = P.with_name_author(P.drop_noise(P.normalize_lines(P.explode_lines(books)), rules), rules)
    x = P.with_intro(P.classify_lines(P.unnamed(named), rules), rules)
    n = P.numbered(x.filter("not used").select("book_id", "line_no", "line", "kind"))
    meta = named.select("name", "author").first()
    said = [r["intro"] for r in P.introductions(x).collect()]
    return meta["name"], meta["author"], said, P.assemble_volumes(n).orderBy("volume_ix").collect(), P.assemble_chapters(n).orderBy("volume_ix", "chapter_ix").collect()


def test_inline_name_and_prefixed_intro(spark):
    name, author, intro, _, chapters = parsed(spark, "河边的灯 作者：甲乙\n\n书籍简介：河水每年涨一次。\n灯一直亮着。\n\n第1章 涨水\n谁在那里？")
    assert (name, author, intro) == ("河边的灯", "甲乙", ["河水每年涨一次。\n灯一直亮着。"]) and chapters[0]["n_paragraphs"] == 1


def test_long_line_volume_and_chapters(spark):
    _, _, _, volumes, chapters = parsed(spark, "短书\n作者：丙\n第二卷 山中\n第三回 入山\n" + "字" * 70_000 + "\n第四回 出山\n下山的路")
    assert [v["title"] for v in volumes] == ["第二卷 山中"] and [(c["title"], c["n_paragraphs"]) for c in chapters] == [("第三回 入山", 1), ("第四回 出山", 1)]


def test_overlong_line_fails_its_book(spark):
    books = spark.createDataFrame([(1, "a\r\nbb\r\r\n\nc"), (2, "a\n" + "é" * 6), (3, "")], "book_id long, text string")
    assert [(r[0], r[1], r[2]) for r in P.explode_lines(books, 10).orderBy("book_id", "line_no").collect()] == [(1, 0, "a"), (1, 1, "bb\r"), (1, 2, ""), (1, 3, "c"), (3, 0, "")]
    assert [tuple(r) for r in P.overlong_books(books, 10).collect()] == [(2, 12, "line too long")]


def test_own_patterns(spark):
    from dataclasses import replace

    rules = replace(R.Rules(), title_author=r"^<(.+)>\s+by (.+)$", volume=r"^PART .*$", chapter=r"^\d+\. .*$")
    name, author, _, volumes, chapters = parsed(spark, "<A book> by Some One\nPART one\n12. A start\nwords", rules)
    assert (name, author, len(volumes), chapters[0]["title"]) == ("A book", "Some One", 1, "12. A start")


@pytest.mark.parametrize(("line", "noise"), [("第八卷接近尾声，还有三章", True), ("第八卷：他来了，又走了。", True), ("第八卷 他来了", False), ("第八卷：他来了", False), ("明天请假一次", True), ("正文", False)])
def test_noise(spark, line, noise):
    df = spark.createDataFrame([(line,)], "line string")
    assert df.select(P.is_noise(F.col("line"), R.Rules())).first()[0] is noise


def test_presets_and_merges(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["上架感言：写了一年", "单章求订阅", "作者的话：周末休息", "请假条：周一"])], "book_id long, line_no int, line string")
    assert {"qidian", "serial"} <= {r["name"] for r in P.detect_presets(lines).collect()}
    base = R.extend(R.Rules(), R.PRESETS["jjwxc"].rules)
    assert base.intro_prefixes[-1] == "文案:" and base.title == R.TITLE
    from dataclasses import replace

    assert R.override(base, replace(R.EMPTY, ignored_contains=("x",))).ignored_contains == ("x",)
    with pytest.raises(ValueError):
        R.channel_rules({"channels": {}}, "none")
    with pytest.raises(ValueError):
        R.named("none")


def test_each_book_follows_the_presets_found_in_it(spark):
    text = {1: "书一\n文案：一段话\n第1章 始\n正文\n入V公告：周五", 2: "书二\n第1章 始\n正文\n入V之后\n求月票，求推荐票", 3: "书三\n第1章 始\n文案：一段话\n作者的话：嗯"}
    books = spark.createDataFrame(list(text.items()), "book_id long, text string")
    detected = P.detect_presets(P.normalize_lines(P.explode_lines(books)))
    masked = P.detected_mask(books, P.apply_detected(books, detected, "apply"))
    rules = P.preset_rules()
    lines = P.drop_noise(P.normalize_lines(P.explode_lines(masked)), rules)
    x = P.with_intro(P.classify_lines(P.unnamed(P.with_name_author(lines, rules)), rules), rules)
    parts = P.assemble_chapters(P.numbered(x.filter("not used").select("book_id", "ruleset_id", "line_no", "line", "kind")))
    got = {r["book_id"]: (r["ruleset_id"], re.findall(">([^<]*)</p>", r["content_html"])) for r in parts.collect()}
    intros = {r[0]: r[1] for r in P.introductions(x).collect()}
    bit = {p: 1 << i for i, p in enumerate(R.PRESETS)}
    # The third book has the word of one preset only: its note stays for want of the other's score.
    assert got == {1: (bit["jjwxc"], ["正文"]), 2: (bit["qidian"], ["正文", "入V之后"]), 3: (got[3][0], got[3][1])}
    assert intros[1] == "一段话" and 2 not in intros
    for b, t in text.items():  # and the same as each book parsed alone with its own rules
        own = rules[got[b][0]]
        assert [re.findall(">([^<]*)</p>", c["content_html"]) for c in parsed(spark, t, own)[4]] == [got[b][1]]
    suggested = P.apply_detected(books, detected, "suggest")
    assert {r["ruleset_id"] for r in P.detected_mask(books, suggested).collect()} == {0}


def test_intro_falls_back_to_a_chapter(spark):
    text = {1: "N 作者：A\n简介：said\n楔子\nx", 2: "作者：B\n第1章 a\n第2卷 b\n楔子\na & b\nc\n序\nlate", 3: "T\n作者：C\n第1章\ny", 4: "T\n作者：C\n楔子\n第1章\n序\nz", 5: None, 6: "月底请假"}
    rows = [(b, f"f{b}", i, x) for b, t in text.items() for i, x in enumerate((t or "").split("\n")) if x] + [(5, "f5", None, None)]
    lines = spark.createDataFrame(rows, "book_id long, stem string, line_no int, line string")
    got = {r["book_id"]: (r["name"], r["author"], r["intro"], r["lang"]) for r in P.book_metadata(lines, R.Rules()).collect()}
    assert got == {
        1: ("N", "A", "said", "zh-CN"), 2: ("作者：B", "", "a &amp; b\nc", "zh-CN"), 3: ("T", "C", "", "zh-CN"),
        4: ("T", "C", "", "zh-CN"), 5: ("f5", "", "", "zh-CN"), 6: ("f6", "", "", "zh-CN"),  # 4: the first chapter that matches has no text; 6: noise only
    }
    assert {r["name"]: r["author"] for r in P.book_metadata(lines.filter("book_id = 3"), R.Rules(), " given ", "B").collect()} == {"given": "B"}


def test_one_pass_equals_the_steps(spark):
    """parsed and book_summaries, which drop nothing, against the steps that filter, and derive_intro against the one grouping."""
    rng, rules = random.Random(8), R.Rules()
    some = [*LINES, "月底请假", "序", "第2卷 承", "a <b> & c"]
    rows = [(b, f"f{b}", i, rng.choice(some)) for b in range(300) for i in range(rng.randint(1, 14))]
    lines = spark.createDataFrame(rows, "book_id long, stem string, line_no int, line string")
    named = P.with_name_author(P.drop_noise(lines, rules), rules)
    x = P.with_intro(P.classify_lines(P.unnamed(named), rules), rules)
    n = P.numbered(x.filter("not used"))
    one = P.parsed(lines, rules)
    kept = lambda df: sorted(tuple(r) for r in df.select("book_id", "line_no", "line", "kind", "volume_ix", "chapter_ix").collect())
    assert kept(one.filter("kind is not null")) == kept(n)
    got = {r["book_id"]: (r["name"], r["author"], r["intro"], r["n_volumes"], r["n_chapters"], r["n_paragraphs"], r["n_chars"]) for r in P.book_summaries(one).collect()}
    names = {r[0]: r[1:] for r in named.groupBy("book_id").agg(F.max("name"), F.max("author")).collect()}
    intros = dict(map(tuple, P.introductions(x).collect()))
    volumes = dict(map(tuple, P.assemble_volumes(n).groupBy("book_id").count().collect()))
    chapters = {r[0]: r[1:] for r in P.assemble_chapters(n).groupBy("book_id").agg(F.count("*"), F.sum("n_paragraphs"), F.sum(F.length("content_html").cast("long"))).collect()}
    assert got == {b: (*names.get(b, (None, None)), intros.get(b), volumes.get(b, 0), *chapters.get(b, (0, 0, 0))) for b in {r[0] for r in rows}}
    derived = dict(map(tuple, P.derive_intro(P.assemble_chapters(n), rules).collect()))
    meta = {r["book_id"]: r["intro"] for r in P.book_metadata(lines, rules).collect()}
    assert meta == {b: intros.get(b) or derived.get(b, "") for b in meta} and set(meta) == set(got) and sum(map(bool, derived.values())) > 5


def test_a_long_introduction_takes_linear_time(spark):
    """One book of 100,000 lines, all of its introduction but the last."""
    import time

    books = spark.createDataFrame([(1, "书 作者：甲\n简介：头\n" + "一行字\n" * 100_000 + "第1章 始\n文")], "book_id long, text string")
    lines = P.normalize_lines(P.explode_lines(books))
    began = time.time()
    (row,) = P.book_summaries(P.parsed(lines, R.Rules())).collect()
    assert row["intro"] == "头" + "\n一行字" * 100_000 and (row["name"], row["n_chapters"], row["n_paragraphs"]) == ("书", 1, 1)
    assert time.time() - began < 30


def test_presets_as_a_window(spark):
    """The mask of with_detected against what detect_presets scores, past the first lines too, and null lines counting for nothing."""
    rng = random.Random(4)
    words = [k for p in R.PRESETS.values() for k in p.keywords] + ["入V公告：周五", "单章求订阅", "请假条：周一", "正文"]
    rows = [(b, i, rng.choice(words) if rng.random() < 0.3 else "正文") for b in range(150) for i in range(rng.randint(1, 9))] + [(900, i, "正文") for i in range(5)] + [(900, 5, "作者的话"), (900, 6, "请假条：周一")]
    lines = spark.createDataFrame(rows, "book_id long, line_no int, line string")
    for first in (5, 400):
        want = {b: 0 for b, *_ in rows}
        for r in P.detect_presets(lines, first).collect():
            want[r["book_id"]] += 1 << list(R.PRESETS).index(r["name"])
        blank = lines.unionByName(spark.createDataFrame([(b, i, None) for b in (0, 900, 901) for i in (-3, -2, -1)], lines.schema))
        got = {(r[0], r[1]) for r in P.with_detected(blank, first).select("book_id", "ruleset_id").distinct().collect()}
        assert got == {*want.items(), (901, 0)} and len(set(want.values())) > 3 and (want[900] > 0) == (first == 400)


def test_packages(spark, tmp_path):
    books = spark.createDataFrame([(1, "题\n第1卷 甲\n第1章 乙\n文\n番外 丙\n文"), (2, "题\n无章")], "book_id long, text string")
    rules = R.Rules()
    named = P.with_name_author(P.normalize_lines(P.explode_lines(books)), rules)
    sections = P.assemble_sections(P.numbered(P.with_intro(P.classify_lines(P.unnamed(named), rules), rules).filter("not used").select("book_id", "line_no", "line", "kind")))
    rows = [(r["seq"], r["file_name"], r["parent_file"], r["title"]) for r in sections.orderBy("seq").collect()]
    assert rows == [(1, "volume0.xhtml", "", "第1卷 甲"), (2, "volume0_chapter0.xhtml", "volume0.xhtml", "第1章 乙"), (3, "volume0_chapter1.xhtml", "volume0.xhtml", "番外 丙")]
    assert [tuple(r) for r in P.toc(sections).select("file_name", "children").collect()] == [("volume0.xhtml", ["第1章 乙", "番外 丙"])]
    names = S.output_names(books.select("book_id"), F.lit("题"), F.lit("f"))
    packages = S.package_books(sections, names)
    assert [(r["output_name"], r["n_entries"], r["valid"], len(r["package"]) == r["size"]) for r in packages.collect()] == [("题.epub", 4, True, True)]
    assert [r["book_id"] for r in S.verify_packages(books, packages).collect()] == [2]
    assert [r["valid"] for r in S.package_books(sections, names, lambda pdf: b"no archive").collect()] == [False]
    S.write_sections(sections, str(tmp_path / "s"), 4)
    assert sorted((r["seq"], r["file_name"], r["parent_file"], r["title"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == rows


def test_trim(spark):
    rows = [(x,) for x in ["\u3000 a b\u00a0\u2028", "\ufeffa ", "", "\u200ba\t", " \x85\u1680\u200a", None]]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(T.trim(F.col("x"))).collect()]
    assert got == ["a b", "\ufeffa", "", "\u200ba", "", None]


def test_decode_and_intake(spark, tmp_path):
    text = "河边的灯 作者：甲乙"
    rows = [("a/x.txt", text.encode("gb18030")), ("b.TXT", b"\xef\xbb\xbf" + text.encode()), ("c.txt", text.encode()), ("d.zip", b"x"), ("e.txt", b""), ("f.txt", b"q\0r"), ("g.txt", b"123456" * 99)]
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    got = {r["path"]: (r["encoding"], r["text"]) for r in S.decode_corpus(files.filter("path < 'd'")).collect()}
    assert got == {"a/x.txt": ("gb18030", text), "b.TXT": ("utf-8-bom", text), "c.txt": ("utf-8", text)}
    codes = {r["path"]: r["reject_code"] for r in S.intake_gate(files, 200).collect()}
    assert codes == {"a/x.txt": None, "b.TXT": None, "c.txt": None, "d.zip": "not_txt", "e.txt": "empty", "f.txt": "binary", "g.txt": "too_large"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/一.v2.txt").write_bytes(text.encode("gb18030"))
    (tmp_path / "in/two.md").write_bytes(b"no")
    got = S.decode_corpus(S.read_corpus(spark, str(tmp_path))).collect()
    assert [(r["stem"], r["length"], r["text"]) for r in got] == [("一.v2", len(text.encode("gb18030")), text)]


def test_covers(spark):
    png = lambda w, h: bytes.fromhex("89504e470d0a1a0a0000000d49484452") + w.to_bytes(4, "big") + h.to_bytes(4, "big")
    rows = [(1, png(1, 1)), (2, png(11, 11)), (3, b"\xff\xd8\xff\xe0" + b"0" * 30), (4, b"text" * 9), (5, b"")]
    got = {r[0]: r[1] for r in S.cover_gate(spark.createDataFrame([(i, bytearray(c)) for i, c in rows], "id int, content binary"), 1000, 100).select("id", "reject_code").collect()}
    assert got == {1: None, 2: "pixels", 3: None, 4: "format", 5: "empty"}


def test_stream_parse(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.txt").write_text("书名\n作者：甲\n第一章 始\n文字")
    q = streams.stream_parse(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(90)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("book_id", "title", "n_paragraphs").collect()] == [("one", "第一章 始", 1)]


def test_packages_of_books_in_one_task(spark):
    """Books go through a task one after another, whatever the batches they come in, without a call of Spark for each."""
    sections = spark.createDataFrame([(b, n, f"s{n}.xhtml", f"<h2>{b} {n}</h2>") for b in range(40) for n in reversed(range(1 + b % 9))], "book_id long, seq int, file_name string, body string")
    books = spark.createDataFrame([(b, f"{b}.epub") for b in range(40)], "book_id long, output_name string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        packages = S.package_books(sections, books)
        assert "FlatMapGroupsInPandas" not in packages._jdf.queryExecution().toString()
        got = {r["book_id"]: r for r in packages.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {b: (r["output_name"], r["n_entries"], r["valid"]) for b, r in got.items()} == {b: (f"{b}.epub", 2 + b % 9, True) for b in range(40)}
    import io
    import zipfile

    assert zipfile.ZipFile(io.BytesIO(got[8]["package"])).namelist() == ["mimetype", *[f"s{n}.xhtml" for n in range(9)]]


def test_stream_parse_by_bytes(spark, tmp_path):
    """Small files share a batch up to a size; each is taken once."""
    (tmp_path / "in").mkdir()
    for i in range(50):
        (tmp_path / "in" / f"b{i}.txt").write_text(f"书名\n作者：甲\n第一章 始\n文字{i}")
    q = streams.stream_parse(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), bytes_per_batch=1 << 20)
    q.awaitTermination(120)
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 1
    assert spark.read.parquet(str(tmp_path / "out")).select("book_id").distinct().count() == 50
