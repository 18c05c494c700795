"""The registered queries of the library over the given tables, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quireworks.functions import rules as R
from quireworks.functions import textcols as T
from quireworks.operators import access as A
from quireworks.operators import ledger as L
from quireworks.operators import parse as P
from quireworks.shared import scratch
from quireworks.sources import corpus as S
from quireworks.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- Books: documents with headings and names planted between their lines by line number and doc_id; each line stays whole.

RULES = R.extend(R.Rules(), R.PRESETS["serial"].rules)
_HEADING = """CASE
 WHEN n=0 AND doc_id%5=0 THEN concat('书', cast(doc_id AS {s}), ' 作者：作者', cast(doc_id%97 AS {s}))
 WHEN n=1 AND doc_id%5=1 THEN concat('作者：作者', cast(doc_id%97 AS {s}))
 WHEN n%12=2 THEN concat('第', cast(n AS {s}), '卷')
 WHEN n%4=3 THEN concat('第', cast(n AS {s}), '章 ', cast(doc_id AS {s}))
 WHEN n%16=9 THEN concat('番外 ', cast(n AS {s}))
 WHEN n=8 AND doc_id%7=0 THEN '楔子' END"""
_LINE = """CASE
 WHEN n=1 AND doc_id%3=0 THEN concat('简介：', l)
 WHEN n=1 AND doc_id%7=2 THEN concat('文案：', l)
 WHEN n%10=5 AND doc_id%2=0 THEN concat('作者的话：', l)
 WHEN n=6 AND doc_id%11=3 THEN concat('上架感言：', l)
 ELSE l END"""


def as_books(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    """book_id, line_no, line: trimmed, none blank. A document's line n has the number 2n + 1, the heading before it 2n. With `every`, a book
    without such lines has one row whose line is null.

    Lines are made and trimmed within the array, before it is exploded, where no filter above can move: each is trimmed once."""
    docs = table(spark, d, "documents").select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    planted = F.expr(f"flatten(transform(split(text, '\\n', -1), (l, n) -> array({_HEADING.format(s='string')}, {_LINE.format(s='string')})))")
    lines, fits = F.transform(planted, T.trim), P.longest_line(F.col("text")) <= P.LONGEST_LINE
    if every:
        rows = F.filter(F.transform(lines, lambda x, n: F.struct(n.alias("line_no"), F.nullif(x, F.lit("")).alias("line"))), lambda r: r["line"].isNotNull())
        return docs.select(F.col("doc_id").alias("book_id"), F.inline_outer(F.when(fits, rows)))
    return docs.filter(fits).select(F.col("doc_id").alias("book_id"), F.posexplode(lines).alias("line_no", "line")).filter("line <> ''")


def _tr(x: str) -> str:
    return f"regexp_replace({x}, '^{T.WHITE}+|{T.WHITE}+$', '', 'g')"


def _any(parts: list[str]) -> str:
    return "(" + " OR ".join(parts) + ")"


def _noise(rules: R.Rules) -> str:
    return _any([f"regexp_matches(line, '{p}')" for p in rules.ignored_patterns] + [f"contains(line, '{k}')" for k in rules.ignored_contains])


def _prefix(prefixes: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN starts_with(line, '{p}') THEN {_tr(f'substr(line, {len(p) + 1})')} END" for p in prefixes) + ")"


_NOISE, _PREFIX = _noise(RULES), _prefix(RULES.intro_prefixes)
_SPECIAL = _any([f"line = '{t}'" for t in RULES.special_titles] + [f"starts_with(line, '{s}')" for s in R.SPECIAL_STARTS])
_KIND = f"CASE WHEN regexp_matches(line, '{RULES.volume}') THEN 'volume' WHEN regexp_matches(line, '{RULES.chapter}') THEN 'chapter' WHEN regexp_matches(line, '{RULES.extra}') THEN 'extra' WHEN {_SPECIAL} THEN 'special' ELSE 'body' END"
_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '\"', '&#34;')"
_LINES = f"""WITH raw AS (
  SELECT doc_id, unnest(range(0, len(p)))::INT AS n, unnest(p) AS l FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
lines AS (SELECT book_id, line_no, {_tr('line')} AS line FROM (
  SELECT doc_id AS book_id, 2 * n AS line_no, {_HEADING.format(s='VARCHAR')} AS line FROM raw UNION ALL SELECT doc_id, 2 * n + 1, {_LINE.format(s='VARCHAR')} FROM raw) WHERE {_tr('line')} <> ''),
"""


def _cte(noise: str = _NOISE, prefix: str = _PREFIX, lines: str = "lines") -> str:
    """All steps of the parse. lines is a table of lines with what noise and prefix ask for."""
    return _LINES + f"""clean AS (SELECT * FROM {lines} WHERE NOT {noise}),
f AS (SELECT *, {_tr(f"regexp_extract(line, '{RULES.title_author}', 1)")} AS ia, {_tr(f"regexp_extract(line, '{RULES.title_author}', 2)")} AS ib,
             {_tr(f"regexp_extract(line, '{RULES.title}', 0)")} AS t, {_tr(f"regexp_extract(line, '{RULES.author}', 1)")} AS a FROM clean),
g AS (SELECT *, (ia <> '' AND ib <> '') AS inl FROM f),
h AS (SELECT *, min(line_no) FILTER (inl) OVER (PARTITION BY book_id) AS i1, min(line_no) FILTER (t <> '' AND NOT inl) OVER (PARTITION BY book_id) AS t1 FROM g),
h2 AS (SELECT *, CASE WHEN i1 IS NULL OR t1 < i1 THEN t1 END AS tl FROM h),
h3 AS (SELECT *, min(line_no) FILTER (a <> '' AND NOT inl AND line_no IS DISTINCT FROM tl) OVER (PARTITION BY book_id) AS a1 FROM h2),
n AS (SELECT *, least(i1, t1) AS name_line, least(i1, a1) AS author_line FROM h3),
names AS (SELECT book_id, max(CASE WHEN line_no = name_line THEN CASE WHEN inl THEN ia ELSE t END END) AS name,
                 max(CASE WHEN line_no = author_line THEN CASE WHEN inl THEN ib ELSE a END END) AS author,
                 min(name_line) AS name_line, min(author_line) AS author_line FROM n GROUP BY book_id),
rest AS (SELECT *, {_KIND} AS kind FROM n WHERE line_no IS DISTINCT FROM name_line AND line_no IS DISTINCT FROM author_line),
p AS (SELECT *, {prefix} AS p FROM rest),
s AS (SELECT *, sum(CASE WHEN p IS NULL AND kind <> 'body' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY line_no) AS seg FROM p),
m AS (SELECT *, bool_or(p IS NOT NULL) OVER (PARTITION BY book_id, seg ORDER BY line_no) AS member FROM s),
tx AS (SELECT *, CASE WHEN member THEN nullif(coalesce(p, line), '') END AS tx FROM m),
ff AS (SELECT *, min(CASE WHEN tx IS NOT NULL THEN seg END) OVER (PARTITION BY book_id) AS fs FROM tx),
intros AS (SELECT book_id, string_agg(tx, chr(10) ORDER BY line_no) AS intro FROM ff WHERE seg = fs AND tx IS NOT NULL GROUP BY book_id),
body AS (SELECT book_id, line_no, line, kind FROM ff WHERE NOT (member AND (fs IS NULL OR seg <= fs))),
v AS (SELECT *, sum((kind = 'volume')::INT) OVER (PARTITION BY book_id ORDER BY line_no) AS v FROM body),
v2 AS (SELECT *, (v + max((kind IN ('chapter', 'extra', 'special') AND v = 0)::INT) OVER (PARTITION BY book_id) - 1)::INT AS volume_ix FROM v),
num AS (SELECT *, (sum((kind IN ('chapter', 'extra', 'special'))::INT) OVER (PARTITION BY book_id, volume_ix ORDER BY line_no) - 1)::INT AS chapter_ix FROM v2),
chapters AS (SELECT book_id, volume_ix, chapter_ix, max(CASE WHEN kind <> 'body' THEN line END) AS title,
                    coalesce(string_agg('<p style="text-indent: 2em;">' || {_ESCAPED.format('line')} || '</p>' || chr(10), '' ORDER BY line_no) FILTER (kind = 'body'), '') AS content_html,
                    sum((kind = 'body')::INT)::BIGINT AS n_paragraphs
             FROM num WHERE volume_ix >= 0 AND chapter_ix >= 0 AND kind <> 'volume' GROUP BY ALL),
volumes AS (SELECT book_id, volume_ix, coalesce(max(CASE WHEN kind = 'volume' THEN line END), '') AS title,
                   sum((kind IN ('chapter', 'extra', 'special'))::INT)::BIGINT AS n_chapters FROM num WHERE volume_ix >= 0 AND kind <> 'body' GROUP BY ALL),
sections AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY volume_ix, chapter_ix)::INT AS seq, file_name, parent_file, title, body FROM (
  SELECT book_id, volume_ix, -1 AS chapter_ix, 'volume' || volume_ix || '.xhtml' AS file_name, '' AS parent_file, title, '<h1>' || {_ESCAPED.format('title')} || '</h1>' AS body FROM volumes WHERE title <> ''
  UNION ALL SELECT c.book_id, c.volume_ix, c.chapter_ix, 'volume' || c.volume_ix || '_chapter' || c.chapter_ix || '.xhtml',
                   CASE WHEN v.title <> '' THEN 'volume' || c.volume_ix || '.xhtml' ELSE '' END, c.title, '<h2>' || {_ESCAPED.format('c.title')} || '</h2>' || content_html
            FROM chapters c JOIN volumes v USING (book_id, volume_ix)))
"""


_CTE = _cte()


def _named(spark: SparkSession, d: str) -> DataFrame:
    return P.with_name_author(P.drop_noise(as_books(spark, d), RULES), RULES)


def _introduced(spark: SparkSession, d: str) -> DataFrame:
    return P.with_intro(P.classify_lines(P.unnamed(_named(spark, d)), RULES), RULES)


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return P.numbered(_introduced(spark, d).filter("not used").select("book_id", "line_no", "line", "kind"))


def _parsed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = _numbered(spark, d)
    return P.assemble_volumes(x), P.assemble_chapters(x)


@query("line_kinds", _CTE + f"SELECT kind, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM (SELECT line, CASE WHEN {_NOISE} THEN 'noise' ELSE {_KIND} END AS kind FROM lines) GROUP BY kind")
def line_kinds(spark, d):
    x = P.classify_lines(as_books(spark, d), RULES).withColumn("kind", F.when(P.is_noise(F.col("line"), RULES), "noise").otherwise(F.col("kind")))
    return x.groupBy("kind").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("noise_lines", _CTE + f"SELECT book_id, line_no, line FROM lines WHERE {_NOISE}")
def noise_lines(spark, d):
    return P.noise_lines(as_books(spark, d), RULES)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("book_id"), F.coalesce("text", F.lit("")).alias("text"))


@query("overlong_books", "SELECT doc_id AS book_id, max(strlen(l))::INT AS longest, 'line too long' AS parse_error FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents) GROUP BY doc_id HAVING max(strlen(l)) > 2000")
def overlong_books(spark, d):
    return P.overlong_books(_texts(spark, d), 2000)


@query("book_lines", "SELECT doc_id AS book_id, count(*) AS n_lines, sum(strlen(l))::BIGINT AS n_bytes FROM (SELECT doc_id, l, max(strlen(l)) OVER (PARTITION BY doc_id) AS longest FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents)) WHERE longest <= 2000 GROUP BY doc_id")
def book_lines(spark, d):
    return P.explode_lines(_texts(spark, d), 2000).groupBy("book_id").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("line").cast("long")).alias("n_bytes"))


@query("book_names", _CTE + "SELECT * FROM names")
def book_names(spark, d):
    return _named(spark, d).groupBy("book_id").agg(*[F.min(c).alias(c) for c in ("name", "author", "name_line", "author_line")])


@query("book_intros", _CTE + "SELECT book_id, intro FROM intros")
def book_intros(spark, d):
    return P.introductions(_introduced(spark, d))


_DERIVED = f"SELECT book_id, {_tr("regexp_replace(arg_min(content_html, (volume_ix, chapter_ix)), '<[^>]*>', '', 'g')")} AS intro FROM chapters WHERE regexp_matches(title, '{RULES.intro}') GROUP BY book_id"
_META = f", derived AS ({_DERIVED}) SELECT d.doc_id AS book_id, coalesce(nullif(name, ''), 'doc' || d.doc_id) AS name, coalesce(author, '') AS author, coalesce(nullif(i.intro, ''), v.intro, '') AS intro, 'zh-CN' AS lang FROM documents d LEFT JOIN names n ON n.book_id = d.doc_id LEFT JOIN intros i ON i.book_id = d.doc_id LEFT JOIN derived v ON v.book_id = d.doc_id"


@query("book_metadata", _CTE + _META)
def book_metadata(spark, d):
    lines = as_books(spark, d, every=True)
    return P.book_metadata(lines.withColumn("stem", F.concat(F.lit("doc"), F.col("book_id").cast("string"))), RULES)


@query("chapter_summary", _CTE + "SELECT book_id, count(*) AS n_chapters, sum(length(content_html))::BIGINT AS n_chars FROM chapters GROUP BY book_id")
def chapter_summary(spark, d):
    return _parsed(spark, d)[1].groupBy("book_id").agg(F.count("*").alias("n_chapters"), F.sum(F.length("content_html").cast("long")).alias("n_chars"))


@query("chapters", _CTE + "SELECT * FROM chapters")
def chapters(spark, d):
    return _parsed(spark, d)[1]


@query("volumes", _CTE + "SELECT * FROM volumes")
def volumes(spark, d):
    return _parsed(spark, d)[0]


@query("unparsed_books", _CTE + "SELECT doc_id AS book_id FROM documents WHERE doc_id NOT IN (SELECT book_id FROM volumes)")
def unparsed_books(spark, d):
    return P.unparsed_books(table(spark, d, "documents").select(F.col("doc_id").alias("book_id")), volumes(spark, d))


@query("derived_intros", _CTE + _DERIVED)
def derived_intros(spark, d):
    return P.derive_intro(chapters(spark, d), RULES)


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return P.assemble_sections(_numbered(spark, d))


_SECTIONS = _CTE + "SELECT book_id, seq, file_name, parent_file, title, md5(body) AS body_md5 FROM sections"


def _digested(sections: DataFrame) -> DataFrame:
    return sections.withColumn("body_md5", F.md5(F.col("body").cast("binary"))).select("book_id", "seq", "file_name", "parent_file", "title", "body_md5")


@query("sections", _SECTIONS)
def sections(spark, d):
    return _digested(_sections(spark, d))


@query("stored_sections", _SECTIONS)
def stored_sections(spark, d):
    to = scratch(spark, "sections")
    S.write_sections(_sections(spark, d), to)
    return _digested(spark.read.parquet(to))


@query("toc", _CTE + "SELECT t.book_id, t.seq, t.file_name, t.title, coalesce(any_value(c.k), '') AS children FROM sections t LEFT JOIN (SELECT book_id, parent_file, string_agg(title, '|' ORDER BY seq) AS k FROM sections WHERE parent_file <> '' GROUP BY ALL) c ON c.book_id = t.book_id AND c.parent_file = t.file_name WHERE t.parent_file = '' GROUP BY ALL")
def toc(spark, d):
    return P.toc(_sections(spark, d)).withColumn("children", F.array_join("children", "|")).select("book_id", "seq", "file_name", "title", "children")


@query("strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


def _detect_sql() -> str:
    """Tables head and found(book_id, name, score, reasons), after lines."""
    parts = []
    for p in R.PRESETS.values():
        tests = [(f"contains(line, '{k}')", 1, f"keyword:{k}") for k in dict.fromkeys(p.keywords)] + [(f"regexp_matches(line, '{r}')", 2, f"pattern:{r}") for r in dict.fromkeys(p.patterns)]
        score = " + ".join(f"{w} * bool_or({c})::INT" for c, w, _ in tests)
        why = "concat_ws('|', " + ", ".join(f"CASE WHEN bool_or({c}) THEN '{s}' END" for c, _, s in tests) + ")"
        parts.append(f"SELECT book_id, '{p.name}' AS name, ({score})::INT AS score, {why} AS reasons FROM head GROUP BY book_id HAVING {score} >= {p.least}")
    return "head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY line_no) AS k FROM lines) WHERE k <= 400), found AS (" + " UNION ALL ".join(parts) + ")"


@query("detect_presets", _LINES + _detect_sql() + " SELECT * FROM found")
def detect_presets(spark, d):
    return P.detect_presets(as_books(spark, d)).withColumn("reasons", F.array_join("reasons", "|"))


def _applied(spark: SparkSession, d: str) -> DataFrame:
    books = table(spark, d, "documents").select(F.col("doc_id").alias("book_id"))
    return P.apply_detected(books, P.detect_presets(as_books(spark, d)), "apply")


@query("apply_detected", _LINES + _detect_sql() + " SELECT doc_id AS book_id, coalesce(string_agg(name, ',' ORDER BY score DESC, name), '') AS applied FROM documents LEFT JOIN found ON book_id = doc_id GROUP BY doc_id")
def apply_detected(spark, d):
    return _applied(spark, d).select("book_id", F.array_join("applied", ",").alias("applied"))


def _by_mask() -> str:
    """The parse where each book follows the presets that were found in it."""
    bits = {p: 1 << i for i, p in enumerate(R.PRESETS)}
    own = [f"(ruleset_id & {bits[p.name]} > 0 AND {_noise(p.rules)})" for p in R.PRESETS.values()]
    prefixes = [_prefix(R.Rules().intro_prefixes)] + [f"CASE WHEN ruleset_id & {bits[p.name]} > 0 THEN {_prefix(p.rules.intro_prefixes)} END" for p in R.PRESETS.values() if p.rules.intro_prefixes]
    masks = "masks AS (SELECT doc_id AS book_id, coalesce(sum(CASE name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in bits.items()) + " END), 0)::INT AS ruleset_id FROM documents LEFT JOIN found ON book_id = doc_id GROUP BY doc_id),\n"
    steps = _cte(_any([_noise(R.Rules()), *own]), f"coalesce({', '.join(prefixes)})", "marked").replace(_LINES, "")
    return _LINES + _detect_sql() + ", " + masks + "marked AS (SELECT * FROM lines JOIN masks USING (book_id)),\n" + steps


@query("parsed_by_detection", _by_mask() + "SELECT m.book_id, ruleset_id, coalesce(i.intro, '') AS intro, coalesce(c.n, 0)::BIGINT AS n_chapters, coalesce(c.k, 0)::BIGINT AS n_chars FROM masks m LEFT JOIN intros i USING (book_id) LEFT JOIN (SELECT book_id, count(*) AS n, sum(length(content_html)) AS k FROM chapters GROUP BY book_id) c USING (book_id)")
def parsed_by_detection(spark, d):
    found = P.book_summaries(P.parsed(P.with_detected(as_books(spark, d, every=True)), P.preset_rules()))
    return found.select("book_id", "ruleset_id", F.coalesce("intro", F.lit("")).alias("intro"), "n_chapters", "n_chars")


@query("assign_rulesets", "SELECT doc_id AS book_id, CASE WHEN c = 'src0' THEN 1 WHEN c = 'src1' THEN 2 WHEN c = 'default' THEN 3 END AS ruleset_id, CASE WHEN c NOT IN ('src0', 'src1', 'default') THEN 'unknown channel ' || c END AS rule_error FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'default' ELSE source END AS c FROM documents)")
def assign_rulesets(spark, d):
    books = table(spark, d, "documents").select(F.col("doc_id").alias("book_id"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.upper("source")).alias("channel"))
    known = spark.createDataFrame([("src0", 1), ("SRC1", 2), ("default", 3)], "channel string, ruleset_id int")
    return P.assign_rulesets(books, known, "default").drop("channel")


@query("union_distinct", "SELECT doc_id, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS joined FROM (SELECT doc_id, [lang, source, lang] AS a, list_filter([source, 'x' || doc_id % 3], lambda x: x <> '') AS b FROM documents)")
def union_distinct(spark, d):
    x = table(spark, d, "documents").withColumn("t", F.concat(F.lit(" x"), (F.col("doc_id") % 3).cast("string")))
    return x.select("doc_id", F.array_join(T.union_distinct(F.array("lang", "source", "lang"), F.array(F.concat("source", F.lit("　")), "t", F.lit(" "), "t")), ",").alias("joined"))


_SAFE = _tr("translate(name, '<>:\"/\\|?*', '_________')")
_NAMED = f"SELECT book_id, coalesce(nullif(regexp_replace({_SAFE}, '^[. ]+|[. ]+$', '', 'g'), ''), 'doc') || '.epub' AS output_name FROM names"


@query("output_names", _CTE + f"SELECT *, count(*) OVER (PARTITION BY output_name) > 1 AS collides FROM ({_NAMED})")
def output_names(spark, d):
    return S.output_names(book_names(spark, d), T.safe_name(F.col("name")), F.lit("doc")).select("book_id", "output_name", "collides")


@query("package_books", _CTE + f"SELECT s.book_id, output_name, count(*) + 1 AS n_entries, true AS valid FROM sections s JOIN ({_NAMED}) o ON o.book_id = s.book_id GROUP BY ALL")
def package_books(spark, d):
    return S.package_books(_sections(spark, d), output_names(spark, d)).select("book_id", "output_name", "n_entries", "valid")


@query("verify_packages", _CTE + "SELECT doc_id AS book_id FROM documents WHERE doc_id NOT IN (SELECT book_id FROM sections)")
def verify_packages(spark, d):
    books = table(spark, d, "documents").select(F.col("doc_id").alias("book_id"))
    return S.verify_packages(books, S.package_books(_sections(spark, d), output_names(spark, d)))


@query("read_corpus", "SELECT 'shelf=' || (doc_id % 64) AS folder, strlen(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id)) + 1 AS length, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10)) AS content_md5 FROM documents GROUP BY ALL")
def read_corpus(spark, d):
    """All documents as 64 text files, one a shelf, read back whole."""
    to = scratch(spark, "corpus")
    docs = table(spark, d, "documents").select((F.col("doc_id") % 64).alias("shelf"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs.repartition(64, "shelf").sortWithinPartitions("shelf", "doc_id").select("shelf", "text").write.partitionBy("shelf").text(to)
    files = S.read_corpus(spark, to)
    return files.select(F.regexp_extract("path", "(shelf=[0-9]+)/[^/]*$", 1).alias("folder"), "length", F.md5("content").alias("content_md5"))


@query("intake_gate", "SELECT reject_code, count(*) AS n FROM (SELECT CASE WHEN doc_id % 11 = 0 THEN 'not_txt' WHEN text IS NULL OR text = '' THEN 'empty' WHEN strlen(text) > 5000 THEN 'too_large' END AS reject_code FROM documents) GROUP BY reject_code")
def intake_gate(spark, d):
    files = table(spark, d, "documents").select(F.when(F.col("doc_id") % 11 == 0, "a.zip").otherwise("b.TXT").alias("path"), F.col("text").cast("binary").alias("content"))
    return S.intake_gate(files, 5000).groupBy("reject_code").agg(F.count("*").alias("n"))


@query("encoding_census", "SELECT 'utf-8' AS encoding, count(*) AS n_books, sum(strlen(text))::BIGINT AS n_bytes FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT 'utf-8-bom', count(*), sum(strlen(text))::BIGINT FROM documents WHERE doc_id % 2 = 0")
def encoding_census(spark, d):
    raw = F.col("text").cast("binary")
    files = table(spark, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), raw)).otherwise(raw).alias("content"))
    return S.encoding_census(S.decode_corpus(files))


#: Images that stand in for the pages by page_id: PNG heads with a size of their own, JPEG heads, text, nothing, and what is too long.
_COVER_PIXELS, _COVER_BYTES = 4_000_000, 4_000


@query("cover_gate", f"""SELECT page_id, CASE WHEN page_id % 5 < 3 THEN 'png' WHEN page_id % 5 = 3 AND page_id % 10 = 3 THEN 'jpeg' END AS format,
  CASE WHEN page_id % 10 = 4 THEN 'empty' WHEN n > {_COVER_BYTES} THEN 'too_large' WHEN page_id % 5 = 4 OR page_id % 10 = 8 THEN 'format' WHEN page_id % 5 < 3 AND w * h > {_COVER_PIXELS} THEN 'pixels' END AS reject_code
FROM (SELECT page_id, page_id * 37 + 1 AS w, strlen(html) AS h, strlen(html) + CASE WHEN page_id % 5 < 3 THEN 24 WHEN page_id % 10 = 3 THEN 3 ELSE 0 END AS n FROM pages)""")
def cover_gate(spark, d):
    number = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    k, html = F.col("page_id"), F.col("html").cast("binary")
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(k * 37 + 1), number(F.octet_length(html))))
    content = F.when(k % 5 < 3, F.concat(png, html)).when(k % 10 == 3, F.concat(F.unhex(F.lit("FFD8FF")), html)).when(k % 10 == 4, F.lit(b"")).otherwise(html)
    return S.cover_gate(table(spark, d, "pages").select("page_id", content.alias("content")), _COVER_BYTES, _COVER_PIXELS).select("page_id", "format", "reject_code")


@F.pandas_udf(BinaryType())
def _as_gb18030(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.encode("gb18030"))


@query("decode_corpus", r"SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'utf-8-bom' WHEN 2 THEN 'utf-8' ELSE CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'gb18030' ELSE 'utf-8' END END AS encoding, md5(coalesce(text, '')) AS text_md5 FROM documents")
def decode_corpus(spark, d):
    text = F.coalesce("text", F.lit(""))
    raw = text.cast("binary")
    content = F.when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), raw)).when(F.col("doc_id") % 3 == 2, raw).otherwise(_as_gb18030(F.when(F.col("doc_id") % 3 == 0, text)))
    return S.decode_corpus(table(spark, d, "documents").select("doc_id", content.alias("content"))).select("doc_id", "encoding", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# --- The ledger: events as conversion jobs.

NOW, KEEP_HOURS, QUOTA = "2024-01-30 12:00:00", 24, 5_000_000


def as_ledger(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    done = F.timestamp_add("SECOND", F.get_json_object("props", "$.k").cast("int"), F.col("ts"))
    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "converting").when(F.col("event_type") == "error", "failed").otherwise("succeeded")
    x = e.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("client_id"), (F.col("user_id") % 50).alias("owner_id"), F.floor(F.col("value") * 1000).cast("long").alias("output_size"), F.col("ts").alias("created_at"), status.alias("status"), done.alias("done_at"))
    ended = lambda *s: F.when(F.col("status").isin(*s), F.col("done_at"))
    return x.withColumns({"completed_at": ended("succeeded", "failed"), "expires_at": L.after(ended("succeeded"), KEEP_HOURS), "purge_at": L.after(ended("failed"), KEEP_HOURS)})


def _leases(spark, d):
    return as_ledger(spark, d).filter("job_id % 13 = 0").select("job_id")


_LEDGER = f"""WITH l0 AS (SELECT event_id AS job_id, user_id AS client_id, user_id % 50 AS owner_id, floor(value * 1000)::BIGINT AS output_size, ts AS created_at,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'converting' WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS status,
  ts + to_seconds(json_extract_string(props, '$.k')::INT) AS done_at FROM events),
ledger AS (SELECT *, CASE WHEN status IN ('succeeded', 'failed') THEN done_at END AS completed_at, CASE WHEN status = 'succeeded' THEN done_at + INTERVAL {KEEP_HOURS} HOUR END AS expires_at,
  CASE WHEN status = 'failed' THEN done_at + INTERVAL {KEEP_HOURS} HOUR END AS purge_at FROM l0),
leases AS (SELECT job_id FROM ledger WHERE job_id % 13 = 0)
"""


def _now() -> Column:
    return F.to_timestamp_ntz(F.lit(NOW), F.lit("yyyy-MM-dd HH:mm:ss"))


@query("capacity", _LEDGER + "SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status IN ('queued', 'converting')) AS active, count(*) FILTER (status = 'converting') AS running, count(*) FILTER (status = 'converting') < 2 AND count(*) FILTER (status = 'queued') = 0 AS available FROM ledger")
def capacity(spark, d):
    return L.capacity(as_ledger(spark, d), 2)


@query("active_by_client", _LEDGER + "SELECT client_id, count(*) AS n_active FROM ledger WHERE status IN ('queued', 'converting') GROUP BY client_id")
def active_by_client(spark, d):
    return L.active_by_client(as_ledger(spark, d))


@query("queue_positions", _LEDGER + "SELECT job_id, row_number() OVER (ORDER BY created_at, job_id) AS queue_position FROM ledger WHERE status = 'queued' UNION ALL SELECT job_id, 0 FROM ledger WHERE status <> 'queued'")
def queue_positions(spark, d):
    return L.queue_positions(as_ledger(spark, d))


@query("expire", _LEDGER + f"SELECT job_id, 'expired' AS status, TIMESTAMP '{NOW}' + INTERVAL {KEEP_HOURS} HOUR AS purge_at FROM ledger WHERE status = 'succeeded' AND expires_at <= TIMESTAMP '{NOW}' AND job_id NOT IN (SELECT job_id FROM leases)")
def expire(spark, d):
    return L.expire(as_ledger(spark, d), _leases(spark, d), _now(), KEEP_HOURS).select("job_id", "status", "purge_at")


@query("purge", _LEDGER + f"SELECT job_id, output_size FROM ledger WHERE status = 'failed' AND purge_at <= TIMESTAMP '{NOW}' AND job_id NOT IN (SELECT job_id FROM leases)")
def purge(spark, d):
    return L.purge(as_ledger(spark, d), _leases(spark, d), _now()).select("job_id", "output_size")


_LIVE = f"live AS (SELECT * FROM ledger WHERE NOT (status = 'succeeded' AND expires_at <= TIMESTAMP '{NOW}')), may AS (SELECT job_id, output_size, sum(output_size) OVER (ORDER BY completed_at, job_id) - output_size AS before FROM live WHERE status = 'succeeded' AND job_id NOT IN (SELECT job_id FROM leases)), gone AS (SELECT job_id, output_size FROM may, (SELECT sum(output_size) AS used FROM live WHERE status = 'succeeded') u WHERE used - before > {QUOTA})"


def _live(spark, d):
    return as_ledger(spark, d).filter(~F.coalesce((F.col("status") == "succeeded") & (F.col("expires_at") <= _now()), F.lit(False)))


@query("evict_to_quota", _LEDGER.rstrip() + ",\n" + _LIVE + " SELECT job_id, output_size FROM gone")
def evict_to_quota(spark, d):
    return L.evict_to_quota(_live(spark, d), _leases(spark, d), QUOTA).select("job_id", "output_size")


@query("storage_full", _LEDGER.rstrip() + ",\n" + _LIVE + f" SELECT used::BIGINT AS used, evicted::BIGINT AS evicted, used - evicted > {QUOTA} AS storage_full FROM (SELECT sum(output_size) AS used FROM live WHERE status = 'succeeded'), (SELECT coalesce(sum(output_size), 0) AS evicted FROM gone)")
def storage_full(spark, d):
    return L.storage_full(_live(spark, d), _leases(spark, d), QUOTA)


def _files(spark, d):
    kind = F.when(F.col("job_id") % 7 == 0, "inbox").when(F.col("job_id") % 101 == 0, "key").otherwise("output")
    return as_ledger(spark, d).select(F.concat(F.lit("jobs/"), F.col("job_id").cast("string")).alias("path"), kind.alias("kind"), (F.col("job_id") * 3 % 4001).alias("job_id"), F.col("output_size").alias("length"), F.col("done_at").alias("modified_at"))


_FILES = ", files AS (SELECT 'jobs/' || job_id AS path, CASE WHEN job_id % 7 = 0 THEN 'inbox' WHEN job_id % 101 = 0 THEN 'key' ELSE 'output' END AS kind, job_id * 3 % 4001 AS job_id, output_size AS length, done_at AS modified_at FROM ledger) "


@query("storage_usage", _LEDGER + _FILES + "SELECT job_id, sum(length)::BIGINT AS n_bytes FROM files GROUP BY ROLLUP (job_id)")
def storage_usage(spark, d):
    return L.storage_usage(_files(spark, d))


@query("orphans", _LEDGER + _FILES + f"SELECT path, kind FROM files WHERE kind <> 'key' AND modified_at <= TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE AND (kind = 'inbox' OR job_id NOT IN (SELECT job_id FROM ledger WHERE job_id % 2 = 0))")
def orphans(spark, d):
    return L.orphans(_files(spark, d), as_ledger(spark, d).filter("job_id % 2 = 0"), _now(), 10).select("path", "kind")


@query("reconcile", _LEDGER + f""", r AS (SELECT *, CASE WHEN status IN ('queued', 'converting') AND job_id % 3 = 0 THEN 'queued' WHEN status IN ('queued', 'converting') THEN 'failed' WHEN status = 'succeeded' AND job_id % 5 <> 0 THEN 'expired' ELSE status END AS s,
  CASE WHEN status IN ('queued', 'converting') AND job_id % 3 <> 0 THEN 'input_missing' WHEN status = 'succeeded' AND job_id % 5 <> 0 THEN 'output_missing' END AS error_code FROM ledger)
SELECT job_id, s AS status, error_code, CASE WHEN s IN ('failed', 'expired', 'evicted') AND purge_at IS NULL THEN coalesce(completed_at, TIMESTAMP '{NOW}') + INTERVAL {KEEP_HOURS} HOUR ELSE purge_at END AS purge_at FROM r""")
def reconcile(spark, d):
    x = as_ledger(spark, d)
    return L.reconcile(x, x.filter("job_id % 3 = 0").select("job_id"), x.filter("job_id % 5 = 0").select("job_id"), _now(), KEEP_HOURS)


@query("finish", _LEDGER + f"SELECT job_id, CASE WHEN status = 'converting' THEN CASE WHEN job_id % 4 <> 0 THEN 'succeeded' ELSE 'failed' END ELSE status END AS status, CASE WHEN status = 'converting' AND job_id % 4 <> 0 THEN job_id ELSE output_size END AS output_size, CASE WHEN status = 'converting' AND job_id % 4 = 0 THEN CASE WHEN job_id % 8 = 0 THEN 'timeout' ELSE 'conversion_failed' END END AS error_code, CASE WHEN status = 'converting' AND job_id % 4 <> 0 THEN done_at + INTERVAL {KEEP_HOURS} HOUR ELSE expires_at END AS expires_at, CASE WHEN status = 'converting' AND job_id % 4 = 0 THEN done_at + INTERVAL {KEEP_HOURS} HOUR ELSE purge_at END AS purge_at FROM ledger")
def finish(spark, d):
    x = as_ledger(spark, d)
    results = x.filter("status = 'converting'").select("job_id", (F.col("job_id") % 4 != 0).alias("ok"), (F.col("job_id") % 8 == 0).alias("timed_out"), F.col("job_id").alias("size"), "done_at")
    return L.finish(x.drop("done_at"), results, KEEP_HOURS)


@query("download_eligibility", _LEDGER + f"SELECT request_id, CASE WHEN l.job_id IS NULL OR l.owner_id <> asker_id THEN 'NOT_FOUND' WHEN status IN ('expired', 'evicted') THEN 'EXPIRED' WHEN expires_at <= TIMESTAMP '{NOW}' AND l.job_id % 13 <> 0 THEN 'EXPIRED' WHEN status <> 'succeeded' THEN 'NOT_READY' WHEN l.job_id % 5 = 0 THEN 'EXPIRED' ELSE 'OK' END AS verdict FROM (SELECT job_id AS request_id, job_id * 2 AS want, client_id % 3 AS k, owner_id FROM ledger) r LEFT JOIN ledger l ON l.job_id = r.want, LATERAL (SELECT CASE WHEN k = 0 THEN r.owner_id ELSE l.owner_id END AS asker_id)")
def download_eligibility(spark, d):
    x = as_ledger(spark, d)
    own = x.select(F.col("job_id").alias("want"), F.col("owner_id").alias("real"))
    r = x.select(F.col("job_id").alias("request_id"), (F.col("job_id") * 2).alias("want"), (F.col("client_id") % 3).alias("k"), "owner_id").join(own, "want", "left")
    requests = r.select("request_id", F.col("want").alias("job_id"), F.when(F.col("k") == 0, F.col("owner_id")).otherwise(F.col("real")).alias("asker_id"))
    return L.download_eligibility(requests, x, _leases(spark, d), x.filter("job_id % 5 <> 0").select("job_id"), _now())


@query("owner_jobs", _LEDGER + "SELECT job_id, owner_id, status, created_at, completed_at, output_size FROM ledger WHERE owner_id IN (SELECT DISTINCT owner_id FROM ledger WHERE job_id % 97 = 1)")
def owner_jobs(spark, d):
    x = as_ledger(spark, d)
    return L.owner_jobs(x, x.filter("job_id % 97 = 1").select("owner_id"))


@query("history", _LEDGER + f"""SELECT owner_id, job_id, rank::INT AS rank, CASE WHEN status = 'succeeded' AND expires_at <= TIMESTAMP '{NOW}' THEN 'expired' ELSE status END AS status FROM (
  SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, job_id DESC) AS rank FROM (
    SELECT * EXCLUDE (job_id), job_id % 500 AS job_id, row_number() OVER (PARTITION BY owner_id, job_id % 500 ORDER BY created_at DESC, job_id DESC) AS k FROM ledger) WHERE k = 1) WHERE rank <= 30""")
def history(spark, d):
    x = as_ledger(spark, d).select("owner_id", F.col("job_id").alias("event_id"), (F.col("job_id") % 500).alias("job_id"), F.col("created_at").alias("updated_at"), "expires_at", "status")
    return L.history(x, _now())


#: One submission after another; the jobs that are open go from row to row as a list.
_ADMISSION = """, o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY created_at, job_id) AS k, job_id, client_id, created_at, CASE WHEN job_id % 2500 <> 7 THEN done_at END AS done_at, output_size AS size FROM ledger),
r AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS job_id, NULL::BIGINT AS client_id, '' AS verdict, 0::BIGINT AS client_open, 0::BIGINT AS all_open, []::STRUCT(e TIMESTAMP, c BIGINT, s BIGINT)[] AS open
UNION ALL
SELECT k, job_id, client_id, verdict, n, m, CASE WHEN verdict = 'accepted' THEN list_append(still, {'e': done_at, 'c': client_id, 's': size}) ELSE still END FROM (
  SELECT *, CASE WHEN n >= 1 THEN 'ip_limit' WHEN m >= 4 THEN 'queue_full' WHEN coalesce(list_sum(list_transform(still, lambda x: x.s)), 0) + size > 200000 THEN 'storage_full' ELSE 'accepted' END AS verdict FROM (
    SELECT *, len(still)::BIGINT AS m, len(list_filter(still, lambda x: x.c = client_id))::BIGINT AS n FROM (
      SELECT o.*, list_filter(r.open, lambda x: x.e IS NULL OR x.e > o.created_at) AS still FROM r JOIN o ON o.k = r.k + 1))))
SELECT job_id, client_id, verdict, client_open::INT AS client_open, all_open::INT AS all_open FROM r WHERE k > 0"""


@query("admission_replay", _LEDGER.replace("WITH", "WITH RECURSIVE", 1) + _ADMISSION)
def admission_replay(spark, d):
    x = as_ledger(spark, d)
    return L.admission_replay(x.withColumns({"size": F.col("output_size"), "done_at": F.when(F.col("job_id") % 2500 != 7, F.col("done_at"))}), 1, 4, 200_000)


@query("stage_progress", _LEDGER + "SELECT CASE status WHEN 'queued' THEN 1 WHEN 'converting' THEN 2 WHEN 'succeeded' THEN 3 ELSE CASE WHEN completed_at IS NOT NULL THEN 2 ELSE 0 END END AS stage, count(*) AS n_jobs FROM ledger GROUP BY ALL")
def stage_progress(spark, d):
    return L.stage_progress(as_ledger(spark, d))


@query("read_ledger", "SELECT status, count(*) AS n_jobs, sum(s_suppkey * 10)::BIGINT AS n_bytes FROM (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'succeeded' ELSE 'failed' END AS status FROM supplier WHERE s_suppkey % 13 <> 1 AND s_suppkey % 17 <> 1 AND s_suppkey % 19 <> 1) GROUP BY status")
def read_ledger(spark, d):
    """A record for each supplier in a folder of its own, read back; some records broken off, some under another's name, some with a size that is no
    number. A folder a job is the ledger's format; at some 14 ms a folder it is not one for the events."""
    to, job = scratch(spark, "ledger"), F.col("s_suppkey")
    own = F.concat(F.lit("job="), F.when(job % 13 == 1, job + 1).otherwise(job).cast("string"))
    status = F.when(job % 3 == 0, "queued").when(job % 3 == 1, "succeeded").otherwise("failed")
    record = F.concat(F.lit('{"id": "'), own, F.lit('", "status": "'), status, F.lit('", "input_size": '), F.when(job % 19 == 1, '"large"').otherwise((job * 10).cast("string")), F.when(job % 17 == 1, "").otherwise("}"))
    S.write_folders(table(spark, d, "supplier").select(job.alias("job"), record.alias("value")), "job", to)
    return S.read_ledger(spark, f"{to}/job=*").groupBy("status").agg(F.count("*").alias("n_jobs"), F.sum("input_size").alias("n_bytes"))


# --- Streams: the tables as files in the order of their times, taken some at a time, run to their end and read back.

PER_CLIENT, LIFETIME_S, TIMEOUT_S, RETENTION_S = 2, 3_000_000, 60, 3600


def _event_stream(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The ledger's events (submit; start a second later, but for the queued; end some seconds on) as a stream of files, two a batch, and a folder
    for results. Two ticks of a clock after all others let every deadline pass."""
    at = scratch(spark, "replay")
    x = _jobs(spark, d)
    after = lambda s: F.timestamp_add("SECOND", s, F.col("at"))
    kinds = F.array(
        F.struct(F.lit("submit").alias("kind"), F.col("at").alias("at")), F.when(F.col("status") != "queued", F.struct(F.lit("start").alias("kind"), after(F.lit(1)).alias("at"))),
        F.when(F.col("status").isin("succeeded", "failed"), F.struct(F.when(F.col("status") == "failed", "fail").otherwise("finish").alias("kind"), after(F.col("k") + 2).alias("at"))),
    )
    events = x.select("job_id", "client_key", F.explode(F.filter(kinds, lambda e: e.isNotNull())).alias("e")).select("job_id", "client_key", "e.kind", "e.at")
    tick = lambda days: (spark.createDataFrame([("clock", "clock", "clock")], "job_id string, client_key string, kind string").withColumn("at", F.to_timestamp(F.lit(f"2200-01-0{days} 00:00:00"))), "at", 1)
    S.replay_files(f"{at}/events", (events, "at", 8), tick(1), tick(2))
    return spark.readStream.schema("job_id string, client_key string, kind string, at timestamp").option("maxFilesPerTrigger", 2).parquet(f"{at}/events"), at


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return as_ledger(spark, d).select(F.col("job_id").cast("string").alias("job_id"), F.col("client_id").cast("string").alias("client_key"), "status", F.date_trunc("millisecond", F.col("created_at").cast("timestamp")).alias("at"), F.timestamp_diff("SECOND", F.col("created_at"), F.col("done_at")).cast("int").alias("k"))


_JOBS = ", jobs AS (SELECT job_id, client_id, status, date_trunc('millisecond', created_at) AS begun, date_diff('second', created_at, done_at) AS k FROM ledger)"


@query("stream_admission", _LEDGER.replace("WITH", "WITH RECURSIVE", 1) + _JOBS + f""", o AS MATERIALIZED (SELECT job_id, client_id, begun, row_number() OVER (PARTITION BY client_id ORDER BY begun, job_id::VARCHAR) AS i,
  least(begun + to_seconds({LIFETIME_S}), CASE WHEN status IN ('succeeded', 'failed') THEN begun + to_seconds(k + 2) END) AS until FROM jobs),
r AS (SELECT client_id, 0::BIGINT AS i, NULL::BIGINT AS job_id, 0::BIGINT AS open, []::TIMESTAMP[] AS held FROM (SELECT DISTINCT client_id FROM o)
UNION ALL
SELECT client_id, i, job_id, len(still)::BIGINT, CASE WHEN len(still) < {PER_CLIENT} THEN list_append(still, until) ELSE still END FROM (
  SELECT o.client_id, o.i, o.job_id, o.until, list_filter(r.held, lambda u: u > o.begun) AS still FROM r JOIN o ON o.client_id = r.client_id AND o.i = r.i + 1))
SELECT job_id::VARCHAR AS job_id, client_id::VARCHAR AS client_key, open::INT AS open, open < {PER_CLIENT} AS admitted FROM r WHERE i > 0""")
def stream_admission(spark, d):
    events, at = _event_stream(spark, d)
    rows = streams.stream_admission(events, PER_CLIENT, LIFETIME_S)
    streams.run_to_end(rows, f"{at}/out", f"{at}/check")
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


@query("stream_timeouts", _LEDGER + _JOBS + f" SELECT job_id::VARCHAR AS job_id, CASE WHEN status = 'converting' OR k + 1 > {TIMEOUT_S} THEN 'timeout' ELSE 'expired' END AS status FROM jobs WHERE status = 'converting' OR (status IN ('succeeded', 'failed') AND k + 1 > {TIMEOUT_S}) OR status = 'succeeded'")
def stream_timeouts(spark, d):
    events, at = _event_stream(spark, d)
    rows = streams.stream_timeouts(events, TIMEOUT_S, RETENTION_S)
    streams.run_to_end(rows, f"{at}/out", f"{at}/check")
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


@query("stream_capacity", _LEDGER + "SELECT status, count(*) AS n_jobs FROM ledger GROUP BY status")
def stream_capacity(spark, d):
    events, at = _event_stream(spark, d)
    streams.stream_capacity(events, f"{at}/out", f"{at}/check").awaitTermination()
    return streams.capacity_at(spark, f"{at}/out")


_SHELF = 16


@query("stream_parse", _cte(lines="shelved").replace("clean AS", f"shelved AS (SELECT book_id // {_SHELF} AS book_id, row_number() OVER (PARTITION BY book_id // {_SHELF} ORDER BY book_id, line_no)::INT AS line_no, line FROM lines),\nclean AS", 1) + "SELECT book_id, volume_ix, chapter_ix, title, md5(content_html) AS content_md5, n_paragraphs FROM chapters")
def stream_parse(spark, d):
    """The lines of sixteen books at a time as one text file, which arrive as an inbox and are parsed batch by batch."""
    at = scratch(spark, "inbox")
    lines = as_books(spark, d).withColumn("shelf", F.floor(F.col("book_id") / _SHELF))
    lines.repartition("shelf").sortWithinPartitions("shelf", "book_id", "line_no").select("shelf", F.col("line").alias("value")).write.partitionBy("shelf").text(f"{at}/in")
    streams.stream_parse(spark, f"{at}/in", f"{at}/out", f"{at}/check", RULES, "regexp_extract(path, 'shelf=([0-9]+)/', 1)", bytes_per_batch=64 << 20).awaitTermination()
    found = spark.read.schema("book_id string, volume_ix int, chapter_ix int, title string, content_html string, n_paragraphs long").parquet(f"{at}/out")
    return found.select(F.col("book_id").cast("long").alias("book_id"), "volume_ix", "chapter_ix", "title", F.md5(F.col("content_html").cast("binary")).alias("content_md5"), "n_paragraphs")


# --- Access log, addresses and names.


def as_access_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        "event_id", F.concat(F.when(F.col("user_id") % 7 == 5, "[::FFFF:10.0.0.").otherwise("10.0.0."), (F.col("user_id") % 250).cast("string"), F.when(F.col("user_id") % 7 == 5, "]:443").otherwise(":443")).alias("remote"),
        F.when(F.col("user_id") % 7 == 3, F.concat(F.lit("2001:0DB8:0:0:0:0:0:"), F.get_json_object("props", "$.k"), F.lit(", 10.1.2.3, 2001:db8:ff7f::1"))).when(F.col("user_id") % 7 == 4, "198.51.100.1:80, 10.1.2.3").when(F.col("user_id") % 7 == 0, F.concat(F.lit("2001:db8::"), F.get_json_object("props", "$.k"), F.lit(", ::ffff:10.1.2.3"))).when(F.col("user_id") % 7 == 1, F.lit(" ")).when(F.col("user_id") % 7 == 2, "10.9.9.9, 10.1.2.3")
        .otherwise(F.concat(F.lit("198.51.100."), F.get_json_object("props", "$.k"), F.lit(", 10.1.2.3"))).alias("forwarded"), F.col("event_type").alias("status"),
        F.concat(F.lit("/api/conversions/"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "/download").otherwise("")).alias("path"),
        F.floor("value").alias("duration_ms"), F.floor(F.col("value") * 10).alias("response_bytes"),
        F.when(F.col("user_id") % 3 == 0, "https://Books.example").when(F.col("user_id") % 3 == 1, "https://books.example/x").alias("origin"),
    )


@query("route_report", "SELECT CASE WHEN event_id % 2 = 0 THEN '/api/conversions/{id}/download' ELSE '/api/conversions/{id}' END AS route, event_type AS status, count(*) AS n, sum(floor(value * 10))::BIGINT AS n_bytes, sum(floor(value))::BIGINT AS total_ms, max(floor(value))::BIGINT AS longest_ms FROM events GROUP BY ALL")
def route_report(spark, d):
    return A.route_report(as_access_log(spark, d))


@query("attribute_clients", "SELECT event_id, CASE WHEN user_id % 7 IN (0, 3) THEN '2001:db8::' || ltrim(k::VARCHAR, '0') WHEN user_id % 7 = 4 THEN '10.0.0.' || (user_id % 250) WHEN user_id % 7 = 2 THEN '10.9.9.9' WHEN user_id % 7 > 2 AND k BETWEEN 0 AND 255 THEN '198.51.100.' || k ELSE '10.0.0.' || (user_id % 250) END AS client FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)")
def attribute_clients(spark, d):
    return A.attribute_clients(as_access_log(spark, d), ("10.0.0.0/8", "2001:db8:ff00::/40")).select("event_id", "client")


def _hmac_sql(value: str, key: bytes) -> str:
    inner, outer = (bytes(x ^ p for x in key.ljust(64, b"\0")).hex() for p in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}))))"


@query("pseudonymize", "SELECT event_id, " + _hmac_sql("'10.0.0.' || (user_id % 250)", b"an example key") + " AS client_key FROM events")
def pseudonymize(spark, d):
    return as_access_log(spark, d).select("event_id", A.pseudonym(A.host_of(F.col("remote")), b"an example key").alias("client_key"))


_CAUSES = [*(c for c, *_ in A.ERRORS), "odd"]


@query("error_report", "SELECT CASE k " + " ".join(f"WHEN {i} THEN {s}" for i, (_, s, *_r) in enumerate(A.ERRORS)) + " ELSE 500 END::INT AS status, CASE k " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, _s, c, _w) in enumerate(A.ERRORS)) + " ELSE 'INTERNAL_ERROR' END AS code, CASE k " + " ".join(f"WHEN {i} THEN {w}" for i, (*_r, w) in enumerate(A.ERRORS)) + f" ELSE 0 END::INT AS retry_seconds, count(*) AS n FROM (SELECT event_id % {len(_CAUSES)} AS k FROM events) GROUP BY ALL")
def error_report(spark, d):
    cause = F.element_at(F.array(*map(F.lit, _CAUSES)), (F.col("event_id") % len(_CAUSES) + 1).cast("int"))
    return A.error_report(table(spark, d, "events").select(cause.alias("cause")))


#: URLs that stand in for those of the pages by page_id, with the code that each must get.
_ODD_URLS = (
    ("https:///p", "no_host"), ("https://u:p@books.example/p", "userinfo"), ("ftp://books.example/p", "scheme"), ("https://books.example:8443/p", "port"), ("https://127.0.0.1/p", "address"),
    ("https://[::1]/p", "address"), ("https://[::ffff:10.0.0.1]/p", "address"), ("https://172.20.1.1/p", "address"), ("https://books.example:443/p", None), ("https://8.8.8.8/p", None),
    ("https://[0:0:0:0:0:0:0:1]/", "address"), ("https://[0:0:0:0:0:ffff:10.0.0.1]/", "address"), ("https://[0:0:0:0:0:FFFF:7f00:1]/", "address"), ("https://h:abc/", "invalid"), ("https://h /", "invalid"),
    ("https://255.255.255.255/", "address"), ("https://:443/p", "no_host"), ("https:books.example", "no_host"), ("https://books.example:/p", None), ("https://books.example:99999999999/", "port"),
    ("https://[2001:DB8:1::7]:443/p", None), ("https://[2001:db8::1%25eth0]/", "address"), ("https://[2001:db8::g]/", "invalid"), ("https://[::1/", "invalid"), ("https://a:b:443/", "invalid"),
    ("https://0.0.0.0/", "address"), ("https://0.1.2.3/", None), ("https://100.64.0.0/", "address"), ("https://100.128.0.0/", None), ("https://[fd12::1]/", "address"),
    ("https://[FE80:0::1]/", "address"), ("https://[ff02::1]/", "address"), ("https://224.0.0.9/", "address"), ("https://169.254.1.1/", "address"), ("https://192.168.7.7/", "address"),
    ("https://books.example/%zz", "invalid"), ("https://books.example/p?q=%zz", None), ("https://books.example/#%zz", "invalid"), ("http://10.0.0.1/", "scheme"), ("https://a{b/", "invalid"),
)


_PICK = "page_id % 50"


@query("audit_urls", f"SELECT page_id, CASE {_PICK} " + " ".join(f"WHEN {i} THEN '{u}'" for i, (u, _) in enumerate(_ODD_URLS)) + f" ELSE url END AS url, CASE WHEN {_PICK} < {len(_ODD_URLS)} THEN CASE {_PICK} " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(_ODD_URLS) if c) + " END WHEN NOT starts_with(lower(url), 'https:') THEN 'scheme' END AS reject_code FROM pages")
def audit_urls(spark, d):
    url = F.col("url")
    for i, (u, _) in enumerate(_ODD_URLS):
        url = F.when(F.col("page_id") % 50 == i, u).otherwise(url)
    return A.audit_urls(table(spark, d, "pages").select("page_id", url.alias("url")))


@query("audit_origins", "SELECT event_id, user_id % 3 <> 1 AS origin_ok FROM events")
def audit_origins(spark, d):
    return A.audit_origins(as_access_log(spark, d), "https://books.example").select("event_id", "origin_ok")


_NAME = """CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat(url, '%5Cdir%2F%E7%AC%AC+', cast(page_id AS {s}), '%0A.txt') WHEN 2 THEN concat(url, '/100%') ELSE concat(url, '%20a%2Bb%00', repeat('c', 200)) END"""


@query("clean_names", f"SELECT page_id, CASE WHEN n = '' THEN 'novel.txt' ELSE left(n, 180) END AS display_name FROM (SELECT page_id, trim(regexp_replace(regexp_extract(replace(CASE WHEN page_id % 4 = 2 THEN n ELSE url_decode(replace(n, '+', '%2B')) END, chr(92), '/'), '([^/]*)/*$', 1), '[\\x00-\\x1F\\x7F]', '', 'g')) AS n FROM (SELECT page_id, {_NAME.format(s='VARCHAR')} AS n FROM pages))")
def clean_names(spark, d):
    return A.clean_names(table(spark, d, "pages").select("page_id", F.expr(_NAME.format(s="string")).alias("name"))).select("page_id", "display_name")
