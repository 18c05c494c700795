"""From the ordered lines of books to their names, introductions, volumes, chapters and sections.

Everything is a window over (book_id, line_no) or a grouping by book_id, so one exchange by book_id carries the parse.

`rules` is one rule set for all books or, where books follow different ones, a dict of rule sets by the lines' column ruleset_id:
each expression then has a branch for each of them, and a line takes its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quireworks.functions import textcols as T
from quireworks.functions.rules import EMPTY, LANGUAGE, PRESETS, SPECIAL_STARTS, Rules, extend

RuleSets = Rules | dict[int, Rules]

#: The longest line taken, in bytes; a longer one fails its whole book.
LONGEST_LINE = 4 << 20
HEADINGS = ("chapter", "extra", "special")


def _book() -> WindowSpec:
    return Window.partitionBy("book_id")


def _lines() -> WindowSpec:
    return _book().orderBy("line_no")


def by_rules(rules: RuleSets, f, *fields: str) -> Column:
    """f(rules) for the rule set of a line. Rule sets with the same values of `fields`, all that f looks at, share a branch; other branches are not
    evaluated."""
    if isinstance(rules, Rules):
        return f(rules)
    alike: dict[tuple, list[int]] = {}
    for k, own in rules.items():
        alike.setdefault(tuple(getattr(own, c) for c in fields), []).append(k)
    if len(alike) == 1:
        return f(next(iter(rules.values())))
    out = F
    for ids in alike.values():
        out = out.when(F.col("ruleset_id").isin(*ids), f(rules[ids[0]]))
    return out if rules else f(EMPTY)


def longest_line(text: Column) -> Column:
    return F.array_max(F.transform(F.split(text, "\n", -1), F.octet_length))


def explode_lines(books: DataFrame, most: int = LONGEST_LINE) -> DataFrame:
    """book_id (and ruleset_id), line_no, line of books(book_id, text): split at line feeds, one carriage return at a line's end dropped.
    A line of more than `most` bytes fails its whole book, which has no lines here; see overlong_books."""
    own = ["book_id", *(c for c in books.columns if c == "ruleset_id")]
    line = F.transform(F.split("text", "\n", -1), lambda x: F.when(x.endswith("\r"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))
    return books.filter(longest_line(F.col("text")) <= most).select(*own, F.posexplode(line).alias("line_no", "line"))


def overlong_books(books: DataFrame, most: int = LONGEST_LINE) -> DataFrame:
    """book_id, longest, parse_error of the books(book_id, text) that an overlong line fails."""
    x = books.select("book_id", longest_line(F.col("text")).alias("longest")).filter(F.col("longest") > most)
    return x.withColumn("parse_error", F.lit("line too long"))


def normalize_lines(lines: DataFrame) -> DataFrame:
    """Lines trimmed of Unicode white space, blank ones dropped."""
    return lines.withColumn("line", T.trim(F.col("line"))).filter("line <> ''")


def is_noise(line: Column, rules: RuleSets) -> Column:
    """Whether an ignored pattern matches or an ignored word is in the line. Where lines follow different rule sets, each pattern is tried once, for
    the rule sets that have it."""
    sets = {0: rules} if isinstance(rules, Rules) else rules
    found = F.lit(False)
    for field, test in (("ignored_patterns", T.matches), ("ignored_contains", lambda c, k: F.contains(c, F.lit(k)))):
        holders: dict[str, list[int]] = {}
        for k, own in sets.items():
            for x in dict.fromkeys(getattr(own, field)):
                holders.setdefault(x, []).append(k)
        for x, ids in holders.items():
            found = found | (test(line, x) if len(ids) == len(sets) else F.coalesce(F.col("ruleset_id").isin(*ids), F.lit(False)) & test(line, x))
    return found


def drop_noise(lines: DataFrame, rules: RuleSets) -> DataFrame:
    return lines.filter(~is_noise(F.col("line"), rules))


def noise_lines(lines: DataFrame, rules: RuleSets) -> DataFrame:
    return lines.filter(is_noise(F.col("line"), rules))


def kind_of(line: Column, rules: RuleSets) -> Column:
    """volume, chapter, extra, special or body; the first that holds."""

    def own(r: Rules) -> Column:
        special = line.isin(*r.special_titles)
        for s in SPECIAL_STARTS:
            special = special | line.startswith(s)
        return F.when(T.matches(line, r.volume), "volume").when(T.matches(line, r.chapter), "chapter").when(T.matches(line, r.extra), "extra").when(special, "special").otherwise("body")

    return by_rules(rules, own, "volume", "chapter", "extra", "special_titles")


def classify_lines(lines: DataFrame, rules: RuleSets) -> DataFrame:
    return lines.withColumn("kind", kind_of(F.col("line"), rules))


def with_name_author(lines: DataFrame, rules: RuleSets, name: str = "", author: str = "") -> DataFrame:
    """lines with name, author and the lines they come from, in the closed form of a first-match scan.

    The inline pattern (name and author on one line) wins over the title on its line; a title line can't be the author's."""
    line = F.col("line")
    inline_name, inline_author = (by_rules(rules, lambda r, k=k: T.capture_two(line, r.title_author)[k], "title_author") for k in (0, 1))
    name, author = name.strip(), author.strip()
    x = lines.withColumns({"_in": inline_name, "_ia": inline_author, "_t": by_rules(rules, lambda r: T.capture(line, r.title), "title"), "_a": by_rules(rules, lambda r: T.capture(line, r.author), "author")})
    at = lambda c: F.min(F.when(c, F.col("line_no"))).over(_book())
    first = F.lit(None).cast("int")
    x = x.withColumns({"_i1": at(F.col("_in").isNotNull()), "_t1": first if name else at(F.col("_t").isNotNull() & F.col("_in").isNull())})
    x = x.withColumn("_tl", F.when(F.col("_i1").isNull() | (F.col("_t1") < F.col("_i1")), F.col("_t1")))
    x = x.withColumn("_a1", first if author else at(F.col("_a").isNotNull() & F.col("_in").isNull() & ~F.col("line_no").eqNullSafe(F.col("_tl"))))
    x = x.withColumns({"name_line": first if name else F.least("_i1", "_t1"), "author_line": first if author else F.least("_i1", "_a1")})
    value = lambda line_no, inline, own: F.max(F.when(F.col("line_no") == F.col(line_no), F.coalesce(inline, own))).over(_book())
    x = x.withColumns({"name": F.lit(name) if name else value("name_line", F.col("_in"), F.col("_t")), "author": F.lit(author) if author else value("author_line", F.col("_ia"), F.col("_a"))})
    return x.select(*lines.columns, "name", "author", "name_line", "author_line")


def unnamed(lines: DataFrame) -> DataFrame:
    """The lines that neither the name nor the author used up."""
    no = F.col("line_no")
    return lines.filter(~(no.eqNullSafe(F.col("name_line")) | no.eqNullSafe(F.col("author_line"))))


def joined(c: str, by: str, sep: str = "\n") -> Column:
    """An aggregate: the values of c that aren't null, in the order of `by`."""
    return F.expr(f"listagg({c}, '{sep}') WITHIN GROUP (ORDER BY {by})")


def with_intro(lines: DataFrame, rules: RuleSets) -> DataFrame:
    """lines(book_id, line_no, line, kind) with intro_part, the line's share of its book's introduction, and used, whether the line was taken
    for it; see introductions. A line whose kind is null is passed over.

    A prefix opens a stretch that ends at the next heading without one; the first stretch with text is the introduction. All is running sums
    and one minimum a book, so no row holds more than its own line."""
    there = F.col("kind").isNotNull()
    x = lines.withColumn("_p", F.when(there, by_rules(rules, lambda r: T.strip_prefix(F.col("line"), r.intro_prefixes), "intro_prefixes")))
    x = x.withColumn("_seg", F.sum(F.when(F.col("_p").isNull() & there & (F.col("kind") != "body"), 1).otherwise(0)).over(_lines()))
    x = x.withColumn("_member", F.coalesce(F.max(F.when(F.col("_p").isNotNull(), F.col("_seg"))).over(_lines()) == F.col("_seg"), F.lit(False)) & there)
    x = x.withColumn("_text", F.when(F.col("_member"), F.nullif(F.coalesce("_p", "line"), F.lit(""))))
    x = x.withColumn("_first", F.min(F.when(F.col("_text").isNotNull(), F.col("_seg"))).over(_book()))
    x = x.withColumns({"intro_part": F.when(F.col("_seg") == F.col("_first"), F.col("_text")), "used": F.col("_member") & (F.col("_first").isNull() | (F.col("_seg") <= F.col("_first")))})
    return x.select(*lines.columns, "intro_part", "used")


def introductions(lines: DataFrame) -> DataFrame:
    """book_id, intro of the books that have one, from the lines of with_intro."""
    return lines.filter("intro_part is not null").groupBy("book_id").agg(joined("intro_part", "line_no").alias("intro"))


def numbered(lines: DataFrame) -> DataFrame:
    """lines(book_id, line_no, line, kind) with volume_ix and chapter_ix; -1 before the first of its kind. A line whose kind is null counts for nothing.

    Chapters before the first volume line live in an anonymous volume, which shifts the numbers of the others. A chapter's number is the
    headings up to it less those up to its volume's line: one order of lines carries both numbers."""
    heading, volume = F.coalesce(F.col("kind").isin(*HEADINGS), F.lit(False)), F.coalesce(F.col("kind") == "volume", F.lit(False))
    x = lines.withColumns({"_v": F.sum(volume.cast("int")).over(_lines()), "_h": F.sum(heading.cast("int")).over(_lines())})
    x = x.withColumns({"_anon": F.max((heading & (F.col("_v") == 0)).cast("int")).over(_book()), "_before": F.coalesce(F.max(F.when(volume, F.col("_h"))).over(_lines()), F.lit(0))})
    return x.withColumns({"volume_ix": (F.col("_v") + F.col("_anon") - 1).cast("int"), "chapter_ix": (F.col("_h") - F.col("_before") - 1).cast("int")}).drop("_v", "_h", "_anon", "_before")


def parsed(lines: DataFrame, rules: RuleSets, name: str = "", author: str = "") -> DataFrame:
    """All steps on lines(book_id, line_no, line, more) with nothing dropped: name, author, kind, intro_part, volume_ix, chapter_ix. kind is null where
    the line is null or noise, or went into the name, the author or the introduction. A book without lines may have one row with a null line.

    As every row stays and every step is a window by book, any grouping by book that follows needs no further exchange and no join."""
    line = F.col("line")
    x = with_name_author(lines.withColumn("line", F.when(~is_noise(line, rules), line)), rules, name, author)
    taken = F.col("line_no").eqNullSafe(F.col("name_line")) | F.col("line_no").eqNullSafe(F.col("author_line"))
    x = with_intro(x.withColumn("kind", F.when(line.isNotNull() & ~taken, kind_of(line, rules))).drop("name_line", "author_line"), rules)
    return numbered(x.withColumn("kind", F.when(~F.col("used"), F.col("kind"))).drop("used"))


def book_summaries(lines: DataFrame) -> DataFrame:
    """A row a book of parsed lines: name, author, intro, n_volumes, n_chapters, n_paragraphs, n_chars (of the chapters' HTML); with ruleset_id if the
    lines have it."""
    own = ["book_id", *(c for c in lines.columns if c == "ruleset_id")]
    body, heading = (F.col("kind") == "body") & (F.col("chapter_ix") >= 0), F.col("kind").isin(*HEADINGS)
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0)).cast("long")
    volumes = n(F.col("kind") == "volume") + F.coalesce(F.max((heading & (F.col("volume_ix") == 0)).cast("long")) * F.min(F.when(F.col("kind") == "volume", F.col("volume_ix")).otherwise(1)), F.lit(0))
    return lines.groupBy(*own).agg(
        F.max("name").alias("name"), F.max("author").alias("author"), joined("intro_part", "line_no").alias("intro"), volumes.cast("long").alias("n_volumes"), n(heading).alias("n_chapters"),
        n(body).alias("n_paragraphs"), F.coalesce(F.sum(F.when(body, F.length(paragraph(F.col("line"))).cast("long"))), F.lit(0)).alias("n_chars"),
    )


def paragraph(line: Column) -> Column:
    return F.concat(F.lit('<p style="text-indent: 2em;">'), T.escaped(line), F.lit("</p>\n"))


def assemble_chapters(lines: DataFrame) -> DataFrame:
    """book_id, volume_ix, chapter_ix, title, content_html, n_paragraphs; chapters without paragraphs stay."""
    own = lines.filter((F.col("volume_ix") >= 0) & (F.col("chapter_ix") >= 0) & (F.col("kind") != "volume"))
    body = F.col("kind") == "body"
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(body, F.struct("line_no", paragraph(F.col("line")).alias("h"))))), lambda x: x["h"]), "")
    keys = ["book_id", *(c for c in lines.columns if c == "ruleset_id")]
    return own.groupBy(*keys, "volume_ix", "chapter_ix").agg(F.max(F.when(~body, F.col("line"))).alias("title"), html.alias("content_html"), F.sum(body.cast("long")).alias("n_paragraphs"))


def assemble_volumes(lines: DataFrame) -> DataFrame:
    """book_id, volume_ix, title ("" for the anonymous volume), n_chapters."""
    own = lines.filter((F.col("volume_ix") >= 0) & (F.col("kind") != "body"))
    return own.groupBy("book_id", "volume_ix").agg(F.coalesce(F.max(F.when(F.col("kind") == "volume", F.col("line"))), F.lit("")).alias("title"), F.sum(F.col("kind").isin(*HEADINGS).cast("long")).alias("n_chapters"))


def unparsed_books(books: DataFrame, volumes: DataFrame) -> DataFrame:
    return books.select("book_id").distinct().join(volumes, "book_id", "left_anti")


def derive_intro(chapters: DataFrame, rules: RuleSets) -> DataFrame:
    """book_id, intro: the text of the first chapter whose title the intro pattern matches, tags off, trimmed, entities as they are."""
    first = F.min_by("content_html", F.struct("volume_ix", "chapter_ix"))
    return chapters.filter(by_rules(rules, lambda r: T.matches(F.col("title"), r.intro), "intro")).groupBy("book_id").agg(T.trim(T.strip_tags(first)).alias("intro"))


def book_metadata(lines: DataFrame, rules: RuleSets, name: str = "", author: str = "") -> DataFrame:
    """name, author, intro, lang of every book of lines(book_id, stem, line_no, line), a book without lines having one row with a null line.

    The stem stands in for a missing name. Where no prefix gave an introduction, the text of the first chapter whose title the intro pattern
    matches does, tags off, trimmed, entities as they are: the body lines below that heading and above the next. One grouping takes all of it."""
    x = parsed(lines, rules, name, author)
    heading = F.coalesce(F.col("kind") != "body", F.lit(False))
    x = x.withColumn("_at", F.sum(heading.cast("int")).over(_lines()))
    own = F.col("kind").isin(*HEADINGS) & by_rules(rules, lambda r: T.matches(F.col("line"), r.intro), "intro")
    x = x.withColumn("_intro_at", F.min(F.when(own, F.col("_at"))).over(_book()))
    x = x.withColumn("_derived", F.when((F.col("kind") == "body") & (F.col("_at") == F.col("_intro_at")), paragraph(F.col("line"))))
    clean = lambda c: F.nullif(T.trim(F.col(c)), F.lit(""))
    found = x.groupBy("book_id").agg(F.max("stem").alias("stem"), F.max("name").alias("name"), F.max("author").alias("author"), joined("intro_part", "line_no").alias("said"), joined("_derived", "line_no", "").alias("derived"))
    intro = F.coalesce(F.nullif(F.col("said"), F.lit("")), T.trim(T.strip_tags(F.col("derived"))), F.lit(""))
    return found.select("book_id", F.coalesce(clean("name"), "stem").alias("name"), F.coalesce(clean("author"), F.lit("")).alias("author"), intro.alias("intro"), F.lit(LANGUAGE).alias("lang"))


def assemble_sections(lines: DataFrame) -> DataFrame:
    """book_id, seq, file_name, parent_file, title, body in reading order: volumes and chapters from one grouping of lines(book_id, line_no,
    line, kind, volume_ix, chapter_ix). A volume's own line is alone with chapter_ix -1; body lines before a first chapter belong to nothing."""
    body = F.col("kind") == "body"
    own = lines.filter((F.col("volume_ix") >= 0) & ((F.col("chapter_ix") >= 0) | (F.col("kind") == "volume")))
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(body, F.struct("line_no", paragraph(F.col("line")).alias("h"))))), lambda x: x["h"]), "")
    units = own.groupBy("book_id", "volume_ix", "chapter_ix").agg(F.max(F.when(~body, F.col("line"))).alias("title"), html.alias("html"))
    volume, order = Window.partitionBy("book_id", "volume_ix"), Window.partitionBy("book_id").orderBy("volume_ix", "chapter_ix")
    head = F.col("chapter_ix") < 0
    stem = F.concat(F.lit("volume"), F.col("volume_ix").cast("string"))
    x = units.withColumns({"_named": F.max(head).over(volume), "seq": F.row_number().over(order)})
    tag = lambda name: F.concat(F.lit(f"<{name}>"), T.escaped(F.col("title")), F.lit(f"</{name}>"))
    return x.select(
        "book_id", "seq",
        F.concat(stem, F.when(head, "").otherwise(F.concat(F.lit("_chapter"), F.col("chapter_ix").cast("string"))), F.lit(".xhtml")).alias("file_name"),
        F.when(F.col("_named") & ~head, F.concat(stem, F.lit(".xhtml"))).otherwise("").alias("parent_file"),
        "title", F.when(head, tag("h1")).otherwise(F.concat(tag("h2"), F.col("html"))).alias("body"),
    )


def toc(sections: DataFrame) -> DataFrame:
    """book_id, file_name, seq, title, children: the top level of the contents with what is under each entry, in order."""
    under = F.col("parent_file") != ""
    entry = F.when(under, F.col("parent_file")).otherwise(F.col("file_name")).alias("file_name")
    own = lambda c: F.max(F.when(~under, F.col(c))).alias(c)
    children = F.transform(F.array_sort(F.collect_list(F.when(under, F.struct("seq", "title")))), lambda x: x["title"])
    return sections.groupBy("book_id", entry).agg(own("seq"), own("title"), children.alias("children"))


def _preset_tests(line: Column) -> list[tuple]:
    """(preset, why, points, whether the line has it) of each keyword and pattern."""
    tests = [(p, f"keyword:{k}", 1, F.contains(line, F.lit(k))) for p in PRESETS.values() for k in dict.fromkeys(p.keywords)]
    return tests + [(p, f"pattern:{r}", 2, T.matches(line, r)) for p in PRESETS.values() for r in dict.fromkeys(p.patterns)]


def detect_presets(lines: DataFrame, first: int = 400) -> DataFrame:
    """book_id, name, score, reasons of each preset that the first lines of a book fit; lines trimmed, none blank."""
    head = lines.withColumn("_k", F.row_number().over(_lines())).filter(F.col("_k") <= first)
    tests = _preset_tests(F.col("line"))
    hits = head.groupBy("book_id").agg(*[F.max(c).alias(f"_h{i}") for i, (*_, c) in enumerate(tests)])
    rows = []
    for p in PRESETS.values():
        own = [(i, w, why) for i, (q, why, w, _) in enumerate(tests) if q is p]
        score = sum((F.when(F.col(f"_h{i}"), w).otherwise(0) for i, w, _ in own), F.lit(0))
        why = F.filter(F.array(*[F.when(F.col(f"_h{i}"), F.lit(s)) for i, _, s in own]), lambda x: x.isNotNull())
        rows.append(F.struct(F.lit(p.name).alias("name"), score.cast("int").alias("score"), why.alias("reasons"), F.lit(p.least).alias("least")))
    each = hits.select("book_id", F.explode(F.array(*rows)).alias("d"))
    return each.filter("d.score >= d.least").select("book_id", "d.name", "d.score", "d.reasons")


def with_detected(lines: DataFrame, first: int = 400) -> DataFrame:
    """lines(book_id, line_no, line; null lines count for nothing) with ruleset_id, the mask of preset_rules that says which presets the first lines
    of the book fit. What detect_presets scores in a grouping is a window here, so the parse goes on in the same partitions."""
    there = F.col("line").isNotNull()
    x = lines.withColumn("_head", there & (F.sum(there.cast("int")).over(_lines()) <= first))
    tests = _preset_tests(F.col("line"))
    hits = [F.when(F.max(F.when(F.col("_head"), c)).over(_book()), w).otherwise(0) for *_, w, c in tests]
    mask = F.lit(0)
    for i, p in enumerate(PRESETS.values()):
        score = sum((h for h, (q, *_) in zip(hits, tests) if q is p), F.lit(0))
        mask = mask + F.when(score >= p.least, 1 << i).otherwise(0)
    return x.withColumn("ruleset_id", mask.cast("int")).drop("_head")


def assign_rulesets(books: DataFrame, rulesets: DataFrame, default: str) -> DataFrame:
    """books(book_id, channel) with ruleset_id, and rule_error where the channel asked for isn't there. How rulesets are joined is left to Spark, which
    knows their size."""
    asked = books.withColumn("_c", F.coalesce(F.nullif(F.lower(T.trim(F.col("channel"))), F.lit("")), F.lit(default.lower())))
    known = rulesets.select(F.lower("channel").alias("_c"), "ruleset_id")
    return asked.join(known, "_c", "left").withColumn("rule_error", F.when(F.col("ruleset_id").isNull(), F.concat(F.lit("unknown channel "), F.col("_c")))).drop("_c")


def preset_rules(base: Rules = Rules()) -> dict[int, Rules]:
    """Rule sets by mask: base extended by the presets whose bits are set, in the order of their names' list."""
    out = {}
    for mask in range(1 << len(PRESETS)):
        own = base
        for i, p in enumerate(PRESETS.values()):
            if mask >> i & 1:
                own = extend(own, p.rules)
        out[mask] = own
    return out


def detected_mask(books: DataFrame, applied: DataFrame) -> DataFrame:
    """books with ruleset_id, the mask of preset_rules for what applied(book_id, applied) names."""
    mask = sum((F.when(F.array_contains("applied", name), 1 << i).otherwise(0) for i, name in enumerate(PRESETS)), F.lit(0))
    return books.join(applied.select("book_id", mask.cast("int").alias("ruleset_id")), "book_id")


def apply_detected(books: DataFrame, detections: DataFrame, mode: str, named: bool = False) -> DataFrame:
    """book_id, suggested, applied: preset names of each book, best first; they take effect in mode apply, and not where a preset was named."""
    mode = mode if mode in ("off", "apply") else "suggest"
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "name")))
    found = detections.groupBy("book_id").agg(F.transform(order, lambda x: x["name"]).alias("_n"))
    none = F.array().cast("array<string>")
    names = none if named or mode == "off" else F.coalesce("_n", none)
    return books.select("book_id").join(found, "book_id", "left").select("book_id", names.alias("suggested"), (names if mode == "apply" else none).alias("applied"))
