"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Every rule is a row of RULES: a measure, the least and the most value allowed, and the verdict's name. `measures()` adds
the counts as columns, `verdict()` folds the table into one boolean column. A document is kept if the base rule holds
and no row of the table is broken.

Defined cases: a null text has no words and no lines; an empty text likewise (both fail the base rule of at least ten
words). Extra columns are carried along untouched; columns of the counts replace columns of the same name.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import table

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with is in for it on was as by this from are at or an "
    "der die das und ist von zu mit den ein eine nicht auf im sich dem des als auch "
    "le la les de des et un une est que qui dans pour sur par avec au en du il elle pas ou plus "
    "el los las y del que se con por una su para es al lo como un más"
).split()


class Rule(NamedTuple):
    """`measure` must lie between `least` and `most` (either may be absent), for documents of `min_words` words or more."""

    measure: str
    least: float | None
    most: float | None
    min_words: int = 0


#: The threshold table. Ratios are of the words unless the measure says otherwise.
RULES = (
    Rule("n_words", 10, 1_000_000),
    Rule("mean_word_chars", 1.5, 20.0),
    Rule("symbol_word_ratio", None, 0.25),
    Rule("n_stop_words", 1, None, 20),
    Rule("stop_word_ratio", 0.02, None, 50),
    Rule("dup_line_ratio", None, 0.5),
)

_SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of the contract and the ratios of the table. Linear in the text but for the sort of repeated windows."""
    t = F.coalesce(F.col(text), F.lit(""))
    has_word = "[^\\x20\\x09-\\x0D]"
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),  # no column of docs stands beside those made here
        F.array_remove(F.split(t, _SPACE_RUN, -1), "").alias("_w"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(has_word)).alias("_lines"),
        F.length(_without(t, " \t\n\x0b\f\r")).cast("long").alias("_word_chars"),
        F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("_n_symbols"),
    )
    n = F.size("_w")
    # A window is five words joined by a byte that no word holds; equal strings are equal windows.
    windows = F.when(
        n >= 5,
        F.transform(
            F.sequence(F.lit(0), n - 5),
            lambda i: F.xxhash64(F.col("_w")[i], F.col("_w")[i + 1], F.col("_w")[i + 2], F.col("_w")[i + 3], F.col("_w")[i + 4]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = base.select("*", windows.alias("_g"))
    # Only texts in which some window comes twice go on: their windows are sorted with their places.
    placed = hashed.select(
        "*",
        F.when(
            F.size(F.array_distinct("_g")) < F.size("_g"),
            F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ).alias("_s"),
    )
    twice = placed.select(
        "*",
        F.when(
            F.col("_s").isNotNull(),
            F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(
                            F.col("_s"),
                            lambda x, k: F.struct(
                                x["i"].alias("i"),
                                ((F.get(F.col("_s"), k - 1)["h"].eqNullSafe(x["h"])) | (F.get(F.col("_s"), k + 1)["h"].eqNullSafe(x["h"]))).alias("again"),
                            ),
                        ),
                        lambda x: x["again"],
                    ),
                    lambda x: x["i"],
                )
            ),
        ).alias("_r"),
    )
    covered = F.when(
        F.col("_r").isNotNull(),
        F.aggregate(
            F.transform("_r", lambda x, k: F.least(F.lit(5), F.coalesce(F.get(F.col("_r"), k + 1) - x, F.lit(5)))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        ),
    ).otherwise(F.lit(0).cast("long"))
    counted = twice.select(
        "_row",
        n.cast("long").alias("n_words"),
        F.col("_word_chars").alias("word_chars"),
        F.col("_n_symbols").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    out = counted.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in _COUNTS], *counted.columns[1:])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.select(
        "*",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbol_word_ratio"),
        ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    )


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "mean_word_chars", "symbol_word_ratio", "stop_word_ratio", "dup_line_ratio")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean column over the measures: true if no row of it is broken."""
    ok = F.lit(True)
    for r in rules:
        holds = F.lit(True)
        if r.least is not None:
            holds = holds & (F.col(r.measure) >= F.lit(r.least))
        if r.most is not None:
            holds = holds & (F.col(r.measure) <= F.lit(r.most))
        ok = ok & ((F.col("n_words") < r.min_words) | holds)
    return ok


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with all measures, `base_failed` and `kept`."""
    return measures(docs).withColumns({"base_failed": base_failed(), "kept": ~base_failed() & verdict(rules)})


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns."""
    own = docs.select(F.struct("*").alias("_doc"), F.col("text").alias("text"))
    # A filter moves below the projections it reads from and would put the counts inside one another, evaluated once for
    # each element. It stays above a column that isn't deterministic; this one is always true.
    barred = apply_rules(own, rules).select("_doc", (F.col("kept") & (F.monotonically_increasing_id() >= 0)).alias("_stays"))
    return barred.filter("_stays").select("_doc.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    ok = []
    for r in RULES:
        b = [f"{r.measure} >= {r.least}"] if r.least is not None else []
        b += [f"{r.measure} <= {r.most}"] if r.most is not None else []
        ok.append(f"(n_words < {r.min_words} OR ({' AND '.join(b)}))")
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, list_aggregate(w[i:i+4], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
c AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words
  FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
q AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_word_ratio,
         CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_word_ratio,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {' AND '.join(ok)} AS kept
FROM q"""


ORACLE_SQL = _oracle()
