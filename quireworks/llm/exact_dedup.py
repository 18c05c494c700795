"""Exact dedup by content sort, in DataFrame operations only.

Texts are normalised (runs of space and U+0009 to U+000D become one space) and range-partitioned by their first bytes and a hash:
Spark samples the splitters, which are short whatever the texts, sorts each range externally by these and the whole text, and the window over
adjacent rows compares neighbours in full. The smallest doc_id of a run of equal texts stays; rows carry their doc_id through the sort.

A text with more copies than a share of a partition would pull all of them into one range. Such texts are counted
beforehand by their hash, and there can be no more than rows / threshold of them. Their copies get a salt from the doc_id as a third range key, as
many salts as they have shares, so the splitters cut through the run; the runs of one text, one row a salt, are merged afterwards. The list of
such texts is broadcast if it has BROADCAST_ROWS rows or less, and joined by a shuffle, whose skew Spark splits, beyond that.

Defined cases: null counts as empty; a null doc_id sorts last within its run and names a group only if all its doc_ids
are null; rows repeated with one doc_id are all returned and all count. Extra columns are ignored, or carried by
`filter_documents`, whatever their names; of several rows with the doc_id that stays it returns one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireworks.llm.common import materialised, pieces_for, table

#: Characters of a text in the range key.
PREFIX = 16
#: Bytes of text in a range.
RANGE_BYTES = 24 << 20
#: A text is dealt over ranges if it has more copies than this, and more than a quarter of a mean range.
LEAST_HOT = 64
#: Rows of 17 to 90 bytes up to which the list of such texts is broadcast.
BROADCAST_ROWS = 500_000


def normalised(text: Column) -> Column:
    """Runs of white space as one space. Plain replaces first: most texts then need no regular expression."""
    t = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\f\r":
        t = F.replace(t, F.lit(c), F.lit(" "))
    return F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t)


def _sorted(docs: DataFrame, carry: Column, range_bytes: int, least_hot: int) -> tuple[DataFrame, int]:
    """doc_id, norm, h, hot, `carry` as row, and of each run of equal texts: at (place in it), least (its smallest doc_id), n (its rows).
    Runs of a hot text are one a salt. Also how many texts are hot."""
    of = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("n")).first()
    n_ranges = pieces_for(of["bytes"] or 0, range_bytes)
    hot_from = max(least_hot, of["n"] // (4 * n_ranges))
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm"), carry.alias("row")).withColumn("h", F.xxhash64("norm"))
    hot = materialised(rows.groupBy("h").agg(F.count("*").alias("copies")).filter(F.col("copies") > hot_from), "hot")
    n_hot = hot.count()
    salt = F.when(F.col("copies").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("copies") / hot_from)) + 1)
    known = rows.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, "h", "left")
    keyed = known.select("doc_id", "norm", "row", "h", F.col("copies").isNotNull().alias("hot"), salt.alias("salt"), F.left("norm", F.lit(PREFIX)).alias("prefix"))
    run = Window.partitionBy("prefix", "h", "norm", "salt")
    first = run.orderBy(F.col("doc_id").asc_nulls_last())
    ordered = keyed.repartitionByRange(n_ranges, "prefix", "h", "salt")
    return ordered.select("doc_id", "norm", "row", "h", "hot", F.row_number().over(first).alias("at"), F.first("doc_id").over(first).alias("least"), F.count("*").over(run).alias("n")), n_hot


def groups_of(docs: DataFrame, range_bytes: int = RANGE_BYTES, least_hot: int = LEAST_HOT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs(doc_id, text)."""
    found, n_hot = _sorted(docs.select("doc_id", "text"), F.lit(None).cast("int"), range_bytes, least_hot)
    found = found.select("doc_id", "hot", "at", "least", "n", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    keep, size = F.col("least"), F.col("n")
    if n_hot:
        found = materialised(found, "runs")  # without the texts
        merged = found.filter("hot and at = 1").groupBy("text_sha256").agg(F.min("least").alias("all_least"), F.sum("n").alias("all_n"))
        found = found.join(F.broadcast(merged) if n_hot <= BROADCAST_ROWS else merged, "text_sha256", "left")
        keep, size = F.when(F.col("hot"), F.col("all_least")).otherwise(keep), F.when(F.col("hot"), F.col("all_n")).otherwise(size)
    # Of rows repeated with one doc_id all are returned; `kept` tells the doc_id that stays.
    return found.select("doc_id", keep.alias("keep_id"), size.cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def filter_documents(docs: DataFrame, range_bytes: int = RANGE_BYTES, least_hot: int = LEAST_HOT) -> DataFrame:
    """One row of docs for each normalised text: one of the smallest doc_id, with docs' own columns."""
    found, n_hot = _sorted(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), range_bytes, least_hot)
    first = found.filter("at = 1")
    if not n_hot:
        return first.select("row.*")
    again = Window.partitionBy("h", "norm").orderBy(F.col("doc_id").asc_nulls_last())
    # One row a salt of each hot text.
    merged = first.filter("hot").withColumn("at", F.row_number().over(again)).filter("at = 1")
    return first.filter("not hot").select("row.*").unionByName(merged.select("row.*"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups_of(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW w AS (PARTITION BY t)"""
