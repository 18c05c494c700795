"""Whole text files as rows, their intake checks and their decoding; the job ledger as a table; images for covers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
MAX_UPLOAD, MAX_COVER, MAX_PIXELS = 20 << 20, 5 << 20, 25_000_000
JOB = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "owner_hash", "client_key", "original_name", "status", "output_name", "error_code")]
    + [T.StructField(n, T.LongType()) for n in ("input_size", "output_size", "queue_position")]
    + [T.StructField(n, T.TimestampType()) for n in ("created_at", "completed_at", "expires_at", "purge_at")]
)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return with_stem(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path))


def stream_corpus(spark: SparkSession, path: str, files_per_batch: int | None = None, bytes_per_batch: int | None = None) -> DataFrame:
    """New files of an inbox and its folders, each taken once, in batches of at most so many files or bytes (not both). A batch has a cost of its own, so
    small files are better taken by bytes."""
    reader = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true")
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return with_stem((reader.option("maxBytesPerTrigger", bytes_per_batch) if bytes_per_batch else reader).load(path))


def with_stem(files: DataFrame) -> DataFrame:
    return files.withColumn("stem", F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), "\\.[^.]*$", ""))


def intake_gate(files: DataFrame, most: int = MAX_UPLOAD) -> DataFrame:
    """files(path, content) with reject_code, null where accepted; the first test that fails decides."""
    c = F.col("content")
    code = (
        F.when(~F.lower("path").endswith(".txt"), "not_txt").when(c.isNull() | (F.octet_length(c) == 0), "empty").when(F.octet_length(c) > most, "too_large")
        .when(F.expr("position(X'00' IN substring(content, 1, 8192)) > 0"), "binary")
    )
    return files.withColumn("reject_code", code)


def cover_gate(images: DataFrame, most: int = MAX_COVER, pixels: int = MAX_PIXELS) -> DataFrame:
    """images(content) with format and reject_code; only PNG tells its size here."""
    head = F.hex(F.substring("content", 1, 24))
    fmt = F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg")
    number = lambda at: F.conv(F.substring(head, at, 8), 16, 10).cast("decimal(20,0)")
    code = (
        F.when(F.col("content").isNull() | (F.octet_length("content") == 0), "empty").when(F.octet_length("content") > most, "too_large").when(fmt.isNull(), "format")
        .when((fmt == "png") & (number(33) * number(41) > pixels), "pixels")
    )
    return images.withColumns({"format": fmt, "reject_code": code})


@F.pandas_udf(T.StringType())
def _gb18030(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("gb18030", errors="replace"))


def decode_corpus(files: DataFrame, encoding: str = "auto") -> DataFrame:
    """files(content) with text, encoding, decode_error. auto: a UTF-8 mark, else valid UTF-8, else GB18030, whose bytes alone go through Python; files
    are read once. A null content counts as GB18030 with a null text."""
    encoding = encoding.lower()
    if encoding not in ("auto", "utf-8", "gbk", "gb18030"):
        raise ValueError(f"unknown encoding {encoding!r}")
    c, s = F.col("content"), F.col("content").cast("string")
    if encoding in ("gbk", "gb18030"):
        return files.withColumns({"text": _gb18030(c), "encoding": F.lit(encoding), "decode_error": F.lit(None).cast("string")}).drop("content")
    marked, valid = F.hex(F.substring(c, 1, 3)) == "EFBBBF", F.is_valid_utf8(s)
    if encoding == "utf-8":
        return files.withColumns({"text": F.when(valid, s), "encoding": F.lit("utf-8"), "decode_error": F.when(~valid, "invalid utf-8")}).drop("content")
    kind = F.when(marked, "utf-8-bom").when(valid, "utf-8").otherwise("gb18030")
    plain = F.when(marked, F.make_valid_utf8(F.substring(c, 4, 1 << 30).cast("string"))).when(valid, s)
    other = _gb18030(F.when(~marked & ~valid, c))  # null, and so nothing to send to Python, for all other files
    return files.withColumns({"text": F.coalesce(plain, other), "encoding": kind, "decode_error": F.lit(None).cast("string")}).drop("content")


def encoding_census(decoded: DataFrame) -> DataFrame:
    return decoded.groupBy("encoding").agg(F.count("*").alias("n_books"), F.sum(F.octet_length("text").cast("long")).alias("n_bytes"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One record a job folder; records that can't be read whole, a field of another type included, or whose id isn't the folder's name, are
    left out."""
    rows = spark.read.schema(T.StructType([*JOB, T.StructField("_corrupt", T.StringType())])).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]*$", 1)
    return rows.filter(F.col("_corrupt").isNull() & (F.col("id") == F.try_url_decode(folder))).drop("_corrupt")


def replay_files(path: str, *parts: tuple[DataFrame, str, int]) -> None:
    """Tables as files of a stream: each (rows, column of time, number of files) is dealt by ranges of time over so many files, and all files get times of
    modification in that order, which is the order in which a file source takes them. The file system has to keep times."""
    spark = parts[0][0].sparkSession
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(context._jsc.hadoopConfiguration())
    began, done = context._jvm.System.currentTimeMillis() - 3_600_000, set()
    for rows, time, n in parts:
        rows.repartitionByRange(n, time).sortWithinPartitions(time).write.mode("append").parquet(path)
        for name in sorted({f.getPath().getName() for f in fs.listStatus(at)} - done):
            fs.setTimes(context._jvm.org.apache.hadoop.fs.Path(at, name), began + 1000 * len(done), -1)
            done.add(name)


def output_names(books: DataFrame, safe: Column, stem: Column) -> DataFrame:
    """books with output_name and collides, whether another book gets the same."""
    from pyspark.sql import Window

    name = F.concat(F.coalesce(F.nullif(safe, F.lit("")), F.nullif(stem, F.lit("")), F.lit("book")), F.lit(".epub"))
    return books.withColumn("output_name", name).withColumn("collides", F.count("*").over(Window.partitionBy("output_name")) > 1)


def write_sections(sections: DataFrame, path: str, buckets: int = 64) -> None:
    sections.withColumn("bucket", F.pmod(F.xxhash64("book_id"), F.lit(buckets)).cast("int")).repartition(buckets, "bucket").sortWithinPartitions("bucket", "book_id", "seq").write.partitionBy("bucket").mode("overwrite").parquet(path)


def zip_book(pdf: pd.DataFrame) -> bytes:
    """The sections of one book as a zip of XHTML files; the default packer."""
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        for name, body in zip(pdf["file_name"], pdf["body"]):
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def write_folders(rows: DataFrame, key: str, path: str, each: int = 500) -> None:
    """rows(value and the key) as text, a folder for each value of the key. What a folder costs is time, not bytes, so tasks are dealt by rows, `each` on
    average, and move their own folders into place; the path must be a fresh one that is read after the write has ended."""
    parts = max(1, -(-rows.count() // each))
    rows.repartition(parts, key).sortWithinPartitions(key).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(key).text(path)


def _by_book(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one book after another, from rows in the order of their books."""
    pieces: list[pd.DataFrame] = []
    for pdf in batches:
        ids = pdf["book_id"].to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            own = pdf.iloc[a:b]
            if pieces and (a or pieces[0]["book_id"].iloc[0] != ids[0]):
                yield pd.concat(pieces) if len(pieces) > 1 else pieces[0]
                pieces = []
            if len(own):
                pieces.append(own)
    if pieces:
        yield pd.concat(pieces)


def package_books(sections: DataFrame, books: DataFrame, pack=zip_book) -> DataFrame:
    """book_id, output_name, package, size, n_entries, valid: one archive for each of books(book_id, output_name) that has sections. A book is
    bounded by the intake's size limit; books run through a task one after another, as a call of Spark for each costs more than its archive."""
    columns = ["book_id", "output_name", "package", "size", "n_entries", "valid"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        rows, held = [], 0
        for pdf in _by_book(batches):
            raw = pack(pdf)
            try:
                n = len(zipfile.ZipFile(io.BytesIO(raw)).namelist())
            except zipfile.BadZipFile:
                n = 0
            rows.append((pdf["book_id"].iloc[0], pdf["output_name"].iloc[0], raw, len(raw), n, n > 0))
            held += len(raw)
            if held > 16 << 20 or len(rows) >= 1000:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
        yield pd.DataFrame(rows, columns=columns)

    own = sections.select("book_id", "seq", "file_name", "body").join(books.select("book_id", "output_name"), "book_id")
    kind = dict(sections.dtypes)["book_id"]
    return own.repartition("book_id").sortWithinPartitions("book_id", "seq").mapInPandas(run, f"book_id {kind}, output_name string, package binary, size bigint, n_entries bigint, valid boolean")


def verify_packages(books: DataFrame, packages: DataFrame) -> DataFrame:
    """The books that have no valid package."""
    return books.select("book_id").join(packages.filter("valid"), "book_id", "left_anti")
