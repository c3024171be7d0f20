"""Readers and writers for books, pages, chunks, question files and results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.functions.text import clean_board_text
from folioscope.operators.chapters import starts_by_file
from folioscope.plans.scale import bound_batches

PageDecoder = Callable[[bytes], list[str]]
GridDecoder = Callable[[bytes], list[list[list[list[str | None]]]]]

FILE_NAME = r"(?U)\A(\S+) (\S+) (\S+) (\S+) Year (\d+)\.(\w+)\z"


def pdf_page_texts(data: bytes) -> list[str]:
    """Text of each page of a PDF, through pdfplumber where it is installed."""
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        return [page.extract_text() or "" for page in pdf.pages]


def pdf_page_grids(data: bytes) -> list[list[list[list[str | None]]]]:
    """Tables of each page of a PDF, through pdfplumber where it is installed."""
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        return [page.extract_tables() or [] for page in pdf.pages]


def book_files(spark: SparkSession, directory: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a directory as ``filename, content``; a missing directory is an error.

    File contents are read in the tasks; a file is one record of at most 2 GB.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def decode_pages(files: DataFrame, decode: PageDecoder = pdf_page_texts) -> DataFrame:
    """``filename, page_texts``: one row per file, decoded once for all later uses; a task holds a few megabytes of files, or one file."""
    bound_batches(files.sparkSession)

    @F.pandas_udf("array<string>")
    def pages(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda data: decode(bytes(data)))

    return files.select("filename", pages("content").alias("page_texts"))


def decode_grids(files: DataFrame, decode: GridDecoder = pdf_page_grids) -> DataFrame:
    """``filename, page_index, table_ix, rows``: one row per table."""
    bound_batches(files.sparkSession)

    @F.pandas_udf("array<array<array<array<string>>>>")
    def grids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda data: decode(bytes(data)))

    pages = files.select("filename", F.posexplode_outer(grids("content")).alias("page_index", "_tables"))
    tables = pages.select(
        "filename", F.col("page_index").cast("long").alias("page_index"), F.posexplode_outer("_tables").alias("table_ix", "rows")
    )
    return tables.where(F.col("rows").isNotNull()).withColumn("table_ix", F.col("table_ix").cast("long"))


def page_rows(decoded: DataFrame) -> DataFrame:
    """One row per page: ``book_id, filename, page_index, text``."""
    rows = decoded.select("filename", F.posexplode_outer("page_texts").alias("page_index", "text"))
    return rows.where(F.col("text").isNotNull()).select(
        F.col("filename").alias("book_id"), "filename", F.col("page_index").cast("long").alias("page_index"), "text"
    )


def joined_text(page_texts: Column, after_page: str = "") -> Column:
    """Pages of one file as one text; ``after_page`` follows every page."""
    return F.array_join(F.transform(page_texts, lambda p: F.concat(p, F.lit(after_page))), "")


def filename_parts(name: Column) -> list[Column]:
    """``grade, class, subject, board, year, title, extension`` of ``<grade> Class <subject> <board> Year <year>.<ext>``."""
    group = lambda i: F.nullif(F.regexp_extract(name, FILE_NAME, i), F.lit(""))
    title = F.concat_ws(" ", *[F.regexp_extract(name, FILE_NAME, i) for i in (1, 2, 3, 4)])
    return [
        group(1).alias("grade"),
        group(2).alias("class"),
        group(3).alias("subject"),
        group(4).alias("board"),
        group(5).alias("year"),
        F.when(name.rlike(FILE_NAME), title).alias("title"),
        group(6).alias("extension"),
    ]


def filename_parts_by_position(name: Column) -> list[Column]:
    """The positional reading of a file name: ``year`` is the fifth word and ``extension`` the sixth."""
    parts = F.split(name, " ")
    at = lambda i: F.get(parts, F.lit(i))
    return [
        at(0).alias("grade"),
        at(1).alias("class"),
        at(2).alias("subject"),
        at(3).alias("board"),
        at(4).alias("year"),
        F.array_join(F.slice(parts, 1, 4), " ").alias("title"),
        at(5).alias("extension"),
    ]


def load_books(
    spark: SparkSession, directory: str, decode: PageDecoder = pdf_page_texts, clean: Callable[[Column], Column] = clean_board_text
) -> DataFrame:
    """Decoded and cleaned books with their file-name metadata, one row per file.

    ``starts`` holds the hand-made chapter starts of the books that have some; ``book_boundaries`` uses them.
    """
    decoded = decode_pages(book_files(spark, directory), decode)
    books = decoded.select(
        F.col("filename").alias("book_id"), *filename_parts(F.col("filename")), "page_texts", clean(joined_text(F.col("page_texts"))).alias("text")
    )
    listed = starts_by_file(spark).withColumnRenamed("filename", "book_id")  # a fixed table of a few rows
    return books.join(F.broadcast(listed), "book_id", "left")


def read_text(spark: SparkSession, path: str, folders: Sequence[str] = ()) -> DataFrame:
    """Whole text files, one row each: ``text`` and the values of ``folders`` named in their paths."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), *folders)


def write_text(df: DataFrame, column: str, path: str, rows_per_file: int = 0) -> None:
    """One line per row; with ``rows_per_file`` a file ends there, so that readers of whole files need bounded memory."""
    df.select(column).write.option("maxRecordsPerFile", rows_per_file).text(path)


def write_chunks(chunks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Chunks as JSON lines; characters outside ASCII stay as they are."""
    chunks.write.mode(mode).json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CHUNKS).json(path)


def _question_rows(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """``test_key, raw``: the entries of a file of tests; text that is no JSON object is an error."""
    files = spark.read.text(path, wholetext=not lines).where(F.trim("value") != "")
    entries = files.select(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}).alias("tests"))
    rows = entries.select(F.explode_outer("tests").alias("test_key", "raw"))
    return rows.where(F.col("test_key").isNotNull())


def _exploded(tests: DataFrame) -> DataFrame:
    """One row per question of ``test``; a list without questions gives none, a question without an id stays."""
    rows = tests.select("test_key", "test.name", "test.subject", F.posexplode_outer("test.questions").alias("place", "q"))
    return rows.where(F.col("place").isNotNull() & F.col("q").isNotNull())


def read_questions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Questions of a file of tests; entries that are no tests or have no questions are skipped.

    A file is one JSON object of any layout, or has one object per line with ``lines``. Ids are texts and may be
    missing. Adds ``source``, the name of the test or else its key.
    """
    tests = _question_rows(spark, path, lines).select("test_key", F.from_json("raw", schemas.TEST).alias("test"))
    return _exploded(tests).select(F.coalesce("name", "test_key").alias("source"), "subject", "q.*")


def read_keyed_questions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Questions with the key ``<test>:<id>``; an entry without questions, or a question without an id, is an error."""
    tests = _question_rows(spark, path, lines).select("test_key", F.from_json("raw", schemas.TEST).alias("test"))
    missing = lambda what: F.raise_error(F.concat(F.lit(f"{what} in entry "), F.col("test_key")))
    listed = F.when(F.col("test.questions").isNull(), missing("no questions")).otherwise(F.col("test.questions"))
    rows = tests.select("test_key", "test.subject", listed.alias("questions"))
    rows = rows.select("test_key", "subject", F.posexplode_outer("questions").alias("place", "q")).where(F.col("place").isNotNull())
    ident = F.when(F.col("q.id").isNull(), missing("a question without id")).otherwise(F.col("q.id"))
    return rows.select(F.concat_ws(":", "test_key", ident).alias("key"), "subject", "q.question", "q.options", "q.correct_answer")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored results; an absent path is an empty table."""
    try:
        return spark.read.schema(schemas.RESULTS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.RESULTS)


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").parquet(path)
