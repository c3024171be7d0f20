"""Splitting book texts into chunks. Every splitter works inside the row of its text."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioscope.functions import fixed
from folioscope.functions.headings import chapter_at
from folioscope.functions.text import chunk_id, strip
from folioscope.plans.scale import top_k

OUTPUT_ROWS = 8192


def _others(df: DataFrame, text: str) -> list[str]:
    return [c for c in df.columns if c != text]


def fixed_chunks(df: DataFrame, text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``: adds ``chunk_ix, text, start_index``.

    The text is cut once into pieces of one step; a chunk is a piece and what
    follows it, so the cost stays linear in the length of the text.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    span = -(-size // step)
    pieces = f"regexp_extract_all(`{text}`, '(?s).{{1,{step}}}', 0)"
    windows = (
        f"transform(array({pieces}), ps -> transform(ps, (p, i) -> "
        f"substring(array_join(slice(ps, i + 1, {span}), ''), 1, {size})))[0]"
    )
    out = df.select(*_others(df, text), F.posexplode_outer(F.expr(windows)).alias("chunk_ix", "_chunk"))
    return out.where(F.col("_chunk").isNotNull()).select(
        *_others(df, text),
        F.col("chunk_ix").cast("long").alias("chunk_ix"),
        F.col("_chunk").alias("text"),
        (F.col("chunk_ix").cast("long") * step).alias("start_index"),
    )


def packed_sentences(text, size: int):
    """Greedy packing of sentences into chunks of about ``size`` characters, as an array Column."""
    sentences = F.split(text, r"(?U)(?<=[.!?])" + fixed.SPACE + "+")
    none = F.array().cast("array<string>")

    def step(acc, sentence):
        room = F.length(acc["open"]) + F.length(sentence) <= size
        return F.when(
            room,
            F.struct(acc["done"].alias("done"), F.concat(acc["open"], sentence, F.lit(" ")).alias("open")),
        ).otherwise(
            F.struct(
                F.concat(acc["done"], F.array(strip(acc["open"]))).alias("done"),
                F.concat(sentence, F.lit(" ")).alias("open"),
            )
        )

    start = F.struct(none.alias("done"), F.lit("").alias("open"))
    return F.aggregate(
        sentences, start, step, lambda acc: F.concat(acc["done"], F.array(strip(acc["open"])))
    )


def sentence_chunks(df: DataFrame, text: str = "text", size: int = 1000) -> DataFrame:
    """Whole sentences packed up to ``size`` characters, without overlap."""
    out = df.select(*_others(df, text), F.posexplode_outer(packed_sentences(F.col(text), size)).alias("chunk_ix", "_chunk"))
    return out.where(F.col("_chunk").isNotNull()).select(
        *_others(df, text),
        F.col("chunk_ix").cast("long").alias("chunk_ix"),
        F.col("_chunk").alias("text"),
        F.lit(None).cast("long").alias("start_index"),
    )


def _merge(pieces: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    window: deque[str] = deque()
    total = 0
    for piece in pieces:
        if total + len(piece) > size and window:
            yield "".join(window).strip()
            while total > overlap or (total + len(piece) > size and total > 0):
                total -= len(window.popleft())
        window.append(piece)
        total += len(piece)
    yield "".join(window).strip()


def split_recursively(text: str, size: int, overlap: int, separators: Sequence[str]) -> Iterator[str]:
    """Split at the first separator present, merge small pieces, and go deeper into large ones."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), None)
    if at is None:
        pieces, deeper = [text], ()
    else:
        mark, deeper = separators[at], separators[at + 1 :]
        if mark:
            head, *tail = text.split(mark)
            pieces = [p for p in (head, *(mark + t for t in tail)) if p]
        else:
            pieces = list(text)
    small: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            small.append(piece)
            continue
        if small:
            yield from filter(None, _merge(small, size, overlap))
            small = []
        if deeper:
            yield from split_recursively(piece, size, overlap, deeper)
        else:
            yield piece
    if small:
        yield from filter(None, _merge(small, size, overlap))


def chunks_with_starts(text: str, size: int, overlap: int) -> Iterator[tuple[str, int]]:
    """Chunks of one text with the offset each is found at (-1 when it is not)."""
    start, length = 0, 0
    for chunk in split_recursively(text, size, overlap, fixed.SEPARATORS):
        start = text.find(chunk, max(0, start + length - overlap))
        length = len(chunk)
        yield chunk, start


def recursive_chunks(df: DataFrame, text: str = "text", size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP) -> DataFrame:
    """Chunks cut at paragraphs, else lines, else words, else characters."""
    if overlap > size:
        raise ValueError("overlap must not be larger than size")
    others = _others(df, text)
    schema = T.StructType(
        [df.schema[c] for c in others]
        + [
            T.StructField("chunk_ix", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("start_index", T.LongType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def emit(batch, source, ix, out, starts):
        keep = pa.array(source, pa.int64())
        columns = [batch.column(c).take(keep) for c in others]
        columns += [pa.array(ix, pa.int64()), pa.array(out, pa.string()), pa.array(starts, pa.int64())]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[list, ...] = ([], [], [], [])
            for row, value in enumerate(batch.column(text)):
                for i, (chunk, start) in enumerate(chunks_with_starts(value.as_py() or "", size, overlap)):
                    for column, item in zip(found, (row, i, chunk, start)):
                        column.append(item)
                    if len(found[0]) == OUTPUT_ROWS:
                        yield emit(batch, *found)
                        found = ([], [], [], [])
            if found[0]:
                yield emit(batch, *found)

    return df.select(*others, text).mapInArrow(run, schema)


def chunk_books(books: DataFrame, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP, method: str = "recursive") -> DataFrame:
    """Chunk every book by ``method`` and label each chunk with its chapter.

    ``books`` has ``book_id, text, subject, grade`` and, for labels,
    ``chapter_boundaries``. Chunks of a book are numbered in order.
    """
    keep = ["book_id", "subject", "grade", "chapter_boundaries"]
    base = books.select(*[c for c in keep if c in books.columns], "text")
    if method == "fixed":
        chunks = fixed_chunks(base, "text", size, overlap)
    elif method == "sentence":
        chunks = sentence_chunks(base, "text", size)
    elif method == "recursive":
        chunks = recursive_chunks(base, "text", size, overlap)
    else:
        raise ValueError(f"Unknown chunking method: {method}")
    if "chapter_boundaries" in chunks.columns:
        label = F.when(F.col("start_index").isNotNull(), chapter_at(F.col("chapter_boundaries"), F.col("start_index")))
        chunks = chunks.withColumn("chapter", label).drop("chapter_boundaries")
    return chunks


def attach_ids(chunks: DataFrame) -> DataFrame:
    """Add the content hash of the text as ``chunk_id``."""
    return chunks.withColumn("chunk_id", chunk_id(F.col("text")))


def drop_short(chunks: DataFrame, min_length: int = fixed.MIN_CHUNK_LENGTH) -> DataFrame:
    """Keep chunks whose stripped text has at least ``min_length`` characters."""
    return chunks.where(F.length(strip(F.col("text"))) >= min_length)


def first_of_each_id(chunks: DataFrame, order: Sequence[str]) -> DataFrame:
    """One chunk per ``chunk_id``: the first in ``order``. Copies are dropped in each task before the shuffle."""
    return top_k(chunks, ["chunk_id"], [F.asc(c) for c in order], 1, "_copy").drop("_copy")


def count_by_subject(chunks: DataFrame) -> DataFrame:
    """``subject, n_chunks`` with a total row (null subject), from one pass of partial counts."""
    counts = chunks.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    return counts.rollup("subject").agg(F.sum("n").alias("n_chunks"))
