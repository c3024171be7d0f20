"""Incremental ingestion: new book texts arrive as files and only new chunks are stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators.chunking import attach_ids, chunk_books, drop_short
from folioscope.operators.vectors import HashingEncoder
from folioscope.sources.collection import Collection


def ingest_books(
    spark: SparkSession,
    source: str,
    schema: str,
    collection: Collection,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame],
    make_model: Callable = HashingEncoder,
    remember: str | None = None,
    **chunking,
) -> StreamingQuery:
    """Stream parquet files of books into ``collection`` and stop when all present files are in.

    Duplicates are found by an anti-join with the stored ids, so nothing grows with the number of chunks seen. A batch
    that is run again after a failure inserts nothing twice.

    With ``remember``, such as "2 hours", the stream keeps the ids that arrived within that time as state, and only the first
    of their copies goes on to the collection, which then sees each id about once. The time is that of the batch, so no file
    is ever late and none is dropped; a copy of a chunk that the state has forgotten meets the anti-join. Which copy of one
    batch goes on is open. ``prepare`` then has to be possible on a stream.
    """

    def chunks_of(books: DataFrame) -> DataFrame:
        chunks = drop_short(attach_ids(chunk_books(prepare(books), **chunking)))
        for column in ("grade", "chapter"):
            if column not in chunks.columns:
                chunks = chunks.withColumn(column, F.lit(None).cast("string"))
        return chunks

    def store(batch: DataFrame, _: int) -> None:
        collection.add_texts(batch if remember else chunks_of(batch), make_model)

    stream = spark.readStream.schema(schema).parquet(source)
    if remember:
        stream = chunks_of(stream).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", remember)
        stream = stream.dropDuplicatesWithinWatermark(["chunk_id"]).drop("arrived")
    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
