"""Token files: flat unsigned ids with 64-bit document offsets, read by memory mapping.

``<shard>.tokens`` holds the ids of its documents one after another, unsigned 16-bit where
the vocabulary allows it and 32-bit otherwise; ``<shard>.docs`` the document ids and
``<shard>.lengths`` their token counts; ``<shard>.offsets`` the place of every document in
the whole collection and, at its end, the place after the last. The table ``index`` names
the shards in order with their first token and document.

Documents are dealt out by ranges of their ids, so the shards are in ascending order; the
first token of a shard is the prefix sum over the counts of those before it. A task that
runs again writes under a new name, and the index names the files of the run that counted.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.tokens import WORD_BPE, word_encoder
from folioscope.plans.scale import bound_batches, materialise

ROWS = 512
INDEX = "shard int, name string, width int, n_docs long, n_null long, n_tokens long"


def file_system(folder: str) -> tuple[FileSystem, str]:
    """The file system of a shared folder (local mount, HDFS, object store) and the path in it."""
    return FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        fs, root = file_system(folder)
        shard = TaskContext.get().partitionId()
        name = f"{shard:07d}-{uuid.uuid4().hex}"
        docs, lengths, nulls, out = [], [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or fs.open_output_stream(f"{root}/{name}.tokens")
            for ids in encoder.encode_all(batch.column("text"), end):
                ids = np.frombuffer(ids.as_buffer(), "<u4")
                out.write(ids.astype(f"<u{width}").tobytes())
                lengths.append(len(ids))
            nulls += batch.column("doc").null_count
            docs.extend(batch.column("doc").fill_null(0).to_pylist())
        if out:
            out.close()
            for kind, values, dtype in (("docs", docs, "<i8"), ("lengths", lengths, "<u4")):
                with fs.open_output_stream(f"{root}/{name}.{kind}") as file:
                    file.write(np.array(values, dtype).tobytes())
            row = {"shard": shard, "name": name, "width": width, "n_docs": len(docs), "n_null": nulls, "n_tokens": sum(lengths)}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("name", pa.string()), ("width", pa.int32()), *((c, pa.int64()) for c in ("n_docs", "n_null", "n_tokens"))]))

    return run


def _mapped(fs: FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file as an array; only what is touched is read where the file system is a mounted one."""
    if isinstance(fs, LocalFileSystem):
        with pa.memory_map(path) as file:
            return np.frombuffer(file.read_buffer(), dtype)
    with fs.open_input_file(path) as file:
        return np.frombuffer(file.read_buffer(), dtype)


def _offsets(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                lengths = _mapped(fs, f"{root}/{row['name']}.lengths", "<u4").astype("<i8")
                places = np.concatenate([[0], np.cumsum(lengths)]) + row["first_token"]
                with fs.open_output_stream(f"{root}/{row['name']}.offsets") as file:
                    file.write(places.astype("<i8").tobytes())
            yield batch

    return run


def write_token_files(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = WORD_BPE, end_id: int = 2
) -> DataFrame:
    """Write the ids of all whole texts, ``end_id`` after each, in ascending id order; return the index.

    A null or empty text gives the end id alone. Rows without an id come first. Rows that share
    an id stand together, ordered by text. An empty table gives an index without rows.
    """
    bound_batches(docs.sparkSession)
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    shards = rows.repartitionByRange("doc").sortWithinPartitions("doc", "text").mapInArrow(_write(folder, tokenizer, end_id), INDEX)
    shards = materialise(shards, "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    based = shards.select(
        "*",
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first_token"),
        F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("first_doc"),
    )
    based.mapInArrow(_offsets(folder), based.schema).write.mode("overwrite").parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(based.schema).parquet(f"{folder}/index")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                tokens = _mapped(fs, f"{root}/{row['name']}.tokens", f"<u{row['width']}")
                places = _mapped(fs, f"{root}/{row['name']}.offsets", "<i8")
                docs = _mapped(fs, f"{root}/{row['name']}.docs", "<i8")
                for at in range(0, row["n_docs"], ROWS):
                    until = min(at + ROWS, row["n_docs"])
                    local = places[at : until + 1] - row["first_token"]
                    ids = [tokens[a:b].astype("<u4").tobytes() for a, b in zip(local, local[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[at:until], mask=np.arange(at, until) < row["n_null"]),
                            pa.array(places[at:until]),
                            pa.array(np.diff(local)),
                            pa.array(ids, pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: ``doc_id, start, n_tokens`` and ``ids``, little-endian unsigned 32-bit."""
    index = spark.read.parquet(f"{folder}/index")
    shards = index.agg(F.max("shard")).first()[0]
    dealt = index.repartitionByRange((shards or 0) + 1, "shard")
    return dealt.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids binary")
