"""Nearest neighbours over vector tables.

Query vectors are sent to the tasks in blocks of a checked size; every task
keeps a running top-k per query over its own vectors, so neither pairs nor
vectors are shuffled and only ``k`` rows per query and task reach the final sort.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import fixed
from folioscope.plans.scale import bound_batches, materialise, scratch_path, top_k

QUERY_BLOCK = 4096
_CELLS = 2_000_000
DIGITS = 9


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _blocks(queries: DataFrame, block_rows: int) -> Iterator[pa.Table]:
    """A stored query table in Arrow blocks of about ``block_rows`` rows."""
    parts = max(1, -(-queries.count() // block_rows))
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    for p in range(parts):
        yield queries.where(part == p).toArrow()


def _distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    d = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2.0 * (q @ v.T)
    return np.round(np.maximum(d, 0.0), DIGITS)


def _prune(row: np.ndarray, dist: np.ndarray, ident: np.ndarray, k: int):
    order = np.lexsort((ident, dist, row))
    row, dist, ident = row[order], dist[order], ident[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    keep = place < k
    return row[keep], dist[keep], ident[keep]


def _near(q_rows: np.ndarray, q: np.ndarray, v: np.ndarray, ident: np.ndarray, k: int):
    """Candidates (query row, distance, id) that can be among the ``k`` nearest of this batch."""
    step = max(1, _CELLS // max(1, len(q_rows)))
    for lo in range(0, len(v), step):
        d = _distances(q, v[lo : lo + step])
        if d.shape[1] > k:
            near = d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        else:
            near = np.ones_like(d, dtype=bool)
        r, c = np.nonzero(near)
        yield _prune(q_rows[r], d[r, c], ident[lo : lo + step][c], k)


def _scan(block: pa.Table, k: int, scoped: bool, schema: pa.Schema):
    ids = block.column("query_id").combine_chunks()
    q = _matrix(block.column("vector"))
    q_scope = np.array(block.column("scope").to_pylist(), dtype=object) if scoped else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        rows = np.arange(len(ids))
        for batch in batches:
            if batch.num_rows == 0 or len(rows) == 0:
                continue
            ident = np.array(batch.column("id").to_pylist())
            v = _matrix(batch.column("vector"))
            todo = [(rows, slice(None))]
            if scoped:
                scope = np.array(batch.column("scope").to_pylist(), dtype=object)
                todo = [(rows[q_scope == s], scope == s) for s in set(scope.tolist()) & set(q_scope.tolist()) if s is not None]
                free = rows[np.array([s is None for s in q_scope], dtype=bool)]
                if len(free):
                    todo.append((free, slice(None)))
            for q_rows, pick in todo:
                for found in _near(q_rows, q[q_rows], v[pick], ident[pick], k):
                    best = found if best is None else _prune(*(np.concatenate(p) for p in zip(best, found)), k)
        if best is not None:
            row, dist, ident = best
            out = [ids.take(pa.array(row)), pa.array(ident.tolist(), schema.field("id").type), pa.array(dist, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    return run


def knn(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = QUERY_BLOCK) -> DataFrame:
    """Exact ``k`` nearest by squared L2: ``query_id, id, distance, rank``.

    ``vectors`` has ``id, vector`` and ``queries`` has ``query_id, vector``. When
    both have ``scope``, a query sees the vectors of its own scope, and a query
    with a null scope sees all. Ties go to the smaller id. The queries are stored first, so an embedding model
    runs once per query. A block of queries is finished before the next one leaves the driver, and the
    scopes it asks for are a filter of its scan.
    """
    scoped = "scope" in vectors.columns and "scope" in queries.columns
    columns = ["vector"] + (["scope"] if scoped else [])
    rows = vectors.select("id", *columns).where(F.col("vector").isNotNull())
    asked = materialise(queries.select("query_id", *columns), "query-vectors").where(F.col("vector").isNotNull())
    out = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", vectors.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    arrow = pa.schema(
        [
            pa.field("query_id", _arrow_type(out["query_id"].dataType)),
            pa.field("id", _arrow_type(out["id"].dataType)),
            pa.field("distance", pa.float64()),
        ]
    )
    order = [F.asc("distance"), F.asc("id")]
    folder = scratch_path(vectors.sparkSession, "nearest")
    for block in _blocks(asked, block_rows):
        here = rows
        if scoped and not block.column("scope").null_count:
            here = rows.where(F.col("scope").isin(block.column("scope").unique().to_pylist()))
        near = here.mapInArrow(_scan(block, k, scoped, arrow), out)
        top_k(near, ["query_id"], order, k).write.mode("append").parquet(folder)
    return vectors.sparkSession.read.parquet(folder)


def _arrow_type(dtype: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(dtype)


def choose_pivots(vectors: DataFrame, n: int) -> DataFrame:
    """``n`` vectors picked by the hash of their id, numbered 0 to n-1 in id order: ``cell, vector``."""
    picked = vectors.orderBy(F.md5(F.col("id").cast("string")), "id").limit(n)
    return top_k(picked.withColumn("_all", F.lit(0)), ["_all"], [F.asc("id")], n, "cell").select(
        (F.col("cell") - 1).alias("cell"), F.col("vector")
    )


def assign_cells(vectors: DataFrame, pivots: DataFrame, probes: int = 1) -> DataFrame:
    """Add ``scope``: the nearest pivot of each row, or one row per pivot for the ``probes`` nearest."""
    table = pivots.orderBy("cell").toArrow()
    cells = np.array(table.column("cell").to_pylist())
    centre = _matrix(table.column("vector"))

    @F.pandas_udf("array<bigint>")
    def nearest(vector: pd.Series) -> pd.Series:
        if vector.empty:
            return pd.Series([], dtype=object)
        d = _distances(np.stack(vector.to_numpy()).astype(np.float64), centre)
        order = np.argsort(d, axis=1, kind="stable")[:, :probes]
        return pd.Series(list(cells[order]))

    return vectors.where(F.col("vector").isNotNull()).withColumn("scope", F.explode(nearest("vector")))


def knn_in_cells(cells: DataFrame, pivots: DataFrame, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """Approximate ``k`` nearest: only the ``probes`` cells nearest to a query are read.

    ``cells`` is the vector table with its cell in ``scope``; stored partitioned by
    ``scope``, cells that no query probes are never read.
    """
    asked = assign_cells(queries, pivots, probes)
    probed = [r.scope for r in asked.select("scope").distinct().collect()]
    return knn(cells.where(F.col("scope").isin(probed)), asked, k)


class HashingEncoder:
    """Deterministic stand-in for an embedding model: hashed token counts at unit length."""

    CACHE = 1 << 16
    """Tokens whose place is remembered; one task at a time uses them, and a few thousand tokens make up most of a text."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions
        self._places: dict[str, tuple[int, int]] = {}

    def _place(self, token: str) -> tuple[int, int]:
        found = self._places.get(token)
        if found is None:
            h = int.from_bytes(md5(token.encode()).digest()[:8], "little")
            found = (h % self.dimensions, 1 if (h >> 32) & 1 else -1)
            if len(self._places) >= self.CACHE:
                self._places.clear()
            self._places[token] = found
        return found

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for i, text in enumerate(texts):
            row = [0] * self.dimensions
            for token, count in Counter(text.lower().split()).items():
                place, sign = self._place(token)
                row[place] += sign * count
            out[i] = row
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


def embed(df: DataFrame, text: str, make_model=HashingEncoder, name: str = "embedding") -> DataFrame:
    """Add the embedding of ``text``; the model is made once per task and fed whole batches of a few megabytes.

    ``make_model`` returns an object with ``encode(list[str])``.
    """
    bound_batches(df.sparkSession)

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for batch in batches:
            yield pd.Series(list(np.asarray(model.encode(batch.tolist()), dtype=np.float32)))

    return df.withColumn(name, encode(F.col(text)))


def embed_queries(df: DataFrame, text: str, make_model=HashingEncoder, prefix: str = fixed.QUERY_PREFIX) -> DataFrame:
    """Query-side embedding: the retrieval instruction goes before the text."""
    prefixed = df.withColumn("_text", F.concat(F.lit(prefix), F.col(text)))
    return embed(prefixed, "_text", make_model, "vector").drop("_text")
