"""Exact top-k by integer inner product, with MaxScore.

The dimensions are the terms of a query. In a shard each term has bounds on what it can add; the
essential terms are those without which no candidate can reach the k-th best score so far.
Their postings (columns of the shard) are added up for all its candidates; the other terms are
probed, largest bound first, only for candidates that can still get in. Shards are merged by
a top-k per query. Queries come in blocks of a fixed size; a block is done before the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.plans.scale import materialise, scratch_path, top_k

BLOCK = 2048
ROWS = 8192
"""Candidates whose postings are traversed together."""


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as whole numbers in double precision, cut or filled up with zeros to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), lengths)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row[at < width], at[at < width]] = values[at < width]
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def max_score(query: np.ndarray, postings: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidates whose score is ``floor`` or more, and their scores.

    ``postings`` has a row per term. Contributions are counted from the least one of their term,
    so that they are never negative.
    """
    ends = np.stack([query * postings.max(axis=1), query * postings.min(axis=1)])
    least, bound = ends.min(axis=0), np.abs(ends[0] - ends[1])
    order = np.argsort(bound)
    wanted = floor - least.sum()
    reach = np.cumsum(bound[order])  # what the terms with smaller bounds can add together
    n_other = int(np.searchsorted(reach, wanted, side="left")) if wanted > -np.inf else 0
    essential, others = order[n_other:], order[:n_other][::-1]
    alive = np.arange(postings.shape[1])
    score = query[essential] @ postings[essential] - least[essential].sum()
    for first in range(0, len(others) + 1, 8):
        left = reach[n_other - first - 1] if first < n_other else 0.0
        competitive = score + left >= wanted
        alive, score = alive[competitive], score[competitive]
        part = others[first : first + 8]
        if not len(part) or not len(alive):
            break
        score = score + query[part] @ postings[np.ix_(part, alive)] - least[part].sum()
    keep = score >= wanted
    return alive[keep], score[keep] + least.sum()


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, own, queries = shared.value
        found = [(np.zeros(0), np.zeros(0, np.int64))] * len(numbers)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                ids = part.column("vec_id").to_numpy()
                postings = np.ascontiguousarray(matrix(part.column("vector"), queries.shape[1]).T)
                for q, query in enumerate(queries):
                    scores, names = found[q]
                    at, score = max_score(query, postings, scores[-1] if len(scores) == k else -np.inf)
                    other = ids[at] != own[q]
                    scores, names = np.append(scores, score[other]), np.append(names, ids[at][other])
                    chosen = best(scores, names, k)
                    found[q] = scores[chosen], names[chosen]
        sizes = [len(s) for s, _ in found]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(numbers, sizes)),
                pa.array(np.concatenate([n for _, n in found] or [np.zeros(0, np.int64)]).astype(np.int64)),
                pa.array(np.concatenate([s for s, _ in found] or [np.zeros(0)]).astype(np.int64)),
            ],
            ["number", "vec_id", "score"],
        )

    return run


def search(queries: DataFrame, candidates: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of every query but those of its own id.

    Both tables are ``(vec_id long, vector array<long>)``. Rows with a null id or vector, or with a null
    component, take no part; a missing component counts as zero. Equal scores go to the smaller
    id. Every row is a query or candidate of its own, also where ids repeat. Scores must stay
    below 2**53. Only a block of ``block`` queries at a time goes through the driver to the tasks.
    """
    spark = queries.sparkSession
    sound = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    asked = queries.where(sound).select(F.monotonically_increasing_id().alias("number"), F.col("vec_id").alias("query_id"), "vector")
    asked = materialise(asked, "queries")
    n_blocks = -(-asked.count() // block)
    folder = scratch_path(spark, "top-k")
    result = "number long, vec_id long, score long"
    spark.createDataFrame([], result).write.parquet(folder)
    for b in range(n_blocks):
        here = asked.where(F.pmod(F.xxhash64("number"), F.lit(n_blocks)) == b).orderBy("number").toArrow()
        width = max(1, *np.diff(here.column("vector").combine_chunks().offsets.to_numpy()), 1) if here.num_rows else 1
        shared = spark.sparkContext.broadcast((here.column("number").to_numpy(), here.column("query_id").to_numpy(), matrix(here.column("vector"), int(width))))
        shards = candidates.where(sound).select("vec_id", "vector").mapInArrow(_search(shared, k), result)
        merged = top_k(shards, ["number"], [F.desc("score"), F.asc("vec_id")], k)
        merged.select("number", "vec_id", "score").write.mode("append").parquet(folder)
        shared.unpersist()
    hits = spark.read.schema(result).parquet(folder)
    ranked = top_k(hits, ["number"], [F.desc("score"), F.asc("vec_id")], k)
    return ranked.join(asked.select("number", "query_id"), "number").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id`` and ``vector``: floor of ``scale`` times each component; rows that cannot take part are left out."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return vectors.where(F.col(vector_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("vector"))
