"""Queries over the vector table; ``label`` stands for the metadata a query filters on."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog import sql
from folioscope.catalog.registry import built_once, query, table
from folioscope.functions.vectors import cosine, squared_l2
from folioscope.operators import vectors
from folioscope.plans.scale import scratch_path, spread

K = 10
CELLS = 16
PROBES = 4


def vector_table(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("scope")
    )


def query_vectors(spark, sf):
    """The vector of each benchmark item is the vector with its id."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    return items.join(vector_table(spark, sf), F.col("query_id") == F.col("id")).select("query_id", "vector", "scope")


QUERY_SQL = """SELECT item_id AS query_id, embedding::DOUBLE[] AS vector, label AS scope
               FROM benchmark JOIN embeddings ON vec_id = item_id"""
REPORT_SQL = " SELECT query_id, id AS vec_id, round(distance, 6) AS distance, rank FROM knn_ranked"


def _report(near):
    return near.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


@query("knn_l2_topk", "WITH " + sql.knn(QUERY_SQL, K, False) + REPORT_SQL)
def knn_topk(spark, sf):
    return _report(vectors.knn(vector_table(spark, sf).drop("scope"), query_vectors(spark, sf), K))


@query("knn_filtered", "WITH " + sql.knn(QUERY_SQL, K, True) + REPORT_SQL)
def knn_filtered(spark, sf):
    return _report(vectors.knn(vector_table(spark, sf), query_vectors(spark, sf), K))


@query(
    "cosine_neighbours",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine,
              round(power(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2), 6) AS squared_l2
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_neighbours(spark, sf):
    a = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = table(spark, sf, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select(
        "vec_id",
        F.round(cosine(F.col("a"), F.col("b")), 6).alias("cosine"),
        F.round(squared_l2(F.col("a"), F.col("b")), 6).alias("squared_l2"),
    )


def _cells(spark, sf):
    def make():
        rows = vector_table(spark, sf).drop("scope")
        pivots = vectors.choose_pivots(rows, CELLS)
        path = scratch_path(spark, "cells")
        vectors.assign_cells(rows, pivots).write.partitionBy("scope").parquet(path)
        return spark.read.parquet(path).withColumn("scope", F.col("scope").cast("long")), pivots

    return built_once(spark, sf, "cells", make)


_PIVOT_SQL = f"""
    pv AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell, embedding::DOUBLE[] AS centre FROM
           (SELECT * FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT {CELLS})),
    near AS (SELECT vec_id, embedding::DOUBLE[] AS vector, cell,
                    row_number() OVER (PARTITION BY vec_id
                      ORDER BY round(power(list_distance(embedding::DOUBLE[], centre), 2), 9), cell) AS nth
             FROM embeddings, pv)"""


@query("vector_cells", f"WITH {_PIVOT_SQL} SELECT vec_id, cell FROM near WHERE nth = 1")
def vector_cells(spark, sf):
    cells, _ = _cells(spark, sf)
    return cells.select(F.col("id").alias("vec_id"), F.col("scope").alias("cell"))


@query(
    "knn_approximate",
    f"""WITH {_PIVOT_SQL},
        asked AS (SELECT item_id AS query_id, vector, cell FROM benchmark JOIN near ON vec_id = item_id WHERE nth <= {PROBES}),
        dist AS (SELECT query_id, n.vec_id, round(power(list_distance(a.vector, n.vector), 2), 9) AS d
                 FROM asked a JOIN near n ON n.cell = a.cell AND n.nth = 1)
        SELECT query_id, vec_id, round(d, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank
        FROM dist QUALIFY rank <= {K}""",
)
def knn_approximate(spark, sf):
    cells, pivots = _cells(spark, sf)
    asked = query_vectors(spark, sf).drop("scope")
    return _report(vectors.knn_in_cells(cells, pivots, asked, K, PROBES))


def _embedding_sql(name: str, ident: str, text: str) -> str:
    """The offline encoder in SQL: a byte of each token's hash picks the place, another the sign."""
    return f"""WITH t AS (SELECT {ident}, unnest(string_split_regex(lower({text}), '\\s+')) AS token FROM {name}),
        h AS (SELECT {ident}, ('0x' || substring(md5(token), 1, 2))::INT % 64 AS i,
                     CASE WHEN ('0x' || substring(md5(token), 9, 2))::INT % 2 = 1 THEN 1 ELSE -1 END AS v FROM t WHERE token <> ''),
        e AS (SELECT {ident}, i, sum(v) AS v FROM h GROUP BY ALL),
        n AS (SELECT {ident}, sqrt(sum(v * v)) AS norm, map_from_entries(list((i, v))) AS m FROM e GROUP BY ALL)
        SELECT {ident}, 64::BIGINT AS dimensions, coalesce(CASE WHEN norm > 0 THEN m[0] / norm END, 0)::FLOAT::DOUBLE AS first,
               array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN m[i] > 0 THEN '+' WHEN m[i] < 0 THEN '-' ELSE '0' END), '') AS signs
        FROM {name} LEFT JOIN n USING ({ident})"""


def _embedding_report(rows, ident, column):
    sign = lambda v: F.when(v > 0, "+").when(v < 0, "-").otherwise("0")
    return rows.select(
        ident,
        F.size(column).cast("long").alias("dimensions"),
        F.get(F.col(column), F.lit(0)).cast("double").alias("first"),
        F.array_join(F.transform(F.col(column), sign), "").alias("signs"),
    )


@query("embed_passages", _embedding_sql("documents", "doc_id", "text"))
def embed_passages(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return _embedding_report(vectors.embed(docs, "text"), "doc_id", "embedding")


@query("embed_queries", _embedding_sql("benchmark", "item_id", "'Represent this sentence for searching relevant passages: ' || text"))
def embed_queries(spark, sf):
    return _embedding_report(vectors.embed_queries(table(spark, sf, "benchmark"), "text"), "item_id", "vector")
