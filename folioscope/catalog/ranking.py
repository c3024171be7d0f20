"""Fusion and rerank queries. Passage ids are document ids; a vector belongs to the document with its id."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog import sql
from folioscope.catalog.lexical import SUBJECT_SQL, benchmark_queries, index, item_subject
from folioscope.catalog.registry import built_once, query, table
from folioscope.operators import fusion
from folioscope.plans.scale import sized_join, materialise

CANDIDATES, FINAL = 20, 5


def passages(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "text", F.col("lang").alias("subject"), F.col("source").alias("chapter")
    )


def vectors(spark, sf):
    """Document vectors with the subject of their document."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("scope"))
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vecs.join(docs, "id")


def questions(spark, sf):
    asked = benchmark_queries(spark, sf, item_subject())
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return asked.join(vecs, "query_id", "left")


def candidates(spark, sf):
    """The stored hybrid candidates, with question and passage texts."""

    def make():
        fused = fusion.hybrid(index(spark, sf), vectors(spark, sf), questions(spark, sf), CANDIDATES)
        asked = questions(spark, sf).select("query_id", F.col("text").alias("question"))
        ranked = sized_join(fused.select("query_id", "id", "score", "rank"), asked, ["query_id"])
        return materialise(fusion.with_texts(materialise(ranked, "fused"), passages(spark, sf)), "candidates")

    return built_once(spark, sf, "candidates", make)


def final(spark, sf):
    return built_once(spark, sf, "final", lambda: materialise(fusion.rerank(candidates(spark, sf), FINAL), "final"))


HYBRID_SQL = (
    sql.bm25(f"SELECT item_id AS query_id, text, {SUBJECT_SQL} AS subject FROM benchmark", 2 * CANDIDATES)
    + f""",
    dv AS (SELECT doc_id AS id, embedding::DOUBLE[] AS vector, lang AS scope FROM embeddings JOIN documents ON doc_id = vec_id),
    qv AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS vector, {SUBJECT_SQL} AS scope FROM benchmark JOIN embeddings ON vec_id = item_id),
    kd AS (SELECT query_id, id, round(power(list_distance(qv.vector, dv.vector), 2), 9) AS d FROM qv JOIN dv USING (scope)),
    kr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM kd QUALIFY rank <= {2 * CANDIDATES}),
    fused AS (
      SELECT query_id, id::VARCHAR AS id, coalesce(1 / (60 + l.rank), 0) + coalesce(1 / (60 + v.rank), 0) AS score
      FROM (SELECT query_id, doc AS id, rank FROM bm25_ranked) l FULL JOIN kr v USING (query_id, id)),
    cand AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS rank
             FROM fused QUALIFY rank <= {CANDIDATES}),
    full_cand AS (SELECT c.*, b.text AS question, d.text AS text, d.source AS chapter FROM cand c
                  JOIN benchmark b ON b.item_id = c.query_id JOIN documents d ON d.doc_id::VARCHAR = c.id),
    scored AS (SELECT *, len(list_intersect({sql.keywords('question')}, {sql.keywords('text')})) AS overlap FROM full_cand),
    fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank) AS final_rank
            FROM scored QUALIFY final_rank <= {FINAL})"""
)


@query(
    "rrf_fusion",
    """WITH a AS (SELECT source AS query_id, md5(text) AS id, max(doc_id + 1) AS rank FROM documents GROUP BY ALL),
            b AS (SELECT source AS query_id, md5(text) AS id, max(n_chars) AS rank FROM documents WHERE doc_id % 3 > 0 GROUP BY ALL)
       SELECT query_id, id, a.rank AS rank_a, b.rank AS rank_b,
              round(coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0), 9) AS score
       FROM a FULL JOIN b USING (query_id, id)""",
)
def rrf_fusion(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("query_id"), F.md5("text").alias("id"), "doc_id", "n_chars")
    arms = {
        "a": docs.withColumn("rank", F.col("doc_id") + 1),
        "b": docs.where("doc_id % 3 > 0").withColumn("rank", F.col("n_chars")),
    }
    return fusion.fuse(arms).select("query_id", "id", "rank_a", "rank_b", F.round("score", 9).alias("score"))


@query(
    "rrf_topk",
    """WITH r AS (SELECT source AS query_id, md5(text) AS id, max(doc_id + 1) AS a, max(n_chars) AS b FROM documents GROUP BY ALL),
       s AS (SELECT query_id, id, round(1 / (60 + a) + 1 / (60 + b), 9) AS score,
              row_number() OVER (PARTITION BY query_id ORDER BY 1 / (60 + a) + 1 / (60 + b) DESC, id DESC) AS rank FROM r)
       SELECT * FROM s WHERE rank <= 10""",
)
def rrf_topk(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("query_id"), F.md5("text").alias("id"), "doc_id", "n_chars")
    arms = {"a": docs.withColumn("rank", F.col("doc_id") + 1), "b": docs.withColumn("rank", F.col("n_chars"))}
    return fusion.fuse(arms, 10).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query(
    "fusion_lookup",
    """WITH l AS (SELECT source AS query_id, md5(text) AS id, 'lexical ' || lang AS title, NULL::VARCHAR AS chapter
                  FROM documents WHERE doc_id % 3 <> 1 GROUP BY ALL),
            v AS (SELECT source AS query_id, md5(text) AS id, 'vector ' || lang AS title, max(source) AS chapter
                  FROM documents WHERE doc_id % 3 <> 2 GROUP BY ALL)
       SELECT query_id, id, coalesce(l.title, v.title) AS title, CASE WHEN l.id IS NULL THEN v.chapter END AS chapter
       FROM l FULL JOIN v USING (query_id, id)""",
)
def fusion_lookup(spark, sf):
    """A text that stands in a source under several languages has as many copies."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("query_id"), F.md5("text").alias("id"), "lang")
    title = lambda arm: F.concat(F.lit(f"{arm} "), "lang").alias("title")
    lexical = docs.where("doc_id % 3 <> 1").select("query_id", "id", title("lexical")).distinct()
    near = docs.where("doc_id % 3 <> 2").select("query_id", "id", title("vector"), F.col("query_id").alias("chapter")).distinct()
    return fusion.payloads(lexical, near, ["title", "chapter"])


@query("hybrid_topk", f"WITH {HYBRID_SQL} SELECT query_id, id, round(score, 9) AS score, rank FROM cand")
def hybrid_topk(spark, sf):
    return candidates(spark, sf).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query(
    "rerank_overlap",
    f"WITH {HYBRID_SQL} SELECT query_id, id, overlap::DOUBLE AS rerank_score, final_rank FROM fin",
)
def rerank_overlap(spark, sf):
    return final(spark, sf).select("query_id", "id", "rerank_score", "final_rank")


@query(
    "rerank_survivors",
    f"""WITH {HYBRID_SQL} SELECT c.query_id, c.id, c.rank, f.id IS NOT NULL AS in_final
        FROM cand c LEFT JOIN fin f USING (query_id, id)""",
)
def rerank_survivors(spark, sf):
    marked = fusion.survivors(candidates(spark, sf), final(spark, sf))
    return marked.select("query_id", "id", "rank", "in_final")
