"""Queries over the lexical index: documents are the passages and ``lang`` is the subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.catalog import sql
from folioscope.catalog.registry import built_once, query, table
from folioscope.functions.text import tokens
from folioscope.operators import lexical
from folioscope.plans.scale import running_sum, scratch_path, sized_join

SUBJECT_SQL = "['en', 'fr', 'de', 'es'][1 + item_id % 4]"
TOP = 10


def item_subject():
    """The subject a benchmark item is asked under."""
    return F.element_at(F.array(*map(F.lit, ["en", "fr", "de", "es"])), (F.col("item_id") % 4 + 1).cast("int"))


def index(spark: SparkSession, sf: str) -> lexical.LexicalIndex:
    """The stored index of the documents, built on first use."""

    def make():
        built = lexical.build_index(table(spark, sf, "documents"), "doc_id", "doc_id", "text", "lang")
        return built.save(scratch_path(spark, "index"))

    return built_once(spark, sf, "index", make)


def benchmark_queries(spark: SparkSession, sf: str, subject) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text", subject.alias("subject"))


def _report(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


REPORT_SQL = "SELECT query_id, doc AS doc_id, round(score, 6) AS score, rank FROM bm25_ranked"


@query(
    "tokenize_terms",
    f"""SELECT doc_id, len(tk)::BIGINT AS n_terms, md5(array_to_string(tk, ' ')) AS terms_md5
        FROM (SELECT doc_id, {sql.tokens('text')} AS tk FROM documents)""",
)
def tokenize_terms(spark, sf):
    out = table(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("tk"))
    return out.select("doc_id", F.size("tk").cast("long").alias("n_terms"), F.md5(F.array_join("tk", " ")).alias("terms_md5"))


@query(
    "bm25_corpus_stats",
    f"""WITH c AS (SELECT unnest([lang, '*']) AS subject, len({sql.tokens('text')}) AS dl FROM documents)
        SELECT subject, count(*) AS n_docs, round(avg(dl), 6) AS avgdl FROM c GROUP BY subject""",
)
def corpus_stats(spark, sf):
    return index(spark, sf).corpora.select("subject", "n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(
    "bm25_term_stats",
    "WITH " + sql.bm25("SELECT 0 AS query_id, '' AS text, '' AS subject", 1)
    + " SELECT scope AS subject, term, df, round(idf, 6) AS idf FROM idfs",
)
def term_stats(spark, sf):
    return lexical.idf(index(spark, sf)).select("subject", "term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_topk", "WITH " + sql.bm25("SELECT item_id AS query_id, text, 'en' AS subject FROM benchmark", TOP) + REPORT_SQL)
def bm25_topk(spark, sf):
    return _report(lexical.search(index(spark, sf), benchmark_queries(spark, sf, F.lit("en")), TOP))


@query(
    "bm25_topk_by_subject",
    "WITH " + sql.bm25(f"SELECT item_id AS query_id, text, {SUBJECT_SQL} AS subject FROM benchmark", TOP) + REPORT_SQL,
)
def bm25_by_subject(spark, sf):
    return _report(lexical.search(index(spark, sf), benchmark_queries(spark, sf, item_subject()), TOP))


@query(
    "bm25_topk_no_filter",
    "WITH " + sql.bm25("SELECT item_id AS query_id, text, '*' AS subject FROM benchmark", TOP) + REPORT_SQL,
)
def bm25_no_filter(spark, sf):
    none = F.lit(None).cast("string")
    return _report(lexical.search(index(spark, sf), benchmark_queries(spark, sf, none), TOP))


GROUPS = [["tion", "ment"], ["heit", "ent"], ["able", "est"]]
SUBJECT_OF_SEARCH = "fr"


@query(
    "term_group_search",
    """WITH c AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, lang, lower(text) AS t FROM documents),
       m AS (SELECT pos AS match_pos FROM c WHERE lang = 'fr' AND (contains(t, 'tion') OR contains(t, 'ment'))
             AND (contains(t, 'heit') OR contains(t, 'ent')) AND (contains(t, 'able') OR contains(t, 'est')))
       SELECT match_pos, (c.pos - match_pos)::BIGINT AS "offset", doc_id, lang
       FROM m JOIN c ON c.pos BETWEEN match_pos - 1 AND match_pos + 1 WHERE lang = 'fr'""",
)
def term_group_search(spark, sf):
    documents = table(spark, sf, "documents")
    numbered = running_sum(documents.select("doc_id"), [], "doc_id", F.lit(1), "pos")  # only ids are moved
    docs = sized_join(documents.select("doc_id", "lang", "text"), numbered, ["doc_id"])
    subject = docs.where(F.col("lang") == SUBJECT_OF_SEARCH)
    matches = lexical.find_terms(subject, "text", GROUPS).select("pos", "lang")
    found = lexical.with_neighbours(matches, docs.select("pos", "doc_id", "lang"), "pos", "lang")
    return found.select("match_pos", "offset", "doc_id", "lang")
