"""Chunking queries: each document is a book text, ``lang`` its subject and ``source`` its shelf."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog import sql
from folioscope.catalog.registry import query, table
from folioscope.operators import chunking
from folioscope.plans.jobs import number_rows
from folioscope.plans.scale import spread

SIZE, OVERLAP = 1000, 200


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "lang", "text"))


def _report(chunks):
    return chunks.select(
        "doc_id", "chunk_ix", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("chunk_id")
    )


FIXED_SQL = f"""
    fixed AS (SELECT doc_id, lang, s // {SIZE - OVERLAP} AS chunk_ix, s AS start_index,
                     substring(text, s + 1, {SIZE}) AS chunk
              FROM (SELECT doc_id, lang, text, unnest(range(0, length(text), {SIZE - OVERLAP})) AS s FROM documents))"""

SENTENCE_SQL = rf"""
    sentences AS (SELECT doc_id, lang, list_transform(string_split(
                    regexp_replace(text, '([.!?])\s+', E'\\1\x01', 'g'), E'\x01'), lambda s: {{'done': []::VARCHAR[], 'c': s}}) AS ss
                  FROM documents),
    folded AS (SELECT doc_id, lang, list_reduce(ss, lambda a, x:
                 CASE WHEN length(a.c) + length(x.c) <= {SIZE} THEN {{'done': a.done, 'c': a.c || x.c || ' '}}
                      ELSE {{'done': list_append(a.done, a.c), 'c': x.c || ' '}} END,
                 {{'done': []::VARCHAR[], 'c': ''}}) AS f FROM sentences),
    packed AS (SELECT doc_id, lang, i - 1 AS chunk_ix, {sql.strip('list_append(f.done, f.c)[i]')} AS chunk
               FROM (SELECT doc_id, lang, f, unnest(range(1, len(f.done) + 2)) AS i FROM folded))"""


@query(
    "chunk_fixed",
    f"""WITH {FIXED_SQL} SELECT doc_id, chunk_ix, start_index, length(chunk)::BIGINT AS n_chars, md5(chunk) AS chunk_id FROM fixed""",
)
def chunk_fixed(spark, sf):
    chunks = chunking.fixed_chunks(docs(spark, sf), "text", SIZE, OVERLAP)
    return chunks.select(
        "doc_id", "chunk_ix", "start_index", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("chunk_id")
    )


@query(
    "chunk_sentence",
    f"WITH {SENTENCE_SQL} SELECT doc_id, chunk_ix, length(chunk)::BIGINT AS n_chars, md5(chunk) AS chunk_id FROM packed",
)
def chunk_sentence(spark, sf):
    return _report(chunking.sentence_chunks(docs(spark, sf), "text", SIZE))


@query("chunk_recursive")
def chunk_recursive(spark, sf):
    chunks = chunking.recursive_chunks(docs(spark, sf), "text", 450, 100)
    return chunks.select(
        "doc_id", "chunk_ix", "start_index", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("chunk_id")
    )


@query(
    "chunk_ids",
    """SELECT doc_id, md5(text) AS chunk_id FROM documents""",
)
def chunk_ids(spark, sf):
    return chunking.attach_ids(docs(spark, sf)).select("doc_id", "chunk_id")


@query(
    "chunk_first_copies",
    "SELECT md5(text) AS chunk_id, min(doc_id) AS doc_id FROM documents GROUP BY 1",
)
def chunk_first_copies(spark, sf):
    ids = chunking.attach_ids(docs(spark, sf)).select("doc_id", "chunk_id")
    return chunking.first_of_each_id(ids, ["doc_id"])


@query(
    "chunk_filter_short",
    rf"""WITH lines AS (SELECT doc_id, i - 1 AS chunk_ix, ls[i] AS line FROM
           (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM
             (SELECT doc_id, string_split(text, E'\n') AS ls FROM documents)))
         SELECT doc_id, chunk_ix, length(line)::BIGINT AS n_chars, md5(line) AS chunk_id FROM lines
         WHERE length({sql.strip('line')}) >= 10""",
)
def chunk_filter_short(spark, sf):
    lines = docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_ix", "text"))
    return _report(chunking.drop_short(lines.withColumn("chunk_ix", F.col("chunk_ix").cast("long"))))


@query(
    "chunk_counts",
    f"WITH {FIXED_SQL} SELECT lang AS subject, count(*) AS n_chunks FROM fixed GROUP BY ROLLUP (lang)",
)
def chunk_counts(spark, sf):
    chunks = chunking.fixed_chunks(docs(spark, sf), "text", SIZE, OVERLAP)
    return chunking.count_by_subject(chunks.withColumnRenamed("lang", "subject"))


@query(
    "chunk_books_by_method",
    f"""WITH {FIXED_SQL}, {SENTENCE_SQL}
        SELECT 'fixed' AS method, doc_id AS book_id, count(*) AS n_chunks, sum(length(chunk))::BIGINT AS n_chars FROM fixed GROUP BY ALL
        UNION ALL
        SELECT 'sentence', doc_id, count(*), sum(length(chunk))::BIGINT FROM packed GROUP BY ALL""",
)
def chunk_books_by_method(spark, sf):
    books = docs(spark, sf).select(F.col("doc_id").alias("book_id"), "text", F.col("lang").alias("subject"))
    parts = []
    for method in ("fixed", "sentence"):
        chunks = chunking.chunk_books(books, SIZE, OVERLAP, method)
        counts = chunks.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))
        parts.append(counts.select(F.lit(method).alias("method"), "book_id", "n_chunks", "n_chars"))
    return parts[0].unionByName(parts[1])


@query(
    "corpus_positions",
    f"""WITH {FIXED_SQL} SELECT doc_id, chunk_ix, row_number() OVER (ORDER BY lang, doc_id, chunk_ix) - 1 AS pos FROM fixed""",
)
def corpus_positions(spark, sf):
    chunks = chunking.fixed_chunks(docs(spark, sf), "text", SIZE, OVERLAP).select("lang", "doc_id", "chunk_ix")
    return number_rows(chunks, ["lang", "doc_id", "chunk_ix"]).select("doc_id", "chunk_ix", "pos")
