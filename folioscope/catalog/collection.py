"""Storage queries: chunk files, question files, results, the vector collection and incremental ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.catalog.registry import built_once, query, table
from folioscope.operators.chunking import attach_ids
from folioscope.operators.evaluation import remaining
from folioscope.plans.scale import scratch_path, spread
from folioscope.sources import files
from folioscope.sources.collection import Collection, embedding_cache
from folioscope.streaming.ingest import ingest_books

FIRST_SQL = "firsts AS (SELECT md5(text) AS chunk_id, min(doc_id) AS doc_id FROM documents GROUP BY 1)"


def chunk_rows(spark, sf):
    """Whole documents as chunks."""
    docs = spread(table(spark, sf, "documents"))
    return attach_ids(
        docs.select(
            "text",
            F.col("lang").alias("subject"),
            F.lit("11th").alias("grade"),
            F.lit(None).cast("string").alias("chapter"),
            F.col("source").alias("book_id"),
            F.col("doc_id").alias("chunk_ix"),
            F.lit(0).cast("long").alias("start_index"),
        )
    )


_NAME = "CASE WHEN doc_id % 10 = 9 THEN 'notes.txt' ELSE concat(10 + doc_id % 3, 'th Class ', upper(lang), ' ', source, ' Year ', 2000 + doc_id % 30, '.pdf') END"


@query(
    "filename_metadata",
    """SELECT doc_id, CASE WHEN ok THEN 10 + doc_id % 3 || 'th' END AS grade, CASE WHEN ok THEN 'Class' END AS class,
              CASE WHEN ok THEN upper(lang) END AS subject, CASE WHEN ok THEN source END AS board,
              CASE WHEN ok THEN (2000 + doc_id % 30)::VARCHAR END AS year,
              CASE WHEN ok THEN concat(10 + doc_id % 3, 'th Class ', upper(lang), ' ', source) END AS title,
              CASE WHEN ok THEN 'pdf' END AS extension FROM (SELECT *, doc_id % 10 <> 9 AS ok FROM documents)""",
)
def filename_metadata(spark, sf):
    named = table(spark, sf, "documents").select("doc_id", F.expr(_NAME).alias("name"))
    return named.select("doc_id", *files.filename_parts(F.col("name")))


@query(
    "filename_metadata_positional",
    """SELECT doc_id, 10 + doc_id % 3 || 'th' AS grade, 'Class' AS class, upper(lang) AS subject, source AS board, 'Year' AS year,
              concat(10 + doc_id % 3, 'th Class ', upper(lang), ' ', source) AS title, (2000 + doc_id % 30) || '.pdf' AS extension
       FROM documents WHERE doc_id % 10 <> 9
       UNION ALL SELECT doc_id, 'notes.txt', NULL, NULL, NULL, NULL, 'notes.txt', NULL FROM documents WHERE doc_id % 10 = 9""",
)
def filename_metadata_positional(spark, sf):
    named = table(spark, sf, "documents").select("doc_id", F.expr(_NAME).alias("name"))
    return named.select("doc_id", *files.filename_parts_by_position(F.col("name")))


@query(
    "chunk_file_round_trip",
    """SELECT doc_id AS chunk_ix, md5(text) AS chunk_id, md5(text) AS text_md5, lang AS subject, source AS book_id FROM documents""",
)
def chunk_file_round_trip(spark, sf):
    path = scratch_path(spark, "chunks")
    files.write_chunks(chunk_rows(spark, sf), path)
    return files.read_chunks(spark, path).select("chunk_ix", "chunk_id", F.md5("text").alias("text_md5"), "subject", "book_id")


@query(
    "text_file_round_trip",
    r"""SELECT md5(line) AS line_md5, count(*) AS n FROM (SELECT unnest(string_split(text, E'\n')) AS line FROM documents) GROUP BY 1""",
)
def text_file_round_trip(spark, sf):
    """A text file holds lines, so the lines are what comes back."""
    path = scratch_path(spark, "text")
    files.write_text(spread(table(spark, sf, "documents").select("text")), "text", path)
    lines = spark.read.text(path, lineSep="\n")
    return lines.groupBy(F.md5("value").alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


PER_BOOK = 256
"""Documents that share a book file."""


@query(
    "book_file_scan",
    r"""SELECT md5(line) AS page_md5, length(line)::BIGINT AS n_chars, count(*) AS n FROM
        (SELECT unnest(string_split(text, E'\n')) AS line FROM documents) GROUP BY ALL""",
)
def book_file_scan(spark, sf):
    """A directory of book files, decoded to pages in the tasks; here a page is a line of a text file."""
    path = scratch_path(spark, "books")
    files.write_text(spread(table(spark, sf, "documents").select("text")), "text", path, PER_BOOK)
    decoded = files.decode_pages(files.book_files(spark, path, "*.txt"), lambda data: data.decode().split("\n")[:-1])
    pages = files.page_rows(decoded)
    return pages.groupBy(F.md5("text").alias("page_md5"), F.length("text").cast("long").alias("n_chars")).agg(F.count(F.lit(1)).alias("n"))


PER_FILE = 64
"""Documents whose tests share a question file."""


def question_files(spark, sf, strict: bool) -> str:
    """Stored question files: pretty-printed objects with a test per document, whose questions are its whole text.

    Ids are numbers, texts or, in the lenient files, missing. There every seventh entry is no test and another
    has no questions.
    """

    def make():
        ident = lambda i: F.when(i == 0, "1").when(i == 1, "q2")
        questions = F.transform(
            F.sequence(F.lit(0), (F.col("doc_id") % (2 if strict else 3)).cast("int")),
            lambda i: F.struct(
                ident(i).alias("id"),
                F.concat(i.cast("string"), F.lit(" "), "text").alias("question"),
                F.lit("").alias("explanation"),
                F.array(F.lit("A. yes"), F.lit("B. no")).alias("options"),
                F.lit("B. no").alias("correct_answer"),
            ),
        )
        test = F.struct(F.when(F.col("doc_id") % 2 == 0, "named test").alias("name"), F.col("lang").alias("subject"), questions.alias("questions"))
        body = F.regexp_replace(F.to_json(test, {"pretty": "true"}), r'"id" : "(\d+)"', '"id" : $1')
        if not strict:
            body = F.when(F.col("doc_id") % 7 == 0, '"a remark"').when(F.col("doc_id") % 7 == 1, '{"subject": "none"}').otherwise(body)
        entry = F.concat(F.lit('"test'), F.col("doc_id").cast("string"), F.lit('" : '), body)
        rows = table(spark, sf, "documents").select(F.expr(f"doc_id div {PER_FILE}").alias("file"), entry.alias("entry"))
        objects = rows.groupBy("file").agg(F.concat(F.lit("{\n  "), F.array_join(F.collect_list("entry"), ",\n  "), F.lit("\n}")).alias("value"))
        path = scratch_path(spark, "questions")
        objects.repartition("file").write.partitionBy("file").text(path)
        return path

    return built_once(spark, sf, f"questions-{strict}", make)


def _questions_sql(choices: int, where: str) -> str:
    return f"""q AS (SELECT doc_id, lang, ['1', 'q2', NULL][i + 1] AS id, i || ' ' || text AS question
        FROM (SELECT doc_id, lang, text, unnest(range(0, doc_id % {choices} + 1)) AS i FROM documents WHERE {where}))"""


@query(
    "question_file_scan",
    f"""WITH {_questions_sql(3, 'doc_id % 7 > 1')} SELECT CASE WHEN doc_id % 2 = 0 THEN 'named test' ELSE 'test' || doc_id END AS source,
            lang AS subject, id, md5(question) AS question_md5, 'B. no' AS correct_answer FROM q""",
)
def question_file_scan(spark, sf):
    found = files.read_questions(spark, question_files(spark, sf, strict=False))
    return found.select("source", "subject", "id", F.md5("question").alias("question_md5"), "correct_answer")


@query(
    "question_file_keys",
    f"""WITH {_questions_sql(2, 'true')} SELECT 'test' || doc_id || ':' || id AS key, lang AS subject, md5(question) AS question_md5 FROM q""",
)
def question_file_keys(spark, sf):
    found = files.read_keyed_questions(spark, question_files(spark, sf, strict=True))
    return found.select("key", "subject", F.md5("question").alias("question_md5"))


@query(
    "pages_joined",
    r"""SELECT doc_id, md5(replace(text, E'\n', '')) AS plain_md5, md5(text || E'\n') AS lines_md5 FROM documents""",
)
def pages_joined(spark, sf):
    """The lines of a document as its pages, joined as they are and with a line end after each."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.split("text", "\n").alias("pages"))
    return docs.select(
        "doc_id", F.md5(files.joined_text(F.col("pages"))).alias("plain_md5"), F.md5(files.joined_text(F.col("pages"), "\n")).alias("lines_md5")
    )


@query(
    "text_file_scan",
    f"""SELECT doc_id // {PER_FILE} AS file, md5(string_agg(text, E'\\n' ORDER BY doc_id) || E'\\n') AS text_md5 FROM documents GROUP BY 1""",
)
def text_file_scan(spark, sf):
    """Text files of a bounded number of documents each, read back whole; the writer ends a file with a line end."""
    path = scratch_path(spark, "texts")
    rows = table(spark, sf, "documents").select(F.expr(f"doc_id div {PER_FILE}").alias("file"), F.struct("doc_id", "text").alias("row"))
    joined = rows.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("row")).getField("text"), "\n").alias("value"))
    joined.repartition("file").write.partitionBy("file").text(path)
    return files.read_text(spark, path, ["file"]).select(F.col("file").cast("long").alias("file"), F.md5("text").alias("text_md5"))


@query(
    "results_resume",
    """SELECT doc_id::VARCHAR AS key, lang AS subject, CASE WHEN doc_id % 4 = 1 THEN 'A' ELSE 'B' END AS predicted FROM documents""",
)
def results_resume(spark, sf):
    """Two runs of one evaluation: the second only adds what the first has not stored."""
    path = scratch_path(spark, "results")
    work = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("lang").alias("subject"), "doc_id")

    def run(rows, letter):
        done = files.read_results(spark, path)
        files.append_results(
            remaining(rows, done).select(
                "key", "subject", F.lit("q").alias("question"), F.lit("A").alias("correct"),
                F.lit(letter).alias("predicted"), F.lit(letter == "A").alias("is_correct"),
            ),
            path,
        )

    run(work.where("doc_id % 4 = 1"), "A")
    run(work, "B")
    return files.read_results(spark, path).select("key", "subject", "predicted")


def _vectors(rows):
    return rows.withColumn("embedding", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")))


@query(
    "collection_upsert",
    f"""WITH {FIRST_SQL}, early AS (SELECT md5(text) AS chunk_id, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 1 GROUP BY 1)
        SELECT f.chunk_id, d.lang AS subject, d.n_chars::DOUBLE AS first_value
        FROM firsts f LEFT JOIN early e USING (chunk_id) JOIN documents d ON d.doc_id = coalesce(e.doc_id, f.doc_id)""",
)
def collection_upsert(spark, sf):
    """Odd documents first, then all: ids already stored are left alone."""
    store = Collection(spark, scratch_path(spark, "collection"))
    rows = _vectors(chunk_rows(spark, sf)).withColumn("book_id", F.lit("all"))
    store.add(rows.where("chunk_ix % 2 = 1"))
    store.add(rows)
    return store.read().select("chunk_id", "subject", F.get("embedding", F.lit(0)).cast("double").alias("first_value"))


def _stored(spark, sf):
    def make():
        store = Collection(spark, scratch_path(spark, "stored"))
        store.add(_vectors(chunk_rows(spark, sf)).withColumn("book_id", F.lit("all")))
        return store

    return built_once(spark, sf, "stored", make)


@query(
    "collection_metadata_update",
    f"""WITH {FIRST_SQL} SELECT chunk_id, d.lang AS subject, CASE WHEN doc_id % 3 = 0 THEN '12th' ELSE '11th' END AS grade,
            CASE WHEN doc_id % 3 = 0 THEN 'Ch ' || source END AS chapter, md5(text) AS text_md5 FROM firsts JOIN documents d USING (doc_id)""",
)
def collection_metadata_update(spark, sf):
    store = Collection(spark, scratch_path(spark, "patched"))
    rows = _vectors(chunk_rows(spark, sf)).withColumn("source", F.col("book_id")).withColumn("book_id", F.lit("all"))
    store.add(rows)
    firsts = rows.groupBy("chunk_id").agg(F.min(F.struct("chunk_ix", "source")).alias("f")).where("f.chunk_ix % 3 = 0")
    store.update_metadata(
        firsts.select("chunk_id", F.lit("12th").alias("grade"), F.concat(F.lit("Ch "), F.col("f.source")).alias("chapter"))
    )
    return store.read().select("chunk_id", "subject", "grade", "chapter", F.md5("text").alias("text_md5"))


@query(
    "collection_delete",
    f"WITH {FIRST_SQL} SELECT chunk_id FROM firsts WHERE chunk_id NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id))",
)
def collection_delete(spark, sf):
    store = Collection(spark, scratch_path(spark, "deleted"))
    store.add(_vectors(chunk_rows(spark, sf)))
    ids = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.md5("text").alias("chunk_id"))
    store.delete(ids)
    return store.read().select("chunk_id")


@query(
    "collection_get",
    f"""WITH {FIRST_SQL} SELECT chunk_id, lang AS subject FROM firsts JOIN documents d USING (doc_id)
        WHERE chunk_id IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id) WHERE quality = 1)""",
)
def collection_get(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1")
    ids = table(spark, sf, "documents").join(good, "doc_id").select(F.md5("text").alias("chunk_id"))
    return _stored(spark, sf).get(ids, ["subject"])


@query("collection_count", "SELECT subject, count(*) AS n FROM (SELECT md5(text) AS chunk_id, arg_min(lang, doc_id) AS subject FROM documents GROUP BY 1) GROUP BY ROLLUP (subject)")
def collection_count(spark, sf):
    from folioscope.operators.chunking import count_by_subject

    return count_by_subject(_stored(spark, sf).read()).withColumnRenamed("n_chunks", "n")


@query(
    "subject_index_build",
    "SELECT md5(text) AS chunk_id, 64::BIGINT AS dimensions FROM documents WHERE lang = 'de' GROUP BY 1",
)
def subject_index_build(spark, sf):
    store = Collection(spark, scratch_path(spark, "subject"))
    store.add_texts(chunk_rows(spark, sf), subject="de")
    return store.read().select("chunk_id", F.size("embedding").cast("long").alias("dimensions"))


@query("embedding_cache", "SELECT md5(text) AS chunk_id, 64::BIGINT AS dimensions FROM documents GROUP BY 1")
def cached_embeddings(spark, sf):
    """The cache is filled for a third of the documents before all are asked for."""
    path = scratch_path(spark, "cache")
    rows = chunk_rows(spark, sf)
    embedding_cache(spark, path, rows.where("chunk_ix % 3 = 0"))
    return embedding_cache(spark, path, rows).select("chunk_id", F.size("embedding").cast("long").alias("dimensions"))


INGEST_SQL = "SELECT md5(text) AS chunk_id, min(length(text))::BIGINT AS n_chars FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 10 GROUP BY 1"


@query("incremental_ingest", INGEST_SQL)
def incremental_ingest(spark, sf):
    """Documents stream in as whole-text chunks; copies are stored once."""
    store = Collection(spark, scratch_path(spark, "ingested"))
    source = scratch_path(spark, "incoming")
    docs = table(spark, sf, "documents").select(F.col("source").alias("book_id"), "text", F.col("lang").alias("subject"))
    docs.write.parquet(source)
    stream = ingest_books(
        spark, source, "book_id string, text string, subject string", store, scratch_path(spark, "stream"),
        prepare=lambda batch: batch, method="fixed", size=1 << 24, overlap=0,
    )
    stream.awaitTermination()
    return store.read().select("chunk_id", F.length("text").cast("long").alias("n_chars"))


@query("incremental_ingest_state", INGEST_SQL)
def incremental_ingest_state(spark, sf):
    """Odd documents arrive first, then all of them in late and repeated files, after a restart; ids are kept as streaming state."""
    store = Collection(spark, scratch_path(spark, "ingested"))
    source, checkpoint = scratch_path(spark, "incoming"), scratch_path(spark, "stream")
    docs = table(spark, sf, "documents").select(F.col("source").alias("book_id"), "text", F.col("lang").alias("subject"), "doc_id")
    for arriving in (docs.where("doc_id % 2 = 1"), docs):
        arriving.drop("doc_id").write.mode("append").parquet(source)
        ingest_books(
            spark, source, "book_id string, text string, subject string", store, checkpoint,
            prepare=lambda books: books, remember="2 hours", method="fixed", size=1 << 24, overlap=0,
        ).awaitTermination()
    return store.read().select("chunk_id", F.length("text").cast("long").alias("n_chars"))
