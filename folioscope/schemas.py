"""Spark schemas of the tables the engine reads and writes, as DDL."""

PAGES = "book_id STRING, page_index BIGINT, text STRING"

BOUNDARIES = "ARRAY<STRUCT<offset: BIGINT, chapter: STRING>>"

BOOKS = (
    "book_id STRING, text STRING, subject STRING, grade STRING, board STRING, year STRING, "
    f"title STRING, extension STRING, chapter_boundaries {BOUNDARIES}"
)

CHUNKS = (
    "chunk_id STRING, text STRING, subject STRING, grade STRING, chapter STRING, "
    "book_id STRING, chunk_ix BIGINT, start_index BIGINT"
)

VECTORS = "chunk_id STRING, embedding ARRAY<FLOAT>, text STRING, subject STRING, grade STRING, chapter STRING"

QUESTION = "STRUCT<id: STRING, question: STRING, explanation: STRING, options: ARRAY<STRING>, correct_answer: STRING>"

TEST = f"STRUCT<name: STRING, subject: STRING, questions: ARRAY<{QUESTION}>>"

QUESTIONS = "key STRING, subject STRING, question STRING, options ARRAY<STRING>, correct_answer STRING"

RESULTS = "key STRING, subject STRING, question STRING, correct STRING, predicted STRING, is_correct BOOLEAN"

TIMINGS = "question_id STRING, stage STRING, seconds DOUBLE"

TABLE_GRIDS = "page_index BIGINT, table_ix BIGINT, rows ARRAY<ARRAY<STRING>>"
