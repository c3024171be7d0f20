"""Queries against their SQL twins on documents that the test tables do not hold."""

import duckdb
import pytest

import __spark_entry__ as contract
from oracle import compare


def differences(spark, folder, name, docs):
    """``docs`` are ``text, lang, source``, numbered from 0."""
    rows = [(i, text, lang, source, len(text)) for i, (text, lang, source) in enumerate(docs)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return compare(contract.queries()[name](spark, str(folder)), con, contract.oracle_sql()[name])


def test_lines_that_read_like_titles_start_no_chapter(spark, tmp_path):
    docs = [("La the", "en", "src0"), ("First line.\nOf this.\nOf the\n12 Some Title\nLast.", "en", "src0"), ("", "en", "src0")]
    assert differences(spark, tmp_path, "chapter_boundaries", docs) is None


def test_copies_of_a_text_in_several_languages_are_all_looked_up(spark, tmp_path):
    docs = [("La la.", lang, "src0") for lang in ("fr", "es", "fr", "es", "en", "de")] + [("A.", lang, "src1") for lang in ("en", "fr")]
    assert differences(spark, tmp_path, "fusion_lookup", [*docs, ("alone", "en", "src1")]) is None


@pytest.mark.parametrize("name", ["paper_questions", "paper_valid_questions", "paper_question_counts"])
def test_a_word_like_an_option_letter_is_text(spark, tmp_path, name):
    docs = [("A. the of", "en", "src0"), ("B.", "en", "src0"), ("A. A. A. 3. 4. A.", "en", "src0"), ("3. A. " * 20, "en", "src0")]
    assert differences(spark, tmp_path, name, docs) is None
