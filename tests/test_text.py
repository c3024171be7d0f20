"""Column functions against small cases with known results."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import headings, mcq, text

BAD = "�"
NBSP, EM = " ", " "


def one(spark, column, value, ddl="t string"):
    return spark.createDataFrame([(value,)], ddl).select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "raw, cleaned",
    [
        ("Intro text\nFig. 2.1 Chains\nAs shown in Fig. 2.1 here", "Intro text\nAs shown in Fig. 2.1 here"),
        (f"Body at 37 {BAD}C", "Body at 37°C"),
        (f"it{BAD}s warm", "it's warm"),
        ("a (cid:3)  (cid:4)\tb end", "a b end"),
        ("first line\nk\no\nsecond line", "first line\nsecond line"),
        ("one line\n\n\n\n\ntwo line", "one line\n\ntwo line"),
        (" eLearn.Punjab heading text ", "heading text"),
        (f"{NBSP}{NBSP}x{NBSP}\n{EM}ab{EM}\nlong line here", "long line here"),
        ("", ""),
    ],
)
def test_cleaning(spark, raw, cleaned):
    assert one(spark, text.clean_board_text, raw) == cleaned


def test_cleaning_is_stable_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(text.clean_board_text(F.col("text")).alias("once"))
    assert docs.where(text.clean_board_text(F.col("once")) != F.col("once")).count() == 0


@pytest.mark.parametrize(
    "raw, tokens",
    [
        ("What is the H₂O % in bone-cells? It's 20.", ["h₂o", "bone", "cells", "s", "20"]),
        ("How does DNA_replication work?", ["dna_replication", "work"]),
        ("", []),
    ],
)
def test_tokens(spark, raw, tokens):
    assert one(spark, text.tokens, raw) == tokens


@pytest.mark.parametrize(
    "page, label",
    [
        ("  12.1 Gaseous Exchange eLearn.Punjab\n text", "12.1 Gaseous Exchange"),
        ("x\n 3.2 Some Title Here\nfoo bar", "3.2. Some Title Here"),
        ("Thermal Physics\nfoo.", "Thermal Physics"),
        ("foo.\nThermal Physics\n", None),
        ("Multiple Choice Questions\n", None),
        ("", None),
    ],
)
def test_page_heading(spark, page, label):
    assert one(spark, headings.page_heading, page) == label


def labels(*names):
    return F.array(*[F.struct(F.lit(n).alias("label")) for n in names])


def test_locate_labels(spark):
    found = one(
        spark,
        lambda c: headings.locate_labels(c, labels("1. Intro", "2. Bio (Mol)", "9. Missing")),
        "zz 1. Intro\nx 2.  Bio (Mol) y 2. Bio (Mol)",
    )
    assert [tuple(r) for r in found] == [(3, "1. Intro"), (14, "2. Bio (Mol)")]


def test_locate_counts_characters_not_units(spark):
    found = one(spark, lambda c: headings.locate_labels(c, labels("Alpha Beta")), "\U0001f600\U0001f600 Alpha\n Beta")
    assert [tuple(r) for r in found] == [(3, "Alpha Beta")]


def test_equal_offsets_keep_the_later_label(spark):
    found = one(spark, lambda c: headings.locate_labels(c, labels("Front Matter", "13. Gas", "13. Gas Exchange")), "x 13. Gas Exchange")
    assert [tuple(r) for r in found] == [(0, "Front Matter"), (2, "13. Gas Exchange")]


@pytest.mark.parametrize("offset, chapter", [(-1, "Unknown chapter"), (0, "A"), (9, "A"), (10, "C"), (99, "C")])
def test_chapter_at(spark, offset, chapter):
    bounds = F.array(*[F.struct(F.lit(o).alias("offset"), F.lit(n).alias("chapter")) for o, n in [(0, "A"), (10, "B"), (10, "C")]])
    assert one(spark, lambda c: headings.chapter_at(bounds, F.lit(offset)), "x") == chapter


def test_answer_letters(spark):
    said = ["B", "b) x", "The answer is C", "B. a virus", "", "Answer: D because A is wrong"]
    rows = spark.createDataFrame([(s,) for s in said], "t string")
    valid = F.array(*map(F.lit, "ABCD"))
    out = rows.select(mcq.answer_letter(F.col("t")), mcq.answer_letter_robust(F.col("t"), valid)).collect()
    assert [r[0] for r in out] == ["B", "B", "T", "B", "", "A"]
    assert [r[1] for r in out] == ["B", "B", "C", "A", "", "A"]


@pytest.mark.parametrize("stem, kept", [("Which of statement II holds?", False), ("Water is", False), ("Water is:", True)])
def test_standalone_stems(spark, stem, kept):
    assert one(spark, mcq.is_standalone, stem) is kept


def test_missing_section_header_fails(spark):
    with pytest.raises(Exception, match="Section header not found"):
        one(spark, mcq.paper_sections, "Biology\nno other section")
