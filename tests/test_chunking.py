"""Splitters against a plain-Python reading of their rules, and their laws."""

import random
import re

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from folioscope.operators import chunking

TEXT = st.text(alphabet="ab. !?\n\n ée", max_size=400)


def chunks_of(spark, make, values, *args):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, text string")
    rows = make(df, "text", *args).orderBy("id", "chunk_ix").collect()
    return [[r.text for r in rows if r.id == i] for i in range(len(values))]


def random_texts(n, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab. !?\n\ré\U0001f600 ") for _ in range(rng.randrange(0, 300))) for _ in range(n)]


def plain_fixed(text, size, overlap):
    return [text[s : s + size] for s in range(0, len(text), size - overlap)]


def random_sentences(n, seed=11):
    """Lists of sentences of words with one space between, each ended by a mark."""
    rng = random.Random(seed)
    sentence = lambda: " ".join(rng.choice(["a", "bb", "ccc", "é", "dddddd"]) for _ in range(rng.randrange(1, 7))) + rng.choice(".!?")
    return [[sentence() for _ in range(rng.randrange(1, 12))] for _ in range(n)]


@pytest.mark.parametrize(
    "text, size, overlap, expected",
    [("abcdefghij", 4, 1, ["abcd", "defg", "ghij", "j"]), ("abcdefg", 4, 2, ["abcd", "cdef", "efg", "g"]), ("", 4, 1, [])],
)
def test_fixed_cases(spark, text, size, overlap, expected):
    assert chunks_of(spark, chunking.fixed_chunks, [text], size, overlap) == [expected]


@pytest.mark.parametrize("size, overlap", [(10, 3), (10, 8), (50, 0)])
def test_fixed_matches_plain(spark, size, overlap):
    texts = random_texts(60)
    assert chunks_of(spark, chunking.fixed_chunks, texts, size, overlap) == [plain_fixed(t, size, overlap) for t in texts]


def test_fixed_rejects_endless_overlap(spark):
    with pytest.raises(ValueError):
        chunks_of(spark, chunking.fixed_chunks, ["a"], 4, 4)


@pytest.mark.parametrize(
    "text, size, expected",
    [
        ("One two. Three! Four five six seven. Eight?", 20, ["One two. Three!", "Four five six seven.", "Eight?"]),
        ("This first sentence is too long. Ok.", 10, ["", "This first sentence is too long.", "Ok."]),
    ],
)
def test_sentence_cases(spark, text, size, expected):
    assert chunks_of(spark, chunking.sentence_chunks, [text], size) == [expected]


@pytest.mark.parametrize("size", [10, 25, 60])
def test_sentence_laws(spark, size):
    """Nothing is lost or moved, a chunk exceeds the size only as one sentence, and no chunk could take one more."""
    lists = random_sentences(80)
    for sentences, chunks in zip(lists, chunks_of(spark, chunking.sentence_chunks, [" ".join(x) for x in lists], size)):
        assert " ".join(c for c in chunks if c) == " ".join(sentences)
        groups = [re.findall(r"[^.!?]+[.!?]", c) for c in chunks if c]
        groups = [[x.strip() for x in g] for g in groups]
        assert [x for g in groups for x in g] == sentences
        for here, after in zip(groups, groups[1:]):
            assert len(" ".join([*here, after[0]])) > size
        for g in groups:
            assert len(g) == 1 or len(" ".join(g)) <= size


@settings(max_examples=200, deadline=None, derandomize=True)
@given(TEXT, st.integers(5, 60), st.integers(0, 5))
@example("???? ?\n?", 5, 2)
def test_recursive_laws(text, size, overlap):
    """The search for a chunk starts where the overlap with the chunk before begins."""
    earliest = 0
    for chunk, start in chunking.chunks_with_starts(text, size, overlap):
        assert chunk and chunk == chunk.strip()
        assert chunk in text
        assert len(chunk) <= size
        if start >= 0:
            assert text[start : start + len(chunk)] == chunk
            assert start >= earliest
        earliest = max(0, start + len(chunk) - overlap)


@settings(max_examples=100, deadline=None, derandomize=True)
@given(TEXT, st.integers(5, 60))
def test_recursive_keeps_every_visible_character(text, size):
    joined = "".join(c for c, _ in chunking.chunks_with_starts(text, size, 0))
    assert re.sub(r"\s", "", joined) == re.sub(r"\s", "", text)


def test_recursive_cases():
    split = lambda t, size, overlap: [c for c, _ in chunking.chunks_with_starts(t, size, overlap)]
    assert split("aa bb cc dd", 5, 0) == ["aa bb", "cc", "dd"]
    assert split("one two three four", 9, 4) == ["one two", "three", "four"]
    assert split("para one\n\npara two", 11, 0) == ["para one", "para two"]
    assert split("x" * 12, 5, 2) == ["xxxxx", "xxxxx", "xxxxx", "xxx"]


def test_recursive_in_spark_matches_the_helper(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = chunking.recursive_chunks(docs, "text", 450, 100).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    expected = {(d, i, c, s) for d, t in texts.items() for i, (c, s) in enumerate(chunking.chunks_with_starts(t, 450, 100))}
    assert {(r.doc_id, r.chunk_ix, r.text, r.start_index) for r in rows} == expected
    assert len(rows) == len(expected)


def test_unknown_method(spark):
    books = spark.createDataFrame([("b", "t", "s", "g")], "book_id string, text string, subject string, grade string")
    with pytest.raises(ValueError, match="Unknown chunking method"):
        chunking.chunk_books(books, method="other")
