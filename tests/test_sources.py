"""Files, the vector collection, streaming ingestion, generation and the composed jobs."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from folioscope.operators import chapters, evaluation, generation
from folioscope.plans import jobs
from folioscope.plans.timing import Stopwatch, timed
from folioscope.sources import files
from folioscope.sources.collection import Collection
from folioscope.streaming.ingest import ingest_books

BOOK = "11th Class Chemistry PunjabBoard Year 2025.pdf"


decode = lambda data: data.decode().split("\f")  # a lambda is sent to the tasks by value


@pytest.fixture
def library(tmp_path):
    (tmp_path / "12th Class Biology Board Year 2026.pdf").write_text(
        "Cover page.\n\f1.1 Cell Theory eLearn.Punjab\nCells are small. Fig. 1.1\f more on cells.\n\f2.1 Gas Exchange eLearn.Punjab\nGases move."
    )
    (tmp_path / BOOK).write_text("\f".join(["front"] * 4 + ["PERIODIC TABLE AND\n1\nrows and columns", "more"]))
    (tmp_path / "notes.txt").write_text("not a book")
    return str(tmp_path)


def test_directory_scan_takes_books_only(spark, library):
    assert sorted(r.filename for r in files.book_files(spark, library).collect()) == sorted([BOOK, "12th Class Biology Board Year 2026.pdf"])


def test_missing_directory_fails(spark, tmp_path):
    with pytest.raises(AnalysisException):
        files.book_files(spark, str(tmp_path / "none")).collect()


def test_page_joins_differ(spark, library):
    decoded = files.decode_pages(files.book_files(spark, library), decode).where(F.col("filename") == BOOK)
    plain, lines = decoded.select(files.joined_text(F.col("page_texts")), files.joined_text(F.col("page_texts"), "\n")).first()
    assert plain.startswith("frontfront") and lines.startswith("front\nfront\n") and lines.endswith("more\n")


def test_books_with_boundaries(spark, library):
    books = files.load_books(spark, library, decode)
    rows = {r.subject: r for r in chapters.book_boundaries(books).collect()}
    biology, chemistry = rows["Biology"], rows["Chemistry"]
    assert (biology.grade, biology.board, biology.year, biology.extension) == ("12th", "Board", "2026", "pdf")
    assert [b.chapter for b in biology.chapter_boundaries] == ["Front Matter", "1.1 Cell Theory", "2.1 Gas Exchange"]
    for b in biology.chapter_boundaries[1:]:
        assert biology.text[b.offset :].startswith(b.chapter)
    assert [tuple(b) for b in chemistry.chapter_boundaries] == [(chemistry.text.index("PERIODIC"), "1. Periodic Table and Periodic Properties")]


def test_page_rows_and_hand_made_starts(spark, library):
    pages = files.page_rows(files.decode_pages(files.book_files(spark, library), decode))
    filled = chapters.fill_labels(chapters.raw_labels(pages, chapters.chapter_starts(spark)))
    labels = [r.chapter for r in filled.where(F.col("book_id") == BOOK).orderBy("page_index").collect()]
    assert labels == ["Front Matter"] * 4 + ["1. Periodic Table and Periodic Properties"] * 2


def test_grids(spark, library):
    grid = files.decode_grids(files.book_files(spark, library), lambda data: [[[["a", None]]], []])
    assert {(r.page_index, r.table_ix, str(r.rows)) for r in grid.collect()} == {(0, 0, "[['a', None]]")}


def question_file(path, tests):
    path.write_text(json.dumps(tests, indent=2))
    return str(path)


BIOLOGY = {"name": "One", "subject": "Biology", "questions": [{"id": 6, "question": "q?", "options": ["A. x"], "correct_answer": "A"}]}


def test_lenient_questions_keep_every_question(spark, tmp_path):
    odd = {"subject": "Physics", "questions": [{"id": "six", "question": "r?"}, {"question": "no id?"}]}
    path = question_file(tmp_path / "q.json", {"t1": BIOLOGY, "t2": odd, "note": "text", "empty": {"subject": "None"}, "none": {"questions": []}})
    found = {(r.source, r.subject, r.id, r.question) for r in files.read_questions(spark, path).collect()}
    assert found == {("One", "Biology", "6", "q?"), ("t2", "Physics", "six", "r?"), ("t2", "Physics", None, "no id?")}


def test_strict_questions(spark, tmp_path):
    other = {"subject": "Physics", "questions": [{"id": "six", "question": "r?", "options": [], "correct_answer": "B"}]}
    path = question_file(tmp_path / "q.json", {"t1": BIOLOGY, "t2": other})
    assert {r.key for r in files.read_keyed_questions(spark, path).collect()} == {"t1:6", "t2:six"}


@pytest.mark.parametrize("entry", ["text", {"subject": "None"}, {"questions": [{"question": "no id?"}]}])
def test_strict_questions_fail_on_incomplete_entries(spark, tmp_path, entry):
    path = question_file(tmp_path / "q.json", {"t1": BIOLOGY, "bad": entry})
    with pytest.raises(Exception, match="in entry bad"):
        files.read_keyed_questions(spark, path).collect()


@pytest.mark.parametrize("read", [files.read_questions, files.read_keyed_questions])
def test_questions_fail_on_text_that_is_no_json(spark, tmp_path, read):
    (tmp_path / "q.json").write_text('{"t1": {"questions": [')
    with pytest.raises(Exception, match="(?i)malformed"):
        read(spark, str(tmp_path / "q.json")).collect()


def test_chunk_file_keeps_characters(spark, tmp_path):
    df = spark.createDataFrame([("id", "37°C “x”\n", "s", "g", None, "b", 0, 0)], "chunk_id string, text string, subject string, grade string, chapter string, book_id string, chunk_ix long, start_index long")
    files.write_chunks(df, str(tmp_path / "c"))
    assert files.read_chunks(spark, str(tmp_path / "c")).first().text == "37°C “x”\n"
    assert "°" in "".join(p.read_text() for p in (tmp_path / "c").glob("part-*"))


def test_whole_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert files.read_text(spark, str(tmp_path)).first().text == "one\ntwo"


def test_collection_life(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "c"))
    assert store.count() == 0
    ddl = "chunk_id string, embedding array<float>, text string, subject string, grade string, chapter string"
    rows = [(f"c{i}", [float(i)], f"t{i}", "s", "g", None) for i in range(5)]
    store.add(spark.createDataFrame(rows[:3], ddl))
    store.add(spark.createDataFrame(rows, ddl))
    store.add(spark.createDataFrame(rows, ddl))
    assert store.count() == 5
    store.update_metadata(spark.createDataFrame([("c1", "Ch 1"), ("zz", "no")], "chunk_id string, chapter string"))
    assert {(r.chunk_id, r.chapter, r.embedding[0]) for r in store.read().collect()} == {(f"c{i}", "Ch 1" if i == 1 else None, float(i)) for i in range(5)}
    ids = spark.createDataFrame([("c1",), ("c4",), ("zz",)], "chunk_id string")
    assert {r.chunk_id for r in store.get(ids).collect()} == {"c1", "c4"}
    store.delete(ids)
    assert {r.chunk_id for r in store.read().collect()} == {"c0", "c2", "c3"}


def files_of(path):
    return {p.name: p.stat().st_mtime_ns for p in path.rglob("part-*")}


def test_collection_merges_changes_when_read(spark, tmp_path):
    """Updates and deletions write no vector, hold only for what was stored before them, and go into the next generation."""
    ddl = "chunk_id string, embedding array<float>, text string, subject string, grade string, chapter string"
    rows = spark.createDataFrame([(f"c{i}", [float(i)], f"t{i}", "s", "g", None) for i in range(40)], ddl)
    store = Collection(spark, str(tmp_path / "c"), buckets=4)
    store.update_metadata(rows.select("chunk_id", "chapter"))
    store.add(rows)
    vectors = tmp_path / "c" / "rows-000001-4"
    before = files_of(vectors)
    assert 0 < len(before) <= 4
    change = lambda id_, **v: store.update_metadata(spark.createDataFrame([(id_, *v.values())], "chunk_id string, " + ", ".join(f"{c} string" for c in v)))
    change("c1", chapter="one", grade="9")
    change("c1", chapter="two")
    change("c1", grade=None)
    store.delete(spark.createDataFrame([("c2",), ("c2",), ("c3",)], "chunk_id string"))
    assert files_of(vectors) == before
    found = {r.chunk_id: (r.grade, r.chapter) for r in store.read().collect()}
    assert found["c1"] == ("9", "two") and not {"c2", "c3"} & set(found) and len(found) == 38
    store.add(rows.where("chunk_id in ('c1', 'c2')").withColumn("chapter", F.lit("again")))
    want = {r.chunk_id: (r.grade, r.chapter) for r in store.read().collect()}
    assert want["c2"] == ("g", "again") and want["c1"] == ("9", "two") and len(want) == 39
    change("c2", chapter="later")
    want["c2"] = ("g", "later")
    for _ in range(2):
        assert {r.chunk_id: (r.grade, r.chapter) for r in store.read().collect()} == want
        opened = Collection(spark, str(tmp_path / "c"), buckets=8)
        spark.sql(f"DROP TABLE {store._table(store._generation())}")  # as a new application, which knows only the files
        assert opened.count() == 39
        opened.compact()
        assert opened._generation().endswith("-8") and not opened._folders(opened._changes_path(opened._generation()), "c")


@pytest.mark.parametrize("changed", [False, True])
def test_stored_rows_are_not_shuffled(spark, tmp_path, changed):
    """Get, insert and merge meet the stored rows bucket by bucket."""
    ddl = "chunk_id string, embedding array<float>, text string, subject string, grade string, chapter string"
    rows = spark.createDataFrame([(f"c{i}", [float(i)], f"t{i}", "s", "g", None) for i in range(100)], ddl)
    store = Collection(spark, str(tmp_path / "c"), buckets=4)
    store.add(rows)
    if changed:
        store.update_metadata(rows.select("chunk_id", F.lit("x").alias("chapter")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (store.get(rows.select("chunk_id")), store.missing(rows.withColumn("chunk_id", F.concat("chunk_id", F.lit("0"))))):
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString()
            lines = plan[plan.index("Final Plan") : plan.index("Initial Plan")].splitlines() if "Initial Plan" in plan else plan.splitlines()
            scans = [i for i, line in enumerate(lines) if "bucketed_" in line or "rows-000001" in line]
            assert scans and all("Bucketed: true" in lines[i] for i in scans)
            for i in scans:
                depth = len(lines[i]) - len(lines[i].lstrip(" :+-*()0123456789"))
                above = [line for line in lines[:i] if len(line) - len(line.lstrip(" :+-*()0123456789")) < depth]
                until = next(k for k in range(len(above) - 1, -1, -1) if "Join" in above[k])
                assert not any("Exchange" in line for line in above[until:])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stream_ingests_each_chunk_once(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "store"))
    ddl = "book_id string, text string, subject string"

    def arrive(rows):
        spark.createDataFrame(rows, ddl).write.mode("append").parquet(str(tmp_path / "in"))
        ingest_books(spark, str(tmp_path / "in"), ddl, store, str(tmp_path / "ck"), lambda b: b, method="fixed", size=50, overlap=0).awaitTermination()

    arrive([("a", "first text of a book", "x"), ("b", "first text of a book", "x")])
    assert store.count() == 1
    arrive([("c", "first text of a book", "x"), ("d", "another text, a longer one", "y")])
    assert {r.text for r in store.read().collect()} == {"first text of a book", "another text, a longer one"}


def test_retry_only_on_lost_connections():
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise ConnectionError
        return "B"

    assert generation.Retry(wait_seconds=0).call(flaky, "p") == "B"
    with pytest.raises(ConnectionError):
        generation.Retry(attempts=2, wait_seconds=0).call(lambda p: (_ for _ in ()).throw(ConnectionError()), "p")
    tried = []
    with pytest.raises(ValueError):
        generation.Retry(wait_seconds=0).call(lambda p: tried.append(p) or int("x"), "p")
    assert len(tried) == 1


def test_rewrite_keeps_the_question(spark):
    asked = spark.createDataFrame([("k", "why?")], "query_id string, question string")
    row = generation.rewrite(asked, lambda: lambda prompt: "full " + prompt.split("Original: ")[1].split("\n")[0]).first()
    assert (row.question, row.retrieval_text) == ("why?", "full why?")


def test_stopwatch(spark):
    watch = Stopwatch()
    with timed(watch, "q", "a"):
        pass
    with pytest.raises(KeyError), timed(watch, "q", "b"):
        raise KeyError
    with timed(watch, "q", "a"), timed(None, "q", "c"):
        pass
    assert {(r.question_id, r.stage) for r in watch.table(spark).collect()} == {("q", "a"), ("q", "b")}


def test_latency_summary_case(spark):
    rows = [("1", "a", 1.0), ("1", "b", 2.0), ("2", "a", 3.0), ("2", "b", 4.0)]
    df = spark.createDataFrame(rows, "question_id string, stage string, seconds double")
    out = {r.stage: (r.min_s, r.avg_s, r.max_s) for r in evaluation.latency_summary(df).collect()}
    assert out == {"a": (1.0, 2.0, 3.0), "b": (2.0, 3.0, 4.0)}


def test_accuracy_of_nothing(spark):
    df = spark.createDataFrame([], "is_correct boolean, subject string")
    assert tuple(evaluation.accuracy(df).first()) == (0, 0, 0.0)


def test_target_count_is_checked(spark):
    asked = spark.createDataFrame([("test1", 6)], "test_key string, id long")
    with pytest.raises(ValueError, match="expected 27"):
        evaluation.select_targets(asked, evaluation.second_model_targets(spark), 27)


@pytest.fixture(scope="module")
def corpus(spark, sf_dir, tmp_path_factory):
    books = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("source").alias("shelf"), F.col("doc_id").cast("string").alias("book_id"), "text", F.col("lang").alias("subject"), F.lit("g").alias("grade"),
        F.array(F.struct(F.lit(0).alias("offset"), F.lit("Start").alias("chapter"))).alias("chapter_boundaries"),
    )
    return jobs.Corpus.build(books.drop("shelf"), str(tmp_path_factory.mktemp("corpus")))


def test_corpus_positions_are_dense(corpus):
    n = corpus.chunks.count()
    assert corpus.chunks.agg(F.min("pos"), F.max("pos"), F.countDistinct("pos")).first() == (0, n - 1, n)
    assert corpus.collection.count() == n == corpus.chunks.select("chunk_id").distinct().count()


def test_end_to_end_with_resume(spark, corpus, sf_dir, tmp_path):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id < 12")
    work = items.select(
        F.col("item_id").cast("string").alias("key"), F.lit("en").alias("subject"), F.col("text").alias("question"),
        F.array(F.lit("A. yes"), F.lit("B. no")).alias("options"), F.when(F.col("item_id") % 2 == 0, "A. yes").otherwise("B. no").alias("correct_answer"),
    )
    path = str(tmp_path / "results")
    seen = tmp_path / "calls"

    def limited():
        def model(prompt):
            if seen.exists():
                raise jobs.QuotaReached
            return "The answer is A"

        return model

    run = lambda todo: jobs.answer_choices(corpus, todo, limited)
    watch = Stopwatch()
    first = work.where("cast(key as int) < 5")
    assert jobs.run_resumable(first, path, lambda todo: jobs.answer_choices(corpus, todo, limited, watch=watch), parts=1)
    assert {r.stage for r in watch.table(spark).collect()} == {"retrieval", "rerank"}
    seen.write_text("x")
    assert not jobs.run_resumable(work, path, run, parts=2)
    assert files.read_results(spark, path).count() == 5
    seen.unlink()
    assert jobs.run_resumable(work, path, run, parts=2)
    results = files.read_results(spark, path)
    assert results.count() == 12 and results.select("key").distinct().count() == 12
    assert {(int(r.key) % 2 == 0, r.is_correct) for r in results.collect()} == {(True, True), (False, False)}
    before = results.count()
    assert jobs.run_resumable(work, path, lambda todo: 1 / 0, parts=2) and files.read_results(spark, path).count() == before


def test_stream_state_passes_each_chunk_once(spark, tmp_path):
    """Repeated files, also after a restart, do not reach the collection again; what the state has forgotten is not stored twice."""

    class Counting(Collection):
        passed = []

        def add_texts(self, chunks, *args):
            self.passed.append(sorted(r.text for r in chunks.select("text").collect()))
            super().add_texts(chunks, *args)

    store = Counting(spark, str(tmp_path / "store"))
    ddl = "book_id string, text string, subject string"

    def arrive(rows, remember="1 hour", checkpoint="ck"):
        spark.createDataFrame(rows, ddl).write.mode("append").parquet(str(tmp_path / "in"))
        ingest_books(
            spark, str(tmp_path / "in"), ddl, store, str(tmp_path / checkpoint), lambda b: b, remember=remember, method="fixed", size=50, overlap=0
        ).awaitTermination()

    first, second = "first text of a book", "another text, a longer one"
    arrive([("a", first, "x"), ("b", first, "x")])
    arrive([("c", first, "x"), ("d", second, "y"), ("e", None, "y"), ("f", "short", "y")])
    assert [t for t in store.passed if t] == [[first], [second]] and store.count() == 2
    arrive([("g", second, "y")], checkpoint="new")  # a state that knows nothing
    assert store.count() == 2
