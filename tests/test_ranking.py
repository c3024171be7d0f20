"""Ranking operators against plain Python, on both sides of every size check, and their laws."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import fusion, lexical, vectors

WORDS = "atom bond cell dna energy force gene heat ion joule light mass".split()


def passages(n, seed=3, vocabulary=WORDS):
    """A third of all passages are one text, and one subject holds most of them."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "atom bond atom" if i % 3 == 0 else " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 9)))
        rows.append((i, text, "x" if i % 5 else "y"))
    return rows


def plain_bm25(rows, question, subject, k):
    docs = [(i, t.split()) for i, t, s in rows if not subject or s == subject]
    if not docs:
        return []
    avgdl = sum(len(t) for _, t in docs) / len(docs)
    df = {}
    for _, t in docs:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if r < 0 else r for w, r in raw.items()}
    scored = []
    for i, t in docs:
        score = 0.0
        for w in question.split():
            tf = t.count(w)
            score += idf.get(w, 0.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl))
        scored.append((-round(score, 9), i))
    return [(i, -s) for s, i in sorted(scored)[:k]]


QUESTIONS = [(0, "atom dna", "x"), (1, "heat heat unknown", "y"), (2, "nothing known", "x"), (3, "gene ion mass", None), (4, "atom bond", "")]


@pytest.fixture(scope="module", params=["lazy", "saved"])
def index(request, spark, tmp_path_factory):
    df = spark.createDataFrame(passages(120), "id long, text string, subject string")
    built = lexical.build_index(df, "id", "id", "text", "subject")
    return built if request.param == "lazy" else built.save(str(tmp_path_factory.mktemp("index") / "i"))


@pytest.mark.parametrize("block", [5, 100_000])
def test_bm25_matches_plain(spark, index, block):
    asked = spark.createDataFrame(QUESTIONS, "query_id long, text string, subject string")
    found = lexical.search(index, asked, 7, block=block).collect()
    for q, text, subject in QUESTIONS:
        got = [(r.doc, r.score) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)]
        want = plain_bm25(passages(120), text, subject, 7)
        assert [d for d, _ in got] == [d for d, _ in want]
        assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-8)


def test_bm25_with_scores_below_zero(spark):
    """Nearly every word is in nearly every passage, so the floor itself is negative."""
    rows = [(i, "atom bond" if i % 7 else "cell", "x") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, subject string")
    index = lexical.build_index(df, "id", "id", "text", "subject")
    asked = spark.createDataFrame([(0, "atom bond", "x"), (1, "cell", "x")], "query_id long, text string, subject string")
    found = lexical.search(index, asked, 20).collect()
    for q, text in ((0, "atom bond"), (1, "cell")):
        got = [r.doc for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)]
        assert got == [d for d, _ in plain_bm25(rows, text, "x", 20)]


def test_bm25_of_a_subject_ignores_other_subjects(spark):
    rows = passages(60)
    asked = spark.createDataFrame([(0, "atom dna heat", "x")], "query_id long, text string, subject string")

    def scores(data):
        df = spark.createDataFrame(data, "id long, text string, subject string")
        built = lexical.build_index(df, "id", "id", "text", "subject")
        return [(r.doc, r.score) for r in lexical.search(built, asked, 10).orderBy("rank").collect()]

    assert scores(rows) == scores(rows + [(1000 + i, "atom atom heat", "z") for i in range(30)])


def test_bm25_of_an_unknown_subject_is_empty(spark, index):
    asked = spark.createDataFrame([(0, "atom", "nowhere")], "query_id long, text string, subject string")
    assert lexical.search(index, asked, 5).count() == 0


def test_term_counts(spark):
    row = spark.createDataFrame([(["b", "a", "b", "c", "b"],)], "tk array<string>").select(lexical.term_counts("tk")).first()[0]
    assert [(r.term, r.tf) for r in row] == [("a", 1), ("b", 3), ("c", 1)]


@pytest.mark.parametrize("block_rows", [1000, 4])
@pytest.mark.parametrize("scoped", [True, False])
def test_knn_matches_plain(spark, block_rows, scoped):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(90, 6)).astype(np.float32)
    base[30:60] = base[0]  # a third of the vectors are one
    scope = ["a" if i % 4 else "b" for i in range(90)]
    asked = rng.normal(size=(9, 6)).astype(np.float32)
    asked[0] = base[0]
    asked_scope = ["a", "b", None] * 3
    vecs = spark.createDataFrame([(i, v.tolist(), s) for i, (v, s) in enumerate(zip(base, scope))], "id long, vector array<float>, scope string")
    qs = spark.createDataFrame(
        [(f"q{i}", v.tolist(), s) for i, (v, s) in enumerate(zip(asked, asked_scope))], "query_id string, vector array<float>, scope string"
    )
    if not scoped:
        qs = qs.drop("scope")
    found = vectors.knn(vecs.repartition(5), qs, 8, block_rows=block_rows).collect()
    for i, (q, s) in enumerate(zip(asked, asked_scope)):
        allowed = [j for j in range(90) if not scoped or s is None or scope[j] == s]
        want = sorted((round(float(((q.astype(float) - base[j].astype(float)) ** 2).sum()), 9), j) for j in allowed)[:8]
        got = sorted((r.rank, r.id) for r in found if r.query_id == f"q{i}")
        assert [j for _, j in got] == [j for _, j in want]


def test_knn_in_all_cells_is_exact(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.where("id < 15").withColumnRenamed("id", "query_id")
    pivots = vectors.choose_pivots(rows, 8)
    cells = vectors.assign_cells(rows, pivots)
    exact = {(r.query_id, r.id, r.rank) for r in vectors.knn(rows, asked, 5).collect()}
    assert {(r.query_id, r.id, r.rank) for r in vectors.knn_in_cells(cells, pivots, asked, 5, 8).collect()} == exact
    some = {(r.query_id, r.id) for r in vectors.knn_in_cells(cells, pivots, asked, 5, 3).collect()}
    assert len(some & {(q, i) for q, i, _ in exact}) / len(exact) > 0.4


def ranking(spark, *names):
    return spark.createDataFrame([(0, n, i + 1) for i, n in enumerate(names)], "query_id long, id string, rank long")


def test_fusion_cases(spark):
    fused = fusion.fuse({"a": ranking(spark, "a", "b", "c"), "b": ranking(spark, "c", "d", "a")}, 10).orderBy("rank").collect()
    assert [r.id for r in fused] == ["c", "a", "d", "b"]
    assert [round(r.score, 9) for r in fused] == [0.032266458, 0.032266458, 0.016129032, 0.016129032]
    one_each = fusion.fuse({"a": ranking(spark, "a"), "b": ranking(spark, "b")}, 10).orderBy("rank").collect()
    assert [r.id for r in one_each] == ["b", "a"]


def test_fusion_counts_the_last_rank_of_a_repeat(spark):
    row = fusion.fuse({"a": ranking(spark, "a", "b", "a"), "b": ranking(spark, "z")}).where("id = 'a'").first()
    assert row.rank_a == 3


def test_fusion_is_the_same_with_arms_swapped(spark):
    a, b = ranking(spark, "a", "b", "c", "e"), ranking(spark, "c", "d", "a")
    ids = lambda arms: [r.id for r in fusion.fuse(arms, 4).orderBy("rank").collect()]
    assert ids({"a": a, "b": b}) == ids({"a": b, "b": a})


def test_rerank_keeps_candidate_order_among_equals(spark):
    rows = [(0, "c1", 1, "heat of fusion", "other"), (0, "c2", 2, "heat of fusion", "heat"), (0, "c3", 3, "heat of fusion", "heat")]
    df = spark.createDataFrame(rows, "query_id long, id string, rank long, question string, text string")
    assert [r.id for r in fusion.rerank(df, 3).orderBy("final_rank").collect()] == ["c2", "c3", "c1"]


def test_encoder_gives_unit_vectors(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 20")
    norms = vectors.embed(docs, "text").select(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x).alias("n"))
    assert norms.where(F.abs(F.col("n") - 1) > 1e-4).count() == 0


def test_knn_embeds_each_query_once_and_filters_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0], f"s{i % 3}") for i in range(60)], "id long, vector array<double>, scope string")
    rows.write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def model(i):
        calls.add(1)
        return [float(i), 1.0]

    asked = spark.createDataFrame([(i, f"s{i % 2}") for i in range(20)], "query_id long, scope string").withColumn("vector", model("query_id"))
    found = vectors.knn(stored, asked, 2, block_rows=4)
    assert found.count() == 40 and calls.value == 20
    plan = stored.where(F.col("scope").isin(["s0", "s1"])).mapInArrow(lambda b: b, stored.schema)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(scope, [s0,s1])]" in plan


def test_stored_passages_are_scored_where_they_lie(spark, tmp_path):
    rows = [(i, f"alpha beta word{i} word{i % 5}", "ab"[i % 2]) for i in range(60)]
    built = lexical.build_index(spark.createDataFrame(rows, "id long, text string, subject string"), "id", "id", "text", "subject")
    asked = spark.createDataFrame([(1, "alpha word3", "a"), (2, "word7 beta", None)], "query_id long, text string, subject string")
    want = sorted(map(tuple, lexical.search(built, asked, 5).collect()))
    built.save(str(tmp_path / "index"), buckets=4)
    index = lexical.LexicalIndex.load(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, lexical.search(index, asked, 5).collect())) == want
    weights = lexical.materialise(lexical.query_weights(index, asked), "weights")
    plan = lexical.matched_scores(index, weights)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "hashpartitioning" not in plan


def test_blocks_that_cannot_reach_the_top_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "PASSAGES_PER_BLOCK", 2)
    rng = random.Random(4)
    rows = [(i, " ".join(["gene"] * (1 + i % 3) + ["filler"] * (i % 150)), rng.choice("ab")) for i in range(600)]
    rows += [(1000 + i, "gene gene gene ion", "a") for i in range(4)] + [(2000, None, "a"), (2001, "gene", None)]
    df = spark.createDataFrame(rows, "id long, text string, subject string")
    built = lexical.build_index(df, "id", "id", "text", "subject")
    index = built.save(str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "gene ion", "a"), (2, "ion", None), (3, "filler gene", None)], "query_id long, text string, subject string")
    want = sorted(map(tuple, lexical.search(built, asked, 4).collect()))
    assert sorted(map(tuple, lexical.search(index, asked, 4).collect())) == want

    weights = lexical.materialise(lexical.query_weights(index, asked), "weights")
    bounds = lexical.block_bounds(index, weights)
    reached = {(r.query_id, r.block): r.bound for r in bounds.collect()}
    placed = index.passages.select("doc", "block")
    for row in lexical.matched_scores(index, weights).join(placed, "doc").collect():
        assert row.score <= reached[row.query_id, row.block] + 1e-8
    order = [F.desc("score"), F.asc("pos")]
    first = lexical.top_k(bounds, ["query_id"], [F.desc("bound"), F.asc("block")], 4).select("query_id", "block")
    early = lexical.top_k(lexical.matched_scores(index, weights, first), ["query_id"], order, 4)
    left = lexical.open_blocks(bounds, first, early, 4).where("query_id = 1").count()
    n_blocks = sum(q == 1 for q, _ in reached)
    assert n_blocks > 8 and left < (n_blocks - 4) / 2
