"""Registered queries on the smallest tables, and every pipeline stage against a plain version of its rule."""

import zlib

import numpy as np
import pytest
from oracle import compare, connect
from test_pair_operators import roots, word_sets
from test_text_operators import plain_dedup
from tokenizers import Tokenizer

import corpus_pipeline
from folioscope.llm import packing
from folioscope.llm.mixing import mix
from folioscope.llm.queries import ORACLES, QUERIES
from folioscope.llm.tokens import WORD_BPE
from folioscope.plans.scale import materialise


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


def ids_of(text, end):
    return np.array(Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None


def test_token_file_query(spark, sf_dir, documents):
    want, start = [], 0
    for r in sorted(documents, key=lambda r: r.doc_id):
        ids = ids_of(r.text, 2)
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op3_token_files"](spark, sf_dir).collect())) == want


def pieces(rows):
    for doc, text in rows:
        ids = ids_of(text, 1)
        for i in range(0, len(ids), 4096):
            yield doc, i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(ids[i : i + 4096].tobytes())


def hold_packing(found, rows):
    assert sorted(tuple(r)[:5] for r in found) == sorted(pieces(rows))
    inside = {}
    for r in found:
        inside.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in inside.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(inside) <= -(-sum(r.length for r in found) // 4096) + 1


@pytest.mark.parametrize("pack", [QUERIES["op6_best_two_fit"], lambda spark, d: corpus_pipeline.packing(spark, spark.read.parquet(f"{d}/documents.parquet"), d)])
def test_packing_stores_digests_not_ids(spark, sf_dir, pack, monkeypatch):
    stored = []
    monkeypatch.setattr(packing, "materialise", lambda df, name: stored.append(materialise(df, name)) or stored[-1])
    assert pack(spark, sf_dir).count() >= stored[0].count() > 0
    assert all("ids" not in df.columns for df in stored)


def test_packing_query(spark, sf_dir, documents):
    hold_packing(QUERIES["op6_best_two_fit"](spark, sf_dir).collect(), [(r.doc_id, r.text) for r in documents])


def test_mixing_query(spark, sf_dir, documents):
    found = QUERIES["op4_soft_mixing"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in documents)
    tokens = np.array([r.n_tokens for r in found])
    share = (tokens * np.array([r.rate for r in found])) @ np.array([r.posterior for r in found]) / tokens.sum()
    assert np.allclose(share, [0.85, 0.10, 0.05], rtol=0.01)
    words = {r.doc_id: len([w for w in (r.text or "").replace("\n", " ").split(" ") if w]) for r in documents}
    assert {r.doc_id: r.n_tokens for r in found} == words


def test_near_vector_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    root = roots(ids.tolist(), [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(linked))])
    want = {(int(i), int(n), root[i], root[i] == i) for i, n in zip(ids, linked.sum(axis=1))}
    assert {tuple(r) for r in QUERIES["op7_hnsw"](spark, sf_dir).collect()} == want


def similar(rows, n, percent):
    sets = word_sets([(d, (t or "").encode().lower().decode()) for d, t in rows], n)
    size = {d: len(s) for d, s in sets.items()}
    pairs = []
    for a in sets:
        for b in sets:
            if a < b and 100 * min(size[a], size[b]) >= percent * max(size[a], size[b], 1):
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (size[a] + size[b] - common):
                    pairs.append((a, b))
    return size, roots(sets, pairs)


def test_similarity_query(spark, sf_dir, documents):
    size, root = similar([(r.doc_id, r.text) for r in documents], 3, 90)
    want = {(r.doc_id, size[r.doc_id], root[r.doc_id]) for r in documents}
    assert {tuple(r) for r in QUERIES["op8_part_enum"](spark, sf_dir).collect()} == want


def test_language_query(spark, sf_dir, documents):
    true = {r.doc_id: r.lang for r in documents}
    found = QUERIES["op9_language_id"](spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found) and len(found) == len(true)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.95 * len(held)


def test_quality_query(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest tables hold one or two low-quality rows for the test
    true = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = QUERIES["op10_quality"](spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in true]
    assert sum(r.predicted == true[r.doc_id] for r in held) >= 0.95 * len(held)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, "12 34 !!", None, None, 8), (10**6 + 1, None, "en", "s", None), (10**6 + 2, "", "en", "s", 0)], docs.schema)
    docs = docs.union(odd)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-test")
        if name == "packing":
            hold_packing(docs.collect(), before)
            continue
        assert docs.columns == columns
        after = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        if name == "language_id":
            assert sorted(after) == sorted((d, t) for d, t in before if t and any(c.isalpha() for c in t))
        if name == "line_dedup":
            kept = [(d, t) for d, t, _, gone in plain_dedup(before, 40, 5) if t.strip() or not gone]
            assert sorted(after) == sorted(kept)
        if name == "near_duplicates":
            _, root = similar(before, 5, 80)
            assert sorted(after) == sorted((d, t) for d, t in before if root[d] == d)
        if name == "mixing":
            assert set(after) == set(before) and len(after) >= len(before)


def test_mixing_stage_meets_targets(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), corpus_pipeline.TARGETS, keep=["doc_id"]).collect()
    copies = {r.doc_id: r["count"] for r in corpus_pipeline.mixing(spark, docs, sf_dir).groupBy("doc_id").count().collect()}
    assert set(copies) == {r.doc_id for r in mixed}
    tokens = np.array([r.n_tokens * copies[r.doc_id] for r in mixed]) @ np.array([r.posterior for r in mixed])
    assert np.allclose(tokens / tokens.sum(), [corpus_pipeline.TARGETS[d] for d in sorted(corpus_pipeline.TARGETS)], atol=0.01)


def test_language_stage_without_labels(spark, sf_dir):
    rows = [(1, "some words", None, None, None), (2, "12 !?", None, None, None), (3, None, None, None, None), (4, "É", None, None, None)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, sf_dir).collect()) == [1, 4]


def test_near_duplicate_stage_with_repeated_ids(spark, sf_dir):
    text, other, third = "a b c d e f g", "o p q r s t u", "h i j k l m n"
    rows = [(1, text), (5, text), (5, other), (5, other), (7, third), (7, third), (8, None), (8, None), (9, "!"), (None, text), (9, other)]
    docs = spark.createDataFrame([(d, t, "en", "s", i) for i, (d, t) in enumerate(rows)], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    want = [(None, text), (1, text), (5, other), (7, third), (8, None), (8, None), (9, "!")]
    found = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
