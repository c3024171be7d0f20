"""Top-k search, near vectors, similar documents, components and the archive audit against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import components, hnsw, jaccard, token_files, topk, warc
from folioscope.plans.scale import materialise, scratch_path


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (50, 49), (50, 49)]
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    want = roots({n for p in pairs for n in p if p[0] != p[1]}, pairs)
    assert {r.node: r.component for r in components.components(df).collect()} == want
    assert components.components(df.where("false")).count() == 0


def test_max_score_is_exact():
    draw = np.random.default_rng(2)
    for _ in range(30):
        query, postings = draw.integers(-50, 50, 12).astype(float), draw.integers(-50, 50, (12, 300)).astype(float)
        scores = query @ postings
        for floor in (-np.inf, float(np.sort(scores)[-10]), float(scores.max())):
            at, found = topk.max_score(query, postings, floor)
            assert (np.sort(at) == np.flatnonzero(scores >= floor)).all() and (found == scores[at]).all()


@pytest.mark.parametrize("block", [3, 2048])
def test_search(spark, block):
    draw = np.random.default_rng(3)
    rows = [(i, [int(x) for x in draw.integers(-3, 4, 5)]) for i in range(80)]
    odd = [(None, [1] * 5), (200, None), (201, [1, None, 2, 3, 4]), (202, [5]), (4, rows[4][1]), (10, [9] * 5)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, vector array<long>")
    sound = [(i, (v + [0] * 5)[:5]) for i, v in rows + odd if i is not None and v is not None and None not in v]
    want = []
    for q, v in [x for x in sound if x[0] % 10 == 0]:
        scored = sorted((-int(np.dot(v, w)), i) for i, w in sound if i != q)[:10]
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)]
    got = topk.search(vectors.where("vec_id % 10 = 0"), vectors, 10, block=block)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.search(vectors.where("false"), vectors).count() == 0
    assert topk.search(vectors.where("vec_id = 0"), vectors.where("false")).count() == 0


def test_near_vectors(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.08 * draw.normal(size=16)).tolist()) for i in range(300)]
    rows += [(300 + i, draw.normal(size=16).tolist()) for i in range(100)]
    rows += [(500 + i, rows[0][1]) for i in range(5)]
    odd = [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [None] * 16), (604, [1.0, 2.0]), (605, []), (606, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    ids = np.array([i for i, _ in rows])
    root = roots(ids.tolist(), [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(linked))])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_vectors(df).collect()}
    want = {int(i): (int(n), root[i], root[i] == i) for i, n in zip(ids, linked.sum(axis=1))}
    assert got == want | {i: (0, i, True) for i, _ in odd}
    assert hnsw.near_vectors(df.where("false")).count() == 0


def test_near_vectors_keep_graphs_and_vectors_out_of_stored_rows(spark, monkeypatch):
    """Small shards and slices, mixed dimensions, a group wider than any beam: the rows that Spark stores are narrow, and the result is exact."""
    draw = np.random.default_rng(7)
    centre = draw.normal(size=16)
    vectors = [centre + 0.05 * draw.normal(size=16) for _ in range(260)] + [draw.normal(size=16) for _ in range(240)]
    vectors += [v + 0.01 * draw.normal(size=16) for v in vectors[260:300]] + [vectors[300]] * 3 + [draw.normal(size=5) for _ in range(30)]
    vectors = [v.astype(np.float32) for v in vectors]
    stored = []
    monkeypatch.setattr(hnsw, "materialise", lambda df, name: stored.append(materialise(df, name)) or stored[-1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_vectors(df, shard_size=64, group_size=20).collect()}
    unit = [v.astype(float) / np.linalg.norm(v.astype(float)) for v in vectors]
    pairs = [(a, b) for a in range(len(unit)) for b in range(a) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    root, links = roots(range(len(unit)), pairs), Counter(x for pair in pairs for x in pair)
    assert got == {i: (links[i], root[i]) for i in range(len(unit))}
    assert stored
    for df in stored:
        width = df.select(F.max(F.length(F.to_json(F.struct("*"))))).first()[0]
        assert (width or 0) < 1000, df.columns


def test_beam_search_in_parts(monkeypatch):
    draw = np.random.default_rng(8)
    points = draw.normal(size=(300, 8)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    graph = hnsw.Graph(points, hnsw.drawn(len(points))[1])
    ids, sims = graph.search(points[:50], 12)
    monkeypatch.setattr(hnsw, "SEEN", 2 * len(points))
    in_parts = graph.search(points[:50], 12)
    assert (in_parts[0] == ids).all() and np.allclose(in_parts[1], sims)
    best = np.sort(points[:50] @ points.T, axis=1)[:, ::-1][:, :12]
    assert np.mean(np.isclose(sims, best, atol=1e-5)) > 0.95


def test_thinned_edges_join_the_same_nodes():
    draw = np.random.default_rng(9)
    for n_pairs in (1, 10, 60, 400):
        q = np.sort(draw.choice(np.arange(5, 45), n_pairs))
        p = draw.integers(0, 90, n_pairs)
        of, to, left, right = hnsw.thinned(q, p, 90)
        edges = [(int(a), 100 + int(b)) for a, b in zip(of, to)] + [(int(a), int(b)) for a, b in zip(left, right)]
        assert roots(range(200), edges) == roots(range(200), [(int(a), 100 + int(b)) for a, b in zip(q, p)])
        assert len(of) == len(set(p.tolist()))


def word_sets(rows, n):
    sets = {}
    for doc, text in rows:
        words = (text or "").split()
        sets[doc] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
    return sets


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (1, 50)])
def test_similar_documents(spark, n, percent):
    draw = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = draw.choice(vocabulary, 20 + 30 * group).tolist()
        for _ in range(12):
            words = list(base)
            for at in draw.integers(0, len(words), draw.integers(0, 2 + len(words) // 40)):
                words[at] = draw.choice(vocabulary)
            rows.append((len(rows), " ".join(words[: len(words) - draw.integers(0, 3)])))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "Two words"), (1004, "two\tWORDS "), (1005, rows[0][1].upper() + "\n"), (1006, "a")]
    sets = word_sets([(d, (t or "").lower()) for d, t in rows], n)
    pairs = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    root = roots(sets, pairs)
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    got = jaccard.similar_documents(df, n=n, percent=percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(d, len(sets[d]), root[d]) for d in sets}
    assert [(r.component_id, r.n_shingles) for r in got if r.doc_id is None] == [(None, len(sets[0]))]


def test_similar_documents_of_an_empty_table_and_a_shared_id(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "x y z u v w"), (2, "x y z u v w"), (3, "A b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.similar_documents(df).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert jaccard.similar_documents(df.where("false")).count() == 0


def test_signatures_meet_for_all_sets_that_are_near_enough():
    from fractions import Fraction

    draw = np.random.default_rng(6)
    for least in (Fraction(9, 10), Fraction(8, 10), Fraction(1, 2)):
        for size in (1, 2, 5, 9, 10, 19, 40, 90, 200):
            for _ in range(20):
                x = draw.integers(0, 1 << 62, size).astype(np.uint64)
                gone = int(draw.integers(0, size // 2 + 1))
                y = np.concatenate([x[gone:], draw.integers(0, 1 << 62, int(draw.integers(0, size // 2 + 1))).astype(np.uint64)])
                common, union = size - gone, size + len(y) - (size - gone)
                if len(y) and Fraction(common, union) >= least:
                    assert set(jaccard.signatures(np.unique(x), least)) & set(jaccard.signatures(np.unique(y), least))


def test_tables_of_counts_differ_by_no_more_than_the_sets():
    draw = np.random.default_rng(7)
    for size in (1, 30, 3_000, 400_000):  # the last fills cells beyond what a byte holds
        x = np.unique(draw.integers(0, 1 << 62, size).astype(np.uint64))
        for gone, added in ((0, 0), (size // 9, size // 20), (size - 1, 1), (0, size)):
            y = np.unique(np.concatenate([x[gone:], draw.integers(0, 1 << 62, added).astype(np.uint64)]))
            left, right = (jaccard.cell_counts(s).astype(int) for s in (x, y))
            assert np.abs(left - right).sum() <= len(np.setxor1d(x, y))


PAGES = "page_id long, url string, html string"


def archive(spark, rows):
    folder = scratch_path(spark, "warc")
    return warc.write_archive(spark.createDataFrame(rows, PAGES).coalesce(2), folder), folder


def test_archive_is_readable_and_audited(spark):
    import gzip

    rows = [(i, f"http://a/{i}", f"<p>{i}</p>" * (i % 50)) for i in range(700)] + [(None, None, None), (5, "http://a/5", ""), (5, "http://a/5", "")]
    index, first = archive(spark, rows)
    entries = index.collect()
    assert len(entries) == len(rows)
    fs, root = token_files.file_system(first)
    one = next(e for e in entries if e.page_id == 49)
    with fs.open_input_file(f"{root}/{one.file}") as file:
        file.seek(one.start)
        member = gzip.decompress(file.read(one.stop - one.start))
    assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"<p>49</p>" * 49 + b"\r\n\r\n")

    second = scratch_path(spark, "warc")
    warc.copy_archive(index, first, second)
    expected = warc.merkle_tree(index, first)
    assert warc.audit(index, expected, warc.merkle_tree(index, second)).count() == 0

    fs, root = token_files.file_system(second)
    files = sorted({e.file for e in entries})
    cut, gone = files[0], files[-1]
    last = max((e for e in entries if e.file == cut), key=lambda e: e.record)
    with fs.open_input_file(f"{root}/{cut}") as file:
        data = bytearray(file.read())
    hurt = next(e for e in entries if e.file == cut and e.record == 3)
    data[hurt.start] ^= 1
    with fs.open_output_stream(f"{root}/{cut}", compression=None) as out:
        out.write(bytes(data[:-1]))
    fs.delete_file(f"{root}/{gone}")
    found = {(r.file, r.record) for r in warc.audit(index, expected, warc.merkle_tree(index, second)).collect()}
    assert found == {(cut, 3), (cut, last.record)} | {(gone, e.record) for e in entries if e.file == gone}


def test_empty_archive(spark):
    index, folder = archive(spark, [])
    warc.copy_archive(index, folder, folder + "-b")
    tree = warc.merkle_tree(index, folder)
    assert index.count() == tree.count() == warc.audit(index, tree, tree).count() == 0
