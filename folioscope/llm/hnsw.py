"""Near-duplicate vectors through navigable small-world graphs, one per shard.

Vectors are dealt into shards of a bounded size and every shard builds its hierarchical graph,
which lies with its vectors in a file of the shared folder. Every vector then searches every
shard: a task holds one graph at a time and reads the queries from the shards' files, a slice of a
bounded size after another. A query whose beam ends above the wanted cosine has its beam widened, or
is compared with the whole shard once that costs less, so that a large cluster is found whole. An audit
set is also compared with all rows of each shard; while its recall is too low, all beams start
wider. Found pairs are verified in double precision, and each slice's pairs are reduced to link
counts and a forest, block by block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.token_files import file_system
from folioscope.plans.scale import bound_batches, materialise, scratch_path

DEGREE = 12
BUILD_BEAM = 48
TOGETHER = 4
"""Places of a beam that are expanded in one step; of a wide beam an eighth."""
SEEN = 32 << 20
"""Bytes of marks, one for each query and point, and of gathered vectors that a search holds at once."""
SCAN = 1000
"""Points that are compared in the time that a place of a beam takes."""
CELLS = 1 << 22
"""Cosines of a block of queries with a whole shard."""
ROWS = 8192
"""Vectors that are normalised together."""
SLACK = 1e-4
"""Graphs are walked in single precision."""
SURE = 1e-3
"""What is above the wanted cosine by this in single precision needs no other comparison."""
EDGES = 1 << 18
SHARD_BYTES = 64 << 20
"""Of the single-precision vectors of a shard."""
TURNS = 4
"""Slices of queries that a task takes through a graph."""
INDEX = "name string, size int, width int, n long, layers array<int>"


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _points(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision."""
    points = np.empty(vectors.shape, np.float32)
    for i in range(0, len(vectors), ROWS):
        points[i : i + ROWS] = _unit(vectors[i : i + ROWS].astype(float))
    return points


def _fresh(ids: np.ndarray) -> np.ndarray:
    """Marks the first of each value in every row; -1 never."""
    order = np.argsort(ids, axis=1, kind="stable")
    ordered = np.take_along_axis(ids, order, axis=1)
    first = np.ones(ids.shape, bool)
    first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    out = np.empty_like(first)
    np.put_along_axis(out, order, first & (ordered >= 0), axis=1)
    return out


def beam_search(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``beam`` points of one layer for each query, best first: ids (-1: none) and similarities.

    All queries walk in step, as many at once as ``SEEN`` allows; ``entry`` has a row of start points per query.
    """
    n, n_points = len(queries), len(links)
    together = min(max(TOGETHER, beam // 8), 254)
    most = max(1, SEEN // max(n_points, 8 * together * links.shape[1] * points.shape[1]))
    if n > most:
        parts = [beam_search(points, links, queries[i : i + most], entry[i : i + most], beam) for i in range(0, n, most)]
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([sims for _, sims in parts])
    seen = np.zeros(n * n_points, np.uint8)
    new = _fresh(entry)
    seen[np.nonzero(new)[0] * n_points + entry[new]] = 1
    ids = np.where(new, entry, -1)
    sims = np.where(new, np.einsum("qed,qd->qe", points[entry], queries), -np.inf)
    done = ~new
    if ids.shape[1] < beam:
        fill = beam - ids.shape[1]
        ids, sims, done = np.pad(ids, ((0, 0), (0, fill)), constant_values=-1), np.pad(sims, ((0, 0), (0, fill)), constant_values=-np.inf), np.pad(done, ((0, 0), (0, fill)), constant_values=True)
    order = np.argsort(-sims, axis=1)[:, :beam]
    rows = np.arange(n)[:, None]
    ids, sims, done = ids[rows, order], sims[rows, order], done[rows, order]
    walking = np.flatnonzero((~done).any(axis=1))
    while len(walking):
        place = np.cumsum(~done[walking], axis=1)
        row, at = np.nonzero(~done[walking] & (place <= together))  # best first, as beams are sorted
        tag = (place[row, at] + 1).astype(np.uint8)
        row = walking[row]
        done[row, at] = True
        near = links.take(ids[row, at], axis=0)
        cell = (row * n_points)[:, None] + near
        new = np.flatnonzero((near >= 0) & (seen.take(cell, mode="clip") == 0))
        cell, near, which = cell.take(new), near.take(new), new // links.shape[1]
        tag = tag.take(which)
        seen[cell] = tag
        first = np.flatnonzero(seen.take(cell) == tag)  # of the places of a row that lead to one point, the last to write
        row, near = row.take(which.take(first)), near.take(first)
        sim = np.einsum("kd,kd->k", points.take(near, axis=0), queries.take(row, axis=0))
        good = sim > sims[row, -1]
        row, near, sim = row[good], near[good], sim[good]
        if len(row):
            told, start, count = np.unique(row, return_index=True, return_counts=True)
            coming, at = np.repeat(np.arange(len(told)), count), beam + np.arange(len(row)) - np.repeat(start, count)
            shape = (len(told), beam + int(count.max()))
            all_ids, all_sims, all_done = np.full(shape, -1, ids.dtype), np.full(shape, -np.inf, sims.dtype), np.ones(shape, bool)
            all_ids[:, :beam], all_sims[:, :beam], all_done[:, :beam] = ids[told], sims[told], done[told]
            all_ids[coming, at], all_sims[coming, at], all_done[coming, at] = near, sim, False
            order = np.argsort(-all_sims, axis=1)[:, :beam]
            here = np.arange(len(told))[:, None]
            ids[told], sims[told], done[told] = all_ids[here, order], all_sims[here, order], all_done[here, order]
        walking = walking[(~done[walking]).any(axis=1)]
    return np.where(np.isfinite(sims), ids, -1), sims


def diverse(points: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Up to ``keep`` neighbours per row: those nearer to the row's point than to a chosen one, then the nearest others."""
    n, width = ids.shape
    near = points[ids]
    among = near @ near.transpose(0, 2, 1)
    chosen = np.zeros((n, width), bool)
    closest = np.full((n, width), -np.inf)
    for k in range(width):
        good = (ids[:, k] >= 0) & (closest[:, k] < sims[:, k]) & (chosen.sum(axis=1) < keep)
        chosen[:, k] = good
        closest = np.where(good[:, None], np.maximum(closest, among[:, k]), closest)
    order = np.argsort(~chosen, axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(ids, order, axis=1)


def drawn(n: int, seed: int = 0) -> tuple[np.ndarray, list[int]]:
    """The order in which ``n`` points enter a graph, and the points of each layer, which are the first so many."""
    levels = np.floor(np.random.default_rng(seed).exponential(1 / np.log(DEGREE), n)).astype(int)
    return np.argsort(-levels, kind="stable"), [int((levels >= k).sum()) for k in range(int(levels.max(initial=0)) + 1)]


class Graph:
    """Layers over points in the order drawn; the points of each layer are the first so many."""

    def __init__(self, points: np.ndarray, sizes: list[int]):
        n, self.points, self.sizes = len(points), points, sizes
        self.layers = [np.full((size, DEGREE * (2 if k == 0 else 1)), -1, np.int32) for k, size in enumerate(self.sizes)]
        self.filled = 0
        while self.filled < n:
            until = min([n, self.filled + max(1, min(512, self.filled)), *(s for s in self.sizes if s > self.filled)])
            self._insert(np.arange(self.filled, until))
            self.filled = until

    def _start(self, queries: np.ndarray, level: int) -> np.ndarray:
        """Entry points for ``level``, by greedy descent from the top."""
        entry = np.zeros((len(queries), 1), np.int64)
        for k in range(len(self.layers) - 1, level, -1):
            entry = beam_search(self.points, self.layers[k], queries, entry, 4)[0]
        return entry

    def _insert(self, new: np.ndarray) -> None:
        queries = self.points[new]
        inside = queries @ queries.T
        np.fill_diagonal(inside, -np.inf)
        near_inside = np.argsort(-inside, axis=1)[:, : DEGREE * 2]
        sims_inside = np.take_along_axis(inside, near_inside, axis=1)
        for level, links in enumerate(self.layers):
            if new[0] >= self.sizes[level]:
                break
            ids, sims = new[near_inside], sims_inside
            if self.filled:
                found, found_sims = beam_search(self.points, links, queries, self._start(queries, level), BUILD_BEAM)
                ids, sims = np.concatenate([found, ids], axis=1), np.concatenate([found_sims, sims], axis=1)
            order = np.argsort(-sims, axis=1)[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
            ids = np.where(np.isfinite(sims), ids, -1)
            chosen = diverse(self.points, ids, sims, DEGREE)
            links[new, : chosen.shape[1]] = chosen
            self._link_back(links, np.repeat(new, chosen.shape[1]), chosen.ravel())

    def _link_back(self, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        widest = int(count.max(initial=0))
        if not widest:
            return
        coming = np.full((len(nodes), widest), -1, np.int64)
        coming[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        ids = np.concatenate([links[nodes], coming], axis=1)
        ids[~_fresh(ids)] = -1
        cap = links.shape[1]
        full = (ids >= 0).sum(axis=1) > cap
        roomy = np.take_along_axis(ids[~full], np.argsort(ids[~full] < 0, axis=1, kind="stable")[:, :cap], axis=1)
        links[nodes[~full]] = roomy
        at_once = min(256, max(1, (8 << 20) // (ids.shape[1] * self.points.shape[1])))
        for part in np.array_split(np.flatnonzero(full), max(1, int(full.sum()) // at_once)):
            here = ids[part]
            sims = np.where(here >= 0, np.einsum("nkd,nd->nk", self.points[here], self.points[nodes[part]]), -np.inf)
            best = np.argsort(-sims, axis=1)[:, : 2 * cap]
            links[nodes[part]] = diverse(self.points, np.take_along_axis(here, best, axis=1), np.take_along_axis(sims, best, axis=1), cap)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        return beam_search(self.points, self.layers[0], queries, self._start(queries, 0), beam)


def _array(fs: FileSystem, path: str, dtype: str, at: int, count: int) -> np.ndarray:
    """``count`` values of a file from byte ``at``; mapped where the file system is a mounted one."""
    with pa.memory_map(path) if isinstance(fs, LocalFileSystem) else fs.open_input_file(path) as file:
        file.seek(at)
        return np.frombuffer(file.read_buffer(count * np.dtype(dtype).itemsize), dtype)


class Shard:
    """The file of a shard: ids, copies, vectors as they came, links of each layer and marks of the audit, in the graph's order.

    ``row`` is the shard's row of the index.
    """

    def __init__(self, fs: FileSystem, root: str, row: dict):
        self.fs, self.path, self.row = fs, f"{root}/{row['name']}", row

    @classmethod
    def write(cls, fs: FileSystem, root: str, vectors: np.ndarray, ids: np.ndarray, copies: np.ndarray, audit: np.ndarray, sizes: list[int]) -> dict:
        """Build the graph of rows that stand in the order drawn and write it; return its row."""
        graph = Graph(_points(vectors), sizes)
        row = {"name": uuid.uuid4().hex, "size": vectors.shape[1], "width": vectors.itemsize, "n": len(vectors), "layers": sizes}
        with fs.open_output_stream(f"{root}/{row['name']}") as file:
            file.write(ids.astype("<i8").tobytes())
            file.write(copies.astype("<i8").tobytes())
            for i in range(0, len(vectors), ROWS):
                file.write(vectors[i : i + ROWS].astype(f"<f{vectors.itemsize}").tobytes())
            for links in graph.layers:
                file.write(links.astype("<i4").tobytes())
            file.write(audit.astype("u1").tobytes())
        return row

    def ids(self, first: int, last: int) -> np.ndarray:
        return _array(self.fs, self.path, "<i8", 8 * first, last - first)

    def copies(self) -> np.ndarray:
        return _array(self.fs, self.path, "<i8", 8 * self.row["n"], self.row["n"])

    def vectors(self, first: int, last: int) -> np.ndarray:
        """As they came, a row each."""
        size, width = self.row["size"], self.row["width"]
        return _array(self.fs, self.path, f"<f{width}", 16 * self.row["n"] + first * size * width, (last - first) * size).reshape(-1, size)

    def audit(self, first: int, last: int) -> np.ndarray:
        n, size, width, layers = (self.row[x] for x in ("n", "size", "width", "layers"))
        return _array(self.fs, self.path, "u1", n * (16 + size * width) + 4 * sum(map(_links, range(len(layers)), layers)) + first, last - first) > 0

    def graph(self) -> Graph:
        graph, n, size, width = Graph.__new__(Graph), self.row["n"], self.row["size"], self.row["width"]
        graph.sizes, graph.layers, at = self.row["layers"], [], n * (16 + size * width)
        for k, points in enumerate(graph.sizes):
            graph.layers.append(_array(self.fs, self.path, "<i4", at, _links(k, points)).reshape(points, -1))
            at += 4 * _links(k, points)
        graph.points = _points(self.vectors(0, n))
        return graph


def _links(layer: int, points: int) -> int:
    """Places for links in a layer."""
    return points * DEGREE * (1 if layer else 2)


def within(graph: Graph, queries: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs that may have similarity ``least`` or more, a block of queries at a time: query (ascending), point and similarity."""
    todo, n = np.arange(len(queries)), len(graph.points)
    while len(todo):
        wider = []
        size = max(1, min(512, (1 << 20) // min(beam, n)))
        for first in range(0, len(todo), size):
            part = todo[first : first + size]
            ids, sims = graph.search(queries[part], min(beam, n))
            open_ = (sims[:, -1] >= least - SLACK) & (beam < n)
            wider.append(part[open_])
            q, at = np.nonzero((sims >= least - SLACK) & ~open_[:, None])
            yield part[q], ids[q, at], sims[q, at]
        todo, beam = np.concatenate(wider), 4 * beam
        if beam * SCAN > n:
            break
    yield from compared(graph, queries, todo, least)


def compared(graph: Graph, queries: np.ndarray, which: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``within``, by comparing some of the queries with all points."""
    size = max(1, CELLS // len(graph.points))
    for first in range(0, len(which), size):
        part = which[first : first + size]
        sims = queries[part] @ graph.points.T
        q, p = np.nonzero(sims >= least - SLACK)
        yield part[q], p, sims[q, p]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes, at most one per node: each node and the smallest it can reach."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def thinned(q: np.ndarray, p: np.ndarray, n_points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges between queries (ascending) and points that join the same nodes: one of each point, and edges between queries."""
    turn = np.cumsum(np.diff(q, prepend=q[:1]) != 0)
    rows = q[np.flatnonzero(np.diff(q, prepend=-1))]
    first = np.full(n_points, -1)
    first[p[::-1]] = turn[::-1]  # the last to write is the first query of a point
    hit = np.flatnonzero(first >= 0)
    met = np.zeros((len(rows), len(rows)), bool)
    met[turn, first[p]] = True
    np.fill_diagonal(met, False)
    a, b = np.nonzero(met)
    return rows[first[hit]], hit, rows[a], rows[b]


def _build(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            order, layers = drawn(sum(x.num_rows for x in held))
            ids, copies, audit = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held])[order] for c in ("rep", "copies", "audit"))
            place, vectors, at = np.argsort(order), None, 0
            for x in held:
                values = x.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(x.num_rows, -1)
                vectors = np.empty((len(order), values.shape[1]), values.dtype) if vectors is None else vectors
                vectors[place[at : at + x.num_rows]] = values
                at += x.num_rows
            held.clear()
            row = Shard.write(fs, root, vectors, ids, copies, audit, layers)
            return pa.RecordBatch.from_pylist([row], pa.schema([("name", pa.string()), ("size", pa.int32()), ("width", pa.int32()), ("n", pa.int64()), ("layers", pa.list_(pa.int32()))]))

        for batch in batches:
            sizes = batch.column("size").to_numpy()
            cuts = [0, *np.flatnonzero(np.diff(sizes)) + 1, len(sizes)] if len(sizes) else []
            for first, last in zip(cuts, cuts[1:]):
                part = batch.slice(first, last - first)
                if held and (held[0].column("size")[0].as_py() != sizes[first] or sum(x.num_rows for x in held) + part.num_rows > most):
                    yield done()
                held.append(part)
        if held:
            yield done()

    return run


def _linked(graph: Graph, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, source: Shard, first: int, last: int, least: float, beam: int) -> pa.RecordBatch:
    """Link counts of a slice of ``source`` in a shard, the true counts of its audited vectors (-1: not audited), and a forest."""
    names = source.ids(first, last)
    exact = _unit(source.vectors(first, last).astype(float))
    queries = exact.astype(np.float32)

    def verified(blocks):
        for q, p, sims in blocks:
            good = names[q] != ids[p]
            unsure = np.flatnonzero(good & (sims < least + SURE))
            size = max(1, (1 << 20) // exact.shape[1])
            for i in range(0, len(unsure), size):
                at = unsure[i : i + size]
                good[at] = np.einsum("ij,ij->i", exact[q[at]], _unit(vectors[p[at]].astype(float))) >= least
            yield q[good], p[good]

    def counts(q, p):
        return np.bincount(q, copies[p], len(names)).astype(np.int64)

    n_links, a, b = np.zeros(len(names), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    more: list[tuple[np.ndarray, np.ndarray]] = []
    for q, p in verified(within(graph, queries, least, beam)):
        n_links += counts(q, p)
        if len(q):
            of, to, left, right = thinned(q, p, len(ids))
            more += [(names[of], ids[to]), (names[left], names[right])]
        if sum(len(x) for x, _ in more) > EDGES:
            a, b = forest(*map(np.concatenate, zip((a, b), *more)))
            more = []
    a, b = forest(*map(np.concatenate, zip((a, b), *more)))
    audited = np.flatnonzero(source.audit(first, last))
    true = np.full(len(names), -1, np.int64)
    true[audited] = sum((counts(q, p) for q, p in verified(compared(graph, queries, audited, least))), np.zeros(len(names), np.int64))[audited]
    told = (n_links > 0) | (true >= 0)
    n = int(told.sum())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat([0, 1], [n, len(a)]).astype(np.int32)),
            pa.array(np.concatenate([names[told], a])),
            pa.array(np.concatenate([n_links[told], b])),
            pa.array(np.concatenate([true[told], np.full(len(a), -1)])),
        ],
        ["kind", "a", "b", "exact"],
    )


def _seek(folder: str, least: float, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name, shard = None, ()
        for batch in batches:
            for row in batch.to_pylist():
                if name != row["target"]["name"]:
                    shard, target = (), Shard(fs, root, row["target"])
                    name, n = target.row["name"], target.row["n"]
                    shard = target.graph(), target.ids(0, n), target.copies(), target.vectors(0, n)
                yield _linked(*shard, Shard(fs, root, row["source"]), row["first"], row["last"], least, beam)

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = 0.95,
    beam: int = 32,
    recall: float = 0.98,
    shard_size: int = 1 << 18,
    group_size: int = 1 << 13,
    audit: int = 256,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row: what it is linked with by cosine ``least`` or more.

    Vectors that are null, empty, zero, hold null or non-finite components, or whose norm is not finite,
    link with nothing. Equal vectors (also those that differ in length only by exact scaling do not
    count as equal) enter a graph once and link with each other. ``component_id`` is the smallest
    id reachable. Vectors of different dimensions are never linked. Rows that share an id count as
    several vectors of one node. A row without an id links with nothing. At least ``recall`` of the true links of
    ``audit`` vectors are found, or the beams of all searches are widened.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"  # which is kept as it is, and the rest as doubles
    value = F.col(vector_col) if single else F.transform(vector_col, lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), value.alias("vector"))
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & (norm > 1e-300) & (norm < 1e300), F.lit(False))
    keyed = rows.select("vec_id", F.when(sound, F.sha2(F.array_join(F.transform("vector", lambda x: x.cast("string")), ","), 256)).alias("key"), "vector")
    keys = materialise(keyed.select("vec_id", F.unhex("key").alias("key"), F.size("vector").alias("size")), "vector-keys")
    distinct = keys.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"))
    distinct = materialise(distinct, "distinct-vectors")
    total, components_in = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_shards = max(6, -(-total // shard_size), -(-4 * components_in // SHARD_BYTES))
    audited = F.pmod(F.xxhash64(F.col("key"), F.lit("audit")), F.lit(max(1, total // audit))) == 0
    reps = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"))
    dealt = reps.select("rep", "vector", "copies", audited.alias("audit"), F.size("vector").alias("size")).repartition(n_shards)
    folder = scratch_path(spark, "graphs")
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    index = materialise(dealt.sortWithinPartitions("size", "rep").mapInArrow(_build(folder, 2 * shard_size), INDEX), "graphs")
    slices = F.ceil(F.col("n") / F.lit(group_size))
    step = F.ceil(F.col("n") / slices)
    asking = index.select(F.struct("*").alias("source"), "size", "n", step.alias("step")).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("step"))))
    units = index.select(F.struct("*").alias("target"), "size").join(asking, "size").select("target", "source", "first", F.least(F.col("first") + F.col("step"), F.col("n")).alias("last"))
    units = materialise(units, "searches")
    n_units = units.count()
    n_tasks = max(min(n_units, 2 * spark.sparkContext.defaultParallelism), -(-n_units // TURNS), 1)
    units = units.repartitionByRange(n_tasks, "target.name", "source.name", "first").sortWithinPartitions("target.name", "source.name", "first")
    while True:
        found = materialise(units.mapInArrow(_seek(folder, least, beam), "kind int, a long, b long, exact long"), "near-vectors")
        seen, true = found.where("exact >= 0").agg(F.sum("b"), F.sum("exact")).first()
        if not true or seen >= recall * true or beam >= shard_size:
            break
        beam *= 2
    linked = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    reach = components(found.where("kind = 1").select("a", "b"), "vector-components")
    nodes = distinct.select("key", "rep", "copies").join(linked, "rep", "left").join(reach, F.col("rep") == F.col("node"), "left")
    nodes = nodes.select("key", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = keys.select("vec_id", "key").join(nodes, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
