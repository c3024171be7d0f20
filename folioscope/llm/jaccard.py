"""N-gram Jaccard join with PartEnum signatures.

Equal sets are one class from the start. The features are partitioned and subsets of the parts
enumerated, so that two sets of neighbouring size bands that are similar enough share a
signature; only signatures are shuffled for the search, once. A set whose features mostly occur in
no other text has no partner and signs nothing; two bit arrays of bounded size, for features seen once and
twice, tell most of those. In each signature's bucket the
sets are first compared with one leader. What those links connect needs no more comparing;
the rest of a bucket is compared across its components, without exception. Before the words of
two sets are compared, their sizes and a parity sketch must admit the link: the number of differing
parity bits is never more than the number of differing features. Parity says little of long sets, so small tables of how many
features fall into each cell must admit it as well, before any feature is moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.langid import slices
from folioscope.llm.line_dedup import has, places, repeat_filter
from folioscope.llm.tokens import per_process, small_parts
from folioscope.plans.scale import bound_batches, materialise

LANES = 16
"""64-bit words of the parity sketch."""
CELLS = 1024
"""Cells of the table of counts, one byte each."""
CACHED = 100_000
BYTES_PER_WORD = 6
"""What a word takes in common text, to size the filter."""
ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    values = (values ^ np.uint64(seed)) * ODD
    return values ^ (values >> np.uint64(29))


def shingle_sets(texts: list[str], n: int, words: WordHashes) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``n`` words of each text; a shorter text is one run.

    Words are what stands between ASCII spaces, with A-Z lower-cased (``bytes.lower`` and
    ``bytes.split`` do exactly that).
    """
    found = [t.encode("utf-8", "replace").lower().split() for t in texts]
    flat = np.fromiter(map(words.__getitem__, chain.from_iterable(found)), np.uint64, sum(map(len, found)))
    out, at = [], 0
    with np.errstate(over="ignore"):
        for run in found:
            here = flat[at : at + len(run)]
            at += len(run)
            width = min(n, len(run))
            mixed = np.zeros(len(here) - width + 1 if width else 0, np.uint64)
            for k in range(width):
                mixed = _mix(mixed + here[k : len(here) - width + 1 + k], k + 1)
            out.append(np.unique(mixed))
    return out


def _band(size: int, least: Fraction) -> tuple[int, int]:
    """Number of the size band that holds ``size``, and the band's largest size."""
    number, low = 0, 1
    while True:
        high = low * least.denominator // least.numerator
        if size <= high:
            return number, high
        number, low = number + 1, high + 1


def signatures(shingles: np.ndarray, least: Fraction, seed: int = 0) -> np.ndarray:
    """PartEnum signatures of one set, for its own size band and the next one.

    Sets of a band with similarity ``least`` or more differ in at most d features. The features are
    dealt to (d + 1) / 2 parts, of which one has at most one difference, and each part to three
    pieces, of which then two agree; a signature is the sum of the features of two pieces. Two sets
    of neighbouring bands meet in the signatures of the larger band.
    """
    own, high = _band(len(shingles), least)
    out = []
    for number, top in ((own, high), (own + 1, (high + 1) * least.denominator // least.numerator)):
        apart = 2 * top * (least.denominator - least.numerator) // (least.denominator + least.numerator)
        with np.errstate(over="ignore"):
            base = np.array([number * 1_000_003 + seed], np.uint64)
            if apart == 0:
                out.append(_mix(_mix(shingles, seed + 11).sum(keepdims=True) ^ _mix(base), 5))
                continue
            parts = apart // 2 + 1
            place = _mix(shingles, seed + 17 + number)
            cell = (place >> np.uint64(33)) % np.uint64(3 * parts)
            sums = np.zeros(3 * parts, np.uint64)
            np.add.at(sums, cell.astype(np.int64), _mix(shingles, seed + 23))
            pieces = sums.reshape(parts, 3)
            two = np.stack([pieces[:, 0] * np.uint64(3) + pieces[:, 1], pieces[:, 1] * np.uint64(5) + pieces[:, 2], pieces[:, 0] * np.uint64(7) + pieces[:, 2]], axis=1)
            names = np.arange(3 * parts, dtype=np.uint64).reshape(parts, 3) + _mix(base)
            out.append(_mix(_mix(two, 3) ^ _mix(names, 9), 5).ravel())
    return np.concatenate(out)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of the features that fall on each bit, as signed 64-bit words."""
    with np.errstate(over="ignore"):
        place = (_mix(shingles, 31) >> np.uint64(40)) % np.uint64(64 * LANES)
    bits = np.bincount(place.astype(np.int64), minlength=64 * LANES).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view("<i8")


def cell_counts(shingles: np.ndarray) -> np.ndarray:
    """How many features fall into each cell, 255 at most; tables differ by no more in all than the sets do."""
    place = (_mix(shingles, 47) >> np.uint64(40)) % np.uint64(CELLS)
    return np.minimum(np.bincount(place.astype(np.int64), minlength=CELLS), 255).astype(np.uint8)


def _rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, list[np.ndarray], list[int]]]:
    """Ids, shingle sets and set ids of some whole texts at a time; the set id of an empty set is 0."""
    words = per_process("jaccard", "words", WordHashes)
    for batch in small_parts(batches):
        for first, texts in slices(batch.column("text").to_pylist()):
            sets = shingle_sets(texts, n, words)
            ids = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0 for s in sets]
            yield batch.column("doc").slice(first, len(texts)), sets, ids


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, sets, ids in _rows(batches, n):
            yield pa.RecordBatch.from_arrays(
                [
                    docs,
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(ids, pa.int64()),
                    pa.array([xxhash.xxh3_64_intdigest(s.tobytes(), 1) - (1 << 63) for s in sets], pa.int64()),
                    pa.array([sketch(s) for s in sets], pa.list_(pa.int64())),
                ],
                ["doc", "size", "set", "second", "sketch"],
            )

    return run


def _features(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, sets, _ in _rows(batches, n):
            yield np.concatenate(sets)

    return run


def _sign(n: int, least: Fraction, shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = np.frombuffer(shared.value, np.uint8)
        done: set[int] = set()  # copies in one task sign once
        for docs, sets, ids in _rows(batches, n):
            new = [i for i, k in enumerate(ids) if len(sets[i]) and docs[i].is_valid and k not in done and not done.add(k)]
            common = [np.count_nonzero(has(repeated, places(sets[i], bits, 1))) for i in new]
            new = [i for i, k in zip(new, common) if k * least.denominator >= len(sets[i]) * least.numerator]
            signed = [signatures(sets[i], least) for i in new]
            if signed:
                owner = np.repeat(np.array([ids[i] for i in new], np.int64), [len(x) for x in signed])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(signed).view(np.int64)), pa.array(owner)], ["sig", "set"])

    return run


def _hash_lists(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, ids in _rows(batches, n):
            columns = [ids, [len(s) for s in sets], [cell_counts(s).tobytes() for s in sets], [s.tobytes() for s in sets]]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["set", "size", "counts", "features"])

    return run


def _by_counts(least: Fraction):
    """Pairs whose tables of counts leave the link possible."""
    top, bottom = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for c in ("left", "right"))
            apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
            admitted = apart * (bottom + top) <= batch.column("sizes").to_numpy() * (bottom - top)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(admitted, pa.bool_()))

    return run


def _verify(least: Fraction):
    top, bottom = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(bottom * common >= top * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _admits(least: Fraction, x: str, y: str) -> Column:
    """Whether sizes and sketches of the set structs ``x`` and ``y`` leave the link possible."""
    top, bottom = least.numerator, least.denominator
    a, b = F.col(f"{x}.size"), F.col(f"{y}.size")
    sizes = (F.least(a, b) * bottom >= F.greatest(a, b) * top)
    apart = sum((F.bit_count(F.get(f"{x}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{y}.sketch", F.lit(i)))) for i in range(LANES)), F.lit(0))
    return sizes & (apart * (bottom + top) <= (a + b) * (bottom - top))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, max_filter_bits: int = 1 << 28) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Two documents link when their sets of runs of ``n`` words have a Jaccard similarity of ``percent``
    or more hundredths. A text of fewer words is one run; null and empty texts, and rows without an id, link
    with nothing. ``component_id`` is the smallest id reachable. Rows that share an id are one node with
    several texts. Every link is found, also where the filter of at most ``max_filter_bits`` bits is too small to rule texts out; features and equal sets are told apart by 64 and 128 bits of hash.
    """
    spark, least = docs.sparkSession, Fraction(percent, 100)
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sets = rows.mapInArrow(_describe(n), "doc long, size long, set long, second long, sketch array<long>")
    sets = materialise(sets, "shingle-sets")
    real = sets.where((F.col("size") > 0) & F.col("doc").isNotNull())
    classes = real.groupBy("set", "second").agg(F.min("doc").alias("rep"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    classes = materialise(classes, "set-classes")
    info = classes.select("set", F.struct("rep", "size", "sketch").alias("info"))

    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    bits = min(max_filter_bits, 1 << max(13, (4 * n_bytes // BYTES_PER_WORD).bit_length()))
    shared_features = spark.sparkContext.broadcast(repeat_filter(rows, bits, _features(n), 1).tobytes())
    signed = rows.mapInArrow(_sign(n, least, shared_features, bits), "sig long, set long")
    bucket = Window.partitionBy("sig")
    shared = signed.withColumn("leader", F.min("set").over(bucket)).withColumn("last", F.max("set").over(bucket))
    shared = materialise(shared.where(F.col("leader") != F.col("last")).select("sig", "set", "leader"), "shared-signatures")

    def described(pairs: DataFrame) -> DataFrame:
        left = info.select(F.col("set").alias("a"), F.col("info").alias("x"))
        right = info.select(F.col("set").alias("b"), F.col("info").alias("y"))
        return pairs.join(left, "a").join(right, "b").where(_admits(least, "x", "y")).select("a", "b", F.col("x.rep").alias("p"), F.col("y.rep").alias("q"))

    def links(pairs: DataFrame) -> DataFrame:
        """Links, by representative, among possible pairs ``a, b, p, q``."""
        pairs = materialise(pairs, "possible-pairs")
        needed = materialise(pairs.select("p").union(pairs.select("q")).distinct().select(F.col("p").alias("doc")), "needed-texts")
        lists = rows.join(needed, "doc", "left_semi").mapInArrow(_hash_lists(n), "set long, size long, counts binary, features binary").dropDuplicates(["set"])
        lists = materialise(lists, "feature-lists")

        def with_both(pairs: DataFrame, column: str) -> DataFrame:
            left = lists.select(F.col("set").alias("a"), F.col("size").alias("s"), F.col(column).alias("left"))
            right = lists.select(F.col("set").alias("b"), F.col("size").alias("t"), F.col(column).alias("right"))
            return pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("s") + F.col("t")).alias("sizes"), "left", "right")

        likely = materialise(with_both(pairs.select("a", "b"), "counts").mapInArrow(_by_counts(least), "a long, b long"), "likely-pairs")
        found = with_both(likely, "features").mapInArrow(_verify(least), "a long, b long")
        return materialise(found.join(pairs, ["a", "b"]).select(F.col("p").alias("a"), F.col("q").alias("b")), "links")

    copies = real.join(classes.select("set", "second", "rep"), ["set", "second"]).where(F.col("doc") != F.col("rep")).select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    edges = links(described(shared.where(F.col("set") != F.col("leader")).select(F.col("leader").alias("a"), F.col("set").alias("b")).distinct())).union(copies)
    reach = materialise(components(edges), "reach")

    known = info.join(reach, F.col("info.rep") == F.col("node"), "left").select("set", "info", F.coalesce("component", "info.rep").alias("component"))
    inside = shared.select("sig", "set", "leader").distinct().join(known, "set")
    split = inside.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("low") != F.col("high")).select("sig")
    open_ = materialise(inside.join(split, "sig"), "open-buckets")
    x = open_.where(F.col("set") != F.col("leader")).select("sig", F.col("set").alias("a"), F.col("info").alias("x"), F.col("component").alias("c"))
    y = x.select("sig", F.col("a").alias("b"), F.col("x").alias("y"), F.col("c").alias("d"))
    across = (F.col("l.sig") == F.col("r.sig")) & (F.col("a") < F.col("b")) & (F.col("c") != F.col("d")) & _admits(least, "x", "y")
    rest = x.alias("l").join(y.alias("r"), across).select("a", "b", F.col("x.rep").alias("p"), F.col("y.rep").alias("q")).distinct()
    more = links(rest)
    if not more.isEmpty():
        reach = components(edges.union(more))
    out = sets.join(reach, F.col("doc") == F.col("node"), "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
