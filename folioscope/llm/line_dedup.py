"""Line dedup with two Bloom filters.

Three passes, of which none shuffles a line that occurs once:

1. every task hashes the keys of its lines into two bit arrays, *once* and *twice*;
   sparse pieces of both are merged by position: a bit is set in the merged
   *twice* array if any task had it twice or two tasks had it once;
2. the *twice* array, whose size has a fixed bound, goes to all tasks; only lines that
   hit it (suspected repeats) leave their task, with their text, and are counted
   exactly;
3. the positions to drop, a few numbers per document, are joined to the documents.

A saturated filter costs traffic and never changes the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.tokens import per_process
from folioscope.plans.scale import bound_batches, materialise

PROBES = 3
SEGMENT = 1 << 16
"""Bytes of the filter that travel as one piece."""


def keys_of(text: bytes, min_chars: int) -> dict[bytes, list[int]]:
    """Positions of every key of at least ``min_chars`` code points.

    ``bytes.lower`` touches A-Z only and ``bytes.strip`` exactly the six ASCII spaces.
    """
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.lower().split(b"\n")):
        key = line.strip()
        if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
            found.setdefault(key, []).append(i)
    return found


def places(hashes: np.ndarray, bits: int, probes: int = PROBES) -> np.ndarray:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(probes)])


def _put(filter_: np.ndarray, at: np.ndarray) -> None:
    flat = at.ravel()
    np.bitwise_or.at(filter_, flat >> np.uint64(3), np.uint8(1) << (flat & np.uint64(7)).astype(np.uint8))


def has(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (x.as_py() or b"" for x in batch.column("text"))


def _line_hashes(min_chars: int):
    """Hashes of the keys of each batch, each key once per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield _hashes([k for text in _texts(batch) for k in keys_of(text, min_chars)])

    return run


def _fill(bits: int, hashes_of, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_process("filters", "none", dict)  # frees the tables of earlier stages
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for found in hashes_of(batches):
            hashes, counts = np.unique(found, return_counts=True)
            at = places(hashes, bits, probes)
            _put(twice, at[:, (counts > 1) | has(once, at)])
            _put(once, at)
        for segment, start in enumerate(range(0, bits // 8, SEGMENT)):
            part = once[start : start + SEGMENT]
            if part.any():
                packed = [zlib.compress(x.tobytes(), 1) for x in (part, twice[start : start + SEGMENT])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["segment", "once", "twice"]
                )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    merged: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            once, twice = (np.frombuffer(zlib.decompress(row[c]), np.uint8) for c in ("once", "twice"))
            if row["segment"] in merged:
                seen, repeated = merged[row["segment"]]
                once, twice = seen | once, repeated | twice | (seen & once)
            merged[row["segment"]] = once, twice
    for segment, (_, twice) in merged.items():
        packed = zlib.compress(twice.tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([packed], pa.binary())], ["segment", "twice"])


def repeat_filter(rows: DataFrame, bits: int, hashes_of, probes: int = PROBES) -> np.ndarray:
    """Bit array that has every hash found in two rows or more, and few others.

    ``hashes_of`` turns the batches of a task into arrays of hashes, in which a row has each of its own once.
    """
    pieces = rows.mapInArrow(_fill(bits, hashes_of, probes), "segment int, once binary, twice binary")
    merged = pieces.repartition("segment").mapInArrow(_merge, "segment int, twice binary")
    whole = np.zeros(bits // 8, np.uint8)
    for row in materialise(merged, "repeat-filter").collect():  # bits / 8 bytes at most
        part = np.frombuffer(zlib.decompress(row.twice), np.uint8)
        whole[row.segment * SEGMENT : row.segment * SEGMENT + len(part)] = part
    return whole


def _suspects(shared, bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            row, keys, lines = [], [], []
            for i, text in enumerate(_texts(batch)):
                for key, at in keys_of(text, min_chars).items():
                    row.append(i)
                    keys.append(key)
                    lines.append(at)
            hit = np.flatnonzero(has(twice, places(_hashes(keys), bits)))
            rows = pa.array(np.asarray(row, np.int64)[hit])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").take(rows),
                    batch.column("row_hash").take(rows),
                    pa.array([keys[i] for i in hit], pa.binary()),
                    pa.array([lines[i] for i in hit], pa.list_(pa.int32())),
                ],
                ["doc", "row_hash", "key", "places"],
            )

    return run


def filter_bits(n_bytes: int, min_chars: int, max_bits: int) -> int:
    """Power of two with eight bits for each line that ``n_bytes`` can hold, up to ``max_bits``."""
    wanted = 8 * n_bytes // (min_chars + 1)
    return min(max_bits, 1 << max(13, wanted.bit_length()))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    max_filter_bits: int = 1 << 28,
) -> DataFrame:
    """Drop lines that many documents share, except in the largest id that holds them.

    A key is a line without ASCII space at its ends and with A-Z lower-cased. Keys of
    at least ``min_chars`` code points in at least ``min_docs`` documents lose all their
    lines but those of the largest id. Returns the columns of ``docs`` with the text
    replaced, and ``n_lines`` and ``n_dropped`` (columns with these names are replaced).

    A null or empty text is one empty line. Rows that share an id are one document for
    the counts; each keeps its own row. Rows without an id count as no document and lose
    every line whose key is repeated. ``id_col`` is an integer. ``max_filter_bits`` bounds
    what is broadcast (eight bits per byte); beyond it more lines are checked exactly.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("row_hash"), text.cast("binary").alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    bits = filter_bits(n_bytes, min_chars, max_filter_bits)
    shared = spark.sparkContext.broadcast(repeat_filter(texts.select("text"), bits, _line_hashes(min_chars)).tobytes())

    found = texts.mapInArrow(_suspects(shared, bits, min_chars), "doc long, row_hash long, key binary, places array<int>")
    found = materialise(found, "suspects")
    repeated = (
        found.where(F.col("doc").isNotNull())
        .groupBy("key")
        .agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("key", "keeper")
    )
    drops = (
        found.join(materialise(repeated, "repeated-lines"), "key")
        .where(F.col("doc").isNull() | (F.col("doc") != F.col("keeper")))
        .dropDuplicates(["doc", "row_hash", "key"])
        .groupBy("doc", "row_hash")
        .agg(F.flatten(F.collect_list("places")).alias("drop"))
    )
    drops = materialise(drops, "dropped-lines")

    rows = docs.select(F.struct(*docs.columns).alias("whole"))  # no name of the input meets one of these
    own, given = F.col("whole").getField(text_col), F.coalesce(F.col("whole").getField(text_col), F.lit(""))
    here = F.col("whole").getField(id_col).cast("long").eqNullSafe(F.col("doc")) & (F.xxhash64(given) == F.col("row_hash"))
    lines = F.split(given, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    fewer = F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")
    out = rows.join(drops, here, "left").withColumn("lines", F.when(F.col("drop").isNotNull(), lines))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    new_text = F.when(F.col("drop").isNotNull(), fewer).otherwise(own).alias(text_col)
    return out.select(
        *[new_text if c == text_col else F.col("whole").getField(c).alias(c) for c in rest],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
