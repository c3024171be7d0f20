"""Removal of byte strings that occur more than once, by prefix doubling over sampled positions.

Prefix doubling names strings by rank: the pair of a string's rank and its continuation's is sorted, gets a rank, and
the strings at a position grow until they are unique or long enough. Doubling over every byte would move 16 bytes per byte and
round. So it starts from strings of half the length, at positions that their own bytes choose: every string of the full
length (a *window*) holds ``w`` strings of ``k = length - w + 1`` bytes, and the one with the least hash is its *anchor*. Equal windows
have equal anchors in the same place, and the windows of one anchor are a run of neighbours, about ``w / 2`` of them.

The first round ranks the ``k`` bytes at the anchors. Unique ones are done: none of their windows repeats. Where the whole *hull* of
an anchor's run occurs again (the interior of a repeated passage), all its windows do, and it is done too. What is left
lies at the edges of repeats, a few anchors each. Their runs are split into blocks of windows by their distance from the anchor; the bytes
that all windows of a block share are the rank so far and a continuation to the left or right, so each round sorts pairs of rank and continuation, reranks, and goes
on with blocks that are neither unique nor wholly repeated, until a block is one window of the full length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from folioscope.llm.skew import join_hot
from folioscope.llm.tokens import per_process, small_parts
from folioscope.plans.scale import materialise

CHUNK = 1 << 19
"""Windows of a text that are looked at together."""
PLACE = 24
"""Low bits of a hash that give way to the place, so that the first of equal hashes is least."""
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
TEXT = ["t1", "t2"]
ANCHORS = "t1 long, t2 long, at long, before int, after int, core long, hull long"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _finished(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of all strings of a chunk from prefix sums of powers, modulo 2**64."""

    def __init__(self, most: int):
        self.values = _finished(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
        self.powers, self.inverses = _powers(MULTIPLIER, most + 1), _powers(INVERSE, most + 1)

    def sums(self, chunk: np.ndarray) -> np.ndarray:
        out = np.zeros(len(chunk) + 1, np.uint64)
        np.cumsum(self.values[chunk] * self.powers[: len(chunk)], out=out[1:])
        return out

    def strings(self, sums: np.ndarray, starts, ends) -> np.ndarray:
        return (sums[ends] - sums[starts]) * self.inverses[starts]


def least_places(names: np.ndarray, w: int) -> np.ndarray:
    """Place of the least of each ``w`` neighbours, the first of equal ones."""
    place = np.uint64((1 << PLACE) - 1)
    least, have = (names & ~place) | np.arange(len(names), dtype=np.uint64), 1
    while have < w:
        step = min(have, w - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    return (least & place).astype(np.int64)


def anchors(text: bytes, length: int, w: int, rolling: Rolling) -> Iterator[tuple[np.ndarray, ...]]:
    """Per chunk ``at, before, after, core, hull`` of the anchors; its windows start ``after`` to ``before`` bytes before an anchor."""
    k = length - w + 1
    data = np.frombuffer(text, np.uint8)
    for start in range(0, len(data) - length + 1, CHUNK):
        chunk = data[start : start + CHUNK + length - 1]
        sums = rolling.sums(chunk)
        last = len(chunk) - k + 1
        cores = _finished((sums[k:] - sums[:-k]) * rolling.inverses[:last])
        at = least_places(cores, w)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        final = np.r_[first[1:], len(at)] - 1
        at = at[first]
        before, after = at - first, at - final
        with np.errstate(over="ignore"):
            shape = (before * w + after + 1).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
            hull = _finished(rolling.strings(sums, first, final + length) + shape)
        yield at + start, before, after, cores[at], hull


def _anchor_rows(length: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_process("repeats", "none", dict)  # frees the tables of earlier stages
        rolling = Rolling(CHUNK + length)
        for batch in small_parts(batches, 512):
            names = [batch.column(c).to_numpy() for c in TEXT]
            found: list[tuple[np.ndarray, ...]] = []
            for row, text in enumerate(batch.column("text")):
                for part in anchors(text.as_py(), length, w, rolling):
                    found.append((np.full(len(part[0]), row), *part))
                    if sum(len(x[0]) for x in found[-64:]) > 200_000:
                        yield _anchor_batch(names, found)
                        found = []
            if found:
                yield _anchor_batch(names, found)

    return run


def _anchor_batch(names: list[np.ndarray], found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    row, at, before, after, core, hull = (np.concatenate(x) for x in zip(*found))
    return pa.RecordBatch.from_arrays(
        [*(pa.array(n[row]) for n in names), pa.array(at), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(hull.view(np.int64))],
        [*TEXT, "at", "before", "after", "core", "hull"],
    )


def _cut_out(length: int):
    """The bytes of the hulls that are asked for, from each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches, 64):
            for text, asked in zip(batch.column("text"), batch.column("asked")):
                text, asked = text.as_py(), asked.as_py()
                for first in range(0, len(asked), 4096):
                    part = asked[first : first + 4096]
                    hulls = pa.array([text[x["at"] - x["before"] : x["at"] - x["after"] + length] for x in part], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([x["id"] for x in part], pa.int64()), hulls], ["id", "bytes"])

    return run


def _split(length: int, wide: int, narrow: int):
    """Blocks of ``narrow`` windows inside blocks of ``wide``: the name of the bytes that the block's windows share, and of its hull."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches, 2048):
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("id", "rank", "block", "resolved", "before", "after", "bytes"))
            for id_, rank, block, resolved, before, after, data in zip(*columns):
                low, high = max(after, block * wide), min(before, (block + 1) * wide - 1)
                for b in range(low // narrow, high // narrow + 1):
                    near, far = max(after, b * narrow), min(before, (b + 1) * narrow - 1)
                    shared = data[before - b * narrow : before - (b + 1) * narrow + 1 + length]
                    hull = data[before - far : before - near + length]
                    name = xxhash.xxh3_64_intdigest(shared) - (1 << 63)
                    shape = (far - near) * wide * 2 + near - b * narrow
                    out.append((id_, rank, b, name, xxhash.xxh3_64_intdigest(hull, shape) - (1 << 63), near, far, resolved))
            names = ["id", "rank", "block", "name", "hull", "near", "far", "resolved"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)

    return run


SPLIT = "id long, rank long, block long, name long, hull long, near long, far long, resolved boolean"


def repeated_windows(texts: DataFrame, length: int) -> DataFrame:
    """``t1, t2, first, last``: where windows of ``length`` bytes start that also start elsewhere; runs of starts, stored.

    ``texts`` has ``t1, t2`` (a name of the text) and ``text`` binary, a row for each copy.
    """
    exponent = max((length * 2 // 3).bit_length() - 1, 0)
    w = 1 << exponent
    long = texts.where(F.octet_length("text") >= length)
    found = materialise(long.mapInArrow(_anchor_rows(length, w), ANCHORS), "anchors")
    cores = found.groupBy("core").agg(F.count(F.lit(1)).alias("n"), (F.min("hull") != F.max("hull")).alias("several")).where("n > 1")
    suspects = materialise(join_hot(found, materialise(cores.select("core", "several"), "repeated-cores"), ["core"]), "suspects")
    place = F.struct(*TEXT, "at", "before", "after")
    classes = materialise(suspects.groupBy("core", "hull").agg(F.count(F.lit(1)).alias("n"), F.first("several").alias("several"), F.min(place).alias("one")), "hulls")
    whole = join_hot(suspects, classes.where("n > 1").select("core", "hull"), ["core", "hull"], "left_semi")
    runs = [materialise(whole.select(*TEXT, (F.col("at") - F.col("before")).alias("first"), (F.col("at") - F.col("after")).alias("last")).distinct(), "repeated-runs")]

    unclear = classes.where("several").groupBy("core").agg(F.min("n").alias("least")).where("least = 1").select("core")
    open_ = join_hot(classes.where("several"), materialise(unclear, "unclear-cores"), ["core"], "left_semi")
    open_ = materialise(open_.select(F.monotonically_increasing_id().alias("id"), "core", (F.col("n") > 1).alias("resolved"), "one.*"), "open-anchors")
    asked = open_.groupBy(*TEXT).agg(F.collect_list(F.struct("id", "at", "before", "after")).alias("asked"))  # anchors of one text
    once = join_hot(long, materialise(asked, "asked"), TEXT).dropDuplicates(TEXT)
    hulls = materialise(once.mapInArrow(_cut_out(length), "id long, bytes binary"), "hull-bytes")
    hulls = materialise(open_.select("id", "before", "after").join(hulls, "id"), "hull-bytes")
    work = open_.select("id", F.col("core").alias("rank"), F.lit(0).cast("long").alias("block"), "resolved")
    spans = []
    steps = [exponent, exponent // 2, 0] if exponent > 1 else [exponent, 0]
    for wide, narrow in zip(steps, steps[1:]):
        if work.isEmpty():
            break
        split = materialise(join_hot(work, hulls, ["id"]).mapInArrow(_split(length, 1 << wide, 1 << narrow), SPLIT), "blocks")
        key = ["rank", "block", "name"]
        grouped = split.groupBy(*key, "hull").agg(F.count(F.lit(1)).alias("n"), F.max("resolved").alias("known"), F.min("id").alias("one"))
        grouped = materialise(grouped, "ranks")
        again = join_hot(split.where("not resolved"), grouped.where("n > 1").select(*key, "hull"), [*key, "hull"], "left_semi")
        spans.append(materialise(again.select("id", "near", "far"), "repeated-blocks"))
        ranks = grouped.groupBy(*key).agg(F.count(F.lit(1)).alias("hulls"), F.min(F.when(F.col("known"), 2).otherwise(F.col("n"))).alias("least"), F.min("one").alias("new"))
        ranks = materialise(ranks.where("hulls > 1 and least = 1").select(*key, "new"), "new-ranks")
        work = join_hot(grouped, ranks, key).select(F.col("one").alias("id"), F.col("new").alias("rank"), "block", ((F.col("n") > 1) | F.col("known")).alias("resolved"))
        work = materialise(work, "open-blocks")
    if spans:
        edges = reduce(DataFrame.unionByName, spans)
        places = open_.select("id", *TEXT, "at")
        runs.append(edges.join(places, "id").select(*TEXT, (F.col("at") - F.col("far")).alias("first"), (F.col("at") - F.col("near")).alias("last")))
    return materialise(reduce(DataFrame.unionByName, runs).distinct(), "repeated-windows")


def _without(length: int):
    @pandas_udf("kept binary, n_removed long, n_spans long")
    def without(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for text, found in zip(texts, runs):
            if found is None:
                out.append((text, 0, 0))
                continue
            spans = np.sort(np.asarray(found, np.int64))
            first, end = spans >> 32, (spans & 0xFFFFFFFF) + length
            reach = np.maximum.accumulate(end)
            new = np.flatnonzero(np.r_[True, first[1:] > reach[:-1]])
            starts, stops = first[new], reach[np.r_[new[1:], len(first)] - 1]
            edges = zip([0, *stops.tolist()], [*starts.tolist(), len(text)])
            out.append((b"".join(text[a:b] for a, b in edges), int((stops - starts).sum()), len(starts)))
        return pd.DataFrame(out, columns=["kept", "n_removed", "n_spans"])

    return without


def text_name(text: Column) -> list[Column]:
    """Two 64-bit hashes."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = 400) -> DataFrame:
    """``docs`` without the bytes of strings of ``length`` bytes that start in more than one place.

    Texts are taken as UTF-8; matches lie inside one text and may overlap, and what repeats is judged on the input. Returns the columns
    of ``docs``, with the text as it is, and ``kept`` (binary, as a cut may part a character), ``n_bytes``, ``n_removed`` and ``n_spans``
    (maximal removed runs). Input columns of these four names are replaced. A null text is an empty one; texts under
    ``length`` bytes lose nothing; repeated rows count as two places, so that they lose all they have in common. An empty table gives no rows.
    Texts hold at most 2**31 bytes (as Spark's do). Strings are told apart by 64 bits of hash among those with equal anchors.
    """
    results = ("kept", "n_bytes", "n_removed", "n_spans")
    rest = [c for c in docs.columns if c not in results]
    as_bytes = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    texts = docs.select(as_bytes.alias("text")).select("text", *text_name(F.col("text")))
    runs = repeated_windows(texts, length)
    packed = F.shiftleft("first", 32).bitwiseOR(F.col("last"))
    runs = runs.groupBy(*TEXT).agg(F.collect_list(packed).alias("runs"))  # runs of one text
    keyed = docs.select(F.struct(*rest).alias("row"), *text_name(as_bytes))
    inside = F.encode(F.coalesce(F.col("row").getField(text_col), F.lit("")), "UTF-8")
    found = join_hot(keyed, materialise(runs, "runs-by-text"), TEXT, "left").withColumn("out", _without(length)(inside, F.col("runs")))
    return found.select("row.*", "out.kept", F.octet_length(inside).cast("long").alias("n_bytes"), "out.n_removed", "out.n_spans")
