"""Quality classifier: a factorisation machine over words, structure and metadata.

A text is a sparse vector of hashed words and of binned statistics. Its score is linear in the
features plus the products of all pairs, whose weights are inner products of short factors; the
sum over pairs is half of (square of the sum minus sum of the squares), so it costs no more than
the linear part. Every pass of the fit gives each group of rows one epoch of its own from the
common parameters and averages the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.langid import slices
from folioscope.llm.tokens import free_name, per_process, small_parts
from folioscope.plans.scale import materialise

WORDS = 1 << 14
"""Buckets of hashed words; structure and metadata have places of their own after them."""
EDGES = np.array([1e-9, 0.0005, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9, 0.999])
BINS = len(EDGES) + 1
STATS = ["upper", "digit", "bar", "bang", "symbol", "other_punct", "newline", "beyond_ascii", "repeat", "distinct", "top_word", "word_length", "size"]
RANK = 6
STEPS = 60
CACHED = 300_000

KINDS = np.zeros(256, np.int64)
"""Class of each byte: 0 other, then as the first eight of ``STATS``, 9 ASCII lower case."""
for _byte in range(256):
    _char = chr(_byte)
    KINDS[_byte] = (
        8 if _byte > 127
        else 1 if _char.isupper()
        else 9 if _char.islower()
        else 2 if _char.isdigit()
        else 7 if _char == "\n"
        else 3 if _char == "|"
        else 4 if _char == "!"
        else 5 if _char in "#$%&*@^~<>{}[]=+\\_"
        else 6 if _char.isprintable() and _char != " "
        else 0
    )


class Buckets(dict):
    """Bucket of each word met so far, by its lower-cased form."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        bucket = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "replace")) % WORDS
        self[word] = bucket
        return bucket


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def n_features(n_meta: int) -> int:
    return WORDS + BINS * (len(STATS) + n_meta)


def features(texts: list[str], meta: np.ndarray, buckets: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of every non-zero entry, in row order.

    ``meta`` has a column per metadata field; NaN (missing) is a bin of its own.
    """
    n = len(texts)
    words = [t.split() for t in texts]
    size = np.array([len(w) for w in words])
    row = np.repeat(np.arange(n), size)
    bucket = np.fromiter(map(buckets.__getitem__, chain.from_iterable(words)), np.int64, len(row))
    cell, count = np.unique(row * WORDS + bucket, return_counts=True)
    word_row, word_bucket = cell // WORDS, cell % WORDS
    norm = np.sqrt(np.bincount(word_row, count.astype(float) ** 2, n))
    value = count / norm[word_row]

    raw = [t.encode("utf-8", "replace") for t in texts]
    n_bytes = np.array([len(b) for b in raw])
    kind = KINDS[np.frombuffer(b"".join(raw), np.uint8)]
    kinds = np.bincount(np.repeat(np.arange(n), n_bytes) * 10 + kind, minlength=10 * n).reshape(n, 10)
    again = (row[1:] == row[:-1]) & (bucket[1:] == bucket[:-1])
    top = np.zeros(n)
    np.maximum.at(top, word_row, count)
    letters = kinds[:, 1] + kinds[:, 9]
    stats = [
        _ratio(kinds[:, 1], letters),
        *(_ratio(kinds[:, k], n_bytes) for k in range(2, 9)),
        _ratio(np.bincount(row[1:][again], minlength=n), size),
        _ratio(np.bincount(word_row, minlength=n), size),
        _ratio(top, size),
        _ratio(n_bytes, size) / 20,
        np.log1p(size) / 12,
    ]
    stats += [np.log1p(np.maximum(m, 0)) / 14 for m in meta.T]
    bins = np.stack([np.searchsorted(EDGES, s, side="right") for s in stats], axis=1)
    bins[:, len(STATS) :][np.isnan(meta)] = 0
    place = WORDS + np.arange(len(stats)) * BINS + bins

    rows = np.concatenate([word_row, np.repeat(np.arange(n), len(stats))])
    order = np.argsort(rows, kind="stable")
    values = np.concatenate([value, np.full(place.size, 0.5)])
    return rows[order], np.concatenate([word_bucket, place.ravel()])[order], values[order]


def margins(row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int, bias: float, table: np.ndarray) -> np.ndarray:
    """Score before the logistic function; column 0 of ``table`` is linear, the others are factors.

    Every row has entries, as each statistic falls in some bin, and rows are in order.
    """
    entries = table[feature] * value[:, None]
    starts = np.searchsorted(row, np.arange(n))
    sums = np.add.reduceat(entries, starts, axis=0)
    squares = np.add.reduceat((entries[:, 1:] ** 2).sum(axis=1), starts)
    return bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares)


def epoch(bias: float, table: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rate: float, decay: float, seed: int) -> tuple[float, np.ndarray]:
    """Passes of stochastic gradient descent in small batches, ``STEPS`` steps or one pass at least."""
    table = table.copy()
    draw = np.random.default_rng(seed)
    times = max(1, -(-32 * STEPS // max(1, len(rows))))
    order = np.concatenate([draw.permutation(len(rows)) for _ in range(times)])
    for first in range(0, len(order), 32):
        part = order[first : first + 32]
        n = len(part)
        row = np.repeat(np.arange(n), [len(rows[i][0]) for i in part])
        feature = np.concatenate([rows[i][0] for i in part])
        value = np.concatenate([rows[i][1] for i in part])
        error = 1 / (1 + np.exp(-np.clip(margins(row, feature, value, n, bias, table), -30, 30))) - labels[part]
        entries = table[feature, 1:] * value[:, None]
        sums = np.add.reduceat(entries, np.searchsorted(row, np.arange(n)), axis=0)
        slope = np.empty((len(feature), table.shape[1]))
        slope[:, 0] = value
        slope[:, 1:] = value[:, None] * (sums[row] - entries)
        step = slope * error[row][:, None] + decay * table[feature]
        cells = feature[:, None] * table.shape[1] + np.arange(table.shape[1])
        np.add.at(table.reshape(-1), cells.ravel(), (-rate / np.sqrt(n) * step).ravel())
        bias -= rate * error.mean()
    return bias, table


FIT_ROW = "part int, label double, feature array<long>, value array<double>"


def _featurised(texts: DataFrame, n_meta: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = per_process("quality", "buckets", Buckets)
        for batch in small_parts(batches):
            meta = np.array([batch.column(f"_m{k}").to_pylist() for k in range(n_meta)], float).reshape(n_meta, -1).T
            for first, part in slices(batch.column("_text").to_pylist()):
                n = len(part)
                row, feature, value = features(part, meta[first : first + n], buckets)
                cuts = np.searchsorted(row, np.arange(1, n))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("part").slice(first, n),
                        batch.column("label").slice(first, n),
                        pa.array(np.split(feature, cuts), pa.list_(pa.int64())),
                        pa.array(np.split(value, cuts), pa.list_(pa.float64())),
                    ],
                    ["part", "label", "feature", "value"],
                )

    return texts.mapInArrow(run, FIT_ROW)


def _train(shared, rate: float, seed: int):
    def run(group):
        pairs = zip(group.column("feature").to_pylist(), group.column("value").to_pylist())
        rows = [(np.array(f, np.int64), np.array(v)) for f, v in pairs]
        bias, table = epoch(*shared.value, rows, group.column("label").to_numpy(), rate, 1e-5, seed)
        moved = table - shared.value[1]
        at = np.flatnonzero(np.abs(moved).sum(axis=1))
        return pa.table(
            {
                "n": pa.array([len(rows)], pa.int64()),
                "bias": pa.array([bias]),
                "at": pa.array([at], pa.list_(pa.int64())),
                "moved": pa.array([moved[at].ravel()], pa.list_(pa.float64())),
            }
        )

    return run


def fit(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, id_col: str, text_col: str, meta: list[str], max_rows: int, passes: int, parts: int) -> tuple[float, np.ndarray]:
    """Parameters fitted on about ``max_rows`` labelled rows, as many of either label where there are.

    The rows are those with the smallest hashes of their ids. The bias is set back to the shares of
    the labels among all rows that may be learnt from.
    """
    spark = docs.sparkSession
    table = np.random.default_rng(7).normal(0, 0.05, (n_features(len(meta)), 1 + RANK))
    table[:, 0] = 0
    known = labels.where(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("label"))
    counts = dict(map(tuple, known.groupBy("label").count().collect()))
    total = {k: counts.get(k, 0) for k in (0.0, 1.0)}
    base = np.log((total[1.0] + 0.5) / (total[0.0] + 0.5))
    if not counts:
        return base, table
    grain = 1 << 20
    share = {k: min(1.0, max_rows / 2 / max(n, 1)) for k, n in total.items()}
    place = F.pmod(F.xxhash64("_id"), F.lit(grain))
    chosen = known.where(place < F.when(F.col("label") == 1, int(share[1.0] * grain) + 1).otherwise(int(share[0.0] * grain) + 1))
    fields = [F.col(c).cast("double").alias(f"_m{k}") for k, c in enumerate(meta)]
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"), *fields)
    rows = texts.join(F.broadcast(chosen), "_id").withColumn("part", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(parts)).cast("int"))
    ready = materialise(_featurised(rows, len(meta)), "quality-features")

    seen = {k: total[k] * share[k] for k in total}
    bias = np.log((seen[1.0] + 0.5) / (seen[0.0] + 0.5))
    for k in range(passes):
        shared = spark.sparkContext.broadcast((bias, table))
        rate = 0.5 / (1 + 0.3 * k)

        results = ready.groupBy("part").applyInArrow(_train(shared, rate, k), "n long, bias double, at array<long>, moved array<double>").collect()  # one per part
        weight = sum(r.n for r in results)
        table = table.copy()
        bias = sum(r.bias * r.n for r in results) / weight if weight else bias
        for r in results:
            table[r["at"]] += np.reshape(r.moved, (-1, table.shape[1])) * (r.n / weight)
        shared.unpersist()
    return bias + base - np.log((seen[1.0] + 0.5) / (seen[0.0] + 0.5)), table


def _score(shared, n_meta: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = per_process("quality", "buckets", Buckets)
        bias, table = shared.value
        for batch in small_parts(batches):
            n_keep = batch.num_columns - n_meta - 1
            meta = np.array([batch.column(n_keep + k).to_pylist() for k in range(n_meta)], float).reshape(n_meta, -1).T
            score = np.zeros(batch.num_rows)
            for first, part in slices(batch.column(n_keep + n_meta).to_pylist()):
                n = len(part)
                margin = margins(*features(part, meta[first : first + n], buckets), n, bias, table)
                score[first : first + n] = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(score)], [*batch.schema.names[:n_keep], "score"])

    return run


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    keep: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    meta: tuple[str, ...] = ("n_chars",),
    max_rows: int = 6000,
    passes: int = 8,
    parts: int = 6,
) -> DataFrame:
    """``keep`` columns of every row with ``score``, the probability that its label is 1.

    Only labels of rows that ``learn`` admits (a condition on ``labels``; all by default) are learnt
    from; others than 0 and 1, and rows without an id, are left out. Repeated rows of ``labels``
    count again. ``meta`` are numeric columns of ``docs``. A null text is an empty one and scored
    by its other features. Without labels every score is near a half. A ``keep`` column named
    ``score`` is replaced.
    """
    learn = F.lit(True) if learn is None else learn
    meta = list(meta)
    model = fit(docs, labels, label_col, learn, id_col, text_col, meta, max_rows, passes, parts)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    fields = [F.col(c).cast("double").alias(free_name(f"_m{k}", keep)) for k, c in enumerate(meta)]
    rows = docs.select(*keep, *fields, F.coalesce(text_col, F.lit("")).alias(free_name("_text", keep)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(_score(shared, len(meta)), f"{schema}, score double")
