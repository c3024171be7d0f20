"""Mixing to target weights by soft membership, in DataFrame operations alone.

A classifier fitted on a labelled table gives every document a posterior over domains. Then every
document gets a nonnegative rate so that the expected tokens of each domain come as near to their
targets as least squares allows. One step of projected gradient needs one number per domain from
all documents, and a document's rate follows from those numbers; so a step is one aggregation over a
narrow table and nothing else is kept between steps. Where those steps do not get to the targets, damped
Newton steps on one price per domain do, with as many numbers as there are pairs of domains.
"""

from __future__ import annotations

import json
import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.plans.scale import materialise

LOG = logging.getLogger(__name__)
RIDGE = 1e-8
"""Weight of the prices against the targets; it keeps prices finite where the targets cannot be met."""
MOST_NEWTON = 200
BUCKETS = 4096
"""Buckets of hashed words; number 0 is for the empty string between two spaces."""


def words_of(text: Column) -> Column:
    """The pieces between spaces and line ends, lower-cased; empty strings stand for repeated ones."""
    for space in ("\n", "\t", "\r"):
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.split(F.lower(F.coalesce(text, F.lit(""))), " ")


def bucket_of(word: Column) -> Column:
    return F.when(word == "", 0).otherwise(F.pmod(F.xxhash64(word), F.lit(BUCKETS - 1)) + 1).cast("int")


def label_domain() -> Column:
    """Domain of a row of the labelled table; null (not learnt from) where a label is missing."""
    return F.when(F.col("toxic") == 1, "toxic").when((F.col("toxic") == 0) & (F.col("quality") == 1), "good").when((F.col("toxic") == 0) & (F.col("quality") == 0), "poor")


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], id_col: str, text_col: str, max_rows: int) -> tuple[list[list[float]], list[float]]:
    """Log weight of every bucket by domain, and the log share of each domain.

    Words are counted in about ``max_rows`` labelled rows, as many of each domain where there are: those with
    the smallest hashes of their ids. Shares are counted over all labelled rows.
    """
    known = labels.select(F.col(id_col).alias("_id"), domain.alias("_domain")).where(F.col("_domain").isin(domains) & F.col("_id").isNotNull())
    counts = dict(map(tuple, known.groupBy("_domain").count().collect()))  # one row per domain
    grain = 1 << 20
    limit = F.lit(0)
    for name, n in counts.items():
        limit = F.when(F.col("_domain") == name, int(min(1, max_rows / len(domains) / n) * grain) + 1).otherwise(limit)
    chosen = known.where(F.pmod(F.xxhash64("_id"), F.lit(grain)) < limit)
    words = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    words = words.select("_domain", F.explode(words_of(F.col("_text"))).alias("word"))
    uses = words.groupBy("_domain", bucket_of(F.col("word")).alias("bucket")).count().where("bucket > 0").collect()  # BUCKETS per domain at most
    weights = [[0.5] * BUCKETS for _ in domains]
    for row in uses:
        weights[domains.index(row["_domain"])][row.bucket] += row["count"]
    for k, row in enumerate(weights):
        row[0] = 0.0
        total = sum(row)
        weights[k] = [0.0] + [math.log(x / total) for x in row[1:]]
    total = sum(counts.values()) + len(domains)
    return weights, [math.log((counts.get(d, 0) + 1) / total) for d in domains]


RESULTS = ("n_tokens", "posterior", "rate", "copies")


def memberships(docs: DataFrame, weights: list[list[float]], shares: list[float], text: Column, keep: list[str], sharpness: float) -> DataFrame:
    """``keep`` columns with ``n_tokens`` and ``posterior``, from the mean log weights of the words.

    The sums, the scores and their exponentials pass through the name ``rate``, which no input column has.
    """
    k = range(len(shares))
    tables = [F.from_json(F.lit(json.dumps(row)), "array<double>") for row in weights]
    zero = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(f"s{i}") for i in k])

    def add(acc: Column, bucket: Column) -> Column:
        return F.struct((acc["n"] + F.when(bucket > 0, 1).otherwise(0)).alias("n"), *[(acc[f"s{i}"] + F.get(tables[i], bucket)).alias(f"s{i}") for i in k])

    summed = docs.select(*keep, F.aggregate(F.transform(words_of(text), bucket_of), zero, add).alias("rate"))
    n = F.greatest(F.col("rate.n"), F.lit(1))
    scores = F.array(*[F.col(f"rate.s{i}") / n * sharpness + shares[i] for i in k])
    scored = summed.select(*keep, F.col("rate.n").alias("n_tokens"), scores.alias("rate"))
    raised = scored.select(*keep, "n_tokens", F.transform("rate", lambda s: F.exp(s - F.array_max("rate"))).alias("rate"))
    total = F.aggregate("rate", F.lit(0.0), lambda a, x: a + x)
    return raised.select(*keep, "n_tokens", F.transform("rate", lambda x: x / total).alias("posterior"))


def rate_after(steps: list[list[float]], least: float) -> Column:
    """A document's rate after projected gradient steps: from 1, against the error of its domains, never below ``least``."""
    rate = F.lit(1.0)
    for errors in steps:
        rate = F.greatest(F.lit(least), rate - sum((F.get("posterior", F.lit(i)) * e for i, e in enumerate(errors)), F.lit(0.0)))
    return rate


def rate_at(prices: list[float], least: float) -> Column:
    """The rates nearest to 1 (in squares, by tokens) for the totals that they give: 1 less the price of a document's domains."""
    return F.greatest(F.lit(least), F.lit(1.0) - sum((F.get("posterior", F.lit(i)) * float(x) for i, x in enumerate(prices)), F.lit(0.0)))


def near(totals: np.ndarray, wanted: np.ndarray, tolerance: float) -> bool:
    return bool((np.abs(totals - wanted) <= tolerance * np.maximum(wanted, 1.0)).all())


def settle(soft: DataFrame, base: np.ndarray, weights: np.ndarray, budget: float | None, least: float, tolerance: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Prices by domain, the totals at their rates, and whether the totals are as near to the targets as can be.

    The prices maximise the dual of the least squares, a concave function. A step is damped by the domains' tokens,
    which bound the curvature, so that a fully damped step always gains; damping falls while steps gain. Without a ``budget``
    the totals only have to be in the proportion of ``weights``, and prices stay orthogonal to those.
    """
    k, whole = range(len(base)), base.sum()
    free = np.linalg.svd(weights[None])[2][1:].T if budget is None else np.eye(len(base))

    def at(prices: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        p, n = [F.get("posterior", F.lit(i)) for i in k], F.col("n_tokens")
        rated = soft.select("n_tokens", "posterior", rate_at(list(prices), least).alias("rate"))
        rate = F.col("rate")
        cost = sum((p[i] * float(x) for i, x in enumerate(prices)), F.lit(0.0))
        curved = [F.sum(F.when(rate > least, n * p[i] * p[j]).otherwise(0.0)) for i in k for j in k]
        found = rated.agg(F.sum(n * ((rate - 1) * (rate - 1) / 2 + rate * cost)), *[F.sum(n * p[i] * rate) for i in k], *curved).first()
        found = np.array(found, float) / whole
        wanted = 0.0 if budget is None else budget * weights
        gain = found[0] - prices @ (wanted + RIDGE / 2 * base / whole * prices)
        slope = found[1 : 1 + len(base)] - wanted - RIDGE * base / whole * prices
        return gain, free.T @ slope, found

    prices, damping = np.zeros(len(base)), 1.0
    scale = np.diag(np.maximum(base / whole, 1e-12))
    gain, slope, found = at(prices)
    for _ in range(MOST_NEWTON):
        totals = found[1 : 1 + len(base)] * whole
        if near(totals, weights * (totals.sum() if budget is None else budget * whole), tolerance):
            return prices, totals, True
        curved = found[1 + len(base) :].reshape(len(base), -1)
        step = np.linalg.solve(free.T @ (curved + max(damping, RIDGE) * scale) @ free, slope)
        if slope @ step <= 1e-13 * max(1.0, abs(gain)) and damping <= RIDGE:
            return prices, totals, True
        tried = prices + free @ step
        after = at(tried)
        if after[0] >= gain:
            prices, (gain, slope, found), damping = tried, after, max(damping / 10, RIDGE)
        elif damping >= 1.0:
            return prices, totals, True  # a step that must gain loses to rounding
        else:
            damping = min(1.0, damping * 10)
    return prices, found[1 : 1 + len(base)] * whole, False


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float],
    domain: Column | None = None,
    keep: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    budget: float | None = 1.0,
    least_rate: float = 0.0,
    max_rows: int = 6000,
    sharpness: float = 40.0,
    tolerance: float = 0.001,
    max_steps: int = 40,
) -> DataFrame:
    """``keep`` columns (all by default) of every row of ``docs`` with ``n_tokens``, ``posterior``, ``rate`` and ``copies``.

    ``targets`` are weights by domain; the wanted tokens are ``budget`` times all tokens. Without a budget, rates are those
    nearest to 1 that give the tokens the proportion of the targets, however many they are; if none do, or if that takes more than
    twice the tokens at which the most over-represented domain has its target at rate 1, those tokens are the budget. Totals that
    stay off the targets are logged as a warning. ``max_steps`` bounds the gradient steps, not those after them. ``domain`` names the domain
    of a row of ``labels``; rows without one, or without an id, are not learnt from, and repeated rows count
    again. ``posterior`` is an array in the order of the sorted domain names. ``copies`` is the rate, rounded up or down by a fixed
    hash of the id and text, so that its expectation is the rate. Null and empty texts have the shares of the labels as posterior
    and no tokens. Input columns of these names are replaced. The posteriors are stored once. An empty table gives no rows.
    """
    domains = sorted(targets)
    model = fit_domains(docs, labels, label_domain() if domain is None else domain, domains, id_col, text_col, max_rows)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.select(*keep, F.col(text_col).alias("posterior"), draw.alias("copies"))
    soft = materialise(memberships(rows, *model, F.col("posterior"), [*keep, "copies"], sharpness), "memberships")

    def totals(rate: Column) -> list[float]:
        """Expected tokens of each domain."""
        found = soft.agg(*[F.sum(F.col("n_tokens") * F.get("posterior", F.lit(i)) * rate) for i in range(len(domains))]).first()
        return [x or 0.0 for x in found]

    base = totals(F.lit(1.0))
    whole = sum(targets.values())
    weights = np.array([targets[d] / whole for d in domains])
    steps: list[list[float]] = []
    rate, now, settled = F.lit(1.0), np.array(base), True
    if budget is None and sum(base) > 0:
        prices, now, _ = settle(soft, np.array(base), weights, None, least_rate, tolerance)
        rate = rate_at(list(prices), least_rate)
        budget = float(max(b / sum(base) / w for b, w in zip(base, weights) if w > 0))
        if near(now, weights * now.sum(), tolerance) and now.sum() <= 2 * budget * sum(base):
            budget = now.sum() / sum(base)
        else:
            rate, now = F.lit(1.0), np.array(base)
    wanted = weights * (1.0 if budget is None else budget) * sum(base)
    while len(steps) < max_steps and sum(base) > 0:
        if near(now, wanted, tolerance):
            break
        # errors count relative to a domain's tokens; with that the largest curvature is 1, so full steps converge
        steps.append([(a - b) / max(s, 1e-9) for a, b, s in zip(now, wanted, base)])
        rate = rate_after(steps, least_rate)
        before, now = now, np.array(totals(rate))
        if near(now, before, 1e-6):
            break  # as near as rates of at least ``least_rate`` come, or creeping
    if not near(now, wanted, tolerance):
        prices, now, settled = settle(soft, np.array(base), weights, budget, least_rate, tolerance)
        rate = rate_at(list(prices), least_rate)
    if not near(now, wanted, tolerance):
        how = "the nearest that rates allow" if settled else "steps did not settle"
        LOG.warning("mixing: tokens %s for wanted %s (%s; %s)", now.tolist(), wanted.tolist(), domains, how)
    rated = soft.withColumn("rate", rate)
    return rated.select(*keep, "n_tokens", "posterior", "rate", F.floor(F.col("rate") + F.col("copies")).cast("int").alias("copies"))
