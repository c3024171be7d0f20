"""Accuracy, comparisons of runs, failure stages, latency summaries and resumable work lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import fixed
from folioscope.functions.mcq import answer_letter, answer_letter_robust, parse_options
from folioscope.functions.text import keywords, overlap
from folioscope.plans.scale import sized_join

LOW_OVERLAP = 1


def first_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in an explicit order."""
    return df.orderBy(*order).limit(n)


def judge(predictions: DataFrame, robust: bool = False) -> DataFrame:
    """Compare ``predicted_text`` with ``correct_answer`` as letters: adds ``predicted, correct, is_correct``."""
    if robust:
        valid = F.transform(parse_options(F.col("options")), lambda o: o["letter"])
        read = lambda c: answer_letter_robust(F.col(c), valid)
    else:
        read = lambda c: answer_letter(F.col(c))
    return (
        predictions.withColumn("predicted", read("predicted_text"))
        .withColumn("correct", read("correct_answer"))
        .withColumn("is_correct", F.col("predicted") == F.col("correct"))
    )


def _ratio(correct: Column, total: Column) -> Column:
    return F.when(total > 0, correct / total).otherwise(F.lit(0.0))


def accuracy(results: DataFrame) -> DataFrame:
    """One row ``n_correct, n_total, accuracy``; 0 for an empty input."""
    counts = results.agg(
        F.coalesce(F.sum(F.col("is_correct").cast("long")), F.lit(0)).alias("n_correct"), F.count(F.lit(1)).alias("n_total")
    )
    return counts.withColumn("accuracy", _ratio(F.col("n_correct"), F.col("n_total")))


def accuracy_by_subject(results: DataFrame) -> DataFrame:
    """Accuracy per subject and, under a null subject, overall; the totals come from the subject counts."""
    by_subject = results.groupBy("subject").agg(
        F.sum(F.col("is_correct").cast("long")).alias("c"), F.count(F.lit(1)).alias("t")
    )
    rolled = by_subject.rollup("subject").agg(F.sum("c").alias("n_correct"), F.sum("t").alias("n_total"))
    return rolled.withColumn("accuracy", _ratio(F.col("n_correct"), F.col("n_total")))


def latency_summary(timings: DataFrame) -> DataFrame:
    """``stage, min_s, avg_s, max_s`` over the questions that have the stage."""
    return timings.groupBy("stage").agg(
        F.min("seconds").alias("min_s"), F.avg("seconds").alias("avg_s"), F.max("seconds").alias("max_s")
    )


def last_timings(measured: DataFrame, order: Sequence[str]) -> DataFrame:
    """One time per question and stage: a later measurement of a stage replaces the earlier."""
    return measured.groupBy("question_id", "stage").agg(F.max_by("seconds", F.struct(*order)).alias("seconds"))


def total_time(timings: DataFrame, stages: Sequence[str]) -> DataFrame:
    """``question_id, total_s``: the sum of the given top-level stages of each question."""
    return (
        timings.where(F.col("stage").isin(*stages)).groupBy("question_id").agg(F.sum("seconds").alias("total_s"))
    )


def overlap_scores(candidates: DataFrame, target: str, text: str) -> DataFrame:
    """Add ``overlap``: keywords of ``text`` that also occur in ``target``."""
    return candidates.withColumn("overlap", overlap(keywords(F.col(text)), keywords(F.col(target))).cast("long"))


def failure_stage(candidates: DataFrame, final: DataFrame) -> DataFrame:
    """``query_id, best_id, best_overlap, stage``: which stage lost the best candidate.

    ``candidates`` has ``query_id, id, rank, overlap``. The best candidate has the
    largest overlap, the earliest of equals.
    """
    best = candidates.groupBy("query_id").agg(
        F.max_by(F.struct("id", "overlap"), F.struct(F.col("overlap"), -F.col("rank"))).alias("b")
    )
    best = best.select("query_id", F.col("b.id").alias("id"), F.col("b.overlap").alias("best_overlap"))
    kept = final.select("query_id", "id", F.lit(True).alias("_kept"))
    joined = best.join(kept, ["query_id", "id"], "left")
    stage = (
        F.when(F.col("best_overlap") <= LOW_OVERLAP, "retrieval_miss")
        .when(F.col("_kept").isNull(), "rerank_miss")
        .otherwise("reached_generation")
    )
    return joined.select("query_id", F.col("id").alias("best_id"), "best_overlap", stage.alias("stage"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys on which two result sets differ: ``key, predicted_a, predicted_b, correct_a, correct_b``."""
    left = a.select("key", F.col("predicted").alias("predicted_a"), F.col("is_correct").alias("correct_a"))
    right = b.select("key", F.col("predicted").alias("predicted_b"), F.col("is_correct").alias("correct_b"))
    return left.join(right, "key").where(F.col("predicted_a") != F.col("predicted_b"))


def rewrite_outcome(runs: DataFrame) -> DataFrame:
    """Add ``outcome`` to rows with ``correct, baseline, rewritten`` letters."""
    return runs.withColumn(
        "outcome",
        F.when(F.col("baseline") == F.col("correct"), "baseline_correct")
        .when(F.col("rewritten") == F.col("correct"), "flipped_to_correct")
        .otherwise("still_wrong"),
    )


def second_model_targets(spark) -> DataFrame:
    """The fixed list of ``test_key, id`` pairs for the second-model check."""
    return spark.createDataFrame(fixed.SECOND_MODEL_TARGETS, "test_key string, id long")


def select_targets(questions: DataFrame, targets: DataFrame, expected: int | None = None) -> DataFrame:
    """Questions on a target list; fails when their number is not ``expected``."""
    chosen = sized_join(questions, targets, ["test_key", "id"], "left_semi")
    if expected is not None and (found := chosen.limit(expected + 1).count()) != expected:
        raise ValueError(f"expected {expected} questions, found {found}")
    return chosen


def remaining(work: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Work whose key has no result yet."""
    return sized_join(work, done.select(key).distinct(), [key], "left_anti")
