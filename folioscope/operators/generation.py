"""Prompts over ranked passages and calls to a text model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import prompts


def ranked_context(final: DataFrame) -> DataFrame:
    """``query_id, texts, top_chapter`` of a reranked list.

    A query has at most the ``k`` passages of its final list, so the array is short.
    """
    top = F.max(F.when(F.col("final_rank") == 1, F.col("chapter"))) if "chapter" in final.columns else F.lit(None)
    grouped = final.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("final_rank", "text"))).alias("_ranked"), top.cast("string").alias("top_chapter")
    )
    return grouped.select("query_id", F.transform("_ranked", lambda r: r["text"]).alias("texts"), "top_chapter")


def open_prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Adds ``prompt`` for open questions (``query_id, question``)."""
    return _with_context(questions, contexts).withColumn("prompt", prompts.answer_prompt(F.col("question"), F.col("texts")))


def choice_prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Adds ``prompt`` for multiple-choice questions (``query_id, question, options`` as parsed options)."""
    return _with_context(questions, contexts).withColumn(
        "prompt", prompts.choice_prompt(F.col("question"), F.col("options"), F.col("texts"))
    )


def _with_context(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return questions.join(contexts, "query_id", "left").withColumn("texts", F.coalesce("texts", none))


@dataclass(frozen=True)
class Retry:
    """Repeat a call that fails to connect; other errors are raised at once."""

    attempts: int = 3
    wait_seconds: float = 5.0
    errors: tuple[type[Exception], ...] = (ConnectionError,)

    def call(self, fn: Callable[[str], str], prompt: str) -> str:
        for left in range(self.attempts - 1, -1, -1):
            try:
                return fn(prompt)
            except self.errors:
                if not left:
                    raise
                time.sleep(self.wait_seconds)
        raise ValueError("attempts must be positive")


def generate(df: DataFrame, make_model: Callable[[], Callable[[str], str]], retry: Retry = Retry()) -> DataFrame:
    """Add ``answer`` to rows with a ``prompt``.

    ``make_model`` runs once per task and returns a function from prompt to text.
    """

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for batch in batches:
            yield batch.map(lambda prompt: retry.call(model, prompt))

    return df.withColumn("answer", answer("prompt"))


def first_option_model() -> Callable[[str], str]:
    """Offline stand-in for a text model: answers with the first letter offered."""
    return lambda prompt: "A"


def cite(answers: DataFrame) -> DataFrame:
    """Add the chapter of the top passage to ``answer``."""
    return answers.withColumn("answer", prompts.with_citation(F.col("answer"), F.col("top_chapter")))


def rewrite(questions: DataFrame, make_model: Callable[[], Callable[[str], str]], retry: Retry = Retry()) -> DataFrame:
    """Add ``retrieval_text``, the model's fuller wording; ``question`` stays as it is for the answer."""
    asked = questions.withColumn("prompt", prompts.rewrite_prompt(F.col("question")))
    return generate(asked, make_model, retry).withColumnRenamed("answer", "retrieval_text").drop("prompt")
