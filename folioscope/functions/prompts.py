"""Prompt texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import fixed


def context(texts: Column) -> Column:
    """Passages in rank order, with a blank line between them."""
    return F.array_join(texts, "\n\n", "")


def answer_prompt(question: Column, texts: Column) -> Column:
    """Open question over the passages."""
    return F.concat(
        F.lit(fixed.ANSWER_PROMPT_HEAD),
        context(texts),
        F.lit(fixed.ANSWER_PROMPT_QUESTION),
        question,
        F.lit(fixed.ANSWER_PROMPT_TAIL),
    )


def option_lines(options: Column) -> Column:
    """``A. text`` lines of parsed options."""
    return F.array_join(F.transform(options, lambda o: F.concat(o["letter"], F.lit(". "), o["text"])), "\n")


def choice_prompt(question: Column, options: Column, texts: Column) -> Column:
    """Multiple-choice question over the passages."""
    return F.concat(
        F.lit(fixed.CHOICE_PROMPT_HEAD),
        context(texts),
        F.lit(fixed.CHOICE_PROMPT_QUESTION),
        question,
        F.lit(fixed.CHOICE_PROMPT_OPTIONS),
        option_lines(options),
        F.lit(fixed.CHOICE_PROMPT_TAIL),
    )


def rewrite_prompt(question: Column) -> Column:
    """Ask for a fuller wording of a terse question."""
    return F.concat(F.lit(fixed.REWRITE_PROMPT_HEAD), question, F.lit(fixed.REWRITE_PROMPT_TAIL))


def query_text(question: Column, prefix: str = fixed.QUERY_PREFIX) -> Column:
    """Text handed to the embedding model on the query side."""
    return F.concat(F.lit(prefix), question)


def with_citation(answer: Column, chapter: Column) -> Column:
    """Append the chapter of the top passage unless it cannot be cited."""
    citable = chapter.isNotNull() & (chapter != "") & ~chapter.isin(fixed.UNKNOWN_CHAPTER, fixed.FRONT_MATTER)
    return F.when(citable, F.concat(answer, F.lit(fixed.CITATION_LEAD), chapter)).otherwise(answer)
