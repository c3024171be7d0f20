"""Prompt queries over the reranked passages of the benchmark questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog.ranking import HYBRID_SQL, final
from folioscope.catalog.registry import query, table
from folioscope.functions import fixed, prompts
from folioscope.operators import generation

_FIXED_OPTIONS = [("A", "true"), ("B", "false"), ("C", "both"), ("D", "none")]


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CONTEXT_SQL = f"""WITH {HYBRID_SQL},
    ctx AS (SELECT query_id, string_agg(text, E'\\n\\n' ORDER BY final_rank) AS context,
                   max(chapter) FILTER (WHERE final_rank = 1) AS top_chapter FROM fin GROUP BY query_id),
    asked AS (SELECT item_id AS query_id, text AS question, coalesce(context, '') AS context, top_chapter
              FROM benchmark LEFT JOIN ctx ON query_id = item_id)"""


def asked(spark, sf):
    options = F.array(*[F.struct(F.lit(a).alias("letter"), F.lit(b).alias("text")) for a, b in _FIXED_OPTIONS])
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question"), options.alias("options")
    )


def _report(prompted):
    return prompted.select("query_id", F.length("prompt").cast("long").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


@query(
    "prompt_open",
    f"""{CONTEXT_SQL}, p AS (SELECT query_id, {_q(fixed.ANSWER_PROMPT_HEAD)} || context || {_q(fixed.ANSWER_PROMPT_QUESTION)}
            || question || {_q(fixed.ANSWER_PROMPT_TAIL)} AS prompt FROM asked)
        SELECT query_id, length(prompt)::BIGINT AS n_chars, md5(prompt) AS prompt_md5 FROM p""",
)
def prompt_open(spark, sf):
    return _report(generation.open_prompts(asked(spark, sf), generation.ranked_context(final(spark, sf))))


@query(
    "prompt_choice",
    f"""{CONTEXT_SQL}, p AS (SELECT query_id, {_q(fixed.CHOICE_PROMPT_HEAD)} || context || {_q(fixed.CHOICE_PROMPT_QUESTION)} || question
            || {_q(fixed.CHOICE_PROMPT_OPTIONS)} || E'A. true\\nB. false\\nC. both\\nD. none' || {_q(fixed.CHOICE_PROMPT_TAIL)} AS prompt FROM asked)
        SELECT query_id, length(prompt)::BIGINT AS n_chars, md5(prompt) AS prompt_md5 FROM p""",
)
def prompt_choice(spark, sf):
    return _report(generation.choice_prompts(asked(spark, sf), generation.ranked_context(final(spark, sf))))


@query(
    "answer_with_citation",
    f"""{CONTEXT_SQL} SELECT query_id, CASE WHEN top_chapter IS NOT NULL THEN E'A\\n\\nSource: ' || top_chapter ELSE 'A' END AS answer FROM asked""",
)
def answer_with_citation(spark, sf):
    prompted = generation.open_prompts(asked(spark, sf), generation.ranked_context(final(spark, sf)))
    answered = generation.generate(prompted, generation.first_option_model)
    return generation.cite(answered).select("query_id", "answer")


@query(
    "citation_rule",
    """SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1, 2) THEN 'see' ELSE E'see\n\nSource: ' || source END AS answer FROM documents""",
)
def citation_rule(spark, sf):
    n = F.col("doc_id") % 4
    chapter = F.when(n == 0, fixed.UNKNOWN_CHAPTER).when(n == 1, fixed.FRONT_MATTER).when(n == 3, F.col("source"))
    return table(spark, sf, "documents").select("doc_id", prompts.with_citation(F.lit("see"), chapter).alias("answer"))


@query(
    "rewrite_prompts",
    f"""SELECT item_id, md5({_q(fixed.REWRITE_PROMPT_HEAD)} || text || {_q(fixed.REWRITE_PROMPT_TAIL)}) AS prompt_md5,
               md5({_q(fixed.QUERY_PREFIX)} || text) AS query_md5 FROM benchmark""",
)
def rewrite_prompts(spark, sf):
    return table(spark, sf, "benchmark").select(
        "item_id",
        F.md5(prompts.rewrite_prompt(F.col("text"))).alias("prompt_md5"),
        F.md5(prompts.query_text(F.col("text"))).alias("query_md5"),
    )
