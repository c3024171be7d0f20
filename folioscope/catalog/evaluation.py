"""Evaluation queries: labels stand for outcomes of questions, events for stage timings."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog import sql
from folioscope.catalog.ranking import HYBRID_SQL, candidates, final
from folioscope.catalog.registry import query, table
from folioscope.operators import evaluation

RESULTS_SQL = """results AS (SELECT d.doc_id, d.lang AS subject, quality = toxic AS is_correct
                 FROM labels JOIN documents d USING (doc_id))"""


def results(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("subject"))
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", "subject", (F.col("quality") == F.col("toxic")).alias("is_correct")
    )


@query(
    "accuracy_first_n",
    f"""WITH {RESULTS_SQL}, s AS (SELECT * FROM results ORDER BY doc_id LIMIT 50)
        SELECT coalesce(sum(is_correct::BIGINT), 0)::BIGINT AS n_correct, count(*) AS n_total, round(coalesce(avg(is_correct::INT), 0), 9) AS accuracy FROM s""",
)
def accuracy_first_n(spark, sf):
    sample = evaluation.first_n(results(spark, sf), 50, ["doc_id"])
    return evaluation.accuracy(sample).withColumn("accuracy", F.round("accuracy", 9))


@query(
    "accuracy_by_subject",
    f"""WITH {RESULTS_SQL} SELECT subject, sum(is_correct::BIGINT)::BIGINT AS n_correct, count(*) AS n_total,
            round(avg(is_correct::INT), 9) AS accuracy FROM results GROUP BY ROLLUP (subject)""",
)
def accuracy_by_subject(spark, sf):
    return evaluation.accuracy_by_subject(results(spark, sf)).withColumn("accuracy", F.round("accuracy", 9))


@query(
    "answer_judgement",
    """SELECT doc_id, upper(left(p, 1)) AS predicted, upper(left(c, 1)) AS correct, upper(left(p, 1)) = upper(left(c, 1)) AS is_correct
       FROM (SELECT doc_id, ['A) yes', ' b. no', 'c', ''][1 + (doc_id % 4)] AS p0, trim(p0) AS p,
                    CASE WHEN quality = 1 THEN 'A. yes' ELSE 'B. no' END AS c FROM labels)""",
)
def answer_judgement(spark, sf):
    said = F.element_at(F.array(*map(F.lit, ["A) yes", " b. no", "c", ""])), (F.col("doc_id") % 4 + 1).cast("int"))
    gold = F.when(F.col("quality") == 1, "A. yes").otherwise("B. no")
    rows = table(spark, sf, "labels").select("doc_id", said.alias("predicted_text"), gold.alias("correct_answer"))
    return evaluation.judge(rows).select("doc_id", "predicted", "correct", "is_correct")


def measured(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("question_id"), F.col("event_type").alias("stage"), F.col("value").alias("seconds"), "ts", "event_id"
    )


@query(
    "latency_summary",
    "SELECT event_type AS stage, min(value) AS min_s, round(avg(value), 6) AS avg_s, max(value) AS max_s FROM events GROUP BY 1",
)
def latency_summary(spark, sf):
    return evaluation.latency_summary(measured(spark, sf)).withColumn("avg_s", F.round("avg_s", 6))


LAST_SQL = """last AS (SELECT user_id AS question_id, event_type AS stage, arg_max(value, (ts, event_id)) AS seconds FROM events GROUP BY ALL)"""


@query("latest_timings", f"WITH {LAST_SQL} SELECT * FROM last")
def latest_timings(spark, sf):
    return evaluation.last_timings(measured(spark, sf), ["ts", "event_id"])


@query(
    "total_time_per_question",
    f"WITH {LAST_SQL} SELECT question_id, round(sum(seconds), 6) AS total_s FROM last WHERE stage IN ('view', 'click', 'purchase') GROUP BY 1",
)
def total_time_per_question(spark, sf):
    last = evaluation.last_timings(measured(spark, sf), ["ts", "event_id"])
    return evaluation.total_time(last, ["view", "click", "purchase"]).withColumn("total_s", F.round("total_s", 6))


@query(
    "keyword_overlap",
    f"""SELECT doc_id, len({sql.keywords('text')})::BIGINT AS n_keywords,
               len(list_intersect({sql.keywords('text')}, {sql.keywords("source || ' the and tion ment with auf les that'")}))::BIGINT AS overlap FROM documents""",
)
def keyword_overlap(spark, sf):
    from folioscope.functions.text import keywords

    target = F.concat("source", F.lit(" the and tion ment with auf les that"))
    docs = table(spark, sf, "documents").withColumn("target", target)
    scored = evaluation.overlap_scores(docs, "target", "text")
    return scored.select("doc_id", F.size(keywords(F.col("text"))).cast("long").alias("n_keywords"), "overlap")


@query(
    "failure_stage",
    f"""WITH {HYBRID_SQL},
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank) = 1)
        SELECT b.query_id, b.id AS best_id, b.overlap::BIGINT AS best_overlap,
               CASE WHEN b.overlap <= 1 THEN 'retrieval_miss' WHEN f.id IS NULL THEN 'rerank_miss' ELSE 'reached_generation' END AS stage
        FROM best b LEFT JOIN fin f USING (query_id, id)""",
)
def failure_stage(spark, sf):
    scored = evaluation.overlap_scores(candidates(spark, sf), "question", "text")
    return evaluation.failure_stage(scored, final(spark, sf))


RUN_SQL = "(SELECT doc_id AS key, CASE WHEN {0} = 1 THEN 'A' ELSE 'B' END AS predicted, {0} = quality AS is_correct FROM labels)"


def _run(spark, sf, column):
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("key"),
        F.when(F.col(column) == 1, "A").otherwise("B").alias("predicted"),
        (F.col(column) == F.col("quality")).alias("is_correct"),
    )


@query(
    "run_differences",
    f"""SELECT key, a.predicted AS predicted_a, b.predicted AS predicted_b, a.is_correct AS correct_a, b.is_correct AS correct_b
        FROM {RUN_SQL.format('quality')} a JOIN {RUN_SQL.format('toxic')} b USING (key) WHERE a.predicted <> b.predicted""",
)
def run_differences(spark, sf):
    return evaluation.compare_runs(_run(spark, sf, "quality"), _run(spark, sf, "toxic"))


@query(
    "rewrite_outcomes",
    """SELECT CASE WHEN toxic = quality THEN 'baseline_correct' WHEN doc_id % 2 = quality THEN 'flipped_to_correct' ELSE 'still_wrong' END AS outcome,
              count(*) AS n FROM labels GROUP BY 1""",
)
def rewrite_outcomes(spark, sf):
    runs = table(spark, sf, "labels").select(
        F.col("quality").alias("correct"), F.col("toxic").alias("baseline"), (F.col("doc_id") % 2).cast("int").alias("rewritten")
    )
    return evaluation.rewrite_outcome(runs).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _targets_sql() -> str:
    from folioscope.functions.fixed import SECOND_MODEL_TARGETS

    return ", ".join(f"('{t}', {i})" for t, i in SECOND_MODEL_TARGETS)


@query(
    "target_subset",
    f"""WITH q AS (SELECT 'test' || (1 + doc_id % 3) AS test_key, doc_id // 3 AS id, lang AS subject FROM documents)
        SELECT * FROM q WHERE (test_key, id) IN (VALUES {_targets_sql()})""",
)
def target_subset(spark, sf):
    asked = table(spark, sf, "documents").select(
        F.concat(F.lit("test"), (F.col("doc_id") % 3 + 1).cast("string")).alias("test_key"),
        F.expr("doc_id div 3").alias("id"),
        F.col("lang").alias("subject"),
    )
    return evaluation.select_targets(asked, evaluation.second_model_targets(spark), 27)


@query("resume_remaining", "SELECT doc_id AS key, lang AS subject FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark, sf):
    work = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("subject"))
    return evaluation.remaining(work, table(spark, sf, "labels").select(F.col("doc_id").alias("key")))
