"""The composed jobs: build a corpus from books, answer a set of questions, and resume a long run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.mcq import parse_options
from folioscope.operators import evaluation, fusion, generation
from folioscope.operators.chunking import attach_ids, chunk_books, drop_short, first_of_each_id
from folioscope.operators.lexical import LexicalIndex, build_index
from folioscope.operators.vectors import HashingEncoder, embed_queries
from folioscope.plans.scale import materialise, running_sum
from folioscope.plans.timing import Stopwatch, timed
from folioscope.sources.collection import Collection
from folioscope.sources.files import append_results, read_results

ARM_FACTOR = 4


def number_rows(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Add the dense position of each row in ``order``, counted from 0 over the whole table.

    Rows are range-sorted, so that no group is in one task; the sorted rows are
    written out because their provisional numbers must not be drawn twice.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_rough", F.monotonically_increasing_id())
    return running_sum(materialise(ordered, "numbered"), [], "_rough", F.lit(1), name).drop("_rough")


@dataclass(frozen=True)
class Corpus:
    """Stored chunks with their lexical index and vector collection."""

    chunks: DataFrame
    index: LexicalIndex
    collection: Collection

    @staticmethod
    def build(books: DataFrame, path: str, make_model: Callable = HashingEncoder, **chunking) -> Corpus:
        """Chunk, identify, filter and number the books, then index and embed them below ``path``.

        Copies of a chunk are kept once, at their first position.
        """
        spark = books.sparkSession
        chunks = drop_short(attach_ids(chunk_books(books, **chunking)))
        chunks = first_of_each_id(chunks, ["book_id", "chunk_ix"])
        number_rows(chunks, ["book_id", "chunk_ix"]).write.parquet(f"{path}/chunks")
        stored = spark.read.parquet(f"{path}/chunks")
        build_index(stored, "chunk_id", "pos", "text", "subject").save(f"{path}/index")
        Collection(spark, f"{path}/vectors").add_texts(stored, make_model)
        return Corpus.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Corpus:
        return Corpus(
            spark.read.parquet(f"{path}/chunks"), LexicalIndex.load(spark, f"{path}/index"), Collection(spark, f"{path}/vectors")
        )


def retrieve(
    corpus: Corpus,
    questions: DataFrame,
    k: int = 5,
    make_model: Callable = HashingEncoder,
    scorer: Callable = fusion.overlap_scorer,
    watch: Stopwatch | None = None,
) -> DataFrame:
    """Final passages of each question: hybrid candidates, four times ``k``, reranked to ``k``.

    ``questions`` has ``query_id, question, subject`` and may have
    ``retrieval_text``, which is searched with instead of the question.
    """
    wording = F.coalesce("retrieval_text", "question") if "retrieval_text" in questions.columns else F.col("question")
    asked = embed_queries(questions.select("query_id", "subject", wording.alias("text")), "text", make_model)
    vectors = corpus.collection.read().select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vector"), F.col("subject").alias("scope"))
    with timed(watch, "run", "retrieval"):
        fused = fusion.hybrid(corpus.index, vectors, asked, k * ARM_FACTOR).select("query_id", "id", "rank")
        fused = materialise(fused.join(asked.select("query_id", F.col("text").alias("question")), "query_id"), "fused")
        passages = corpus.chunks.select(F.col("chunk_id").alias("id"), *[c for c in ("text", "subject", "chapter") if c in corpus.chunks.columns])
        candidates = materialise(fusion.with_texts(fused, passages), "candidates")
    with timed(watch, "run", "rerank"):
        return materialise(fusion.rerank(candidates, k, scorer), "final")


def answer_choices(
    corpus: Corpus,
    questions: DataFrame,
    make_generator: Callable,
    k: int = 5,
    robust: bool = True,
    watch: Stopwatch | None = None,
    **retrieval,
) -> DataFrame:
    """Judged results of multiple-choice questions, in the layout of stored results.

    ``questions`` has ``key, question, subject, options`` (texts) and ``correct_answer``.
    """
    asked = questions.withColumnRenamed("key", "query_id")
    final = retrieve(corpus, asked, k, watch=watch, **retrieval)
    parsed = asked.withColumn("raw_options", F.col("options")).withColumn("options", parse_options(F.col("options")))
    prompted = generation.choice_prompts(parsed, generation.ranked_context(final))
    answered = generation.generate(prompted, make_generator).withColumnRenamed("answer", "predicted_text")
    judged = evaluation.judge(answered.withColumn("options", F.col("raw_options")), robust)
    return judged.select(F.col("query_id").alias("key"), "subject", "question", "correct", "predicted", "is_correct")


class QuotaReached(Exception):
    """Raised by a text model whose quota is used up."""


def run_resumable(work: DataFrame, path: str, run: Callable[[DataFrame], DataFrame], parts: int = 16) -> bool:
    """Run what has no stored result yet, part by part, and store each part; True when all is done.

    A used-up quota stops the run and keeps what is stored, so that the next call goes on from there.
    """
    spark = work.sparkSession
    part = F.pmod(F.xxhash64("key"), F.lit(parts))
    for p in range(parts):
        todo = evaluation.remaining(work.where(part == p), read_results(spark, path))
        if todo.isEmpty():
            continue
        try:
            append_results(run(todo), path)
        except PythonException as error:
            if QuotaReached.__name__ not in str(error):
                raise
            return False
    return True
