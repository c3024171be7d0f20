"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``, which are its predecessor's result
stored as Parquet. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.jaccard import similar_documents
from folioscope.llm.langid import UNKNOWN, identify
from folioscope.llm.line_dedup import dedup_lines
from folioscope.llm.mixing import mix
from folioscope.llm.packing import pieces_of, place
from folioscope.plans.scale import materialise

TARGETS = {"good": 0.85, "poor": 0.10, "toxic": 0.05}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, for which no language can be told, go; null texts are such. Labels are not needed for that."""
    return identify(docs, unlearnt="any").where(F.col("lang_pred") != UNKNOWN).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines go, and with them documents that had nothing else but blanks; ``n_chars`` follows the text."""
    cleaned = dedup_lines(docs)
    emptied = (F.col("n_dropped") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.where(~emptied).withColumn("n_chars", n_chars).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar rows one with the smallest id stays; rows without an id or without words stay.

    Rows are told apart by id and text, so that each text of a repeated id is judged alone. Of several texts of the
    smallest id the one with the smallest hash stays, and of rows with equal id and text the first by the other columns.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("whole"), F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")).alias("row"), "doc_id", "text")
    found = similar_documents(keyed, id_col="row", n=5, percent=80).where("doc_id is not null and n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias("row")).agg(F.first("component_id").alias("component"), F.count(F.lit(1)).alias("rows"))
    found = materialise(found.join(keyed.select("row", "doc_id").dropDuplicates(["row"]), "row"), "similar-rows")
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    judged = found.join(first, "component").select("row", "rows", (F.struct("doc_id", "row") == F.col("first")).alias("stays"))
    judged = materialise(judged.where("rows > 1 or not stays"), "near-duplicates")
    kept = keyed.join(judged.where("not stays").select("row"), "row", "left_anti")
    repeated = judged.where("stays").select("row")
    if repeated.isEmpty():
        return kept.select("whole.*")
    place = F.row_number().over(Window.partitionBy("row", "doc_id", "text").orderBy("whole"))
    one = kept.join(repeated, "row", "left_semi").withColumn("place", place).where("place = 1")
    return kept.join(repeated, "row", "left_anti").select("whole.*").union(one.select("whole.*"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated until the domains have their target shares of the tokens; every document comes at least once."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mixed = mix(docs, labels, TARGETS, budget=None, least_rate=1.0)
    return mixed.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in the sequences."""
    pieces = pieces_of(docs, end_id=1, capacity=4096, of_ids=[F.crc32("ids").alias("ids_crc32")])
    return pieces.join(place(pieces, capacity=4096), "piece_key").drop("piece_key")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None
"""Language scores, similarity joins and packing are beyond SQL; tests hold the stages against plain versions."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
