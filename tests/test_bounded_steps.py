"""Steps whose memory must not grow with the input: batches, files and buckets."""

import numpy as np
from pyspark.sql import functions as F

from folioscope.operators import lexical, vectors
from folioscope.plans import scale
from folioscope.sources import collection, files


def test_text_files_end_after_their_rows(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("text")).coalesce(1)
    files.write_text(rows, "text", str(tmp_path / "books"), 8)
    decoded = files.decode_pages(files.book_files(spark, str(tmp_path / "books"), "*.txt"), lambda data: data.decode().split("\n")[:-1])
    assert sorted(r.n for r in decoded.select(F.size("page_texts").alias("n")).collect()) == [4] + 12 * [8]
    assert sorted(r.text for r in files.page_rows(decoded).collect()) == sorted(r.text for r in rows.collect())


def test_the_encoder_is_fed_a_few_megabytes(spark):
    class BatchLength:
        def encode(self, texts):
            return np.full((len(texts), 1), len(texts))

    rows = spark.range(64).select(F.repeat(F.lit("x"), 1 << 20).alias("text")).coalesce(1)
    largest = vectors.embed(rows, "text", BatchLength).agg(F.max(F.col("embedding")[0])).first()[0]
    assert 1 <= largest <= 5


def test_an_index_has_buckets_by_its_size(spark, tmp_path, monkeypatch):
    rows = spark.range(400).select("id", F.concat(F.lit("alpha word"), (F.col("id") % 7).cast("string")).alias("text"), F.lit("a").alias("subject"))
    rows.write.parquet(str(tmp_path / "texts"))
    built = lexical.build_index(spark.read.parquet(str(tmp_path / "texts")), "id", "id", "text", "subject")
    monkeypatch.setattr(lexical, "BUCKET_BYTES", 100)
    stored = built.save(str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index/layout")).first().buckets > 2 * spark.sparkContext.defaultParallelism
    for part in ("terms", "corpora", "postings"):
        have, want = getattr(stored, part), getattr(built, part)
        assert sorted(map(str, have.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_collection_has_buckets_by_its_first_insert(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(collection, "BUCKET_BYTES", 500)
    ddl = "chunk_id string, embedding array<float>, text string, subject string, grade string, chapter string, book_id string, chunk_ix long"
    rows = [(f"c{i % 90}", [float(i)], f"t{i}", "s", "g", None, "all", i) for i in range(99, -1, -1)]
    store = collection.Collection(spark, str(tmp_path / "c"))
    store.add(spark.createDataFrame(rows, ddl))
    assert int(store._generation().rsplit("-", 1)[1]) > collection.BUCKETS
    store.add(spark.createDataFrame([*rows, ("new", [0.0], "new", "s", "g", None, "all", 1)] * 2, ddl))
    assert sorted((r.chunk_id, r.text) for r in store.read().collect()) == sorted([(f"c{i}", f"t{i}") for i in range(90)] + [("new", "new")])


def test_an_insert_moves_whole_rows_once(spark, tmp_path):
    rows = spark.range(50).select(F.col("id").cast("string").alias("chunk_id"), F.lit("t").alias("text"), F.col("id").alias("chunk_ix"))
    store = collection.Collection(spark, str(tmp_path / "c"), buckets=4)
    moved = store.missing(rows)
    assert moved.count() == 50
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Window" not in plan


def test_rows_that_are_not_stored_take_the_least_buckets(spark):
    assert scale.buckets_for(spark.createDataFrame([(1,)], "a long"), 1, 3) >= 3
    assert scale.buckets_for(spark.sparkContext.parallelize([(1,)]).toDF("a long"), 1, 3) == 3
