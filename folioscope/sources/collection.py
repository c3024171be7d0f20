"""A stored vector collection: passages, metadata and embeddings keyed by ``chunk_id``.

Rows lie in files bucketed by id and are only ever appended to. Metadata updates and deletions are narrow numbered
tables beside them, merged when the collection is read: the rows meet them bucket by bucket, so neither a read nor an
insert shuffles what is stored, and no vector is written again. ``compact`` writes the merged rows as the next
generation. Readers of an older generation are not disturbed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.operators.vectors import HashingEncoder, embed
from folioscope.plans.scale import bucketed_table, buckets_for, insert_bucketed, insert_dealt, materialise, sized_join

METADATA = ["subject", "grade", "chapter"]
COLUMNS = [f.strip().split(" ")[0] for f in schemas.VECTORS.split(", ")]
CHANGES = "chunk_id STRING, gone BOOLEAN, subject STRING, grade STRING, chapter STRING, change BIGINT"
BUCKETS = 16
"""Least number of buckets of a new collection that is given none."""
BUCKET_BYTES = 64 << 20
"""Stored bytes of a first insert for which a bucket is made; one bucket is written, and later merged, by one task."""


def _buckets(generation: str) -> int:
    return int(generation.rsplit("-", 1)[1])


class Collection:
    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """``buckets`` counts for a new collection and for the next ``compact``; a stored one keeps its own until then.

        Without it a new collection has a bucket per ``BUCKET_BYTES`` of its first insert.
        """
        self.spark = spark
        self.path = path.rstrip("/")
        self.buckets = buckets

    def _folders(self, path: str, start: str) -> list[str]:
        """Names of the finished folders below ``path`` that begin with ``start``, in order."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(n for n in names if n.startswith(start) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))

    def _generation(self) -> str | None:
        """The folder of the last finished generation; its name ends with the number of buckets."""
        found = self._folders(self.path, "rows-")
        return found[-1] if found else None

    def _table(self, generation: str) -> str:
        """The name under which the session knows the bucketed files of a generation."""
        return bucketed_table(self.spark, f"{self.path}/{generation}", f"{schemas.VECTORS}, inserted BIGINT", "chunk_id", _buckets(generation))

    def _changes_path(self, generation: str) -> str:
        return f"{self.path}/changes-{generation.split('-')[1]}"

    def _rows(self, generation: str, changes: Sequence[str]) -> DataFrame:
        rows = self.spark.table(self._table(generation))
        if not changes:
            return rows.select(*COLUMNS)
        path = self._changes_path(generation)
        listed = self.spark.read.schema(CHANGES).parquet(*[f"{path}/{c}" for c in changes])
        listed = listed.repartition(_buckets(generation), "chunk_id")  # as many as buckets, so that the rows stay where they are
        listed = listed.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("change", "gone", *METADATA))).alias("changes"))  # at most one per change
        later = F.filter("changes", lambda x: x["change"] > F.col("inserted"))
        merged = rows.join(listed, "chunk_id", "left").withColumn("changes", F.coalesce(later, F.array()))
        return merged.where(~F.exists("changes", lambda x: x["gone"])).select(*[_latest(c) if c in METADATA else F.col(c) for c in COLUMNS])

    def read(self) -> DataFrame:
        """All rows as they are now; an empty table for a new collection."""
        generation = self._generation()
        if not generation:
            return self.spark.createDataFrame([], schemas.VECTORS)
        return self._rows(generation, self._folders(self._changes_path(generation), "c"))

    def _append(self, df: DataFrame, generation: str) -> None:
        """Add rows that are dealt to the buckets of ``generation`` already."""
        changes = self._folders(self._changes_path(generation), "c")
        out = df.select(*COLUMNS, F.lit(int(changes[-1][1:]) if changes else 0).cast("long").alias("inserted"))
        insert_dealt(out, self._table(generation))

    def _change(self, rows: DataFrame) -> None:
        generation = self._generation()
        if not generation:
            return
        path = self._changes_path(generation)
        number = int((self._folders(path, "c") or ["c0"])[-1][1:]) + 1
        rows.withColumn("change", F.lit(number).cast("long")).write.parquet(f"{path}/c{number:06d}")

    def compact(self) -> None:
        """Write the rows with all changes merged in as the next generation, in ``buckets`` buckets."""
        generation = self._generation()
        if not generation:
            return
        rows, buckets = self.read().withColumn("inserted", F.lit(0).cast("long")), self.buckets or _buckets(generation)
        insert_bucketed(rows, self._table(f"rows-{int(generation.split('-')[1]) + 1:06d}-{buckets}"), "chunk_id", buckets)

    def _stage(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """The rows, stored once and numbered, and the generation they go to."""
        staged = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "incoming")  # chunked and hashed once
        return staged, self._generation() or f"rows-{1:06d}-{self.buckets or buckets_for(staged, BUCKET_BYTES, BUCKETS)}"

    def _missing(self, staged: DataFrame, generation: str) -> DataFrame:
        """The staged rows whose id is not stored yet, one per id, dealt to the buckets of ``generation``.

        The first row of every id is found from the ids and the order alone. The stored ids that also come in are
        picked out first, so that a small insert never shuffles a large collection. Whole rows are then moved once.
        """
        order = [c for c in ("book_id", "chunk_ix") if c in staged.columns] or ["text"]
        firsts = staged.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.min(F.struct(*order, "_row")).alias("_first"))
        firsts = materialise(firsts.select("chunk_id", F.col("_first._row").alias("_first")), "first-rows")
        known = self.read().select("chunk_id").join(firsts.select("chunk_id"), "chunk_id", "left_semi")
        dealt = lambda df: df.repartition(_buckets(generation), "chunk_id")
        met = dealt(staged).join(dealt(firsts.join(known, "chunk_id", "left_anti")), "chunk_id")
        return met.where(F.col("_row") == F.col("_first")).drop("_row", "_first")

    def missing(self, rows: DataFrame) -> DataFrame:
        """Rows whose id is not stored yet, one per id."""
        return self._missing(*self._stage(rows))

    def add(self, rows: DataFrame) -> None:
        """Insert embedded rows; ids already present are left alone, so a repeated insert changes nothing."""
        staged, generation = self._stage(rows)
        self._append(self._missing(staged, generation), generation)

    def add_texts(self, chunks: DataFrame, make_model: Callable = HashingEncoder, subject: str | None = None) -> None:
        """Embed and insert the chunks that are new, of one subject when it is given."""
        staged, generation = self._stage(chunks if subject is None else chunks.where(F.col("subject") == subject))
        self._append(embed(self._missing(staged, generation), "text", make_model), generation)

    def update_metadata(self, updates: DataFrame) -> None:
        """Replace metadata of the given ids (``chunk_id`` and metadata columns); text and vectors are not touched.

        Null values change nothing. Of several updates for an id the largest counts. Ids that are not stored are ignored.
        """
        named = [c for c in METADATA if c in updates.columns]
        fresh = updates.groupBy("chunk_id").agg(F.max(F.struct(*named)).alias("new"))
        values = [(F.col(f"new.{c}") if c in named else F.lit(None)).cast("string").alias(c) for c in METADATA]
        self._change(fresh.select("chunk_id", F.lit(False).alias("gone"), *values))

    def delete(self, ids: DataFrame) -> None:
        """Remove the given ids; they can be inserted again."""
        self._change(ids.select("chunk_id", F.lit(True).alias("gone"), *[F.lit(None).cast("string").alias(c) for c in METADATA]).distinct())

    def get(self, ids: DataFrame, include: Sequence[str] = ("text", *METADATA)) -> DataFrame:
        """Stored rows of the given ids."""
        return sized_join(self.read().select("chunk_id", *include), ids.select("chunk_id").distinct(), ["chunk_id"], "left_semi")

    def count(self) -> int:
        return self.read().count()


def _latest(column: str) -> Column:
    """The last value that the changes give a metadata column, or the row's own."""
    given = F.filter(F.transform("changes", lambda x: x[column]), lambda v: v.isNotNull())
    return F.coalesce(F.try_element_at(given, F.lit(-1)), F.col(column)).alias(column)


def embedding_cache(spark: SparkSession, path: str, chunks: DataFrame, make_model: Callable = HashingEncoder) -> DataFrame:
    """Embeddings of ``chunks`` by id: computed and stored for ids not stored yet, read for the rest."""
    store = Collection(spark, path)
    store.add_texts(chunks, make_model)
    return sized_join(store.read().select("chunk_id", "embedding"), chunks.select("chunk_id").distinct(), ["chunk_id"], "left_semi")
