"""Helpers that keep plans whole and skew-proof at cluster scale.

Three patterns recur in this package:

* *sized joins*: the small side is stored first, so that its size in bytes is known
  when the join is planned and nothing of it runs twice;
* *block carry*: ordered operations inside a group (forward fill, previous value,
  running sum) run per fixed-width block of positions, and one small summary row
  per block carries the state on, so that one huge group is spread over many tasks;
* *shared tables*: lineage is cut by writing to the cluster's shared folder.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
"""Default width of a position block."""


SMALL_INPUT_PER_CORE = 128 << 20
"""Input bytes per core below which rows are dealt out; this is the usual size of one split."""


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input out evenly over the cores.

    A large input has a split per core and passes unchanged; a single small file
    would otherwise keep heavy per-row work in one task. The size comes from
    plan statistics, so nothing runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL_INPUT_PER_CORE else df


BATCH_BYTES = 4 << 20
"""Bytes of rows that Spark hands to a Python worker at once."""


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session end at ``BATCH_BYTES`` (and one row), where Spark's own bound is 64 MB.

    A batch lies in the executor's direct memory and in the worker, and its results in both again.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def buckets_for(df: DataFrame, bucket_bytes: int, least: int) -> int:
    """A bucket per ``bucket_bytes`` of the stored files that ``df`` reads, at least ``least``; the size comes from the plan."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return max(least, size // bucket_bytes) if size < 1 << 50 else least  # rows that are not stored have no known size


def sized_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``big`` with ``small``, which is stored first unless it is a plain scan.

    Spark then knows the bytes of ``small``: below its broadcast threshold ``big`` is not shuffled. Above it both
    sides are, and adaptive execution splits the large partitions of a hot key of ``big``.
    """
    scan = small._jdf.queryExecution().optimizedPlan().nodeName().startswith("LogicalRelation")
    return big.join(small if scan else materialise(small, "small-side"), list(keys), how)


def _grouped(df: DataFrame, keys: Sequence[str], position: str, width: int) -> DataFrame:
    """Add ``_blk`` and ``_key``, the group and block in one value.

    The later join has two branches over the same shuffle, which Spark runs once
    when both need the same columns. So the keys travel inside ``_key`` only, and a
    struct is never null, so that no null filter is inferred for one branch; a null
    group is a group of its own.
    """
    block = F.floor(F.col(position) / F.lit(width)).cast("long")
    key = F.struct(*[F.col(k) for k in keys], block.alias("_blk")).alias("_key")
    return df.select(*[c for c in df.columns if c not in keys], key)


def _ungrouped(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"_key.{c}").alias(c) if c in keys else F.col(c) for c in columns])


def _across_blocks(keys: Sequence[str]):
    group = F.struct(*[F.col(f"_key.{k}") for k in keys]) if keys else F.lit(0)
    return Window.partitionBy(group).orderBy("_key._blk").rowsBetween(Window.unboundedPreceding, -1)


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    upto: str = "last_value",
    before: str | None = None,
    first: str | None = None,
    order: Sequence[str] = (),
    width: int = BLOCK,
) -> DataFrame:
    """Last non-null ``value`` at or before each row (and strictly before it).

    ``position`` is an integer; ``order`` breaks ties among equal positions.
    ``first`` names a flag for the first row of a group. Work per task is bounded
    by the rows of one block, and the carried summary has one row per block. The
    summary is taken from the windowed rows, which are partitioned by block
    already, so ``df`` is read and shuffled once; keep it narrow.
    """
    base = _grouped(df, keys, position, width)
    by_order = [F.col(c) for c in (position, *order)]
    inside = Window.partitionBy("_key").orderBy(*by_order)
    out = base.withColumn(
        "_upto", F.last(value, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    if before:
        out = out.withColumn(
            "_before", F.last(value, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
        )
    if first:
        out = out.withColumn("_row", F.row_number().over(inside))

    summary = out.groupBy("_key").agg(F.max_by("_upto", F.struct(*by_order)).alias("_tail"))
    across = _across_blocks(keys)
    carry = summary.withColumn("_carry", F.last("_tail", ignorenulls=True).over(across)).drop("_tail")
    if first:
        carry = carry.withColumn("_earlier", F.count(F.lit(1)).over(across))

    out = out.join(carry, "_key", "left")
    if first:
        out = out.withColumn(first, (F.col("_row") == 1) & (F.col("_earlier") == 0)).drop("_row", "_earlier")
    out = out.withColumn(upto, F.coalesce("_upto", "_carry"))
    if before:
        out = out.withColumn(before, F.coalesce("_before", "_carry")).drop("_before")
    extra = [c for c in (upto, before, first) if c and c not in df.columns]
    return _ungrouped(out, [*df.columns, *extra], keys)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    amount: Column,
    name: str,
    width: int = BLOCK,
    blocks: bool = True,
) -> DataFrame:
    """Exclusive running sum of ``amount`` in ``position`` order inside each group.

    Without ``keys`` and with ``blocks`` the sums of the blocks are carried on in two levels, so that no task
    sees all of them.
    """
    base = _grouped(df, keys, position, width).withColumn("_amount", amount.cast("long"))
    inside = Window.partitionBy("_key").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    out = base.withColumn("_inside", F.sum("_amount").over(inside))
    summary = out.groupBy("_key").agg(F.sum("_amount").alias("_total"))
    if keys or not blocks:
        carry = summary.withColumn("_carry", F.sum("_total").over(_across_blocks(keys))).drop("_total")
    else:  # the blocks of one order without groups are summed by blocks of blocks
        numbered = summary.select(F.col("_key").alias("_outer"), F.col("_key._blk").alias("_number"), "_total")
        carry = running_sum(numbered, [], "_number", F.col("_total"), "_carry", width, blocks=False).select(F.col("_outer").alias("_key"), "_carry")
    out = out.join(carry, "_key", "left")
    zero = F.lit(0).cast("long")
    out = out.withColumn(name, F.coalesce("_inside", zero) + F.coalesce("_carry", zero))
    return _ungrouped(out, [*df.columns, name], keys)


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark prunes to ``k`` per task before it shuffles."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where the master is local and none is named."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioscope-"))
        configured = spark.sparkContext.getCheckpointDir()
    return configured.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """The folder of all scratch tables of this application."""
    return f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def bucketed_table(spark: SparkSession, location: str, schema: str, key: str, buckets: int) -> str:
    """The name under which the session knows the files at ``location``, which are (or will be) bucketed by ``key``.

    Joins and groupings that include ``key`` take such rows where they are. Insert rows with ``insert_bucketed``.
    """
    name = f"bucketed_{hashlib.md5(location.encode()).hexdigest()}"
    quoted = location.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{quoted}'")
    spark.catalog.refreshTable(name)
    return name


def insert_bucketed(rows: DataFrame, table: str, key: str, buckets: int) -> None:
    """Append ``rows``, one file per bucket."""
    insert_dealt(rows.repartition(buckets, key), table)


def insert_dealt(rows: DataFrame, table: str) -> None:
    """Append ``rows`` that are repartitioned by the table's key into as many parts as it has buckets."""
    rows.write.insertInto(table)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the application's scratch folder; call it when no result read from there is needed any more."""
    root = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
