"""WARC archives and their Merkle fixity audit.

``write_archive`` stores web pages as gzip members of ``.warc.gz`` files of a bounded number of
records and keeps an index of their offset ranges. A replica is a folder with the same files.
``merkle_tree`` hashes the stored bytes of every range of the index and then, level by level,
the hashes and ranges of up to ``FAN_OUT`` children in their order. ``audit`` compares the roots of two
replicas and follows only the branches that differ, down to the damaged records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.token_files import file_system
from folioscope.plans.scale import materialise

FAN_OUT = 16
LEVELS = 3
"""Levels above the records in a file, so a file has up to ``FAN_OUT ** LEVELS`` records."""
FILE_RECORDS = FAN_OUT ** (LEVELS - 1)
INDEX = "file string, record int, page_id long, start long, stop long, payload_sha256 string"


def record(url: str | None, page_id: int | None, payload: bytes, digest: str) -> bytes:
    """One WARC/1.1 resource record."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest}")
    head = (
        f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"
        + (f"WARC-Target-URI: {' '.join(url.split())}\r\n" if url else "")
        + f"WARC-Payload-Digest: sha256:{digest}\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    )
    return head.encode("utf-8", "replace") + payload + b"\r\n\r\n"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name, out, at, number = "", None, 0, 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if out is None:
                    name, at, number = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                payload = row["html"] or b""
                digest = hashlib.sha256(payload).hexdigest()
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record(row["url"], row["page_id"], payload, digest)) + packer.flush()
                out.write(member)
                rows.append({"file": name, "record": number, "page_id": row["page_id"], "start": at, "stop": at + len(member), "payload_sha256": digest})
                at, number = at + len(member), number + 1
                if number == FILE_RECORDS:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
        if out:
            out.close()

    return run


_SCHEMA = pa.schema(
    [("file", pa.string()), ("record", pa.int32()), ("page_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("payload_sha256", pa.string())]
)


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Store every page where it is read, and return the stored index of offset ranges.

    A null or empty page is a record without payload; a null address is left out of the head; repeated
    rows are records of their own. A task that runs again writes files under new names, and the
    index names those of the run that counted. An empty table gives an empty index.
    """
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("binary").alias("html"))
    return materialise(rows.mapInArrow(_write(folder), INDEX), "warc-index")


def files_of(index: DataFrame) -> DataFrame:
    """One row per file, dealt out evenly."""
    files = materialise(index.groupBy("file").agg(F.max("stop").alias("size")), "warc-files")
    return files.repartition(max(1, files.count() // 4), "file")


def copy_archive(index: DataFrame, folder: str, replica: str) -> None:
    """Copy the files of an archive into another folder, a file per step of a task."""
    file_system(replica)[0].create_dir(file_system(replica)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, root), (to, there) = file_system(folder), file_system(replica)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_file(f"{root}/{name}") as source, to.open_output_stream(f"{there}/{name}", compression=None) as out:
                    while chunk := source.read(1 << 22):
                        out.write(chunk)
            yield batch

    files = files_of(index)
    materialise(files.mapInArrow(run, files.schema), "warc-copied")


def _leaves(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name, source = None, None
        for batch in batches:
            hashes = []
            for file, start, stop in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop"))):
                if file != name:
                    if source:
                        source.close()
                    name = file
                    try:
                        source = fs.open_input_file(f"{root}/{file}")
                    except FileNotFoundError:
                        source = None
                stored = b""
                if source and start < source.size():
                    source.seek(start)
                    stored = source.read(stop - start)
                hashes.append(hashlib.sha256(stored).digest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "record", "start", "stop")), pa.array(hashes, pa.binary())], ["file", "number", "start", "stop", "hash"])

    return run


NODE = ["level", "file", "number", "start", "stop", "hash"]


def merkle_tree(index: DataFrame, folder: str) -> DataFrame:
    """``level, file, number, start, stop, hash`` of all nodes of a replica; level 0 are the records.

    A range that the replica's file does not reach, or whose file is missing, is hashed as far as it is there.
    Every level is stored apart, so a reader of one level reads nothing else.
    """
    ordered = index.repartition("file").sortWithinPartitions("file", "record")
    level = ordered.mapInArrow(_leaves(folder), "file string, number int, start long, stop long, hash binary")
    tree = None
    for depth in range(LEVELS + 1):
        nodes = materialise(level.select(F.lit(depth).alias("level"), *NODE[1:]), f"merkle-{depth}")
        tree = nodes if tree is None else tree.union(nodes)
        parent = F.floor(F.col("number") / FAN_OUT).cast("int").alias("number")
        children = F.array_sort(F.collect_list(F.struct("start", "stop", F.hex("hash").alias("hash"))))  # FAN_OUT at most
        level = nodes.groupBy("file", parent).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), children.alias("below"))
        text = F.array_join(F.transform("below", lambda c: F.concat_ws(" ", c["start"], c["stop"], c["hash"])), "\n")
        level = level.select("file", "number", "start", "stop", F.unhex(F.sha2(text, 256)).alias("hash"))
    return tree


def _differs(x: str, y: str) -> Column:
    return ~F.col(f"{x}.hash").eqNullSafe(F.col(f"{y}.hash"))


def audit(index: DataFrame, expected: DataFrame, found: DataFrame) -> DataFrame:
    """``file, record, page_id, start, stop, payload_sha256`` of every record whose stored bytes differ.

    ``expected`` and ``found`` are the trees of two replicas over the same index. Below the roots only children
    of nodes that differ are read into the comparison.
    """
    suspects = None
    for depth in range(LEVELS, -1, -1):
        left, right = (tree.where(F.col("level") == depth).select("file", "number", "hash") for tree in (expected, found))
        if suspects is not None:
            parents = suspects.select("file", F.col("number").alias("parent"))
            parent = F.floor(F.col("number") / FAN_OUT).cast("int")
            left, right = (t.withColumn("parent", parent).join(parents, ["file", "parent"], "left_semi") for t in (left, right))
        pairs = left.alias("l").join(right.alias("r"), ["file", "number"], "left").where(_differs("l", "r"))
        suspects = materialise(pairs.select("file", "number"), f"merkle-differs-{depth}")
    damaged = suspects.select("file", F.col("number").alias("record"))
    return index.join(damaged, ["file", "record"]).select("file", "record", "page_id", "start", "stop", "payload_sha256")
