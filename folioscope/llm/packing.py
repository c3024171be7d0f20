"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Texts are encoded and cut where they lie. Only keys and lengths are shuffled, into hash
buckets of a bounded number of pieces; each bucket is packed by itself and leaves at most
about one sequence unfilled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.tokens import WORD_BPE, word_encoder
from folioscope.plans.scale import bound_batches, materialise

PIECES = "doc_id long, piece int, start long, length long, ids binary, piece_key long"
BUCKET = 32_768
"""Pieces packed together, on average."""


PART = 4 << 20
"""Bytes of ids that leave a task together."""


def _cut(tokenizer: str, end_id: int, capacity: int):
    def rows(batch: pa.RecordBatch, doc: list[int], piece: list[int], cut: list[bytes], key: int) -> pa.RecordBatch:
        number = np.array(piece, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc").take(pa.array(doc, pa.int64())),
                pa.array(number, pa.int32()),
                pa.array(number * capacity),
                pa.array([len(x) // 4 for x in cut], pa.int64()),
                pa.array(cut, pa.binary()),
                pa.array(key + np.arange(len(cut)), pa.int64()),
            ],
            ["doc_id", "piece", "start", "length", "ids", "piece_key"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        key = TaskContext.get().partitionId() << 40
        step = 4 * capacity
        for batch in batches:
            doc, piece, cut, held = [], [], [], 0
            for row, ids in enumerate(encoder.encode_all(batch.column("text"), end)):
                ids = ids.as_py()
                for i, at in enumerate(range(0, len(ids), step)):
                    doc.append(row)
                    piece.append(i)
                    cut.append(ids[at : at + step])
                    held += len(cut[-1])
                    if held > PART:
                        yield rows(batch, doc, piece, cut, key)
                        key += len(cut)
                        doc, piece, cut, held = [], [], [], 0
            if cut:
                yield rows(batch, doc, piece, cut, key)
                key += len(cut)

    return run


def pieces_of(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = WORD_BPE,
    end_id: int = 1,
    capacity: int = 4096,
    of_ids: Sequence[Column | str] = ("ids",),
) -> DataFrame:
    """Ids of every text, ``end_id`` after them, cut only where they exceed ``capacity``; stored.

    ``ids`` are little-endian unsigned 32-bit. A null or empty text is one piece of one id. ``piece_key``
    is unique to the piece, also where rows share an id or have none. ``of_ids`` names what is stored of the
    ids, which alone take more disk than everything else here.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(_cut(tokenizer, end_id, capacity), PIECES)
    return materialise(pieces.select("doc_id", "piece", "start", "length", *of_ids, "piece_key"), "pieces")


def best_two_fit(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; ``lengths`` are from 1 to ``capacity``.

    A sequence is filled with the largest piece that fits until none does. Then, as long as that
    leaves a smaller gap, its smallest piece gives way to two unpacked ones.
    """
    stock: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        stock.setdefault(lengths[i], []).append(i)
    present = sum(1 << n for n in stock)  # bit n: a piece of n tokens is unpacked

    def largest(limit: int) -> int:
        return (present & ((2 << limit) - 1)).bit_length() - 1

    def take(n: int) -> int:
        nonlocal present
        i = stock[n].pop()
        if not stock[n]:
            present ^= 1 << n
        return i

    def closest_two(room: int, least: int) -> tuple[int, int] | None:
        best, pair, a = least, None, largest(room - 1)
        while 2 * a > best:
            b = largest(min(a, room - a))
            if b == a and len(stock[a]) < 2:
                b = largest(a - 1)
            if b > 0 and a + b > best:
                best, pair = a + b, (a, b)
                if best == room:
                    break
            a = largest(a - 1)
        return pair

    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while present:
        inside, gap = [], capacity
        while gap and (n := largest(gap)) > 0:
            inside.append((n, take(n)))
            gap -= n
        while gap:
            smallest = min(range(len(inside)), key=lambda i: inside[i][0])
            n, i = inside[smallest]
            pair = closest_two(gap + n, n)
            if not pair:
                break
            taken = [(m, take(m)) for m in pair]
            inside[smallest : smallest + 1] = taken
            stock.setdefault(n, []).append(i)
            present |= 1 << n
            gap += n - sum(pair)
        at = 0
        for n, i in inside:
            sequence[i], offset[i] = number, at
            at += n
        number += 1
    return sequence, offset


def place(pieces: DataFrame, capacity: int = 4096, bucket: int = BUCKET) -> DataFrame:
    """``piece_key, sequence_id, offset`` of every piece; ``sequence_id`` is any number."""
    n_buckets = max(1, pieces.count() // bucket)
    dealt = pieces.select("piece_key", "length", F.pmod(F.xxhash64("piece_key"), F.lit(n_buckets)).alias("bucket"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece_key")
        sequence, offset = best_two_fit(group["length"].tolist(), capacity)
        return pd.DataFrame({"piece_key": group["piece_key"], "sequence_id": (int(group["bucket"].iloc[0]) << 32) + sequence, "offset": offset})

    return dealt.groupBy("bucket").applyInPandas(pack, "piece_key long, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = WORD_BPE, end_id: int = 1, capacity: int = 4096
) -> DataFrame:
    """Every piece of every document with its ids and its place in a sequence.

    An empty table gives no rows. Rows that share an id, or have none, are packed each for itself.
    """
    pieces = pieces_of(docs, id_col, text_col, tokenizer, end_id, capacity)
    return pieces.join(materialise(place(pieces, capacity), "places"), "piece_key").drop("piece_key")


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, little-endian unsigned 32-bit; at most its capacity is gathered."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(parts.getField("ids"), "")).alias("ids"))
