"""Chapter labels: per page, forward-filled, compacted, located in the text, and looked up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import fixed
from folioscope.functions.headings import locate_anchors, locate_labels, page_anchor, page_heading
from folioscope.plans.scale import BLOCK, carry_last


def chapter_starts(spark) -> DataFrame:
    """The fixed table of hand-made chapter starts: ``filename, page_index, start_label``."""
    rows = [(name, page, label) for name, starts in fixed.CHAPTER_STARTS.items() for page, label in starts]
    return spark.createDataFrame(rows, "filename string, page_index long, start_label string")


def starts_by_file(spark) -> DataFrame:
    """The hand-made chapter starts as ``filename, starts``, one row per listed book."""
    rows = [(name, starts) for name, starts in fixed.CHAPTER_STARTS.items()]
    return spark.createDataFrame(rows, "filename string, starts array<struct<page_index:long,label:string>>")


def raw_labels(pages: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Add ``label``: the hand-made start of a page if its book has any, else the detected heading.

    ``pages`` has ``book_id, page_index, text`` and, for hand-made starts,
    ``filename``. ``starts`` is a small fixed table.
    """
    if starts is None:
        return pages.withColumn("label", page_heading(F.col("text")))
    listed = starts.select("filename", F.lit(True).alias("_listed")).distinct()
    joined = pages.join(F.broadcast(listed), "filename", "left").join(
        F.broadcast(starts), ["filename", "page_index"], "left"
    )
    label = F.when(F.col("_listed"), F.col("start_label")).otherwise(page_heading(F.col("text")))
    return joined.withColumn("label", label).drop("_listed", "start_label")


def fill_labels(labelled: DataFrame, width: int = BLOCK) -> DataFrame:
    """Carry the last label forward inside each book: ``book_id, page_index, label, chapter, previous``.

    ``previous`` is the chapter of the page before, null on the first page. Only
    these columns are shuffled; page texts are joined back by page where needed.
    """
    narrow = labelled.select("book_id", "page_index", "label")
    filled = carry_last(narrow, ["book_id"], "page_index", "label", "chapter", "previous", "_first", width=width)
    front = F.lit(fixed.FRONT_MATTER)
    return (
        filled.withColumn("chapter", F.coalesce("chapter", front))
        .withColumn("previous", F.when(~F.col("_first"), F.coalesce("previous", front)))
        .drop("_first")
    )


def transitions(filled: DataFrame) -> DataFrame:
    """Pages where the chapter differs from the page before."""
    return filled.where(~F.col("chapter").eqNullSafe(F.col("previous")))


def as_of_label(
    rows: DataFrame, boundaries: DataFrame, book: str = "book_id", offset: str = "start_index", width: int = 1 << 20
) -> DataFrame:
    """Add ``chapter``: the last boundary of the book at or before ``offset``.

    ``boundaries`` has ``book, offset, seq, chapter``; of equal offsets the last in
    ``seq`` counts. Rows and boundaries are merged into one ordered stream and the
    label is carried forward, so no row meets more than one boundary.
    """
    points = boundaries.select(
        F.col(book), F.col("offset").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col("seq").cast("long").alias("_seq"), "chapter"
    )
    unplaced = rows.where(F.col(offset).isNull()).withColumn("chapter", F.lit(fixed.UNKNOWN_CHAPTER))  # they meet no boundary
    asked = rows.where(F.col(offset).isNotNull()).withColumn("_at", F.col(offset).cast("long")).withColumn("_kind", F.lit(1))
    merged = asked.unionByName(points, allowMissingColumns=True)
    carried = carry_last(merged, [book], "_at", "chapter", "_found", order=["_kind", "_seq"], width=width)
    placed = (
        carried.where(F.col("_kind") == 1)
        .withColumn("chapter", F.coalesce("_found", F.lit(fixed.UNKNOWN_CHAPTER)))
        .drop("_at", "_kind", "_seq", "_found")
    )
    return placed.unionByName(unplaced)


def book_boundaries(books: DataFrame, heading: Callable[[Column], Column] = page_heading) -> DataFrame:
    """Add ``chapter_boundaries`` to books that hold their raw ``page_texts`` and cleaned ``text``.

    One row is one decoded file, so headings, forward fill and search all run
    inside the row. ``heading`` gives the label of a page. A non-null ``starts`` (array of ``page_index, label``) replaces
    detection, and the search is then for the first real line of each page.
    """
    raw = F.transform(F.col("page_texts"), heading)
    empty = F.array().cast("array<struct<label:string>>")

    def keep_changes(acc, label):
        current = F.coalesce(label, acc["last"], F.lit(fixed.FRONT_MATTER))
        changed = ~current.eqNullSafe(acc["last"])
        return F.struct(
            current.alias("last"),
            F.when(changed, F.concat(acc["kept"], F.array(F.struct(current.alias("label")))))
            .otherwise(acc["kept"])
            .alias("kept"),
        )

    seed = F.struct(F.lit(None).cast("string").alias("last"), empty.alias("kept"))
    changes = F.aggregate(raw, seed, keep_changes, lambda acc: acc["kept"])
    detected = locate_labels(F.col("text"), changes)
    if "starts" not in books.columns:
        return books.withColumn("chapter_boundaries", detected)
    anchored = F.transform(
        F.filter(F.col("starts"), lambda s: s["page_index"] < F.size("page_texts")),
        lambda s: F.struct(
            s["label"].alias("label"), page_anchor(F.get(F.col("page_texts"), s["page_index"].cast("int"))).alias("anchor")
        ),
    )
    by_hand = locate_anchors(F.col("text"), anchored)
    return books.withColumn("chapter_boundaries", F.when(F.col("starts").isNotNull(), by_hand).otherwise(detected))
