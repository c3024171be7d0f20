"""Facts from table cells. Off by default: in the measured runs these chunks lowered accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import fixed
from folioscope.functions.electrons import annotate
from folioscope.functions.text import let, strip


def flat_text(rows: Column) -> Column:
    """All non-empty cells of a grid in one line."""
    return F.array_join(F.filter(F.flatten(rows), lambda c: c.isNotNull() & (c != "")), " ")


def is_usable(rows: Column) -> Column:
    """Has text, and none of it shows the letter-digit-letter pattern of scrambled cells."""
    flat = flat_text(rows)
    return (strip(flat) != "") & ~flat.rlike(fixed.SCRAMBLED)


def is_header(cells: Column) -> Column:
    """No content, or only short cells without digits."""
    filled = F.filter(cells, lambda c: c.isNotNull() & (strip(c) != ""))
    return F.forall(filled, lambda c: (F.length(c) < 30) & ~c.rlike(r"(?U)\d"))


def page_topic(page: Column, default: Column) -> Column:
    """First numbered heading line, else first title line, else the default."""
    numbered = strip(F.regexp_extract(page, fixed.NUMBERED_HEADING_LINE, 0))
    title = strip(F.regexp_extract(page, fixed.TITLE_LINE, 0))
    return F.coalesce(F.nullif(numbered, F.lit("")), F.nullif(title, F.lit("")), default)


def row_facts(grids: DataFrame, rows: str = "rows", page: str = "page_text", subject: str = "subject") -> DataFrame:
    """One chunk per data row of each usable table: adds ``row_ix, text``.

    ``grids`` has one table per row. Header rows and rows with fewer than two
    filled cells are left out.
    """
    others = [c for c in grids.columns if c not in (rows, page)]
    topic = page_topic(F.col(page), F.col(subject))
    data = let(F.col(rows), lambda grid: F.when(is_usable(grid), grid))
    read = grids.select(*others, topic.alias("_topic"), F.posexplode_outer(data).alias("row_ix", "_cells"))

    def filled(cells):
        tidy = F.transform(cells, lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))))
        return let(tidy, lambda t: F.when(~is_header(t), F.filter(t, lambda c: c != "")))

    facts = read.where(F.col("_cells").isNotNull()).withColumn("_filled", filled(F.col("_cells"))).where(F.size("_filled") >= 2)
    text = F.concat(F.col("_topic"), F.lit(" — "), F.array_join(F.transform("_filled", annotate), " | "))
    return facts.select(*others, F.col("row_ix").cast("long").alias("row_ix"), text.alias("text"))
