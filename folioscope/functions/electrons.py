"""Electron configurations in table cells, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import fixed
from folioscope.functions.text import let


def _orbitals(letter: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, count in fixed.ORBITALS.items():
        out = F.when(letter == name, count).otherwise(out)
    return out


def subshells(text: Column) -> Column:
    """``array<struct<letter,electrons>>`` in order of appearance.

    A two-digit count is taken only when the subshell can hold it, so that
    ``2s22p5`` reads as two subshells.
    """
    group = lambda i: F.regexp_extract_all(text, F.lit(fixed.SUBSHELL), F.lit(i))
    read = F.transform(
        F.arrays_zip(group(1).alias("letter"), group(2).alias("one"), group(3).alias("more")),
        lambda t: F.struct(
            t["letter"].alias("letter"),
            F.when(
                (t["more"] != "") & (F.concat(t["one"], t["more"]).try_cast("int") <= 2 * _orbitals(t["letter"])),
                F.concat(t["one"], t["more"]).try_cast("int"),
            )
            .otherwise(t["one"].try_cast("int"))
            .alias("electrons"),
        ),
    )
    return F.filter(read, lambda t: t["electrons"].isNotNull())


def unpaired(letter: Column, electrons: Column) -> Column:
    """Electrons fill orbitals singly before they pair."""
    orbitals = _orbitals(letter)
    return F.when(electrons <= orbitals, electrons).otherwise(2 * orbitals - electrons)


def total_unpaired(shells: Column) -> Column:
    return F.aggregate(shells, F.lit(0), lambda acc, t: acc + unpaired(t["letter"], t["electrons"]))


def annotate(text: Column) -> Column:
    """Append the number of unpaired electrons to a configuration; other text is unchanged."""

    def noted(shells):
        first_d = F.get(F.filter(shells, lambda t: t["letter"] == "d"), F.lit(0))["electrons"]
        extra = (
            F.when(first_d == 5, fixed.HALF_FULL_NOTE)
            .when(first_d == 10, fixed.FULL_NOTE)
            .otherwise("")
        )
        total = total_unpaired(shells).cast("string")
        note = F.concat(F.lit(" ("), total, F.lit(fixed.UNPAIRED_NOTE), extra, F.lit(")"))
        return F.when(F.size(shells) > 0, F.concat(text, note)).otherwise(text)

    return let(subshells(text), noted)
