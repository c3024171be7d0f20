"""Detecting chapter headings on one page and finding labels in a book's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import fixed
from folioscope.functions.text import let, strip, words


def is_structural(candidate: Column) -> Column:
    """Contains a term of end-of-chapter matter."""
    low = F.lower(candidate)
    terms = F.array(*[F.lit(t) for t in fixed.STRUCTURAL_TERMS])
    return F.exists(terms, lambda t: F.contains(low, t))


def is_garbled(candidate: Column) -> Column:
    """Mostly one- and two-character words, or too few letters."""

    def mostly_short(parts):
        short = F.size(F.filter(parts, lambda w: F.length(w) <= 2))
        return (F.size(parts) > 0) & (short / F.size(parts) > 0.5)

    letters = F.length(F.regexp_replace(candidate, r"[^\p{L}]", ""))
    few_letters = (F.length(candidate) > 0) & (letters / F.length(candidate) < 0.6)
    return let(words(candidate), mostly_short) | few_letters


def is_prose(candidate: Column) -> Column:
    """At least two filler words, repeats counted."""
    return F.size(F.filter(words(F.lower(candidate)), lambda w: w.isin(fixed.PROSE_WORDS))) >= 2


def is_heading(candidate: Column) -> Column:
    return ~(is_prose(candidate) | is_structural(candidate) | is_garbled(candidate))


def _tier(page: Column, pattern: str, group: int, label) -> Column:
    """``label(candidate)`` when the pattern occurs and its first match is a heading."""
    found = let(
        F.regexp_extract(page, pattern, group), lambda candidate: F.when(is_heading(candidate), label(candidate))
    )
    return F.when(page.rlike(pattern), found)


def running_header(page: Column) -> Column:
    """Label of one raw page by its running header alone, or null."""
    return _tier(page, fixed.RUNNING_HEADER, 1, strip)


def page_heading(page: Column) -> Column:
    """Label of one raw page or null: running header, then numbered section, then bare title.

    Only the first match of each tier is tried.
    """
    number = F.regexp_extract(page, fixed.NUMBERED_SECTION, 1)
    return F.coalesce(
        running_header(page),
        _tier(page, fixed.NUMBERED_SECTION, 2, lambda title: F.concat(number, F.lit(". "), strip(title))),
        _tier(page, fixed.BARE_TITLE, 1, strip),
    )


def flexible_pattern(label: Column, limit: int | None = None) -> Column:
    """Pattern for the words of ``label`` with any white space between them."""
    parts = words(label)
    if limit is not None:
        parts = F.slice(parts, 1, limit)
    quoted = F.transform(parts, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.array_join(quoted, rf"(?U:{fixed.SPACE}+)")


def find_from(text: Column, pattern: Column, start: Column) -> Column:
    """Offset, in characters, of the first match at or after ``start``; null if none."""

    def search(rest):
        return let(F.regexp_substr(rest, pattern), lambda hit: start + F.position(hit, rest) - 1)

    return F.when(pattern != "", let(F.substring(text, start + 1, F.length(text)), search))


def _locate(text: Column, items: Column, pattern_of, pinned) -> Column:
    """Fold over ``items`` with a cursor that never moves back."""
    empty = F.array().cast("array<struct<offset:int,chapter:string>>")

    def state(cursor, found):
        return F.struct(cursor.alias("cursor"), found.alias("found"))

    def step(acc, item):
        def record(offset):
            entry = F.struct(offset.alias("offset"), item["label"].alias("chapter"))
            return F.concat(acc["found"], F.array(entry))

        def move(at):
            return F.when(at.isNull(), acc).otherwise(state(at, record(at)))

        search = let(find_from(text, pattern_of(item), acc["cursor"]), move)
        if pinned is None:
            return search
        return F.when(pinned(item), state(acc["cursor"], record(F.lit(0)))).otherwise(search)

    return F.aggregate(items, state(F.lit(0), empty), step, lambda acc: acc["found"])


def _keep_last_of_equal(found: Column) -> Column:
    """Of consecutive entries at one offset keep the last one."""

    def keep(entries):
        is_last = lambda entry, i: (i + 1 == F.size(entries)) | (entry["offset"] != F.get(entries, i + 1)["offset"])
        return F.filter(entries, is_last)

    return let(found, keep)


def locate_labels(text: Column, transitions: Column) -> Column:
    """Boundaries of the labels in ``transitions`` (an array with a ``label`` field)."""
    found = _locate(
        text, transitions, lambda t: flexible_pattern(t["label"]), lambda t: t["label"] == fixed.FRONT_MATTER
    )
    return _keep_last_of_equal(found)


def page_anchor(page: Column) -> Column:
    """First line of a page with at least ten letters; null if there is none."""
    lines = F.transform(F.split(page, fixed.LINE_END), strip)
    return F.get(F.filter(lines, lambda line: F.length(F.regexp_replace(line, r"[^\p{L}]", "")) >= 10), 0)


def locate_anchors(text: Column, starts: Column) -> Column:
    """Boundaries of ``starts`` (an array with ``label`` and ``anchor``), found by anchor text."""
    usable = F.filter(starts, lambda s: s["anchor"].isNotNull())
    return _locate(text, usable, lambda s: flexible_pattern(s["anchor"], 8), None)


def chapter_at(boundaries: Column, offset: Column) -> Column:
    """Label of the last boundary at or before ``offset``, on boundaries held in the row."""
    earlier = F.filter(boundaries, lambda b: b["offset"] <= offset)
    return F.coalesce(F.try_element_at(earlier, F.lit(-1))["chapter"], F.lit(fixed.UNKNOWN_CHAPTER))
