"""Cleaning rules, white-space handling and the tokeniser, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import fixed

TOKEN = r"[\p{L}\p{N}_]+"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` several times.

    Spark shares repeated expressions only outside lambdas; inside one, a repeated
    array expression would run again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sub(pattern: str, replacement: str = ""):
    return lambda c: F.regexp_replace(c, F.lit(pattern), F.lit(replacement))


def strip(c: Column) -> Column:
    """Remove Unicode white space from both ends (``trim`` would only drop spaces)."""
    return F.regexp_replace(c, F.lit(rf"(?U)\A{fixed.SPACE}+|{fixed.SPACE}+\z"), F.lit(""))


def words(c: Column) -> Column:
    """Split on runs of white space, without empty words at the ends."""
    return F.filter(F.split(c, rf"(?U){fixed.SPACE}+"), lambda w: w != "")


RULES = {
    "header": _sub(fixed.HEADER_TOKEN),
    "caption": _sub(fixed.FIGURE_CAPTION),
    "degree": _sub(fixed.DEGREE, "$1°$2"),
    "apostrophe": _sub(fixed.APOSTROPHE, "$1'$2"),
    "blank_lines": _sub(fixed.BLANK_LINES, "\n\n"),
    "glyph_codes": _sub(fixed.GLYPH_CODE),
    "spaces": lambda c: _sub(fixed.SPACE_TAB_RUN, " ")(_sub(fixed.SPACE_RUN, " ")(c)),
    "watermark": _sub(fixed.WATERMARK),
    "short_lines": _sub(fixed.SHORT_LINE),
    "strip": strip,
}

CHAIN = [
    "header", "caption", "degree", "apostrophe", "blank_lines", "glyph_codes",
    "spaces", "watermark", "short_lines", "blank_lines", "strip",
]


def clean_board_text(c: Column) -> Column:
    """The main cleaning chain; the order of the rules matters."""
    return reduce(lambda acc, rule: RULES[rule](acc), CHAIN, c)


def clean_document(c: Column) -> Column:
    """The chain for the second family of books."""
    c = F.replace(c, F.lit(fixed.FOOTER_TEXT), F.lit(""))
    c = _sub(fixed.UPPER_CAPTION)(c)
    c = _sub(fixed.BLANK_LINES, "\n\n")(c)
    c = _sub(fixed.CONTENTS_LINE, "\n")(c)
    return strip(c)


def all_tokens(c: Column) -> Column:
    """Lower-cased maximal runs of word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def tokens(c: Column) -> Column:
    """Tokens without stop words; order and repeats are kept."""
    return F.filter(all_tokens(c), lambda t: ~t.isin(fixed.STOP_WORDS))


def keywords(c: Column) -> Column:
    """Distinct tokens longer than two characters, without stop words."""
    return F.array_distinct(F.filter(tokens(c), lambda t: F.length(t) > 2))


def overlap(a: Column, b: Column) -> Column:
    """Number of keywords two keyword arrays share."""
    return F.size(F.array_intersect(a, b))


def chunk_id(text: Column) -> Column:
    """Content hash: equal text gives an equal id wherever it stands."""
    return F.md5(F.encode(text, "UTF-8"))
