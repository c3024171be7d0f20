"""Cleaning rules over whole documents with the noise of scanned books added to each.

The driver's texts hold none of that noise, so every document is wrapped in the
same noisy lines on both sides of the comparison.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog import sql
from folioscope.catalog.registry import query, table
from folioscope.functions import fixed
from folioscope.functions.text import CHAIN, RULES, clean_board_text, clean_document
from folioscope.plans.scale import spread

_ID = "{id}"
_NOISE = [
    "  eLearn.PUNJAB \n",
    "{text}",
    "\n\n Fig. {id}.1 a caption line\nAs in Fig. 2.1 here\nIt�s {id} � C, 98� F of {id}�Cx\n",
    "(cid:{id}) (cid:3)  x \t end\nk\n o\n \n\n\n\n\nGo to WWW.topstudyworld.com/books to download all PDF books\n for all classes \n",
    "Access for free at openstax.orgFIGURE 3.{id} words\nTopic one, topic two {id}\n{text}\nab\n  ",
]


def _spark_noise():
    parts = []
    for piece in _NOISE:
        for i, bit in enumerate(piece.replace("{text}", "\0t\0").replace("{id}", "\0i\0").split("\0")):
            parts.append({"t": F.col("text"), "i": F.col("doc_id").cast("string")}.get(bit, F.lit(bit)) if i % 2 else F.lit(bit))
    return F.concat(*parts)


def _sql_noise() -> str:
    parts = []
    for piece in _NOISE:
        for i, bit in enumerate(piece.replace("{text}", "\0t\0").replace("{id}", "\0i\0").split("\0")):
            literal = "E'" + bit.replace("\n", "\\n").replace("\t", "\\t") + "'"
            parts.append({"t": "text", "i": "doc_id::VARCHAR"}.get(bit, literal) if i % 2 else literal)
    return " || ".join(parts)


def _re(pattern: str, replacement: str):
    return lambda x: f"regexp_replace({x}, '{sql.pattern(pattern)}', {replacement}, 'g')"


SQL_RULES = {
    "header": _re(fixed.HEADER_TOKEN, "''"),
    "caption": _re(fixed.FIGURE_CAPTION, "''"),
    "degree": _re(fixed.DEGREE, r"'\1°\2'"),
    "apostrophe": _re(fixed.APOSTROPHE, r"'\1''\2'"),
    "blank_lines": _re(fixed.BLANK_LINES, r"E'\n\n'"),
    "glyph_codes": _re(fixed.GLYPH_CODE, "''"),
    "spaces": _re(fixed.SPACE_TAB_RUN, "' '"),
    "watermark": _re(fixed.WATERMARK, "''"),
    "short_lines": _re(fixed.SHORT_LINE, "''"),
    "strip": _re(r"^\s+|\s+$", "''"),
}


def _sql(expression: str) -> str:
    return f"""SELECT doc_id, length(c)::BIGINT AS n_chars, md5(c) AS text_md5
               FROM (SELECT doc_id, {expression} AS c FROM (SELECT doc_id, {_sql_noise()} AS t FROM documents))"""


def _chain_sql() -> str:
    out = "t"
    for rule in CHAIN:
        out = SQL_RULES[rule](out)
    return out


def _alternate_sql() -> str:
    out = f"replace(t, '{fixed.FOOTER_TEXT}', '')"
    out = _re(fixed.UPPER_CAPTION, "''")(out)
    out = SQL_RULES["blank_lines"](out)
    out = _re(fixed.CONTENTS_LINE, r"E'\n'")(out)
    return SQL_RULES["strip"](out)


def _cleaned(spark, sf, rule):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    cleaned = docs.select("doc_id", rule(_spark_noise()).alias("c"))
    return cleaned.select("doc_id", F.length("c").cast("long").alias("n_chars"), F.md5("c").alias("text_md5"))


for _name, _rule in RULES.items():
    query(f"clean_{_name}", _sql(SQL_RULES[_name]("t")))(lambda spark, sf, rule=_rule: _cleaned(spark, sf, rule))

query("clean_full_chain", _sql(_chain_sql()))(lambda spark, sf: _cleaned(spark, sf, clean_board_text))
query("clean_alternate_chain", _sql(_alternate_sql()))(lambda spark, sf: _cleaned(spark, sf, clean_document))
