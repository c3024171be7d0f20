"""Table-fact queries. Every document becomes one page with a small table, in which all its words are used."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog.mcq import _word, worded, words_sql
from folioscope.catalog.registry import query
from folioscope.functions import electrons
from folioscope.operators import tables

WORDS = 7
_CONFIG = "'[Ar] 3d' || (doc_id % 11) || CASE WHEN doc_id % 2 = 0 THEN ' 4s' ELSE '4s  ' END || (doc_id % 3)"


def grids(spark, sf):
    w, n = F.col("w"), F.col("doc_id")
    s = lambda c: c.cast("string")
    config = F.concat(F.lit("[Ar] 3d"), s(n % 11), F.when(n % 2 == 0, " 4s").otherwise("4s  "), s(n % 3))
    none = F.lit(None).cast("string")
    row = lambda *cells: F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cells])
    rows = F.array(
        row("Element", "Configuration"),
        row(_word(w, 0), config),
        row(F.concat(F.lit(" "), _word(w, 1)), F.concat(F.lit("2s22p"), s(n % 7))),
        row(_word(w, 2), none, ""),
        row(none, "  "),
        row(F.concat(_word(w, 3), F.lit("\n"), _word(w, 4)), "no 7 config", _word(w, 5)),
        row(F.when(n % 5 == 0, "a1b2c"), _word(w, 6)),
    )
    page = (
        F.when(n % 3 == 0, F.concat(F.lit("intro\n  2.1 Some Heading\n"), _word(w, 0)))
        .when(n % 3 == 1, F.concat(F.lit("1 x\nTitle Line Here\n"), _word(w, 0)))
        .otherwise("nothing, here")
    )
    return worded(spark, sf, WORDS).select("doc_id", F.lit("Chemistry").alias("subject"), page.alias("page_text"), rows.alias("rows"))


_GRID_SQL = f"""
    g AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '2.1 Some Heading' WHEN 1 THEN 'Title Line Here' ELSE 'Chemistry' END AS topic,
        [['Element', 'Configuration'], [coalesce(w[1], 'word'), {_CONFIG}], [' ' || coalesce(w[2], 'word'), '2s22p' || (doc_id % 7)],
         [coalesce(w[3], 'word'), NULL, ''], [NULL, '  '],
         [coalesce(w[4], 'word') || chr(10) || coalesce(w[5], 'word'), 'no 7 config', coalesce(w[6], 'word')],
         [CASE WHEN doc_id % 5 = 0 THEN 'a1b2c' END, coalesce(w[7], 'word')]] AS rows FROM {words_sql(WORDS)}),
    usable AS (SELECT * FROM g WHERE NOT regexp_matches(array_to_string(list_filter(flatten(rows), lambda c: c <> ''), ' '), '[A-Za-z][0-9][A-Za-z][0-9]?[A-Za-z]'))"""


def _shells(t: str) -> str:
    """Position by position: a digit and a subshell letter, then blanks, then a count that fits."""
    cap = f"CASE substring({t}, i + 1, 1) WHEN 's' THEN 2 WHEN 'p' THEN 6 WHEN 'd' THEN 10 ELSE 14 END"
    rest = f"ltrim(substring({t}, i + 2), ' ')"
    return f"""list_filter(list_transform(
        list_filter(range(1, length({t}) + 1), lambda i: regexp_matches(substring({t}, i, 2), '^[0-9][spdf]$')),
        lambda i: {{'letter': substring({t}, i + 1, 1), 'n': CASE
            WHEN regexp_matches({rest}, '^[0-9][0-9]') AND substring({rest}, 1, 2)::INT <= {cap} THEN substring({rest}, 1, 2)::INT
            WHEN regexp_matches({rest}, '^[0-9]') THEN substring({rest}, 1, 1)::INT END}}), lambda x: x.n IS NOT NULL)"""


_UNPAIRED = """list_sum(list_transform(sh, lambda x: CASE
    WHEN x.n <= (CASE x.letter WHEN 's' THEN 1 WHEN 'p' THEN 3 WHEN 'd' THEN 5 ELSE 7 END) THEN x.n
    ELSE 2 * (CASE x.letter WHEN 's' THEN 1 WHEN 'p' THEN 3 WHEN 'd' THEN 5 ELSE 7 END) - x.n END))"""


@query(
    "subshell_counts",
    f"""WITH c AS (SELECT doc_id, array_to_string(w, ' ') || ' ' || {_CONFIG} || ' 2s22p' || (doc_id % 7) || ' 3d x' AS t FROM {words_sql(WORDS)}),
        s AS (SELECT doc_id, {_shells('t')} AS sh FROM c)
        SELECT doc_id, array_to_string(list_transform(sh, lambda x: x.letter || x.n), ',') AS shells, {_UNPAIRED}::BIGINT AS unpaired FROM s""",
)
def subshell_counts(spark, sf):
    n = F.col("doc_id")
    s = lambda c: c.cast("string")
    text = F.concat(
        F.array_join("w", " "), F.lit(" [Ar] 3d"), s(n % 11), F.when(n % 2 == 0, " 4s").otherwise("4s  "), s(n % 3),
        F.lit(" 2s22p"), s(n % 7), F.lit(" 3d x"),
    )
    shells = worded(spark, sf, WORDS).select("doc_id", electrons.subshells(text).alias("sh"))
    joined = F.array_join(F.transform("sh", lambda x: F.concat(x["letter"], s(x["electrons"]))), ",")
    return shells.select("doc_id", joined.alias("shells"), electrons.total_unpaired(F.col("sh")).cast("long").alias("unpaired"))


@query(
    "table_row_facts",
    f"""WITH {_GRID_SQL},
        r AS (SELECT doc_id, topic, i - 1 AS row_ix, list_transform(rows[i], lambda c: trim(replace(coalesce(c, ''), chr(10), ' '))) AS cells
              FROM (SELECT *, unnest(range(1, len(rows) + 1)) AS i FROM usable)),
        k AS (SELECT doc_id, topic, row_ix, list_filter(cells, lambda c: c <> '') AS cells FROM r),
        d AS (SELECT * FROM k WHERE len(cells) >= 2 AND len(list_filter(cells, lambda c: length(c) >= 30 OR regexp_matches(c, '[0-9]'))) > 0),
        c AS (SELECT doc_id, topic, row_ix, j, cells[j] AS t, {_shells('cells[j]')} AS sh FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS j FROM d)),
        a AS (SELECT *, list_filter(sh, lambda x: x.letter = 'd')[1].n AS nd FROM c),
        n AS (SELECT *, CASE WHEN len(sh) = 0 THEN t ELSE t || ' (' || {_UNPAIRED} || ' unpaired electrons total'
                || CASE nd WHEN 5 THEN '; all five d orbitals contain unpaired electrons' WHEN 10 THEN '; all five d orbitals are fully paired' ELSE '' END || ')' END AS note FROM a)
        SELECT doc_id, row_ix, topic || ' — ' || string_agg(note, ' | ' ORDER BY j) AS text FROM n GROUP BY doc_id, topic, row_ix""",
)
def table_row_facts(spark, sf):
    return tables.row_facts(grids(spark, sf)).select("doc_id", "row_ix", "text")


@query(
    "table_checks",
    f"""WITH {_GRID_SQL} SELECT g.doc_id, u.doc_id IS NOT NULL AS usable, topic,
          len(list_filter(list_transform(g.rows, lambda r: list_filter(r, lambda c: c IS NOT NULL AND trim(c) <> '')),
              lambda r: len(list_filter(r, lambda c: length(c) >= 30 OR regexp_matches(c, '[0-9]'))) = 0))::BIGINT AS n_header_rows
        FROM g LEFT JOIN (SELECT doc_id FROM usable) u USING (doc_id)""",
)
def table_checks(spark, sf):
    return grids(spark, sf).select(
        "doc_id",
        tables.is_usable(F.col("rows")).alias("usable"),
        tables.page_topic(F.col("page_text"), F.col("subject")).alias("topic"),
        F.size(F.filter("rows", tables.is_header)).cast("long").alias("n_header_rows"),
    )
