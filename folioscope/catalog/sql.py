"""SQL fragments shared by the oracles (DuckDB dialect)."""

from __future__ import annotations

import re

from folioscope.functions import fixed


def quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


def tokens(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), "
        f"lambda t: t NOT IN ({quoted(fixed.STOP_WORDS)}))"
    )


def keywords(text: str) -> str:
    return f"list_distinct(list_filter({tokens(text)}, lambda t: length(t) > 2))"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')"


def bm25(queries: str, k: int, pad: bool = True) -> str:
    """CTEs up to ``bm25_ranked(query_id, doc, score, rank)`` from ``queries(query_id, text, subject)``."""
    padded = (
        "SELECT q.query_id, c.doc_id AS doc, coalesce(s.score, 0::DOUBLE) AS score FROM q "
        "JOIN corpus c ON c.scope = q.subject LEFT JOIN scores s ON s.query_id = q.query_id AND s.doc = c.doc_id"
        if pad
        else "SELECT query_id, doc, score FROM scores"
    )
    return f"""
    q AS ({queries}),
    corpus AS (SELECT doc_id, text, unnest([lang, '*']) AS scope FROM documents),
    toks AS (SELECT scope, doc_id, {tokens('text')} AS tk FROM corpus),
    dls AS (SELECT scope, doc_id, len(tk) AS dl FROM toks),
    sizes AS (SELECT scope, count(*) AS n_docs, avg(dl) AS avgdl FROM dls GROUP BY scope),
    post AS (SELECT scope, doc_id, term, count(*) AS tf
             FROM (SELECT scope, doc_id, unnest(tk) AS term FROM toks) GROUP BY ALL),
    dfs AS (SELECT scope, term, count(*) AS df FROM post GROUP BY ALL),
    raw AS (SELECT dfs.scope, term, df, ln(n_docs - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS r
            FROM dfs JOIN sizes USING (scope)),
    floors AS (SELECT scope, 0.25::DOUBLE * avg(r) AS eps FROM raw GROUP BY scope),
    idfs AS (SELECT scope, term, df, CASE WHEN r < 0 THEN eps ELSE r END AS idf FROM raw JOIN floors USING (scope)),
    qt AS (SELECT query_id, subject, term, count(*) AS qtf
           FROM (SELECT query_id, subject, unnest({tokens('text')}) AS term FROM q) GROUP BY ALL),
    scores AS (
      SELECT qt.query_id, post.doc_id AS doc,
             round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
      FROM qt JOIN post ON post.scope = qt.subject AND post.term = qt.term
      JOIN idfs ON idfs.scope = qt.subject AND idfs.term = qt.term
      JOIN dls ON dls.scope = post.scope AND dls.doc_id = post.doc_id
      JOIN sizes ON sizes.scope = post.scope GROUP BY ALL),
    padded AS ({padded}),
    bm25_ranked AS (
      SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank
      FROM padded QUALIFY rank <= {k})"""


def knn(queries: str, k: int, scoped: bool) -> str:
    """CTEs up to ``knn_ranked(query_id, id, distance, rank)`` from ``queries(query_id, vector, scope)``."""
    on = "v.scope = kq.scope" if scoped else "true"
    return f"""
    kq AS ({queries}),
    vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label AS scope FROM embeddings),
    dist AS (SELECT kq.query_id, v.id, round(power(list_distance(kq.vector, v.vector), 2), 9) AS distance
             FROM kq JOIN vecs v ON {on}),
    knn_ranked AS (
      SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
      FROM dist QUALIFY rank <= {k})"""


def pattern(java: str) -> str:
    """A fixed pattern in the dialect of the SQL twin, which has no classes or line-end flags to choose."""
    found = re.match(r"\(\?([A-Za-z]+)\)", java)
    if not found:
        return java
    flags = found[1].replace("U", "").replace("d", "")
    return (f"(?{flags})" if flags else "") + java[found.end() :].replace(r"\uFFFD", "\uFFFD")

