"""Registered queries of the operators in this folder, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.hnsw import near_vectors
from folioscope.llm.jaccard import similar_documents
from folioscope.llm.langid import identify
from folioscope.llm.line_dedup import dedup_lines
from folioscope.llm.mixing import mix
from folioscope.llm.packing import pieces_of, place
from folioscope.llm.phrases import collocations
from folioscope.llm.prefix_trie import prefix_trie
from folioscope.llm.quality import score_quality
from folioscope.llm.repeats import remove_repeats
from folioscope.llm.token_files import file_system, read_token_files, write_token_files
from folioscope.llm.topk import search, whole_numbers
from folioscope.llm.warc import audit, copy_archive, merkle_tree, write_archive
from folioscope.plans.scale import materialise, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(id_col: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.*, coalesce(k.doc_id <> r.keeper, false) AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op1_line_dedup", LINE_DEDUP_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return out.select("doc_id", "n_lines", "n_dropped", kept)


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder, end_id=2)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_best_two_fit")
def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pieces_of(table(spark, sf_dir, "documents"), end_id=1, capacity=4096, of_ids=[F.crc32("ids").alias("ids_crc32")])
    return pieces.join(place(pieces, capacity=4096), "piece_key").drop("piece_key")


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = fold_of("doc_id", 4)
    found = identify(docs, learn=fold != 2, keep=["doc_id"])
    return found.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_quality(docs, labels, learn=fold_of("doc_id", 5) != 0, keep=["doc_id"])
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", predicted)


TOP_K_SQL = """
WITH parts AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op2_max_score", TOP_K_SQL)
def op2_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_numbers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    return search(vectors.where(F.col("vec_id") % 100 == 0), vectors, k=10)


@query("op7_hnsw")
def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


@query("op8_part_enum")
def op8_part_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), n=3, percent=90)


WARC_SQL = """
SELECT page_id, sha256(coalesce(html, '')) AS payload_sha256
FROM pages WHERE page_id % 17 = 3 OR page_id % 31 = 7
"""


def damage(index: DataFrame, folder: str, replica: str) -> None:
    """Bit rot in a replica: one bit of the records of some pages, and zeros over those of others."""

    def run(batches):
        (fs, root), (to, there) = file_system(folder), file_system(replica)
        for batch in batches:
            for file in batch.to_pylist():
                with fs.open_input_file(f"{root}/{file['file']}") as source:
                    data = bytearray(source.read())
                for row in file["rows"]:
                    if row["page_id"] % 17 == 3:
                        data[(row["start"] + row["stop"]) // 2] ^= 1 << row["page_id"] % 8
                    else:
                        data[row["start"] : row["stop"]] = bytes(row["stop"] - row["start"])
                with to.open_output_stream(f"{there}/{file['file']}", compression=None) as out:
                    out.write(bytes(data))
            yield batch

    chosen = index.where("page_id % 17 = 3 or page_id % 31 = 7")
    rows = chosen.groupBy("file").agg(F.collect_list(F.struct("page_id", "start", "stop")).alias("rows"))  # a file's records, bounded
    materialise(rows.mapInArrow(run, rows.schema), "warc-damaged")


@query("op5_warc_merkle", WARC_SQL)
def op5_warc_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose record is damaged in the second replica, which is a copy with known damage."""
    first, second = (scratch_path(spark, f"warc-{k}") for k in ("first", "second"))
    index = write_archive(table(spark, sf_dir, "pages"), first)
    copy_archive(index, first, second)
    damage(index, first, second)
    return audit(index, merkle_tree(index, first), merkle_tree(index, second)).select("page_id", "payload_sha256")


@query("op4_soft_mixing")
def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    mixed = mix(docs, labels, {"good": 0.85, "poor": 0.10, "toxic": 0.05}, keep=["doc_id", "source"])
    return mixed.select("doc_id", "source", "n_tokens", "posterior", "rate", "copies")


PHRASES_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
  FROM documents),
split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
runs AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM split, range(1, 5) t(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS n FROM runs GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, phrase, n AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS y
  FROM f, range(1, 4) t(k) WHERE k < m),
scores AS (
  SELECT c.lang, c.phrase, a, k, l.n AS l, r.n AS r, CAST(2000000::HUGEINT * a // (l.n + r.n) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = x JOIN f r ON r.lang = c.lang AND r.phrase = y),
lowest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + w - 1], ' ') AS phrase, max(n) AS most
  FROM f, range(2, 4) t(w), range(1, 4) u(i) WHERE w < m AND i + w - 1 <= m GROUP BY ALL),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


@query("op13_collocations", PHRASES_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


CRC32_SQL = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda s: CAST(ascii(s) AS UBIGINT))),
      lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))"""

TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 100 AS host, CAST(xor({CRC32_SQL.format("CAST(c AS VARCHAR)")}, 4294967295::UBIGINT) % 6 AS BIGINT) AS h FROM t GROUP BY c),
head AS (SELECT ids.c, t.i AS pos, role, text FROM ids JOIN t ON t.c = ids.host AND t.i <= ids.h),
taken AS (SELECT ids.c, h, count(pos) AS m FROM ids LEFT JOIN head ON head.c = ids.c GROUP BY ALL),
turns AS (
  SELECT * FROM head UNION ALL
  SELECT t.c, i - h + m, role, text FROM t JOIN taken ON taken.c = t.c WHERE i > h),
named AS (
  SELECT c, pos, text, list(md5(length(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING) AS names FROM turns),
prefixes AS (
  SELECT c, 0::BIGINT AS d, '' AS path, '' AS up, 0::BIGINT AS chars FROM ids UNION ALL
  SELECT c, pos, array_to_string(names, ''), array_to_string(names[:-2], ''), length(text) FROM named),
nodes AS (SELECT path, d, any_value(up) AS up, any_value(chars) AS chars, min(c) AS conv_id, count(*) AS n_convs FROM prefixes GROUP BY path, d),
children AS (SELECT up AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY up),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
sums AS (
  SELECT a.path, CAST(count(*) FILTER (x.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((x.n_convs - 1) * x.chars) AS BIGINT) AS saved_tokens
  FROM counted x JOIN prefixes a ON a.c = x.conv_id AND a.d <= x.d GROUP BY a.path),
lengths AS (SELECT c, max(d) AS d FROM prefixes GROUP BY c),
ends AS (SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS convs FROM prefixes JOIN lengths USING (c, d) GROUP BY path)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, sha256(coalesce(convs, '')) AS ends_sha256
FROM counted n JOIN sums USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes u ON n.d > 0 AND u.path = n.up
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


REPEATS_SQL = """
WITH b AS (SELECT doc_id, row_number() OVER () AS row, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT row, unnest(range(1, octet_length(b) - 398)) AS p, b FROM b),
h AS (SELECT row, p, md5(array_slice(b, p, p + 399)) AS h FROM w),
again AS (SELECT row, p, coalesce(max(p) OVER (PARTITION BY row ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 399, -1) AS reach
  FROM (SELECT row, p, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
marked AS (SELECT row, p, sum(CAST(p > reach + 1 AS INTEGER)) OVER (PARTITION BY row ORDER BY p) AS span FROM again),
spans AS (SELECT row, span, min(p) AS first, max(p) + 399 AS last FROM marked GROUP BY ALL),
gaps AS (SELECT row, first, last, coalesce(lag(last) OVER (PARTITION BY row ORDER BY first), 0) + 1 AS since FROM spans),
cut AS (SELECT row, sum(last - first + 1) AS n_removed, count(*) AS n_spans, max(last) AS tail, list({'a': since, 'z': first - 1} ORDER BY first) AS keep FROM gaps GROUP BY row)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN keep IS NULL THEN b ELSE unhex(array_to_string(list_transform(list_append(keep, {'a': tail + 1, 'z': octet_length(b)}), lambda k: CASE WHEN k.z >= k.a THEN hex(array_slice(b, k.a, k.z)) ELSE '' END), '')) END) AS kept_sha256
FROM b LEFT JOIN cut USING (row)
"""


@query("op12_prefix_doubling", REPEATS_SQL)
def op12_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
