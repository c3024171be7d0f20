"""Lexical ranking: a term index over passages and BM25 top-k for sets of queries.

The index holds one row per passage with its length and its term counts, computed
inside the row without a shuffle; its postings are those rows taken apart, and are not
stored again. A stored index has its passages bucketed by blocks of similar length, and the greatest count and
least length of every term in every block. A search meets the passages where they lie with a bounded number of query weights at a
time, so neither passages nor pairs are shuffled before the top-k, and it leaves out the blocks whose bound stays below a
query's k-th score. Corpus statistics are kept per subject, because a query restricted to a subject is
scored against the statistics of that subject alone. The pseudo-subject
``ANY`` carries the statistics of the whole corpus for queries without one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import fixed
from folioscope.functions.text import tokens
from folioscope.plans.scale import bucketed_table, buckets_for, insert_dealt, materialise, running_sum, scratch_path, sized_join, spread, top_k

ANY = "*"
SCORE_DIGITS = 9
WEIGHTS = 100_000
"""Query weights (a query's distinct terms) that are broadcast together, on average."""
BUCKET_BYTES = 16 << 20
"""Stored bytes of passages for which a stored index has a bucket; the bounds of one are gathered in one task, in 30 times that."""
PASSAGES_PER_BLOCK = 128
"""About how many passages share one bound per term."""
LENGTH_CLASSES = 8
"""Classes of length, each 1.4 times the last, that hold most passages of a usual corpus."""


@dataclass(frozen=True)
class LexicalIndex:
    """The parts of an index.

    ``passages``: doc, pos, subject, dl, terms; ``postings``: doc, pos, subject, dl, term, tf;
    ``terms``: subject, term, df; ``corpora``: subject, n_docs, avgdl, mean_idf.
    ``bounds``: block, subject, term, tf (greatest), dl (least). Only a stored index has it; its passages have a column ``block`` too and are bucketed by it.
    """

    passages: DataFrame
    postings: DataFrame
    terms: DataFrame
    corpora: DataFrame
    bounds: DataFrame | None = None

    def save(self, path: str, buckets: int | None = None) -> LexicalIndex:
        """Write the index; each part is computed from the parts already written.

        ``buckets`` is the number of tasks that a search is dealt to; by default one per ``BUCKET_BYTES`` of the
        stored passages, and as many as cores at least, so that the terms of one bucket fit the memory of a task.
        """
        spark = self.passages.sparkSession
        buckets = buckets or buckets_for(self.passages, BUCKET_BYTES, spark.sparkContext.defaultParallelism)
        blocked = _with_blocks(self.passages)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocked.schema)
        table = bucketed_table(spark, f"{path}/passages", schema, "block", buckets)
        insert_dealt(_unpacked(_packed(blocked).repartition(buckets, "block")).select(*blocked.columns), table)
        spark.createDataFrame([(schema, buckets)], "schema string, buckets int").coalesce(1).write.parquet(f"{path}/layout")
        passages = spark.table(table)
        listed = postings(passages, "block").groupBy("block", "subject", "term")
        listed.agg(F.max("tf").alias("tf"), F.min("dl").alias("dl")).write.parquet(f"{path}/bounds")
        _term_statistics(postings(passages)).write.parquet(f"{path}/terms")
        corpora = _corpus_statistics(passages, spark.read.parquet(f"{path}/terms"))
        corpora.write.parquet(f"{path}/corpora")
        return LexicalIndex.load(spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LexicalIndex:
        layout = spark.read.parquet(f"{path}/layout").first()
        passages = spark.table(bucketed_table(spark, f"{path}/passages", layout.schema, "block", layout.buckets))
        return LexicalIndex(passages, postings(passages), *(spark.read.parquet(f"{path}/{part}") for part in ("terms", "corpora", "bounds")))


def _with_blocks(passages: DataFrame) -> DataFrame:
    """Add ``block``: passages of similar length, because the bound of a block is tight where lengths are."""
    parts = max(1, passages.count() // (PASSAGES_PER_BLOCK * LENGTH_CLASSES))
    length = F.floor(F.log2(F.col("dl") + F.lit(1.0)) * 2).cast("long")
    return passages.withColumn("block", length * F.lit(1 << 40) + F.pmod(F.xxhash64("doc"), F.lit(parts)))


def _packed(passages: DataFrame) -> DataFrame:
    """Terms as one text and their counts as one array, a fraction of the bytes of the pairs; terms hold no space."""
    return passages.withColumn("_words", F.array_join("terms.term", " ")).withColumn("_counts", F.col("terms.tf")).drop("terms")


def _unpacked(packed: DataFrame) -> DataFrame:
    pairs = F.arrays_zip(F.split("_words", " ").alias("term"), F.col("_counts").alias("tf"))
    kind = "array<struct<term:string,tf:int>>"
    terms = F.when(F.size("_counts") > 0, pairs.cast(kind)).otherwise(F.array().cast(kind))
    return packed.withColumn("terms", terms).drop("_words", "_counts")


def term_counts(token_array: str) -> Column:
    """``array<struct<term,tf>>`` of a token array column, by sorting it and measuring the runs."""
    s = f"sort_array({token_array})"
    return F.expr(
        f"""transform(array({s}), s ->
              transform(array(filter(sequence(0, size(s) - 1), i -> i = 0 or get(s, i) <> get(s, i - 1))), st ->
                transform(st, (p, j) -> struct(get(s, p) as term, coalesce(get(st, j + 1), size(s)) - p as tf)))[0])[0]"""
    )


def index_passages(passages: DataFrame, doc: str, pos: str, text: str, subject: str) -> DataFrame:
    """One row per passage: ``doc, pos, subject, dl, terms``."""
    tokenised = passages.select(
        F.col(doc).alias("doc"), F.col(pos).alias("pos"), F.col(subject).alias("subject"), tokens(F.col(text)).alias("_tk")
    )
    none = F.array().cast("array<struct<term:string,tf:int>>")
    return tokenised.select(
        "doc", "pos", "subject", F.size("_tk").alias("dl"), F.when(F.size("_tk") > 0, term_counts("_tk")).otherwise(none).alias("terms")
    )


def postings(index: DataFrame, *more: str) -> DataFrame:
    """Explode the index to ``doc, pos, subject, dl, term, tf`` and the columns named in ``more``.

    The outer form keeps Spark from repeating the array expression in a size filter.
    """
    return index.select("doc", "pos", "subject", "dl", *more, F.inline_outer("terms")).where(F.col("term").isNotNull())


def _term_statistics(listed: DataFrame) -> DataFrame:
    terms = listed.groupBy("subject", "term").agg(F.count(F.lit(1)).alias("df"))
    whole = terms.groupBy("term").agg(F.sum("df").alias("df")).select(F.lit(ANY).alias("subject"), "term", "df")
    return terms.unionByName(whole)


def _raw_idf() -> Column:
    n, df = F.col("n_docs"), F.col("df")
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def _corpus_statistics(index: DataFrame, terms: DataFrame) -> DataFrame:
    sizes = index.groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("n_tokens"))
    total = sizes.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    sizes = sizes.unionByName(total.select(F.lit(ANY).alias("subject"), "n_docs", "n_tokens"))
    mean = terms.join(sizes, "subject").groupBy("subject").agg(F.avg(_raw_idf()).alias("mean_idf"))
    avgdl = (F.col("n_tokens") / F.col("n_docs")).alias("avgdl")
    return sizes.join(mean, "subject", "left").select("subject", "n_docs", avgdl, "mean_idf")


def build_index(passages: DataFrame, doc: str, pos: str, text: str, subject: str) -> LexicalIndex:
    """Index ``passages``; ``pos`` is an integer position that settles ties."""
    index = index_passages(spread(passages.select(*{doc, pos, text, subject})), doc, pos, text, subject)
    listed = postings(index)
    terms = _term_statistics(listed)
    return LexicalIndex(index, listed, terms, _corpus_statistics(index, terms))


def _floored_idf() -> Column:
    """Negative values give way to a share of the mean over the vocabulary."""
    return F.when(_raw_idf() < 0, F.col("mean_idf") * fixed.BM25_EPSILON).otherwise(_raw_idf())


def idf(index: LexicalIndex) -> DataFrame:
    """``subject, term, df, idf`` of the whole vocabulary."""
    return index.terms.join(index.corpora, "subject").select("subject", "term", "df", _floored_idf().alias("idf"))


def _scope() -> Column:
    return F.when(F.coalesce("subject", F.lit("")) == "", ANY).otherwise(F.col("subject"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, subject, term, qtf`` of ``queries(query_id, text, subject)``."""
    exploded = queries.select("query_id", _scope().alias("subject"), F.explode_outer(tokens(F.col("text"))).alias("term"))
    return exploded.where("term is not null").groupBy("query_id", "subject", "term").agg(F.count(F.lit(1)).alias("qtf"))


def query_weights(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """``query_id, subject, term, weight, avgdl``: what each query term adds per unit of saturated count."""
    wanted = query_terms(queries)
    known = sized_join(index.terms, wanted, ["subject", "term"]).join(index.corpora, "subject")
    return known.select("query_id", "subject", "term", (F.col("qtf") * _floored_idf()).alias("weight"), "avgdl")


def _asked(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows by term with the weights of one block of queries; a row meets the queries of its own subject and those without one."""
    asked = weights.withColumnRenamed("subject", "_scope")
    return rows.join(F.broadcast(asked), "term").where(F.col("_scope").isin(ANY) | (F.col("_scope") == F.col("subject")))


def _part(weight: Column) -> Column:
    """What a term adds to a score; it grows with ``tf`` and falls with ``dl``."""
    tf, dl = F.col("tf"), F.col("dl")
    k1, b = fixed.BM25_K1, fixed.BM25_B
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))


def matched_scores(index: LexicalIndex, weights: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``query_id, doc, pos, score`` of every passage that shares a term with a query.

    ``weights`` is one block, so it and its subjects are bounded. Passages of other subjects are not read.
    With ``wanted (query_id, block)``, which is stored, only those blocks are scored.
    """
    subjects = [r.subject for r in weights.select("subject").distinct().collect()]
    passages = index.passages if ANY in subjects else index.passages.where(F.col("subject").isin(subjects))
    if wanted is not None:
        passages = passages.join(wanted.select("block").distinct(), "block", "left_semi")
    block = ["block"] if index.bounds is not None else []
    pairs = _asked(postings(passages if block else passages.repartition("doc"), *block), weights)
    if wanted is not None:
        pairs = pairs.join(wanted, ["query_id", "block"], "left_semi")
    score = F.round(F.sum(_part(F.col("weight"))), SCORE_DIGITS)
    return pairs.groupBy("query_id", *block, "doc", "pos").agg(score.alias("score")).select("query_id", "doc", "pos", "score")


def block_bounds(index: LexicalIndex, weights: DataFrame) -> DataFrame:
    """``query_id, block, bound``: no passage of the block scores higher; blocks without a term of the query are left out."""
    part = _part(F.greatest("weight", F.lit(0.0)))
    inside = _asked(index.bounds, weights).groupBy("query_id", "block", "subject").agg(F.sum(part).alias("bound"))
    return inside.groupBy("query_id", "block").agg(F.max("bound").alias("bound"))


def open_blocks(bounds: DataFrame, first: DataFrame, early: DataFrame, k: int) -> DataFrame:
    """``query_id, block`` outside ``first`` that may hold a passage as good as the ``k``-th of ``early``, ties included."""
    floor = early.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    reaches = F.col("floor").isNull() | (F.col("bound") * (1 + 1e-9) + 10.0 ** (1 - SCORE_DIGITS) >= F.col("floor"))
    left = bounds.join(first, ["query_id", "block"], "left_anti").join(floor, "query_id", "left")
    return left.where(reaches).select("query_id", "block")


def _best(index: LexicalIndex, weights: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Top ``k`` of one block of weights.

    Each query first scores its ``k`` blocks of highest bound, which hold ``k`` matches or all, and then only
    those whose bound reaches the ``k``-th score found there.
    """
    if index.bounds is None:
        return top_k(matched_scores(index, weights), ["query_id"], order, k)
    bounds = materialise(block_bounds(index, weights), "block-bounds")
    first = top_k(bounds, ["query_id"], [F.desc("bound"), F.asc("block")], k).select("query_id", "block")
    first = materialise(first, "first-blocks")
    early = materialise(top_k(matched_scores(index, weights, first), ["query_id"], order, k), "first-scores")
    rest = materialise(open_blocks(bounds, first, early, k), "open-blocks")
    late = matched_scores(index, weights, rest)
    return top_k(early.drop("rank").unionByName(late), ["query_id"], order, k)


def _blocks(weights: DataFrame, size: int) -> list[DataFrame]:
    """Whole queries in blocks of about ``size`` weights."""
    n = max(1, -(-weights.count() // size))
    return [weights.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) for b in range(n)]


def _first_places(index: LexicalIndex, need: DataFrame) -> DataFrame:
    """``query_id, doc, pos`` of the first ``reach`` passages by position in each query's subject.

    ``need`` has ``query_id, subject, reach``. Places are numbered per subject as far as its longest reach, and
    a query asks for each of its places, so a subject that many queries share is spread over its places.
    """
    reach = {r.subject: r.reach for r in need.groupBy("subject").agg(F.max("reach").alias("reach")).collect()}  # one row per subject
    longest = max(reach.values(), default=0)
    asked = F.filter(F.array("subject", F.lit(ANY)), lambda x: x.isin(list(reach)))
    places = index.passages.select("doc", "pos", F.explode(asked).alias("subject"))
    early = top_k(places, ["subject"], [F.asc("pos")], longest, "place")
    wanted = need.select("query_id", "subject", F.explode(F.sequence(F.lit(1).cast("long"), F.col("reach").cast("long"))).alias("place"))
    return wanted.join(early, ["subject", "place"]).select("query_id", "doc", "pos")


def search(index: LexicalIndex, queries: DataFrame, k: int, pad: bool = True, block: int = WEIGHTS) -> DataFrame:
    """BM25 top ``k`` per query: ``query_id, doc, pos, score, rank``.

    ``queries`` has ``query_id, text, subject``; a null or empty subject searches
    everything. Ties go to the earlier position. With ``pad``, passages of score
    zero fill the list up, in position order. The ranked matches of each block of queries are written before the
    next block. Only queries with a term of negative weight, which can put passages below zero, are scored again
    to tell those from passages without a match.
    """
    spark = queries.sparkSession
    order = [F.desc("score"), F.asc("pos")]
    weights = materialise(query_weights(index, queries), "weights")
    folder = scratch_path(spark, "bm25")
    for part in _blocks(weights, block):
        _best(index, part, order, k).write.mode("append").parquet(folder)
    best = spark.read.parquet(folder)
    if not pad:
        return best
    full = best.where("score > 0").groupBy("query_id").count().where(F.col("count") >= k)
    short = materialise(queries.join(full, "query_id", "left_anti").select("query_id", _scope().alias("subject")), "short")
    if short.isEmpty():
        return best
    scored = best.where("score <> 0").drop("rank")
    need = short.withColumn("reach", F.lit(k).cast("long"))
    sunk = materialise(weights.where("weight < 0").select("query_id").distinct().join(short.select("query_id"), "query_id"), "sunk")
    if not sunk.isEmpty():
        again = sized_join(weights, sunk, ["query_id"], "left_semi")
        folder = scratch_path(spark, "sunk-scores")
        for part in _blocks(again, block):
            matched_scores(index, part).where("score <> 0").write.mode("append").parquet(folder)
        whole = spark.read.parquet(folder)
        below = whole.where("score < 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_below"))
        need = short.join(below, "query_id", "left").select("query_id", "subject", (F.coalesce("n_below", F.lit(0)) + k).alias("reach"))
        scored = scored.join(sunk, "query_id", "left_anti").unionByName(whole)
    zero = _first_places(index, need).join(scored.select("query_id", "doc"), ["query_id", "doc"], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(scored.unionByName(zero), ["query_id"], order, k)


def find_terms(passages: DataFrame, text: str, groups: Sequence[Sequence[str]]) -> DataFrame:
    """Passages whose lower-cased text holds, for every group, at least one of its terms."""
    low = F.lower(F.col(text))
    keep = F.lit(True)
    for group in groups:
        hit = F.lit(False)
        for term in group:
            hit = hit | F.contains(low, F.lit(term))
        keep = keep & hit
    return passages.where(keep)


def with_neighbours(matches: DataFrame, passages: DataFrame, pos: str, subject: str, context: int = 1) -> DataFrame:
    """Matches with the passages around them, by corpus position and within one subject.

    Adds ``match_pos`` and ``offset``; offset 0 is the match itself.
    """
    offsets = F.explode(F.sequence(F.lit(-context).cast("long"), F.lit(context).cast("long")))
    around = matches.select(F.col(pos).alias("match_pos"), F.col(subject).alias("_subject"), offsets.alias("offset"))
    around = around.withColumn("_pos", F.col("match_pos") + F.col("offset"))
    joined = around.join(passages, around["_pos"] == passages[pos])
    return joined.where(F.col("_subject") == F.col(subject)).drop("_pos", "_subject")
