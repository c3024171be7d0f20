"""A trie of conversations with totals of every subtree, by parallel tree contraction.

A turn is named by two 64-bit hashes of its place, role and text, and a prefix by the exclusive-or of its turns' names, so
prefixes of the longest conversation come from a running aggregate in blocks. Nodes are the distinct prefixes.

Totals follow in rounds, each a few joins on node keys that are unique on both sides. *Rake*: leaves leave the tree and
their totals are summed into their parents. *Compress*: inside chains of nodes with one child every node that precedes both
neighbours in a fixed order, by the trailing zeros of its depth, is spliced out and absorbed by its parent; a chain loses
about half of its nodes. When no node is left, the spliced ones come back in reverse order: a node's total is its parent's without
what the parent had itself at that time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.skew import join_hot
from folioscope.plans.scale import materialise

KEY = ["p", "q"]
BLOCK = 4096
"""Turns of one conversation that a task takes in order."""
IDS = 8192
"""Ids that are joined to one text before they are hashed."""


def numbered(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Number the rows of each group from 1 in the given order, however many one group has.

    Rows are sorted by ranges; a range numbers its own rows, and the rows of a group in earlier ranges are added from
    a table with one row per group and range.
    """
    spread = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    placed = materialise(spread.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "in-order")
    here = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    here = here.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    out = placed.join(materialise(here, "order-parts"), [group, "_part"])
    return out.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_part", "_first", "_rows", "_before")


def turns_of(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, at, h1, h2, chars``: the turns of each conversation in order, each with its hashes and code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    narrow = turns.select(
        "conv", "turn", "role", F.substring("text", 1, 64).alias("start"), F.sha2("text", 256).alias("digest"),
        F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "role", "text").alias("h2"), F.length("text").cast("long").alias("chars"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("start").asc(), F.col("digest").asc()]
    return numbered(narrow, "conv", order, "at").select("conv", "at", "h1", "h2", "chars")


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns of every conversation with its head taken from a host, and ``conv, turns`` of every conversation.

    The first h turns come from the host, the conversation numbered by the next lower multiple of ``every``; the own turns follow
    after the first h. h is the unsigned crc32 of the decimal id modulo ``most``.
    """
    turns = materialise(turns, "turns")
    convs = turns.groupBy("conv").agg(F.max("at").alias("own"))
    convs = convs.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % most).withColumn("host", F.col("conv") - F.col("conv") % every)
    convs = materialise(convs, "conversations")
    first = turns.where((F.col("conv") % every == 0) & (F.col("at") < most))
    heads = first.groupBy(F.col("conv").alias("host")).agg(F.array_sort(F.collect_list(F.struct("at", "h1", "h2", "chars"))).alias("head"))  # most - 1 turns at most
    head = F.filter("head", lambda x: x["at"] <= F.col("h"))
    taken = convs.join(materialise(heads, "host-turns"), "host", "left").withColumn("head", F.coalesce(head, F.array().cast("array<struct<at:bigint,h1:bigint,h2:bigint,chars:bigint>>")))
    taken = taken.select("conv", "h", "head", F.size("head").cast("long").alias("m"), (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("turns"))
    taken = materialise(taken, "rebuilt-heads")
    given = taken.select("conv", F.inline("head"))
    # few turns precede the head's end, so only the long rest of a conversation could be hot, and its ids are unique on the other side
    own = join_hot(turns, taken.select("conv", "h", "m"), ["conv"]).where("at > h").select("conv", (F.col("at") - F.col("h") + F.col("m")).alias("at"), "h1", "h2", "chars")
    return given.unionByName(own), taken.select("conv", "turns")


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv, depth, p, q, up_p, up_q, chars``: the name of every prefix and of the one before it."""
    named = turns.select("conv", "at", F.floor(F.col("at") / BLOCK).alias("block"), F.xxhash64("at", "h1", "h2").alias("z1"), F.xxhash64("h2", "h1", "at").alias("z2"), "chars")
    inside = Window.partitionBy("conv", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    named = named.select("*", F.bit_xor("z1").over(inside).alias("x1"), F.bit_xor("z2").over(inside).alias("x2"))
    named = materialise(named, "turn-names")
    blocks = named.groupBy("conv", "block").agg(F.bit_xor("z1").alias("b1"), F.bit_xor("z2").alias("b2"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv", "block", F.coalesce(F.bit_xor("b1").over(earlier), F.lit(0)).alias("c1"), F.coalesce(F.bit_xor("b2").over(earlier), F.lit(0)).alias("c2"))
    out = named.where("block = 0").select("*", F.lit(0).cast("long").alias("c1"), F.lit(0).cast("long").alias("c2"))
    out = out.unionByName(named.where("block > 0").join(carried, ["conv", "block"]).select(*out.columns))  # only long conversations are joined
    p, q = F.col("x1").bitwiseXOR(F.col("c1")), F.col("x2").bitwiseXOR(F.col("c2"))
    return out.select("conv", F.col("at").alias("depth"), p.alias("p"), q.alias("q"), p.bitwiseXOR(F.col("z1")).alias("up_p"), q.bitwiseXOR(F.col("z2")).alias("up_q"), "chars")


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``p, q`` of every node with the sums of ``values`` over its subtree, and ``n_children``.

    ``nodes`` has the key ``p, q``, the parent's key ``up_p, up_q`` (null at the top), ``depth`` and the values, which are
    additive; ``leaf`` among them counts 1 for each childless node.
    """
    zeros = F.length(F.regexp_extract(F.bin("depth"), "0*$", 0))
    order = F.struct(zeros.alias("zeros"), F.xxhash64("p", "q").alias("r1"), F.col("p").alias("r2"), F.col("q").alias("r3"))
    own = [c for c in values if c != "leaf"]
    now = materialise(nodes.select(*KEY, "up_p", "up_q", order.alias("order"), *own), "tree")
    children, done, spliced = None, [], []
    while not now.isEmpty():
        kids = now.where("up_p is not null").groupBy(F.col("up_p").alias("p"), F.col("up_q").alias("q"))
        kids = kids.agg(F.count(F.lit(1)).alias("kids"), F.min(F.struct("order", F.col("p").alias("kid_p"), F.col("q").alias("kid_q"))).alias("kid"))
        now = now.join(kids, KEY, "left").withColumn("kids", F.coalesce("kids", F.lit(0)).cast("long"))
        if children is None:
            now = now.withColumn("leaf", (F.col("kids") == 0).cast("long"))
        now = materialise(now, "tree-kids")
        if children is None:
            children = now.select(*KEY, F.col("kids").alias("n_children"))
        leaves = now.where("kids = 0")
        done.append(leaves.select(*KEY, *values))
        sums = leaves.where("up_p is not null").groupBy(F.col("up_p").alias("p"), F.col("up_q").alias("q"))
        sums = sums.agg(F.count(F.lit(1)).alias("raked"), *[F.sum(c).alias(f"more_{c}") for c in values])
        rest = now.where("kids > 0").join(sums, KEY, "left")
        rest = rest.select(*KEY, "up_p", "up_q", "order", "kid", ((F.col("kids") == 1) & F.col("raked").isNull()).alias("one"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in values])
        rest = materialise(rest, "raked")
        if rest.isEmpty():
            break
        unary = rest.where("one")
        above = unary.select(F.col("kid.kid_p").alias("p"), F.col("kid.kid_q").alias("q"), F.col("order").alias("above"), *[F.col(c).alias(f"had_{c}") for c in values])
        out = unary.join(above, KEY).where((F.col("order") < F.col("above")) & (F.col("order") < F.col("kid.order")))
        out = materialise(out.select(*KEY, "up_p", "up_q", "kid", *values, *[f"had_{c}" for c in values]), "spliced")
        spliced.append((len(done), out.select(*KEY, "up_p", "up_q", *[f"had_{c}" for c in values])))
        absorbed = out.select(F.col("up_p").alias("p"), F.col("up_q").alias("q"), *[F.col(c).alias(f"more_{c}") for c in values])
        hung = out.select(F.col("kid.kid_p").alias("p"), F.col("kid.kid_q").alias("q"), F.col("up_p").alias("to_p"), F.col("up_q").alias("to_q"))
        rest = rest.join(out.select(*KEY), KEY, "left_anti").join(absorbed, KEY, "left").join(hung, KEY, "left")
        now = materialise(
            rest.select(*KEY, F.coalesce("to_p", "up_p").alias("up_p"), F.coalesce("to_q", "up_q").alias("up_q"), "order", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in values]),
            "tree",
        )
    if not done:
        return nodes.select(*KEY, *[F.lit(0).cast("long").alias(c) for c in [*values, "n_children"]])
    for round_, out in reversed(spliced):
        # only nodes that left the tree after this round can have absorbed these
        parents = union(done[round_:]).select(F.col("p").alias("up_p"), F.col("q").alias("up_q"), *[F.col(c).alias(f"whole_{c}") for c in values])
        back = out.join(parents, ["up_p", "up_q"]).select(*KEY, *[(F.col(f"whole_{c}") - F.col(f"had_{c}")).alias(c) for c in values])
        done.append(materialise(back, "re-expanded"))
    return union(done).join(children, KEY)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash the texts of each key one after another; they come in order, a key's rows together."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], ["p", "q", "ends_sha256"])

    for batch in batches:
        for p, q, ids in zip(*(batch.column(c).to_pylist() for c in ("p", "q", "ids"))):
            if key == (p, q):
                state.update(b",")
            else:
                if key:
                    yield row()
                key, state = (p, q), sha256()
            state.update(ids.encode())
    if key:
        yield row()


def ends_of(last: DataFrame) -> DataFrame:
    """``p, q, ends_sha256`` for ``last (p, q, conv)``: the hash of a node's ids in ascending order, joined by commas.

    The ids of one node are numbered over many tasks and joined there to texts of a bounded number of ids. A hash of one text runs
    in one place, so those texts pass one task in order, of which it keeps one at a time.
    """
    key = F.struct(*KEY)
    placed = numbered(last.withColumn("node", key), "node", [F.col("conv").asc()], "number")
    blocks = placed.groupBy("node", F.floor((F.col("number") - 1) / IDS).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    blocks = materialise(blocks.select("node.p", "node.q", "block", "ids"), "joined-ids")
    return blocks.repartition("p", "q").sortWithinPartitions("p", "q", "block").mapInArrow(_digests, "p long, q long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations (see ``rebuilt``), the empty one included.

    Returns ``conv_id`` (the smallest conversation that starts with the prefix), ``depth`` (its turns), ``parent_conv_id`` (the same of
    the prefix one turn shorter; null for the empty one), ``n_convs`` (conversations that start with it), ``n_children``, ``n_leaves``
    (childless prefixes that start with it, itself included), ``saved_tokens`` (over all those that start with it: conversations less
    one, times the code points of the last text) and ``ends_sha256`` (of the ids of the conversations that end there).

    Turns are in the order of ``turn_col``, null first, then of role and text; null roles and texts are empty. Rows without an id belong
    to no conversation. Repeated rows are turns of their own. An empty table gives no rows. Other columns are not read. Prefixes are
    told apart by 128 bits of hash.
    """
    turns, convs = rebuilt(turns_of(conversations, id_col, turn_col, role_col, text_col))
    whole = materialise(prefixes(turns), "prefixes")
    convs = materialise(convs, "lengths")
    if convs.isEmpty():
        none = [F.lit(0).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
        return convs.select(*none, F.lit("").alias("ends_sha256"))
    nodes = whole.groupBy(*KEY).agg(
        F.first("depth").alias("depth"), F.first("up_p").alias("up_p"), F.first("up_q").alias("up_q"), F.first("chars").alias("chars"), F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    top = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    top = top.select(zero.alias("p"), zero.alias("q"), zero.alias("depth"), none.alias("up_p"), none.alias("up_q"), zero.alias("chars"), "conv_id", "n_convs")
    nodes = materialise(nodes.unionByName(top).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars")), "nodes")
    totals = materialise(subtree_totals(nodes, ["leaf", "saved_tokens"]), "totals")

    last = whole.join(convs, "conv").where("depth = turns").select(*KEY, "conv")
    last = last.unionByName(convs.where("turns = 0").select(zero.alias("p"), zero.alias("q"), "conv"))
    ends = materialise(ends_of(materialise(last, "ends")), "end-digests")
    parents = nodes.select(F.col("p").alias("up_p"), F.col("q").alias("up_q"), F.col("conv_id").alias("parent_conv_id"))
    out = join_hot(nodes.where("up_p is not null").drop("saved_tokens"), parents, ["up_p", "up_q"])
    out = out.unionByName(nodes.where("up_p is null").drop("saved_tokens").withColumn("parent_conv_id", none))
    out = out.join(totals, KEY).join(ends, KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaf").alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
