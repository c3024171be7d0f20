"""Block-carried operations against plain Python, with one group holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import chapters
from folioscope.plans import scale


def hot_rows(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = None if i % 11 == 0 else ("hot" if rng.random() < 0.7 else f"g{i % 4}")
        rows.append((group, i * rng.choice([1, 1, 3]) + i * 1000, f"v{i}" if rng.random() < 0.2 else None, rng.randrange(5)))
    return rows


DDL = "grp string, pos long, val string, amount long"


def by_group(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("width", [1, 5000, 1 << 40])
def test_carry_last(spark, width):
    rows = hot_rows()
    df = spark.createDataFrame(rows, DDL)
    got = {(r.grp, r.pos): (r.now, r.prior, r.start) for r in scale.carry_last(df, ["grp"], "pos", "val", "now", "prior", "start", width=width).collect()}
    assert len(got) == len(rows)
    for group, members in by_group(rows).items():
        last = None
        for i, (_, pos, val, _) in enumerate(members):
            now = val or last
            assert got[group, pos] == (now, last, i == 0)
            last = now


@pytest.mark.parametrize("keys", [["grp"], []])
@pytest.mark.parametrize("width", [7000, 1 << 40])
def test_running_sum(spark, keys, width):
    rows = hot_rows()
    df = spark.createDataFrame(rows, DDL)
    got = {(r.grp, r.pos): r.total for r in scale.running_sum(df, keys, "pos", F.col("amount"), "total", width=width).collect()}
    groups = by_group(rows) if keys else {"all": sorted(rows, key=lambda r: r[1])}
    for members in groups.values():
        total = 0
        for group, pos, _, amount in members:
            assert got[group, pos] == total
            total += amount


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti", "left"])
def test_sized_join_is_the_same_on_both_sides_of_the_bound(spark, how):
    big = spark.createDataFrame([(i % 3 if i % 2 else 9, i) for i in range(100)], "k long, n long")
    small = spark.createDataFrame([(9, "hot"), (1, "one"), (1, "uno")], "k long, name string")
    found = []
    for bound in ("-1", "10MB"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
        found.append(sorted(map(tuple, scale.sized_join(big, small, ["k"], how).collect()), key=str))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found[0] == found[1]


def test_scratch_is_removed(spark):
    df = scale.materialise(spark.range(3), "kept")
    assert df.count() == 3 and scale.scratch_root(spark) in df.inputFiles()[0]


def test_as_of_label(spark):
    bounds = spark.createDataFrame(
        [("b", 0, 0, "A"), ("b", 10, 1, "B"), ("b", 10, 2, "C"), ("late", 50, 0, "Z")], "book_id string, offset long, seq long, chapter string"
    )
    rows = spark.createDataFrame(
        [("b", s) for s in (-1, 0, 9, 10, 99)] + [("late", 49), ("none", 3)], "book_id string, start_index long"
    )
    for width in (4, 1 << 20):
        got = {(r.book_id, r.start_index): r.chapter for r in chapters.as_of_label(rows, bounds, width=width).collect()}
        unknown = "Unknown chapter"
        assert [got["b", s] for s in (-1, 0, 9, 10, 99)] == [unknown, "A", "A", "C", "C"]
        assert got["late", 49] == got["none", 3] == unknown


def test_fill_and_transitions(spark):
    labels = [None, "A", None, "A", "B"]
    df = spark.createDataFrame([("b", i, x) for i, x in enumerate(labels)], "book_id string, page_index long, label string")
    filled = chapters.fill_labels(df, width=2)
    assert [r.chapter for r in filled.orderBy("page_index").collect()] == ["Front Matter", "A", "A", "A", "B"]
    assert sorted(r.page_index for r in chapters.transitions(filled).collect()) == [0, 1, 4]


def test_shared_dir_is_the_configured_one(spark, tmp_path):
    assert scale.shared_dir(spark) == scale.shared_dir(spark)
    assert scale.scratch_path(spark, "x") != scale.scratch_path(spark, "x")
