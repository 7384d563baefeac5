"""Row numbers of groups cut into pieces, against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallymill.functions.ranking import number_within, range_positions


@pytest.fixture(scope="module")
def rows():
    """2,000 rows, a third of them in one group, some without a group."""
    rng = random.Random(7)
    ids = rng.sample(range(-50_000, 1_000_000), 2_000)
    kinds = ["hot"] * 4 + ["a", "b", None, "c", "d", "e", "f", "g"]
    return [(rng.choice(kinds), i % 3, i) for i in ids]


def brute(rows, key):
    groups = defaultdict(list)
    for row in rows:
        groups[key(row)].append(row)
    numbered = {}
    for members in groups.values():
        for n, row in enumerate(sorted(members, key=lambda r: r[2])):
            numbered[row[2]] = (n, len(members))
    return numbered


def test_number_within(spark, rows):
    df = spark.createDataFrame(rows, "g string, h int, i bigint").repartition(5)
    out = number_within(df, ["g", "h"], "i", "n", "total")
    assert out.columns == ["g", "h", "i", "n", "total"]
    wanted = brute(rows, lambda r: (r[0], r[1]))
    got = {r.i: (r.n, r.total) for r in out.collect()}
    assert got == wanted
    assert {(r.g, r.h, r.i) for r in out.collect()} == set(rows)


def test_number_within_leaves_out_total(spark, rows):
    df = spark.createDataFrame(rows, "g string, h int, i bigint")
    assert number_within(df, ["g"], "i").columns == ["g", "h", "i", "row_no"]


def test_number_within_attaches_columns_by_group(spark, rows):
    df = spark.createDataFrame(rows, "g string, h int, i bigint")
    names = spark.createDataFrame([("hot", 1), ("a", 2), (None, 3)], "g string, tag int")
    out = number_within(df, ["g", "h"], "i", "n", attach=names)
    assert out.columns == ["g", "h", "i", "n", "tag"]
    tags = {"hot": 1, "a": 2, None: 3}
    assert {(r.i, r.tag) for r in out.collect()} == {(i, tags.get(g)) for g, _, i in rows}


def test_number_within_when_rows_are_shuffled(spark, rows):
    """Without broadcasts, facts are shuffled once for numbering and join."""
    df = spark.createDataFrame(rows, "g string, h int, i bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = number_within(df, ["g"], "i", "n")
        wanted = brute(rows, lambda r: r[0])
        assert {r.i: r.n for r in out.collect()} == {i: n for i, (n, _) in wanted.items()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_range_positions(spark, rows):
    df = spark.createDataFrame(rows, "g string, h int, i bigint")
    text = df.select("g", F.lpad((F.col("i") + 60_000).cast("string"), 8, "0").alias("t"), "i")
    out = range_positions(text, ["t"], ["g"], "n")
    wanted = brute(rows, lambda r: r[0])
    assert {r.i: r.n for r in out.collect()} == {i: n for i, (n, _) in wanted.items()}
    overall = range_positions(text, ["t"], number="n")
    assert [r.n for r in overall.orderBy("t").collect()] == list(range(len(rows)))


def test_sparse_and_missing_ids(spark):
    """Hashed ids cost no more than dense ones; a missing one is numbered first."""
    rows = [("g", (i * 0x9E3779B97F4A7C15) % 2**63) for i in range(1_000)] + [("g", None)]
    df = spark.createDataFrame(rows, "g string, i bigint")
    out = {r.i: (r.n, r.total) for r in number_within(df, ["g"], "i", "n", "total").collect()}
    assert out == {i: (n, 1_001) for n, i in enumerate([None, *sorted(i for _, i in rows if i is not None)])}
