import math

import pytest
from pyspark.sql import functions as F

from tallymill.functions.arith import PRIME, near_normal, scatter
from tallymill.sources import generate as gen


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.range(997).select(F.concat(F.lit("w"), "id").alias("word"))


def test_scatter_by_hand(spark):
    big = 3 * 2**31 + 5
    row = spark.createDataFrame([(big,)], "id bigint").select(scatter("id", 7, 11)).first()
    x = (5 * 48271 + 3 * 69621 + 7 * 16807 + 11 * 271828183) % PRIME
    assert row[0] == pow(x, 5, PRIME)


def test_scatter_is_even(spark):
    df = spark.range(200_000).select((scatter("id", 0, 3) * 20 / PRIME).cast("int").alias("b"))
    counts = [r["count"] for r in df.groupBy("b").count().collect()]
    assert len(counts) == 20 and max(counts) < 10_600 and min(counts) > 9_400


def test_near_normal_moments(spark):
    z = F.col("z")
    got = spark.range(200_000).select(near_normal("id", 0, 5).alias("z")).agg(
        F.avg(z), F.variance(z), F.skewness(z), F.kurtosis(z), F.avg((F.abs(z) < 1).cast("int"))
    ).first()
    assert got[0] == pytest.approx(0, abs=0.02)
    assert got[1] == pytest.approx(1, abs=0.02)
    assert got[2] == pytest.approx(0, abs=0.05)
    assert got[3] == pytest.approx(-0.1, abs=0.05)  # -1.2 / 12
    assert got[4] == pytest.approx(0.683, abs=0.01)


def test_word_lines(spark, vocab):
    lines = gen.gen_word_lines(spark, vocab, 1_000)
    rows = [r.line.split(" ") for r in lines.collect()]
    assert len(rows) == 1_000 and {len(r) for r in rows} == {15}
    words = {w for r in rows for w in r}
    assert words <= {f"w{i}" for i in range(997)} and len(words) == 997
    assert gen.gen_word_lines(spark, vocab).count() == 500


def test_parallelism_changes_nothing(spark, vocab):
    one = gen.gen_word_lines(spark, vocab, 300, parts=1)
    many = gen.gen_word_lines(spark, vocab, 300, parts=7)
    wanted = {r.id: r.line for r in one.collect()}
    assert wanted == {r.id: r.line for r in many.collect()}
    other = gen.gen_word_lines(spark, vocab, 300, seed=1)
    assert wanted != {r.id: r.line for r in other.collect()}


def test_only_the_dictionary_can_be_the_build_side(spark, vocab):
    """Picks are never broadcast, and a broadcast dictionary leaves them in place."""
    plan = lambda: gen.gen_word_lines(spark, vocab, 300)._jdf.queryExecution().executedPlan().toString()
    small = plan()
    assert "BuildRight" in small and "BuildLeft" not in small and "LeftOuter" in small
    assert "hashpartitioning(id" not in small and "hashpartitioning(idx" not in small
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        assert "Broadcast" not in plan()
        large = {r.id: r.line for r in gen.gen_word_lines(spark, vocab, 300).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert large == {r.id: r.line for r in gen.gen_word_lines(spark, vocab, 300).collect()}


def test_words_go_back_to_their_lines_as_plain_rows(spark, vocab, monkeypatch):
    """With a dictionary beyond broadcasts, lists are made after the exchange by line."""
    monkeypatch.setattr(gen, "_broadcast_bytes", lambda _: 100, raising=False)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    small = {r.id: r.line for r in gen.gen_word_lines(spark, vocab, 300, parts=3).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = gen.gen_word_lines(spark, vocab, 300, parts=3)
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(id#") == 1 and "REPARTITION_BY_COL" in plan
        assert plan.rindex("collect_list") < plan.index("hashpartitioning(id#")
        assert small == {r.id: r.line for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    monkeypatch.undo()
    assert gen._broadcast_bytes(spark) == 10 << 20
    assert small == {r.id: r.line for r in gen.gen_word_lines(spark, vocab, 300).collect()}


def test_empty_dictionary(spark, vocab):
    with pytest.raises(ValueError):
        gen.gen_word_lines(spark, vocab.where(F.lit(False)), 10)


def test_text_has_the_wanted_size(spark, vocab):
    text = gen.gen_text(spark, vocab, 1_000_000, parts=3)
    assert gen._ids(spark, 10**10, None, 100).rdd.getNumPartitions() == 3726  # of 256 MB
    size = text.agg(F.sum(F.octet_length("value") + 1)).first()[0]
    assert size == pytest.approx(1_000_000, rel=0.01)


@pytest.mark.parametrize("cols", [500, 512, 997])
def test_ratings(spark, cols):
    ratings = gen.gen_ratings(spark, 2_000, cols, 20, 4, 40, 50)
    per_row = ratings.groupBy("user").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("item").alias("d")
    )
    assert per_row.where("n <> d").count() == 0
    n = per_row.agg(F.avg("n"), F.variance("n")).first()
    assert n[0] == pytest.approx(40, abs=0.7) and n[1] == pytest.approx(50, rel=0.15)
    v = ratings.agg(F.avg("rating"), F.variance("rating"), F.min("item"), F.max("item")).first()
    assert v[0] == pytest.approx(20, abs=0.05) and v[1] == pytest.approx(4, rel=0.05)
    assert v[2] >= 0 and v[3] < cols


def test_rating_rows_stay_within_the_columns(spark):
    ratings = gen.gen_ratings(spark, 500, 20, 20, 4, 15, 200)
    n = ratings.groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item").alias("d"))
    assert n.where("n > 20 or n <> d").count() == 0
    assert n.agg(F.max("n")).first()[0] == 20
    assert n.count() < 500  # some rows have no entry


def test_coprime_steps():
    for n in (1, 2, 12, 500, 997, 100_000):
        steps = gen._coprimes(n)
        assert steps and all(math.gcd(s, n) == 1 for s in steps)
        assert len(set(steps)) == len(steps)


def test_lineitem(spark):
    items = gen.gen_lineitem(spark, 0.001, parts=4).cache()
    assert items.count() == 6_000
    assert items.select("l_orderkey", "l_linenumber").distinct().count() == 6_000
    bounds = items.agg(
        F.min("l_orderkey"), F.max("l_orderkey"), F.min("l_partkey"), F.max("l_partkey"),
        F.min("l_suppkey"), F.max("l_suppkey"), F.min("l_quantity"), F.max("l_quantity"),
        F.min("l_discount"), F.max("l_discount"), F.min("l_tax"), F.max("l_tax"),
    ).first()
    assert tuple(bounds) == (1, 1_500, 1, 200, 1, 10, 1, 50, 0, 0.1, 0, 0.08)
    assert items.where("l_receiptdate <= l_shipdate or l_shipdate <= date'1992-01-01'").count() == 0
    assert items.where("(l_returnflag = 'N') <> (l_receiptdate > date'1995-06-17')").count() == 0
    assert items.where("(l_linestatus = 'O') <> (l_shipdate > date'1995-06-17')").count() == 0
    one_order = items.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n"))
    assert one_order.where("n > 4").count() == 0
    assert items.select("l_shipmode").distinct().count() == 7
    items.unpersist()
