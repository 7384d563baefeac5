import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.operators import factorize as fz
from tallymill.operators.factorize import MANY_RATINGS, blocks_for, factorize, fit_error, with_sides
from tallymill.sources.generate import gen_ratings


def test_factors_rebuild_a_low_rank_matrix(spark):
    cells = spark.range(40).selectExpr("id as user").join(spark.range(30).selectExpr("id as item"))
    rated = cells.where((F.col("user") + F.col("item")) % 5 != 0).withColumn(
        "rating", (1 + F.col("user") % 4) * (1 + F.col("item") % 3) / 1.0
    )
    users, items = factorize(rated, rank=2, reg=0.001, blocks=3, seed=3)
    dot = F.aggregate(
        F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x
    )
    joined = rated.join(users.selectExpr("id as user", "features as u"), "user").join(
        items.selectExpr("id as item", "features as v"), "item"
    )
    worst = joined.agg(F.max(F.abs(dot - F.col("rating")))).first()[0]
    assert worst < 0.05


def test_defaults_and_every_id(spark):
    ratings = gen_ratings(spark, 60, 50, 20, 4, 10, 4)
    users, items = factorize(ratings, iters=2)
    assert 0 < fit_error(ratings, users, items).first().rmse < 20
    sides = with_sides(users, items)
    sizes = {(r.side, r.id): len(r.features) for r in sides.collect()}
    assert set(sizes.values()) == {15}
    wanted = {("user", r.user) for r in ratings.collect()} | {("item", r.item) for r in ratings.collect()}
    assert set(sizes) == wanted


def test_blocks_follow_the_ratings():
    assert blocks_for(0, 8) == blocks_for(100, 1000) == 1
    assert blocks_for(600_000, 8) == 8  # one per core
    assert blocks_for(600_000, 1000) == 73  # too few ratings for more
    assert blocks_for(320_000_000, 20) == 153 and 320_000_000 / 153 <= MANY_RATINGS
    assert blocks_for(10**12, 1000) * MANY_RATINGS >= 10**12


def test_a_hundred_blocks_when_asked(spark):
    ratings = gen_ratings(spark, 30, 20, 20, 4, 5, 4)
    users, items = factorize(ratings, iters=1, blocks=100)
    assert users.count() <= 30 and items.count() <= 20


def test_an_id_beyond_int_is_an_error(spark):
    big = spark.createDataFrame([(2**40, 1, 1.0)], "user bigint, item int, rating double")
    with pytest.raises(Exception, match="CAST_OVERFLOW|overflow"):
        factorize(big, blocks=1, iters=1)


def test_an_iteration_sends_no_more_than_the_ratings_weigh():
    """The blocks stay as the table grows, until one could not hold its ratings."""
    for times in (1, 10, 60):
        n, numbers = 3_600_000 * times, 210_000 * 15 * times
        blocks = blocks_for(n, 12, numbers)
        assert blocks == 4 and (blocks - 1) * 4 * numbers <= 12 * n
    assert blocks_for(3_600_000, 2, 210_000 * 15) == 2
    assert blocks_for(0, 8, 0) == blocks_for(100, 8, 30) == 1
    assert blocks_for(10**12, 12, 10**12) == -(-(10**12) // fz.MOST_RATINGS)


@pytest.mark.parametrize("held", [1 << 22, 7])
def test_fit_error_cell_by_cell(spark, monkeypatch, held):
    """Ratings twice, without factors or null; no factor travels with a rating."""
    monkeypatch.setattr(fz, "CELL_RATINGS", held)
    u = {i: [float(i), 1.0] for i in range(9)}
    v = {i: [0.5, float(-i)] for i in range(7)}
    cells = [(i, j, float(i * j)) for i in range(11) for j in range(8)] + [(1, 2, 5.0)] * 2 + [(1, 1, None), (None, 1, 2.0)]
    ratings = spark.createDataFrame(cells, "user int, item int, rating float")
    sides = [spark.createDataFrame(list(x.items()), "id int, features array<float>") for x in (u, v)]
    got = fit_error(ratings, *sides)
    off = [sum(a * b for a, b in zip(u[i], v[j])) - r for i, j, r in cells if i in u and j in v and r is not None]
    assert got.first().rmse == pytest.approx(math.sqrt(sum(x * x for x in off) / len(off)))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert fit_error(ratings.where("user = 10"), *sides).first().rmse is None
    assert fit_error(ratings.limit(0), *sides).first().rmse is None


def plain(rows, rank, reg, iters, seed):
    """Alternating least squares, id by id, in doubles."""
    ids = [sorted({r[k] for r in rows}) for k in (0, 1)]
    x = [dict(zip(i, fz._first_factors(np.array(i, np.int32), rank, seed).astype(float))) for i in ids]
    for _ in range(iters):
        for own, other in ((1, 0), (0, 1)):
            of = {i: [r for r in rows if r[own] == i] for i in ids[own]}
            for i, some in of.items():
                v = np.array([x[other][r[other]] for r in some])
                left = v.T @ v + reg * len(some) * np.eye(rank)
                x[own][i] = np.linalg.solve(left, v.T @ np.array([r[2] for r in some]))
    return x


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_factors_do_not_depend_on_blocks_or_what_is_held(spark, monkeypatch, blocks):
    """Ratings twice, an id with nearly all ratings; groups of few ids, tables of one group."""
    rows = [(i, j, float((3 * i + 5 * j) % 7)) for i in range(-20, 20) for j in range(12) if i == 3 or (i + 2 * j) % 3 == 0]
    rows += rows[:30] + [(2**31 - 1, 0, 4.0), (3, -(2**31), 1.0)]
    want = plain(rows, 3, 0.1, 3, 5)
    df = spark.createDataFrame(rows, "user int, item int, rating float").repartition(7)
    for held in (False, True):
        if held:
            for name, n in (("SUMS_BYTES", 200), ("TABLE_BYTES", 50), ("SORTED_RATINGS", 16), ("ROW_BYTES", 40), ("PIECE_BYTES", 1)):
                monkeypatch.setattr(fz, name, n)
        for side, own in zip(factorize(df, rank=3, reg=0.1, iters=3, blocks=blocks, seed=5), want):
            got = {r.id: r.features for r in side.collect()}
            assert set(got) == set(own)
            for i, x in own.items():
                assert got[i] == pytest.approx(x, rel=1e-3, abs=1e-4)


def test_a_task_holds_the_sums_of_a_group(spark):
    """However many ids a side has: with 4 blocks of 54 million ratings, one held 2.7 GB while it was built."""
    for ids in (10, 900_000, 7_200_000, 10**9):
        assert -(-ids // fz.groups_for(ids, 15)) * 136 * 4 <= fz.SUMS_BYTES + 136 * 4
    assert {tuple(x) for n in (1, 2, 7, 60) for x in [spark.createDataFrame([(k,) for k in fz._keys(spark, n)], "key int")
            .selectExpr(f"pmod(hash(key), {n}) as at").toPandas()["at"]]} == {tuple(range(n)) for n in (1, 2, 7, 60)}


@pytest.mark.parametrize("bad", [(None, 1, 1.0), (1, None, 1.0), (1, 1, None), (1, 1, math.nan), (1, 1, -math.inf)])
def test_nulls_and_infinite_ratings_are_errors(spark, bad):
    with pytest.raises(Exception, match="null|finite"):
        factorize(spark.createDataFrame([(1, 2, 1.0), bad], "user int, item int, rating double"), blocks=1, iters=1)
