import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymill.llm import hardnegatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, cell string, v int"


def brute(rows):
    """rows: (vec_id, vector, label), ids distinct."""
    kept = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], label)
        for i, v, label in rows
        if None not in (i, v, label) and None not in v and all(map(math.isfinite, v))
    ]
    dims = max((len(v) for _, v, _ in kept), default=0)
    kept = [(i, v + [0] * (dims - len(v)), label) for i, v, label in kept]
    out = []
    for a, av, al in kept:
        if a % 100:
            continue
        found = [(-sum(x * y for x, y in zip(av, v)), i, label) for i, v, label in kept if i != a]
        for ps, p, _ in sorted(x for x in found if x[2] == al)[:5]:
            fits = sorted(x for x in found if x[2] != al and 80 * -ps <= 100 * -x[0] <= 100 * -ps)[:5]
            out += [(a, p, n + 1, i, -ps, -s) for n, (s, i, _) in enumerate(fits)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, hn.hard_negatives(df, F.col("label"), F.col("vec_id") % 100 == 0).collect()))


def clustered(seed, n=1500, clusters=40, dims=10):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims)) * 3
    at = rng.integers(0, clusters, n)
    x = (centres[at] + rng.normal(size=(n, dims)) * 0.3).astype(np.float32)
    return [(i, x[i].tolist(), int((at[i] + rng.integers(0, 2)) % 7)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(hn, "CELLS", 3)
    monkeypatch.setattr(hn, "FARTHER", 2)
    monkeypatch.setattr(hn, "ANCHORS", 4)
    monkeypatch.setattr(hn, "BLOCK_BYTES", 10 * 8 * 7)
    rows = clustered(seed)
    assert found(spark, rows) == brute(rows)


def test_hot_vector_and_ties(spark):
    """A third of the rows are one vector, in several labels; scores tie."""
    rng = random.Random(5)
    rows = [(i, [1.0, 0.0, 2.0, 0.5], rng.choice([1, 2])) for i in range(0, 200)]
    rows += [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)], rng.choice([1, 2, 3])) for i in range(200, 600)]
    assert found(spark, rows) == brute(rows)


def test_search_ends_before_all_cells(spark):
    vectors = hn.whole_vectors(
        spark.createDataFrame([(*r, "x", 1) for r in clustered(3, clusters=8)], SCHEMA), F.col("label")
    )
    index, rows = hn.build_index(vectors)
    anchors = [r for r in rows.collect() if r.vec_id % 100 == 0]
    cells, visited = int((index.blocks > 0).sum()), 0
    for a in anchors:
        v = np.array([a.v])
        (top1, _), (top2, _) = index.half_bounds(v)
        best, seen = [], 0
        for bound, i, j in hn.cells_by_bound(top1[0], top2[0]):
            if not index.blocks[i, j]:
                continue
            if len(best) == 5 and best[0] > bound + 1:
                break
            seen += 1
            here = [sum(x * y for x, y in zip(a.v, r.v)) for r in rows.where(
                f"cell = {i * index.blocks.shape[1] + j}").collect() if r.vec_id != a.vec_id]
            assert max(here, default=-1e18) <= bound + 1  # the bound holds
            best = sorted(best + here)[-5:]
        visited += seen
    assert visited < cells * len(anchors) / 2


def test_cells_come_in_falling_order():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=7), rng.normal(size=5)
    order = list(hn.cells_by_bound(a, b))
    assert len({(i, j) for _, i, j in order}) == 35
    assert [x for x, _, _ in order] == sorted((x for x, _, _ in order), reverse=True)
    assert list(hn.cells_by_bound(np.zeros(0), np.zeros(0))) == []


def test_nulls_repeats_and_empty(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.9], 2), (3, [1.0], 2), (4, [], 1), (5, None, 1),
            (6, [1.0, None], 2), (7, [inf, 1.0], 2), (8, [nan, 1.0], 2), (9, [1.0, 0.6], None), (None, [1.0, 0.7], 2),
            (100, [0.0, 0.0], 1), (200, [-1.0, -1.0], 3), (11, [0.9, 0.5], 2)]
    want = brute(rows)
    assert found(spark, rows) == want and {r[0] for r in want} >= {0, 100}
    again = rows + [(1, [1.0, 0.5], 1), (2, [1.0, 0.9], 2), (2, [5.0, 5.0], 9)]  # repeated ids count once
    assert found(spark, again) == want
    assert found(spark, []) == [] and found(spark, rows[:1]) == [] and found(spark, rows[:2]) == []
    assert found(spark, [(100 * i, None, 1) for i in range(3)]) == []


def test_large_numbers(spark):
    rows = [(0, [40000.0, 9.0], 1), (1, [39999.5, 1.0], 1), (2, [39000.0, 2.0], 2), (3, [1e6, 1.0], 2)]
    assert found(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(0, [1e15, 1.0], 1), (1, [1e15, 1.0], 1)])


def test_an_anchor_goes_once_to_each_tray(spark, monkeypatch):
    """However many cells anchors visit, few visits are held at once, and a row is made for each tray."""
    monkeypatch.setattr(hn, "TRAY_BYTES", 400 * 8 * 10)
    monkeypatch.setattr(hn, "VISIT_BYTES", 20_000)
    vectors = hn.whole_vectors(spark.createDataFrame([(*r, "x", 1) for r in clustered(4)], SCHEMA), F.col("label"))
    monkeypatch.setattr(hn, "TRAYS_PER_CORE", 0.25)
    index, rows = hn.build_index(vectors)
    slots = {(r.slot, r.tray) for r in rows.collect()}
    assert slots <= set(enumerate(index.trays.tolist())) and len(index.trays) == index.blocks.sum()
    anchors = vectors.toPandas()
    wants = [[{"want": 0, "low": -(1 << 62), "high": 1 << 62}]] * len(anchors)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(anchors["vec_id"]), pa.array(anchors["label"]), pa.array(list(anchors["v"]), pa.list_(pa.int64())),
         pa.array(wants), pa.array([None] * len(anchors), pa.null())], ["id", "label", "v", "wants", "worst"],
    )
    cells = int((index.blocks > 0).sum())
    for begin, end in ((0, 16), (16, cells), (0, cells)):
        made = list(hn._visits(index, begin, end, 1)(iter([batch])))
        assert max(x.nbytes for x in made) < 40_000
        got = pa.Table.from_batches(made).to_pydict()
        assert len(set(zip(got["id"], got["tray"]))) == len(got["id"]) <= len(anchors) * (index.trays.max() + 1)
        assert all(index.trays[s] == t for t, own in zip(got["tray"], got["slots"]) for s in own)
        seen = sum(map(len, got["slots"]))
        assert seen == len(anchors) * len(index.trays) if (begin, end) == (0, cells) else seen >= len(anchors) * (end - begin)


def test_wide_numbers_and_trays(spark, monkeypatch):
    """Components that need 16 and 32 bits; more trays than one."""
    monkeypatch.setattr(hn, "TRAY_BYTES", 60 * 8 * 10)
    for times, kind in ((1, "smallint"), (100, "int")):
        rows = [(i, [float(np.float32(x * times)) for x in v], label) for i, v, label in clustered(6, 400)]
        vectors = hn.whole_vectors(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), F.col("label"))
        assert hn.build_index(vectors)[0].kind == kind
        assert found(spark, rows) == brute(rows)
