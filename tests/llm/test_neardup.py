import random
import sys
from math import comb
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
from tallymill.llm import neardup  # noqa: E402
from tallymill.llm.common import components  # noqa: E402
from tallymill.llm.queries import QUERIES  # noqa: E402
from tallymill.llm.shingles import COORDINATES, WordHashes, shingle_set, sketch  # noqa: E402
from tallymill.sources.tables import read_table  # noqa: E402

SCHEMA = "doc_id bigint, text string, n bigint"


def test_whole_table_like_brute_force(spark, medium):
    docs = {r.doc_id: r.text for r in read_table(spark, medium, "documents").collect()}
    found = QUERIES["op10_minhash_dedup"](spark, medium).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.near_components(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_crowded_buckets_lose_no_link(spark):
    """A base, copies with few edits and copies of those: many share buckets."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(9999)}" for _ in range(150)]
    docs = {}
    for i in range(500):
        words = list(base if i % 3 else docs[rng.randrange(i)].split() if i > 9 else base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(150)] = f"x{rng.randrange(9999)}"
        docs[i] = " ".join(words)
    df = spark.createDataFrame([(i, t, 0) for i, t in docs.items()], SCHEMA)
    found = neardup.near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.near_components(docs)


@pytest.mark.parametrize("words, grows, sizes", [(10**9, 1.2, (250, 500, 1000)), (300, 2, (250, 500))])
def test_pairs_confirmed_among_unlinked_near_copies(spark, monkeypatch, words, grows, sizes):
    """Copies of an absent base, too far apart for a link between most: the pairs whose
    sets are compared grow with the copies where the replaced words hardly recur, and
    towards the square where they do."""
    plain, pairs = neardup._overlaps, []

    def counted(wanted, texts):
        pairs.append(wanted.distinct().count())
        return plain(wanted, texts)

    monkeypatch.setattr(neardup, "_overlaps", counted)
    made = {}
    for n in sizes:
        rng = random.Random(n)
        base, docs = [f"w{i}" for i in range(100)], {}
        for i in range(n):
            copy = list(base)
            for at in rng.sample(range(100), 4):
                copy[at] = f"x{rng.randrange(words)}"
            docs[i] = " ".join(copy)
        pairs.clear()
        df = spark.createDataFrame([(i, t, 0) for i, t in docs.items()], SCHEMA)
        found = neardup.near_duplicates(df).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.near_components(docs)
        made[n] = sum(pairs)
    assert all(made[2 * n] <= 2**grows * made[n] and made[n] < n * n / 10 for n in sizes[:-1])


def test_nulls_ties_repeats_and_clashing_names(spark):
    long = "a b c d e f g " * 20000
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (None, "one two", 0), (4, "One TWO", 0),
            (4, "One TWO", 0), (5, "one  two", 0), (6, long, 0), (7, long, 0), (None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, sig bigint")
    found = neardup.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in found) == [
        (0, 0, 0, True), (0, 1, 4, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True),
        (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False), (6, 7, 6, True), (7, 7, 6, False),
    ]
    kept = neardup.keep_first(df)
    assert kept.columns == ["doc_id", "text", "sig"] and kept.count() == 7
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_every_coordinate_fills_and_estimates_similarity():
    hashes = WordHashes()
    for n in (1, 5, 6, 40, 3000):
        a = shingle_set(" ".join(f"u{i}" for i in range(n)), hashes)
        assert len(sketch(a)) == COORDINATES and (sketch(a) < 2**64 - 1).all()
    words = [f"u{i}" for i in range(1000)]
    a, b = shingle_set(" ".join(words), hashes), shingle_set(" ".join(words[:800]), hashes)
    assert abs(np.mean(sketch(a) == sketch(b)) - len(b) / len(a)) < 0.15


def test_coarse_filter_misses_few_at_the_threshold(spark):
    """Whatever is asked for, the filter passes all but one pair in 100,000."""
    for percent in (50, 75, 90):
        agree = percent / 100 + (1 - percent / 100) / 16
        least = next(m for m in range(COORDINATES, -1, -1) if _passes(spark, m, percent) == [False]) + 1
        missed = sum(comb(COORDINATES, i) * agree**i * (1 - agree) ** (COORDINATES - i) for i in range(least))
        assert 1e-7 < missed < 1e-5


def _passes(spark, equal, percent):
    """Whether the filter passes sketches with so many equal places."""
    bits = [1 if i >= equal else 0 for i in range(COORDINATES)] + [0] * 12
    words = [sum(b << 4 * i for i, b in enumerate(bits[at : at + 16])) for at in range(0, len(bits), 16)]
    row = [(9, [0] * len(words), 9, words)]
    df = spark.createDataFrame(row, "a_size int, a_coarse array<bigint>, b_size int, b_coarse array<bigint>")
    return [r[0] for r in df.select(neardup._alike("a", "b", percent)).collect()]


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    named = {r.node: r.component for r in found.collect()}
    assert named == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}
