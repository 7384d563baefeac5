import zlib

import numpy as np

from tallymill.llm import sharding
from tallymill.llm.queries import QUERIES
from tallymill.sources.tables import read_table


def test_permutation_and_inverse_at_any_size():
    for n in (1, 2, 3, 5, 64, 65, 1000, 4097):
        for seed in (1, -7):
            shuffle = sharding.Shuffle(n, seed)
            place = shuffle.place(np.arange(n))
            assert sorted(place) == list(range(n))
            assert list(shuffle.row(place)) == list(range(n))
    far = np.array([0, 10**14 - 1, 123456789012])
    assert list(sharding.Shuffle(10**14).row(sharding.Shuffle(10**14).place(far))) == list(far)
    assert list(sharding.Shuffle(0).place(np.array([], np.int64))) == []


def test_seeds_and_neighbours_differ():
    a, b = (sharding.Shuffle(10_000, s).place(np.arange(10_000)) for s in (1, 2))
    assert (a == b).mean() < 0.01 and (np.abs(np.diff(a)) < 10).mean() < 0.01
    shards = a[:4000] % 40  # neighbouring rows spread evenly over shards
    assert np.bincount(shards, minlength=40).max() < 160


def test_whole_table(spark, medium):
    docs = {r.doc_id: r.text for r in read_table(spark, medium, "documents").collect()}
    found = {r.doc_id: r for r in QUERIES["op12_sharding"](spark, medium).collect()}
    assert set(found) == set(docs)
    slots = {}
    # ids are unique here, so a document's number is its place among the sorted ids
    shard, slot = sharding.shard_and_slot(np.arange(len(docs)), len(docs))
    assert list(sharding.row_at(shard, slot, len(docs))) == list(range(len(docs)))
    for row, (doc, text) in enumerate(sorted(docs.items())):
        r, data = found[doc], (text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
        assert (r.shard, r.slot) == (shard[row], slot[row])
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(i, [])) for i in range(40)]
    assert max(counts) - min(counts) <= 1


def test_other_files_same_places(spark, medium):
    docs = read_table(spark, medium, "documents")
    a = sharding.shard_table(docs).collect()
    b = sharding.shard_table(docs.orderBy("text").repartition(13)).collect()
    assert sorted(a, key=lambda r: r.doc_id) == sorted(b, key=lambda r: r.doc_id)


def test_nulls_ties_repeats_and_clashing_names(spark, path):
    rows = [(None, None, 1), (None, "é", 2), (3, "", 3), (3, "", 4), (3, "x" * 100_000, 5)]
    rows += [(7, "same", i) for i in range(95)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, slot int")
    found = sharding.shard_table(df).collect()
    assert sorted({(r.doc_id or -1, r.size) for r in found}) == [(-1, 16), (-1, 18), (3, 16), (3, 100_016), (7, 20)]
    assert {r.text_crc32 for r in found if r.size == 16} == {0}
    assert sorted((r.shard, r.slot) for r in found) == [(s, k) for s in range(40) for k in range(3 if s < 20 else 2)]
    assert sharding.shard_table(df.limit(0)).count() == 0
    assert sorted(r.shard for r in sharding.shard_table(df.limit(1)).collect()) == [0]
    stored = sharding.write_shards(df, path(), 7)
    assert stored.columns == ["shard", "slot", "row"]
    back = stored.collect()
    assert sorted(r.row.slot for r in back) == sorted(r[2] for r in rows)
    assert sorted((r.shard, r.slot) for r in back) == sorted((p % 7, p // 7) for p in range(100))
