"""Alternating least squares.

Ids of a side are dealt to groups by a hash, and groups in a row make up a block.
Ratings and factors travel as packed records, some to a row, to the block where they
are needed. A task writes them to a file of its own and works group by group: it holds
the sums of one group's equations and factors of some groups of the other side.
"""

from __future__ import annotations

import gc
import math
import os
import sys
import tempfile
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallymill.sources.scratch import collecting, materialize, release

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Ratings that a block a side should have at least to be worth a task, and at most.
FEW_RATINGS, MANY_RATINGS = 1 << 13, 1 << 21
# Ratings that a block has at most where the exchange decides.
MOST_RATINGS = 1 << 26
# Bytes of a rating with its two ids, and of a number of a factor or a sum.
RATING_BYTES, NUMBER_BYTES = 12, 4
# Bytes that a task holds, about: sums of a group, factors of the other side, and
# matrices of some ratings at a time.
SUMS_BYTES, TABLE_BYTES, PIECE_BYTES = 96 << 20, 16 << 20, 8 << 20
# Bytes of records in a row, at most, and ratings that are sorted at once.
ROW_BYTES, SORTED_RATINGS = 512, 1 << 19
# Ratings of a cell of the matrix, about, where the error of a fit is computed, and
# bytes of a group's factors there.
CELL_RATINGS, CELL_BYTES = 1 << 22, 16 << 20

RATING = np.dtype([("own", "<i4"), ("other", "<i4"), ("rating", "<f4")])
_STATE = "grp int, seq bigint, data binary"
# Ratings have both groups; a block's own factors have no other group, the other side's no own one.
_ROW = "block int, own int, other int, seq bigint, data binary"


def blocks_for(ratings: int, cores: int, numbers: int | None = None) -> int:
    """Blocks a side: one per core while each has enough ratings, more once they would
    have too many. Every user block exchanges factors with every item block, so a
    needless block costs twice that many messages in every iteration.

    With ``numbers``, how many all factors of both sides have, the exchange decides:
    each factor goes to every block of the other side, so there are as many blocks as
    keep what an iteration sends about as large as the ratings, whatever their size.
    What a task holds does not depend on them.
    """
    blocks = max(1, min(cores, ratings // FEW_RATINGS), -(-ratings // MANY_RATINGS))
    if numbers is None:
        return blocks
    sent = -(-RATING_BYTES * ratings // max(1, NUMBER_BYTES * numbers))
    return max(1, min(blocks, sent), -(-ratings // MOST_RATINGS))


def groups_for(ids: int, rank: int) -> int:
    """Groups of a side whose sums a task can hold: for each id the upper half of a
    symmetric matrix and a vector, and how many ratings it has."""
    return max(1, -(-ids * NUMBER_BYTES * ((rank + 1) * (rank + 2) // 2) // SUMS_BYTES))


def _factor(rank: int) -> np.dtype:
    return np.dtype([("id", "<i4"), ("f", "<f4", (rank,))])


def _first_factors(ids: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Directions that depend on id and seed alone: normal numbers, scaled to length 1."""

    def mixed(x: np.ndarray) -> np.ndarray:
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    start = mixed(ids.astype(np.int64).view(np.uint64) ^ mixed(np.array([seed], np.int64).view(np.uint64)))
    drawn = mixed(start[:, None] + np.arange(2 * rank, dtype=np.uint64)[None, :])
    even = ((drawn >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    x = np.sqrt(-2 * np.log(even[:, :rank])) * np.cos(2 * np.pi * even[:, rank:])
    return (x / np.sqrt((x**2).sum(1))[:, None]).astype(np.float32)


def _packed(records: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Rows of records that do not cross a cut: the stretch and the number in it of each row, and its bytes."""
    size = records.dtype.itemsize
    each = max(1, ROW_BYTES // size)
    rows = -(-np.diff(cuts) // each)
    stretch = np.repeat(np.arange(len(rows)), rows)
    seq = np.arange(len(stretch)) - np.repeat(np.cumsum(rows) - rows, rows)
    begin = np.append(cuts[:-1][stretch] + seq * each, len(records)) * size
    data = pa.py_buffer(np.ascontiguousarray(records))
    return stretch, seq, pa.Array.from_buffers(pa.binary(), len(stretch), [None, pa.py_buffer(begin.astype(np.int32)), data])


class _Spool:
    """Rows written to a file of the task as they come, read back group by group."""

    def __init__(self, file):
        self.file, self.size = file, 0
        self.at: dict[tuple[int, int, int], list[tuple[int, int, int]]] = defaultdict(list)

    def add(self, batch: pa.RecordBatch) -> None:
        key = np.stack([batch[c].to_numpy() for c in ("block", "own", "other", "seq")], 1).astype(np.int64)
        if not len(key):
            return
        order = np.lexsort(key.T[::-1])
        key, data = key[order], batch["data"].take(pa.array(order))
        new = (key[1:, :3] != key[:-1, :3]).any(1) | ((key[1:, 1:3] < 0).any(1) & (key[1:, 3] != key[:-1, 3] + 1))
        offsets = np.frombuffer(data.buffers()[1], np.int64 if pa.types.is_large_binary(data.type) else np.int32)
        offsets = offsets[data.offset : data.offset + len(data) + 1].astype(np.int64)
        self.file.write(memoryview(data.buffers()[2])[offsets[0] : offsets[-1]])
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(key)]])
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            place = (int(key[begin, 3]), self.size + int(offsets[begin] - offsets[0]), int(offsets[end] - offsets[begin]))
            self.at[tuple(key[begin, :3].tolist())].append(place)
        self.size += int(offsets[-1] - offsets[0])

    def parts(self, key: tuple[int, int, int], kind: np.dtype, most: int) -> Iterator[np.ndarray]:
        """The records of a key in order, about ``most`` at a time."""
        self.file.flush()
        got, held = [], 0
        for _, offset, size in sorted(self.at.get(key, ())):
            got.append(os.pread(self.file.fileno(), size, offset))
            held += size
            if held >= most * kind.itemsize:
                yield np.frombuffer(bytearray().join(got), kind)
                got, held = [], 0
        if got:
            yield np.frombuffer(bytearray().join(got), kind)

    def all(self, key: tuple[int, int, int], kind: np.dtype) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *self.parts(key, kind, 1 << 62)])

    def work(self) -> Iterator[tuple[int, int, list[int]]]:
        """Each block's own groups, and the other side's groups that the block has."""
        others = defaultdict(list)
        for block, own, other in sorted(self.at):
            if own < 0:
                others[block].append(other)
        for block, own, other in sorted(self.at):
            if own >= 0 and other < 0:
                yield block, own, others[block]

    def cells(self, block: int, own: int, others: list[int], kind: np.dtype) -> Iterator[tuple[np.ndarray, Iterator]]:
        """Factors of some groups, as many as ``TABLE_BYTES`` have, and the ratings between
        them and a group of the own side, some at a time, with the first factor's place and the number of factors."""
        some, held = [], 0
        for other in [*others, None]:
            size = sum(x[2] for x in self.at[block, -1, other]) if other is not None else 0
            if some and (other is None or held + size > TABLE_BYTES):
                tables = [self.all((block, -1, x), kind) for x in some]
                first = np.cumsum([0, *map(len, tables)])
                yield np.concatenate(tables), (
                    (x, slice(int(first[n]), int(first[n + 1])))
                    for n, of in enumerate(some) for x in self.parts((block, own, of), RATING, SORTED_RATINGS)
                )
                some, held = [], 0
            some, held = [*some, other], held + size


def _spooled(batches: Iterator[pa.RecordBatch], file) -> _Spool:
    spool = _Spool(file)
    for batch in batches:
        spool.add(batch)
    return spool


def _found(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted ids, and whether the ids are there."""
    if not len(ids):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return place, ids[place] == wanted


def _stretches(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple[int, ...], int, int]]:
    """Rows in a row with equal values."""
    key = np.stack([batch[c].to_numpy() for c in names], 1)
    cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
    for begin, end in zip([0, *cuts], [*cuts, len(key)] if len(key) else []):
        yield tuple(key[begin].tolist()), int(begin), int(end)


def _made(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    rows = len(columns["data"] if "data" in columns else columns["n"])
    full = {c: x if isinstance(x, pa.Array) else pa.array(np.broadcast_to(x, rows), kinds[t]) for c, t in names for x in [columns[c]]}
    return pa.RecordBatch.from_arrays([full[c] for c, _ in names], [c for c, _ in names])


def _started(rank: int, seed: int):
    """(grp, id) sorted: the groups' first factors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seq = None, 0
        for batch in batches:
            for (grp,), begin, end in _stretches(batch, ["grp"]):
                if grp != last:
                    last, seq = grp, 0
                made = np.zeros(end - begin, _factor(rank))
                made["id"] = batch["id"].slice(begin, end - begin).to_numpy()
                made["f"] = _first_factors(made["id"], rank, seed)
                _, n, data = _packed(made, np.array([0, len(made)]))
                yield _made(_STATE, grp=grp, seq=seq + n, data=data)
                seq += len(n)

    return run


def _dealt(groups: int, blocks: int, others: int):
    """(grp, to, own, other, rating), in any order: rows of packed ratings between two groups."""

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        grp, to, own, other, rating = (np.concatenate([p[c].to_numpy() for p in parts]) for c in range(5))
        key = grp.astype(np.int64) * others + to
        order = np.lexsort((own, key))
        records = np.zeros(len(order), RATING)
        records["own"], records["other"], records["rating"] = own[order], other[order], rating[order]
        key = key[order]
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        stretch, _, data = _packed(records, cuts)
        key = key[cuts[:-1]][stretch]
        return _made(_ROW, block=key // others * blocks // groups, own=key // others, other=key % others, seq=0, data=data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            parts, held = [*parts, batch], held + batch.num_rows
            if held >= SORTED_RATINGS:
                yield packed(parts)
                parts, held = [], 0
        if held:
            yield packed(parts)

    return run


def _solved(rank: int, reg: float):
    """A block's own factors, the other side's factors and the ratings between them, in any
    order. The block's new factors come out, group by group.

    The equations are solved for what the factors change by, so the sums' rounding
    matters to the change only.
    """
    upper = tuple(x[:-1] for x in np.triu_indices(rank + 1))
    piece = max(64, PIECE_BYTES // (8 * (rank + 1) ** 2))
    kind_of = _factor(rank)

    def add(sums: np.ndarray, counts: np.ndarray, old: np.ndarray, table: np.ndarray, x: np.ndarray) -> None:
        u = x["own"]
        rows = np.empty((len(x), rank + 1))
        rows[:, :rank] = table[x["other"]]
        rows[:, rank] = x["rating"] - np.einsum("ij,ij->i", rows[:, :rank], old[u])
        first = np.concatenate([[0], np.flatnonzero(u[1:] != u[:-1]) + 1])
        many = np.diff(np.append(first, len(u)))
        counts[u[first]] += many
        for n in np.unique(many):
            here = first[many == n]
            some = rows[here[:, None] + np.arange(n)]
            sums[u[here]] += (some.transpose(0, 2, 1) @ some)[:, upper[0], upper[1]]

    def solve(sums: np.ndarray, counts: np.ndarray, old: np.ndarray) -> np.ndarray:
        new = np.empty(old.shape, np.float32)
        for begin in range(0, len(old), piece):
            p = slice(begin, begin + piece)
            full = np.zeros((len(old[p]), rank + 1, rank + 1))
            full[:, upper[0], upper[1]] = full[:, upper[1], upper[0]] = sums[p]
            held = reg * counts[p, None] * np.ones(rank)
            left = full[:, :rank, :rank]
            left[:, np.arange(rank), np.arange(rank)] += held
            right = full[:, :rank, rank] - held * old[p]
            new[p] = old[p] + np.linalg.solve(left, right[:, :, None])[:, :, 0]
        return new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as file:
            spool = _spooled(batches, file)
            for block, grp, others in spool.work():
                own = spool.all((block, grp, -1), kind_of)
                ids, old = own["id"].copy(), own["f"].copy()
                sums, counts = np.zeros((len(own), len(upper[0])), np.float32), np.zeros(len(own), np.int64)
                for table, cells in spool.cells(block, grp, others, kind_of):
                    table_ids, some, held = table["id"].copy(), [], 0
                    table = table["f"].copy()
                    for x, there in chain(cells, [(None, None)]):
                        if x is not None:
                            own_place, own_known = _found(ids, x["own"])
                            place, known = _found(table_ids[there], x["other"])
                            if not (own_known.all() and known.all()):
                                raise ValueError("the ratings changed between two reads")
                            x["own"], x["other"] = own_place, place + there.start
                            some.append(x)
                            held += len(x)
                        if some and (x is None or held >= SORTED_RATINGS):
                            whole = np.concatenate(some)
                            whole = whole[np.argsort(whole["own"], kind="stable")]
                            for n in range(0, len(whole), piece):
                                add(sums, counts, old, table, whole[n : n + piece])
                            some, held = [], 0
                own["f"] = solve(sums, counts, old)
                _, seq, data = _packed(own, np.array([0, len(own)]))
                yield _made(_STATE, grp=grp, seq=seq, data=data)

    return run


def _listed(rank: int):
    """The factors of stored rows, as (id, features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch["data"].to_pylist()), _factor(rank))
            flat = pa.array(np.ascontiguousarray(x["f"]).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * rank), flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x["id"])), lists], ["id", "features"])

    return run


def _keys(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` partitions a number that Spark deals to it."""
    keys: dict[int, int] = {}
    begin = 0
    while len(keys) < n:
        numbers = spark.range(begin, begin + 16 * n + 64).select(F.col("id").cast("int").alias("key"))
        for key, at in numbers.select("key", F.pmod(F.hash("key"), F.lit(n))).collect():
            keys.setdefault(at, key)
        begin += 16 * n + 64
    return [keys[at] for at in range(n)]


class _Side:
    """A side's groups, which blocks they are in, and its factors as stored rows."""

    def __init__(self, blocks: int, groups: int, keys: list[int]):
        self.blocks, self.groups, self.keys = blocks, blocks * max(1, -(-groups // blocks)), keys
        self.paths: list[str] = []
        self.factors: DataFrame | None = None

    def group(self, id_: str) -> Column:
        return F.pmod(F.xxhash64(F.col(id_).cast("int")), F.lit(self.groups)).cast("int")

    def keep(self, factors: DataFrame) -> None:
        """Stored; what was stored before goes, with the files of its exchange."""
        spent = self.paths
        with collecting() as self.paths:
            self.factors = materialize(factors, "factors")
        release(factors.sparkSession, tuple(spent))
        gc.collect()
        factors.sparkSession._jvm.System.gc()

    def ratings(self, other: _Side, rows: DataFrame, mine: str, theirs: str) -> DataFrame:
        """(user, item, rating) as rows of packed ratings."""
        dealt = rows.select(self.group(mine).alias("grp"), other.group(theirs).alias("to"), mine, theirs, "rating")
        return dealt.mapInArrow(_dealt(self.groups, self.blocks, other.groups), _ROW)

    def met(self, other: _Side, ratings: DataFrame) -> DataFrame:
        """By block, a task for each: the own factors at theirs, the other side's at every one, and the ratings."""
        at = F.expr(f"cast(cast(grp as bigint) * {self.blocks} div {self.groups} as int)")
        none, every = F.lit(-1), F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1)))
        own = self.factors.select(at.alias("block"), F.col("grp").alias("own"), none.alias("other"), "seq", "data")
        theirs = other.factors.select(every.alias("block"), none.alias("own"), F.col("grp").alias("other"), "seq", "data")
        rows = own.union(theirs).union(ratings)
        key = F.element_at(F.array(*map(F.lit, self.keys)), F.col("block") + 1)
        return rows.withColumn("key", key).repartition(self.blocks, "key").drop("key")


def factorize(
    df: DataFrame,
    user: str = "user",
    item: str = "item",
    rating: str = "rating",
    rank: int = 15,
    reg: float = 1.0,
    iters: int = 10,
    blocks: int | None = None,
    seed: int | None = None,
    checkpoint_interval: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """(user factors, item factors), each (id, features).

    Each iteration solves the items' equations, then the users'; ``reg`` counts as often
    as an id has ratings. The two factor matrices are kept in ``blocks`` blocks a side;
    by default ratings and ids are counted first and ``blocks_for`` decides, with up to
    twice as many while cores are idle, as ratings are sent as well. A task holds
    no more than one of its block's groups needs, see ``groups_for``; the rest waits in a
    temporary file of the task. Factors are stored after each half of an iteration, so a
    lost executor costs that half at most; ``checkpoint_interval`` has no effect beyond.
    Factors start from ids and ``seed`` alone, so they do not depend on the blocks but for
    rounding. Ids must fit an ``int``; a larger one, a null, or a rating that is null or
    not finite is an error, and so is a table without a rating.
    """
    spark = df.sparkSession
    whole = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit("an id or rating is null"))).otherwise(F.col(c))
    value = whole(rating).cast("float")
    finite = F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.raise_error(F.lit("a rating is not finite")))
    ratings = df.select(
        whole(user).cast("int").alias("user"), whole(item).cast("int").alias("item"),
        finite.otherwise(value).alias("rating"),
    )
    with collecting() as paths:
        ids = [materialize(ratings.groupBy(F.col(c).alias("id")).count(), "ids") for c in ("user", "item")]
        n, sizes = ids[0].agg(F.sum("count")).first()[0], [x.count() for x in ids]
        if not n:
            raise ValueError("no rating to fit")
        if blocks is None:
            cores = spark.sparkContext.defaultParallelism
            blocks = blocks_for(n, cores, rank * sum(sizes))
            blocks = max(blocks, min(2 * blocks, cores, n // FEW_RATINGS))
        keys = _keys(spark, blocks)
        sides = [_Side(blocks, groups_for(size, rank), keys) for size in sizes]
        for side, own in zip(sides, ids):
            dealt = own.select(side.group("id").alias("grp"), "id").repartition("grp").sortWithinPartitions("grp", "id")
            side.keep(dealt.mapInArrow(_started(rank, seed or 0), _STATE))
        users, items = sides
        steps = [
            (own, other, materialize(own.ratings(other, ratings, mine, theirs), "ratings"))
            for own, other, mine, theirs in ((items, users, "item", "user"), (users, items, "user", "item"))
        ]
        for _ in range(iters):
            for own, other, dealt in steps:
                own.keep(own.met(other, dealt).mapInArrow(_solved(rank, reg), _STATE))
        made = [
            materialize(s.factors.mapInArrow(_listed(rank), "id int, features array<float>"), "factors") for s in sides
        ]
    release(spark, tuple(paths[:-2]))
    return made[0], made[1]


def with_sides(users: DataFrame, items: DataFrame) -> DataFrame:
    """Both factor tables as (side, id, features)."""
    return users.select(F.lit("user").alias("side"), "id", "features").unionByName(
        items.select(F.lit("item").alias("side"), "id", "features")
    )


def _packed_factors(rank: int):
    """(grp, id, features): rows of packed factors of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(batch["grp"].to_numpy(), kind="stable")
            x = np.zeros(len(order), _factor(rank))
            x["id"] = batch["id"].to_numpy()[order]
            x["f"] = batch["features"].flatten().to_numpy(zero_copy_only=False).reshape(len(order), rank)[order]
            grp = batch["grp"].to_numpy()[order]
            cuts = np.concatenate([[0], np.flatnonzero(grp[1:] != grp[:-1]) + 1, [len(grp)]])
            if len(grp):
                stretch, seq, data = _packed(x, cuts)
                yield _made(_STATE, grp=grp[cuts[:-1]][stretch], seq=seq, data=data)

    return run


def _errors(rank: int):
    """As ``_solved``: sum of squares and number of the ratings whose two ids have factors."""

    def by_id(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(x["id"], kind="stable")
        return x["id"][order], x["f"][order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = 0.0, 0
        with tempfile.TemporaryFile() as file:
            spool = _spooled(batches, file)
            for block, grp, others in spool.work():
                ids, own = by_id(spool.all((block, grp, -1), _factor(rank)))
                for table, cells in spool.cells(block, grp, others, _factor(rank)):
                    table_ids, table = by_id(table)
                    for whole, _ in cells:
                        for n in range(0, len(whole), 65_536):
                            x = whole[n : n + 65_536]
                            (u, has_u), (v, has_v) = _found(ids, x["own"]), _found(table_ids, x["other"])
                            known = has_u & has_v
                            off = np.einsum("ij,ij->i", own[u[known]].astype(float), table[v[known]].astype(float))
                            off -= x["rating"][known]
                            total, rows = total + float(off @ off), rows + int(known.sum())
        yield _made("s double, n bigint", s=[total], n=[rows])

    return run


def fit_error(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """(rmse): how far the factors' products are from the ratings.

    Users are cut into blocks; a block has about as many users as a square cell of
    ``CELL_RATINGS`` ratings would. A user's factor goes to its block, an item's once to
    each. Joined rating by rating, every rating would carry a factor through an exchange.
    A task works group by group and holds no more than ``CELL_BYTES`` of a group's factors.
    """
    known = ratings.where("user is not null and item is not null and rating is not null")
    sizes = [x.agg(F.max(F.size("features")), F.count(F.lit(1))).first() for x in (users, items)]
    rank = max(x[0] or 0 for x in sizes)
    blocks = math.isqrt(max(0, known.count() - 1) // CELL_RATINGS) + 1
    keys = _keys(ratings.sparkSession, blocks)
    sides = [_Side(blocks, -(-n * rank * NUMBER_BYTES // CELL_BYTES), keys) for _, n in sizes]
    for side, factors in zip(sides, (users, items)):
        rows = factors.select(side.group("id").alias("grp"), F.col("id").cast("int").alias("id"), "features")
        side.factors = rows.mapInArrow(_packed_factors(rank), _STATE)
    of_ids = known.select(F.col("user").cast("int"), F.col("item").cast("int"), F.col("rating").cast("float"))
    met = sides[0].met(sides[1], sides[0].ratings(sides[1], of_ids, "user", "item"))
    errors = met.mapInArrow(_errors(rank), "s double, n bigint")
    return errors.agg(F.sqrt(F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("rmse"))
