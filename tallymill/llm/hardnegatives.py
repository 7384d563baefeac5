"""Hard negatives by an inverted multi-index that is searched until the answer is certain.

The vectors are cut into halves and each half has a codebook; a pair of codewords is
a cell. A row's score with an anchor is at most the sum of two half scores, each that
of the codeword plus the anchor's half length times the codeword's radius. So cells
in falling order of that sum can be left alone once the sum is below what is wanted.
"""

from __future__ import annotations

import heapq
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymill.llm.common import column
from tallymill.sources.scratch import materialize

# Workers get this module with the task, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

POSITIVES, NEGATIVES = 5, 5
# A negative's score, in percent of the positive's.
LEAST, MOST = 80, 100
SCALE = 256
# Rows that the codebooks are fitted on at most, and codewords of a half at most. The
# cells' directory, which every task gets, has at most the square of that.
SAMPLE, MOST_CODES = 16_384, 256
# A block has so many bytes of one cell's vectors, about; as many are scored with so
# many anchors at once; a part of the anchors has so many, about.
BLOCK_BYTES, AT_ONCE, ANCHORS = 2 << 20, 256, 65_536
# Blocks go together in trays; a task holds so many bytes of one, about. Visits are
# handed on once they have as many bytes as that, about.
TRAY_BYTES, VISIT_BYTES = 16 << 20, 4 << 20
TRAYS_PER_CORE = 4
# Cells that each anchor visits in the first round; later rounds go so many times as far.
CELLS, FARTHER = 16, 8

_FAR = 1 << 62
_TYPES = {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}
_WANT = "struct<want:int,low:bigint,high:bigint>"
_CODED = "vec_id bigint, label bigint, v array<bigint>, cell int, c1 int, c2 int, r1 double, r2 double"
_HIT = "anchor_id bigint, want int, score bigint, id bigint"


def matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dims)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, in floating point where that is exact."""
    a, b = (x.astype(np.int64, copy=False) for x in (a, b))
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    raise OverflowError("a score may not fit 64 bits")


@dataclass
class Index:
    """Codebooks, their radii, how many blocks each cell has, the tray of each block, cell
    after cell, and the type that holds every component; the rows stay in ``rows``."""

    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    blocks: np.ndarray
    dims: int
    trays: np.ndarray
    kind: str

    def halves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return v[:, : self.dims // 2].astype(float), v[:, self.dims // 2 :].astype(float)

    def codes(self, v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half, the nearest codeword of each row and the distance from it."""
        out = []
        for x, book in zip(self.halves(v), self.books):
            near = ((book**2).sum(1)[None, :] - 2 * x @ book.T).argmin(1)
            out.append((near, np.sqrt(((x - book[near]) ** 2).sum(1))))
        return out

    def half_bounds(self, v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half, the most and the least that a row with each codeword can score."""
        out = []
        for x, book, radius in zip(self.halves(v), self.books, self.radii):
            middle, around = x @ book.T, np.sqrt((x**2).sum(1))[:, None] * radius[None, :]
            out.append((middle + around, middle - around))
        return out


def cells_by_bound(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, i, j) in falling order of first[i] + second[j], by a heap that holds
    a pair only when the pair before it in its row has been given."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap = [(-float(first[a[0]] + second[b[0]]), 0, 0)] if len(a) and len(b) else []
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(a[i]), int(b[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-float(first[a[i]] + second[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-float(first[a[i + 1]] + second[b[0]]), i + 1, 0))


def _above(bound: float) -> float:
    """``bound`` with room for what floating point may have lost."""
    return bound + 1 + 1e-9 * abs(bound)


def _slots(first: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Numbers of blocks: so many from each first one on."""
    before = np.cumsum(blocks) - blocks
    return np.repeat(first - before, blocks) + np.arange(blocks.sum())


def _visits(index: Index, begin: int, end: int, parts: int):
    """The blocks of the cells from number ``begin`` to ``end`` on each anchor's way, unless
    what it still wants is certain before: a row for each tray, with the tray's blocks.

    An anchor's bounds are computed by itself, so every round has its cells in the same
    order. However many the visits, no more than ``VISIT_BYTES`` are held, about.
    """
    schema = _arrow(index.kind)
    filled = np.flatnonzero(index.blocks)
    first, second = np.divmod(filled, max(1, index.blocks.shape[1]))
    blocks = index.blocks.ravel()[filled]
    starts = np.cumsum(blocks) - blocks

    def made(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        tray, part, at, slots, wants = zip(*rows) if rows else [()] * 5
        at = pa.array(at, pa.int64())
        own = {"tray": tray, "part": part, "slots": slots, "wants": wants}
        columns = [pa.array(own[f.name], f.type) if f.name in own else batch[f.name].take(at) for f in schema]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            v = matrix(batch["v"], index.dims).astype(np.int64)
            ids = batch["id"].to_pylist()
            for n, (wants, worst) in enumerate(zip(batch["wants"].to_pylist(), batch["worst"].to_pylist())):
                (top1, low1), (top2, low2) = index.half_bounds(v[n : n + 1])
                if max(np.abs(x).max(initial=0) for x in (top1, low1, top2, low2)) * 2 >= _FAR:
                    raise OverflowError("a score may not fit 64 bits")
                bound, lowest = top1[0, first] + top2[0, second], low1[0, first] + low2[0, second]
                here = np.argsort(-bound, kind="stable")[begin:end]
                bound, lowest = _above(bound[here]), -_above(-lowest[here])
                # what is no worse than the last of enough hits is all that can still count
                worst = dict(worst or [])
                left = [{**w, "low": max(w["low"], worst.get(w["want"], w["low"]))} for w in wants]
                met = [(bound >= w["low"]) & (lowest <= w["high"]) for w in left]
                left = [w for w, x in zip(left, met) if x.any()]
                if not left:
                    continue
                here = np.sort(here[np.logical_or.reduce(met)])
                slots = _slots(starts[here], blocks[here])
                trays, cuts = np.unique(index.trays[slots], return_index=True)
                for tray, own in zip(trays.tolist(), np.split(slots, cuts[1:])):
                    rows.append((tray, hash(ids[n]) % parts, n, own, left))
                    held += v[n].nbytes + own.nbytes + 64 * len(left)
                    if held >= VISIT_BYTES:
                        yield made(batch, rows)
                        rows, held = [], 0
            yield made(batch, rows)

    return run


def _arrow(kind: str) -> pa.Schema:
    wants = pa.list_(pa.struct([("want", pa.int32()), ("low", pa.int64()), ("high", pa.int64())]))
    return pa.schema([
        ("tray", pa.int32()), ("part", pa.int32()), ("id", pa.int64()), ("label", pa.int64()),
        ("v", pa.list_(_TYPES[kind])), ("slots", pa.list_(pa.int32())), ("wants", wants),
    ])


def _visit(kind: str) -> str:
    return f"tray int, part int, id bigint, label bigint, v array<{kind}>, slots array<int>, wants array<{_WANT}>"


def _firsts(k: int, anchor: np.ndarray, want: np.ndarray, score: np.ndarray, id_: np.ndarray) -> tuple:
    """The first ``k`` for each want of each anchor."""
    order = np.lexsort((id_, -score, want, anchor))
    anchor, want, score, id_ = (x[order] for x in (anchor, want, score, id_))
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (want[1:] != want[:-1])
    at = np.arange(len(anchor))
    kept = at - np.maximum.accumulate(np.where(new, at, 0)) < k
    return anchor[kept], want[kept], score[kept], id_[kept]


def _scored(dims: int, same: bool, k: int):
    """Rows sorted by tray and part, vectors before visits: the tray's vectors are held,
    visits stream by; the first ``k`` of a tray for each want come out."""
    panel = max(1, BLOCK_BYTES // (8 * dims))

    def hits(a: np.ndarray, ids: np.ndarray, labels: np.ndarray, wants: list, at: np.ndarray, slots: np.ndarray, tray: tuple) -> tuple:
        """``at`` and ``slots`` are the pairs of an anchor's place and a block that it visits."""
        row_ids, row_labels, rows, row_slots = tray
        own, place = np.unique(row_slots, return_inverse=True)
        to = np.minimum(np.searchsorted(own, slots), len(own) - 1)
        there = own[to] == slots  # a block may have no row
        visited = np.zeros((len(a), len(own)), dtype=bool)
        visited[at[there], to[there]] = True
        low, high = np.full((2, len(a), max(map(len, wants))), _FAR)
        high = -high
        for n, w in enumerate(wants):
            low[n, : len(w)], high[n, : len(w)] = [x["low"] for x in w], [x["high"] for x in w]
        number = np.array([[x["want"] for x in w] + [0] * (low.shape[1] - len(w)) for w in wants])
        best = tuple(np.zeros(0, np.int64) for _ in range(4))
        for begin in range(0, len(rows), panel):
            p = slice(begin, begin + panel)
            span = visited[:, place[begin] : place[p][-1] + 1]
            who = np.flatnonzero(span.any(1))
            if not len(who):
                continue
            table = scores(a[who], rows[p])
            same_label = labels[who, None] == row_labels[None, p]
            fits = same_label & (ids[who, None] != row_ids[None, p]) if same else ~same_label
            fits &= span[who][:, place[p] - place[begin]]
            fits &= (table >= low[who].min(1)[:, None]) & (table <= high[who].max(1)[:, None])
            x, y = np.nonzero(fits)
            s, x, y = table[x, y], who[x], row_ids[p][y]
            for w in range(low.shape[1]):
                ok = (s >= low[x, w]) & (s <= high[x, w])
                more = _firsts(k, x[ok], number[x[ok], w], s[ok], y[ok])
                best = tuple(np.concatenate(z) for z in zip(best, more))
            best = _firsts(k, *best)
        return ids[best[0]], *best[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, tray = None, [], None
        for batch in batches:
            key = np.stack([batch[c].to_numpy() for c in ("tray", "part", "kind")], 1)
            ids, labels = batch["id"].to_numpy(), batch["label"].to_numpy()
            v = matrix(batch["v"], dims)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(key)] if len(key) else []):
                at, kind = tuple(key[begin, :2]), key[begin, 2]
                if at != held:
                    held, parts, tray = at, [], None
                if kind == 0:
                    slots = batch["slots"].slice(begin, end - begin).flatten().to_numpy()
                    parts.append((ids[begin:end], labels[begin:end], v[begin:end], slots))
                    continue
                if tray is None and parts:
                    tray = tuple(np.concatenate(x) for x in zip(*parts))
                    order = np.argsort(tray[3], kind="stable")
                    tray, parts = tuple(x[order] for x in tray), []
                if tray is None:
                    continue
                for n in range(begin, end, AT_ONCE):
                    m = min(end, n + AT_ONCE)
                    slots = batch["slots"].slice(n, m - n)
                    of = np.repeat(np.arange(m - n), [len(x) for x in slots])
                    wants = batch["wants"].slice(n, m - n).to_pylist()
                    out = hits(v[n:m].astype(np.int64), ids[n:m], labels[n:m], wants, of, slots.flatten().to_numpy(), tray)
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(out, kinds)], ["anchor_id", "want", "score", "id"]
                    )

    return run


def whole_vectors(
    rows: DataFrame, label: Column, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """(vec_id, label, v): the rows that take part, their components scaled and floored.

    Left out: rows with a null id, label, vector or component, or one that is not
    finite. Of rows with one id the smallest by label, then vector counts.
    """
    kept = rows.select(
        column(vec_id).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), column(vector).alias("x")
    )
    whole = F.transform("x", lambda c: F.floor(scale * c.cast("double")))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    kept = materialize(kept.select("vec_id", "label", whole.alias("v")), "vectors")
    many = materialize(kept.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated")
    if many.isEmpty():
        return kept
    firsts = kept.join(many, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x"))
    return kept.join(many, "vec_id", "left_anti").union(firsts.select("vec_id", "x.label", "x.v"))


def _books(vectors: DataFrame, dims: int, codes: int) -> list[np.ndarray]:
    sample = materialize(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v"), "sample")
    books = []
    for begin, length in ((1, dims // 2), (dims // 2 + 1, dims - dims // 2)):
        half = sample.select(array_to_vector(F.slice("v", begin, length)).alias("features"))
        books.append(np.array(KMeans(k=codes, seed=1, maxIter=10).fit(half).clusterCenters()))
    return books


def build_index(vectors: DataFrame) -> tuple[Index, DataFrame]:
    """The index, and all vectors by cell and block: (vec_id, label, v, cell, block, slot, tray).

    Vectors are as long as the longest; shorter ones go on with zeros. Codewords of a
    half are about the fourth root of the rows, so a cell has about the square root;
    they are fitted on 16,384 rows chosen by a hash of the id, which decides how far a
    search goes but not what it finds. A cell of any size is cut into blocks by a hash.
    A block's slot is its number, cell after cell; blocks in a row share a tray, and there
    are some trays for each core where there are so many blocks.
    """
    most = F.greatest(F.array_max("v"), F.lit(-1).cast("bigint") - F.array_min("v"))
    rows, longest, most = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(most)).first()
    kind = next(t for t, x in _TYPES.items() if (most or 0) < 1 << (x.bit_width - 1))
    dims = max(2, longest or 0)
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(dims) - F.size("v"))
    vectors = vectors.withColumn("v", F.concat("v", zeros))
    codes = min(MOST_CODES, max(2, math.ceil(rows**0.25)))
    books = _books(vectors, dims, codes) if rows else [np.zeros((0, 1))] * 2
    blocks = np.zeros((len(books[0]), len(books[1])), int)
    index = Index(tuple(books), (np.zeros(0), np.zeros(0)), blocks, dims, np.zeros(0, int), kind)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (c1, r1), (c2, r2) = index.codes(matrix(batch["v"], dims))
            cell = c1 * len(index.books[1]) + c2
            made = [pa.array(x.astype(np.int32)) for x in (cell, c1, c2)] + [pa.array(r1), pa.array(r2)]
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["label"], batch["v"], *made],
                ["vec_id", "label", "v", "cell", "c1", "c2", "r1", "r2"],
            )

    if not rows:
        zero = [F.lit(0).alias(c) for c in ("cell", "block", "slot", "tray")]
        return index, vectors.select("vec_id", "label", "v", *zero)
    by_cell = materialize(vectors.select("vec_id", "label", "v").mapInArrow(coded, _CODED), "coded")
    block_rows = max(1, BLOCK_BYTES // (8 * dims))
    cells = by_cell.groupBy("cell", "c1", "c2").agg(
        F.count(F.lit(1)).alias("rows"), F.max("r1").alias("r1"), F.max("r2").alias("r2")
    )
    radii = [np.zeros(len(b)) for b in books]
    directory = sorted(cells.collect(), key=lambda c: c.cell)  # the square of MOST_CODES rows at most
    for c in directory:
        index.blocks[c.c1, c.c2] = -(-c.rows // block_rows)
        for radius, code, r in ((radii[0], c.c1, c.r1), (radii[1], c.c2, c.r2)):
            radius[code] = max(radius[code], r)
    index.radii = tuple(radii)
    spark = vectors.sparkSession
    parts = min(int(index.blocks.sum()), TRAYS_PER_CORE * spark.sparkContext.defaultParallelism)
    tray_rows = max(1, min(TRAY_BYTES // (8 * dims), -(-rows // parts)))
    listed, trays, before = [], [], 0
    for c in directory:
        blocks = int(index.blocks[c.c1, c.c2])
        listed.append((c.cell, blocks, len(trays), before, c.rows))
        trays += [(before + b * c.rows // blocks) // tray_rows for b in range(blocks)]
        before += c.rows
    index.trays = np.array(trays)
    places = spark.createDataFrame(listed, "cell int, blocks int, first int, before bigint, rows bigint")
    block = F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")
    joined = by_cell.select("vec_id", "label", "v", "cell").join(materialize(places, "places"), "cell")
    joined = joined.withColumn("block", block)
    return index, joined.select(
        "vec_id", "label", "v", "cell", "block", (F.col("first") + F.col("block")).alias("slot"),
        F.expr(f"cast((before + block * rows div blocks) div {tray_rows}L as int)").alias("tray"),
    )


def search(anchors: DataFrame, index: Index, rows: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor_id, want, score, id): the first ``k`` rows for each want of each anchor,
    higher scores first, then smaller ids, of its own label or only of others.

    ``anchors`` is (id, label, v, wants); a want is a number and the least and the
    largest score. Rounds of visits go farther along each anchor's cells, and end when
    no anchor wants a cell any more. A round's visits are dealt by cell, block and a
    part of the anchors, so neither a crowded cell nor many like anchors meet in one
    task; only the first hits of each block are shuffled. Each round is stored.
    """
    spark = anchors.sparkSession
    parts = max(1, math.ceil(anchors.count() / ANCHORS))
    hits = spark.createDataFrame([], _HIT)
    narrow = F.col("v").cast(f"array<{index.kind}>").alias("v")
    begin, end, cells = 0, CELLS, int((index.blocks > 0).sum())
    while begin < cells:
        enough = hits.groupBy(F.col("anchor_id").alias("a"), "want").agg(
            F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")
        ).where(F.col("n") == k)
        worst = enough.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("want", "worst"))).alias("worst"))
        open_ = anchors.join(worst, F.col("id") == F.col("a"), "left").select("id", "label", narrow, "wants", "worst")
        visits = materialize(open_.mapInArrow(_visits(index, begin, end, parts), _visit(index.kind)), "visits")
        if visits.isEmpty():
            break
        part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        wanted = rows.join(visits.select("tray").distinct(), "tray", "left_semi")
        wanted = wanted.select("tray", part, F.col("vec_id").alias("id"), "label", narrow, F.array("slot").alias("slots"))
        both = wanted.withColumn("wants", F.lit(None).cast(f"array<{_WANT}>")).withColumn("kind", F.lit(0)).union(
            visits.withColumn("kind", F.lit(1))
        )
        place = ["tray", "part"]
        dealt = both.repartition(*place).sortWithinPartitions(*place, "kind")
        found = hits.union(dealt.mapInArrow(_scored(index.dims, same, k), _HIT))
        best = Window.partitionBy("anchor_id", "want").orderBy(F.desc("score"), "id")
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        hits = materialize(ranked.drop("rank"), "hits")
        begin, end = end, end * FARTHER
    return hits


def hard_negatives(
    rows: DataFrame, label: Column, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of scaled, floored vectors (see ``whole_vectors``).
    An anchor's positives are its first five other rows of its label; each positive
    has the first five rows of other labels with 80 to 100 percent of its score. Ties
    go to the smaller id. The result is exact: a search ends when the bound of every
    cell not visited rules it out. ``is_anchor`` is a condition on ``vec_id``.

    Anchors without another row of their label, and positives without a row in their
    window, give no rows; a positive with a negative score has an empty window, one
    with score 0 only rows with score 0. Rows that take no part are neither anchors
    nor found. Shorter vectors go on with zeros. Repeated ids count once. Scores that
    may not fit 64 bits are an error. Other columns play no part; no row in, none out.
    """
    vectors = whole_vectors(rows, label, vec_id, vector)
    index, indexed = build_index(vectors)
    indexed = materialize(indexed, "indexed")
    anchors = materialize(indexed.where(is_anchor).select(F.col("vec_id").alias("id"), "label", "v"), "anchors")
    any_score = F.array(F.struct(F.lit(0).alias("want"), F.lit(-_FAR).alias("low"), F.lit(_FAR).alias("high")))
    positives = search(anchors.withColumn("wants", any_score), index, indexed, True, POSITIVES)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    positives = positives.select(
        "anchor_id", (F.row_number().over(best) - 1).alias("want"), F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    positives = materialize(positives, "positives")
    windows = positives.where("positive_score >= 0").withColumn(
        "low", F.expr(f"({LEAST}L * positive_score + 99L) div 100L")
    ).withColumn("high", F.expr(f"{MOST}L * positive_score div 100L"))
    wants = windows.groupBy(F.col("anchor_id").alias("a")).agg(
        F.collect_list(F.struct("want", "low", "high")).alias("wants")
    )
    asking = anchors.join(wants, F.col("id") == F.col("a")).select("id", "label", "v", "wants")
    found = search(materialize(asking, "asking"), index, indexed, False, NEGATIVES)
    of_pair = Window.partitionBy("anchor_id", "want").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(of_pair)).join(positives, ["anchor_id", "want"])
    return found.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
