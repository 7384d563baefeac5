"""Near-duplicate documents: sketches, banding, verification on whole sets."""

from __future__ import annotations

import sys
from math import comb
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tallymill.llm.common import column, components
from tallymill.llm.shingles import (
    COORDINATES, WordHashes, band_keys, coarse, shingle_set, signature, sketch,
)
from tallymill.sources.scratch import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PERCENT = 75
# Two sets are compared in full unless their coarse sketches share so few places as
# sets of the similarity asked for do with this probability at most.
COARSE_MISS = 1e-5
# Centres of a bucket, about, in the rounds that look at each document's largest
# mixed bucket.
CENTRES = (8, 64)
# Members compared with one centre by one task, about.
MEMBERS = 256

_SKETCHED = "doc_id bigint, fp bigint, n_shingles bigint, sig binary, bands array<bigint>, coarse array<bigint>"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        n, sig, bands, small = [], [], [], []
        for text in batch["t"]:
            s = shingle_set(text.as_py(), hashes)
            n.append(len(s))
            c = sketch(s) if len(s) else None
            sig.append(signature(s) if len(s) else None)
            bands.append(band_keys(c) if len(s) else None)
            small.append(coarse(c) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"], batch["fp"], pa.array(n, pa.int64()), pa.array(sig, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())), pa.array(small, pa.list_(pa.int64())),
            ],
            ["doc_id", "fp", "n_shingles", "sig", "bands", "coarse"],
        )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, salt, member): the centre's text comes first, then the
    members, one at a time; only the centre's set is held."""
    hashes, at, centre = WordHashes(), None, np.empty(0, np.uint64)
    for batch in batches:
        out = []
        for a, salt, b, text in zip(*(batch[c].to_pylist() for c in ("a", "salt", "b", "t"))):
            if b is not None:
                member = shingle_set(text, hashes)
                shared = len(np.intersect1d(centre, member, assume_unique=True))
                out.append((a, b, len(centre), len(member), shared))
            elif at != (a, salt):
                at, centre = (a, salt), shingle_set(text, hashes)
        columns = zip(*out) if out else [()] * 5
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = ["a", "b", "a_size", "b_size", "shared"]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names)


def coarse_equal(percent: int) -> int:
    """Places of the coarse sketch that two sets must share to be compared in full.
    A place agrees if the coordinates do, or by chance in one of 16 cases."""
    agree, below = percent / 100 + (1 - percent / 100) / 16, 0.0
    for places in range(COORDINATES + 1):
        below += comb(COORDINATES, places) * agree**places * (1 - agree) ** (COORDINATES - places)
        if below > COARSE_MISS:
            return places
    return COORDINATES


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether sets with these sizes and coarse sketches can be similar."""
    less, more = F.least(f"{a}_size", f"{b}_size"), F.greatest(f"{a}_size", f"{b}_size")
    differ = F.lit(0)
    for i in range(-(-COORDINATES // 16)):
        x = F.get(f"{a}_coarse", F.lit(i)).bitwiseXOR(F.get(f"{b}_coarse", F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return (100 * less >= percent * more) & (differ <= COORDINATES - coarse_equal(percent))


def _overlaps(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, a_size, b_size, shared) of pairs (a: centre, b: member), on their whole
    sets. A centre of many members goes to several tasks; few are such."""
    pairs = materialize(pairs.distinct(), "pairs")
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("salts")).where("salts > 1")
    many = materialize(many, "many")
    salts = F.coalesce("salts", F.lit(1))
    text_of = lambda c: texts.select(F.col("sig").alias(c), "t")
    centres = pairs.select("a").distinct().join(many, "a", "left").join(text_of("a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(None).cast("binary").alias("b"), "t"
    )
    members = pairs.join(many, "a", "left").join(text_of("b"), "b").select(
        "a", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"), "b", "t"
    )
    rows = centres.union(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")
    sizes = "a binary, b binary, a_size bigint, b_size bigint, shared bigint"
    return materialize(rows.mapInArrow(_compared, sizes), "overlaps")


def _similar(overlaps: DataFrame, percent: int) -> DataFrame:
    return overlaps.where(100 * F.col("shared") >= percent * F.expr("a_size + b_size - shared")).select("a", "b")


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for sig, text in zip(batch["sig"], batch["t"]):
            s = shingle_set(text.as_py(), hashes).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([sig.as_py()] * len(s), pa.binary()), pa.array(s)], ["sig", "h"])


def _alone(sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """(sig, alone): of each set, the shingles that no other of these sets has. The rest
    of a set is all that it can have in common with any of them."""
    each = texts.join(sigs, "sig", "left_semi").mapInArrow(_shingled, "sig binary, h bigint")
    once = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("sig").alias("sig")).where("n = 1")
    return materialize(once.groupBy("sig").agg(F.count(F.lit(1)).alias("alone")), "alone")


def _in_common(most: Column, sizes: Column, percent: int) -> Column:
    """Whether two sets with so many items altogether, of which they have ``most`` in
    common at most, can be similar."""
    return (100 + percent) * most >= percent * sizes


def _named(members: DataFrame, component: DataFrame, sig: str = "sig") -> DataFrame:
    """The members with their components, each by ``b``; alone, a member is its own."""
    members = members.withColumnRenamed(sig, "b")
    known = component.withColumnRenamed("node", "b")
    return members.join(known, "b", "left").withColumn("component", F.coalesce("component", "b"))


def _as_a(named: DataFrame) -> DataFrame:
    """The same members as partners: columns of ``b`` are those of ``a``."""
    renamed = {c: "a" + c[1:] for c in named.columns if c == "b" or c.startswith("b_")}
    return named.withColumnsRenamed(renamed | {"component": "ca"})


def _still_open(named: DataFrame, of, texts: DataFrame, percent: int) -> DataFrame | None:
    """The members of buckets with several components that can still have a link, by
    what they share with any other such member; None if there is no such bucket."""
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    named = materialize(named.join(mixed.where("lo <> hi").select("key"), "key").join(of("b"), "b"), "mixed")
    if named.isEmpty():
        return None
    alone = _alone(named.select(F.col("b").alias("sig")).distinct(), texts).withColumnsRenamed(
        {"sig": "b", "alone": "b_alone"}
    )
    named = named.join(alone, "b", "left").withColumn("b_alone", F.coalesce("b_alone", F.lit(0)))
    smallest = F.ceil(F.col("b_size") * percent / 100)
    return materialize(named.where(_in_common(F.expr("b_size - b_alone"), F.col("b_size") + smallest, percent)), "open")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """(doc_id, fp, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked if their sets of five-word shingles share ``percent`` of
    their union or more; a component is named by its smallest ``doc_id`` and that
    document is ``kept``. ``fp`` is the hash of the text.

    Documents with equal sets are one class. A class has a sketch of 100
    coordinates in 25 bands of four; classes that share a band are candidates, so
    a pair at the very threshold is missed with a probability of 1e-4. Links are
    looked for until components are known, not one by one. First each class is
    compared with the centre of its largest bucket: the member with the most company
    in all its buckets, which is what copies are copies of. Then, while a bucket holds
    several components, its members' shingles are counted: what occurs in one of them
    only is common to no two, so a member whose rest is too small for any similar set
    has no link left and leaves, without loss. The others are compared with about 8,
    then 64 centres of the largest of their mixed buckets. At last every member is
    measured against the centre of each of its buckets, and members still in different
    components are compared with each other, unless what they differ in from that
    centre, their sizes or their coarse sketches rule the similarity out (sketches at
    the threshold do so for 1 in 100,000 at most). Links are confirmed on the whole
    sets; the members of a centre are dealt over several tasks.

    Null and empty texts have no shingles, no links, and are kept, as are rows
    with a null ``doc_id`` unless linked to one with an id. Repeated rows are
    copies: rows with the smallest id are all kept. Other columns play no part.
    An empty table gives an empty one.
    """
    t = column(text)
    rows = docs.select(column(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(t).alias("fp"), t.alias("t"))
    sketched = materialize(rows.mapInArrow(_sketches, _SKETCHED), "sketches")
    classes = sketched.where("sig is not null").groupBy("sig").agg(
        F.min(F.struct("doc_id", "fp")).alias("rep"), F.min("doc_id").alias("first_doc"),
        F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
        F.first("coarse").alias("coarse"),
    )
    classes = materialize(classes, "classes")
    banded = classes.select("sig", F.explode("bands").alias("key"))
    keys = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    buckets = materialize(banded.join(keys.where("n > 1"), "key"), "buckets")

    wanted = buckets.select("sig").distinct().join(classes, "sig").select("sig", "rep.*")
    wanted = materialize(wanted, "wanted").withColumnsRenamed({"doc_id": "d", "fp": "f"})
    same_row = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fp") == F.col("f"))
    # candidates are a share of the documents, so this is a merge join at any size
    texts = materialize(rows.join(wanted.hint("merge"), same_row).select("sig", "t"), "texts")

    def of(c: str) -> DataFrame:
        return classes.select(*[F.col(x).alias(y) for x, y in (
            ("sig", c), ("n_shingles", f"{c}_size"), ("coarse", f"{c}_coarse"), ("bands", f"{c}_bands")
        )])

    # a bucket's centre has the most company in all its buckets, like what the others are copies of
    company = buckets.groupBy("sig").agg(F.sum("n").alias("company"))
    met = buckets.join(company, "sig")
    centre = met.groupBy("key").agg(F.max(F.struct("company", "sig")).alias("c")).select("key", F.col("c.sig").alias("c"))
    first = met.join(centre, "key").where("sig <> c")
    first = first.groupBy(F.col("sig").alias("b")).agg(F.max(F.struct("n", "c")).alias("c"))
    first = first.select(F.col("c.c").alias("a"), "b")
    first = first.join(of("a"), "a").join(of("b"), "b").where(_alike("a", "b", percent))
    component = components(_similar(_overlaps(first.select("a", "b"), texts), percent))

    def linked(found: DataFrame) -> DataFrame:
        if found.isEmpty():
            return component
        return components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))

    rest = F.least(F.expr("a_size - a_alone"), F.expr("b_size - b_alone"))
    near = (F.col("k") == F.col("key")) & _in_common(rest, F.expr("a_size + b_size"), percent)
    near &= F.col("component") != F.col("ca")  # what is cheap comes first
    alike = _alike("a", "b", percent)
    for centres in (*CENTRES, None):
        named = _still_open(_named(buckets, component), of, texts, percent)
        if named is None:
            break
        buckets = named.select("key", "n", F.col("b").alias("sig"))
        if centres is not None:
            largest = named.groupBy("b").agg(F.max(F.struct("n", "key")).alias("x")).select("b", "x.key")
            place = F.conv(F.hex(F.substring("a", 1, 4)), 16, 10).cast("bigint") * F.col("an")
            other = _as_a(named).withColumnRenamed("n", "an").where(place < (centres << 32))
            pairs = named.join(largest, ["b", "key"]).withColumnRenamed("key", "k").join(other, near & alike)
            component = linked(_similar(_overlaps(pairs.select("a", "b"), texts), percent))
            continue
        # whatever is still apart meets, in the first bucket it shares, unless the two differ
        # from the bucket's centre in too much that they cannot have in common
        company = named.groupBy("b").agg(F.sum("n").alias("company"))
        centre = named.join(company, "b").groupBy("key").agg(F.max(F.struct("company", "b")).alias("c"))
        to_centre = named.join(centre.select("key", F.col("c.b").alias("a")), "key")
        to_centre = materialize(to_centre.select("key", "a", "b"), "centres")
        overlaps = _overlaps(to_centre.where("a <> b").select("a", "b"), texts)
        component = linked(_similar(overlaps, percent))
        differ = F.expr("a_size + b_size - 2 * shared").alias("b_differ")
        differ = to_centre.join(overlaps, ["a", "b"], "left").select("key", "b", F.col("a").alias("centre"), differ)
        named = _named(named.drop("component"), component, "b").join(differ, ["key", "b"])
        named = materialize(named.withColumn("b_differ", F.coalesce("b_differ", F.lit(0))), "differ")
        home = named.where("b = centre").select("key", F.col("component").alias("home"))
        named = named.drop("centre").join(home, "key")
        shared = F.array_min(F.array_intersect("a_bands", "b_bands"))
        most = F.least(F.expr("a_differ - a_alone"), F.expr("b_differ - b_alone"))
        apart = (100 + percent) * (F.expr("a_differ + b_differ") - 2 * most) <= (100 - percent) * F.expr("a_size + b_size")
        once = F.expr("ca = home or a < b")  # the centre's own component is joined with, but not with itself
        away = named.where("component <> home").withColumnRenamed("key", "k")
        pairs = away.join(_as_a(named).drop("home"), apart & near & once & alike & (shared == F.col("key")))
        component = linked(_similar(_overlaps(pairs.select("a", "b"), texts), percent))

    named = classes.select("sig", "first_doc").join(
        component.withColumnRenamed("node", "sig"), "sig", "left"
    ).withColumn("component", F.coalesce("component", "sig"))
    smallest = named.groupBy("component").agg(F.min("first_doc").alias("smallest"))
    named = named.join(smallest, "component").select("sig", "smallest")
    out = sketched.select("doc_id", "fp", "n_shingles", "sig").join(named, "sig", "left")
    own = F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return out.select(
        "doc_id", "fp", "n_shingles", own.alias("component_id"),
        F.col("doc_id").eqNullSafe(own).alias("kept"),
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; one of each group."""
    gone = near_duplicates(docs, doc_id, text, percent).where("not kept")
    gone = materialize(gone.select(F.col("doc_id").alias("_gone_id"), F.col("fp").alias("_gone_fp")), "gone")
    row = docs.select(
        F.struct(*[column(c) for c in docs.columns]).alias("row"),
        column(doc_id).alias("_id"), F.xxhash64(column(text)).alias("_fp"),
    )
    same = F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_fp") == F.col("_gone_fp"))
    left = row.join(gone, same, "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
