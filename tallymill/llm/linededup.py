"""Line deduplication: an edit join by segments, verified bit-parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallymill.llm.common import column, components, let
from tallymill.sources.scratch import materialize

# Lines shorter than this have exact copies only: too short to tell near ones from chance.
MIN_CHARS = 20
# The bound of the registered query: a line has one segment more, one of them untouched.
EDITS = 1
# A key is cut further where it holds more lines than this for each key that a cut
# makes of a line; lines of other keys are compared pairwise.
CROWD = 16


def edit_distance(a: Column, b: Column, k: int) -> Column:
    """The edit distance of two strings where it is ``k`` or less, else null.

    A band of 2k+1 diagonals is one machine word: bit r of column j is row
    j - k + r. Vertical differences live in two words; each step finds the cells
    whose diagonal step is free by one addition, and the distance is followed
    down the lowest diagonal and then along the last row. ``k`` is 1 to 30. A
    first string shorter than ``k`` is compared by the built-in distance.
    """
    if not 1 <= k <= 30:
        raise ValueError("k must be 1 to 30")
    width, full, lowest = 2 * k + 1, (1 << (2 * k + 1)) - 1, 1 << (2 * k)
    long = lambda n: F.lit(n).cast("bigint")
    bit = lambda word, r: F.call_function("shiftright", word, r).bitwiseAND(long(1))
    other = lambda word: F.bitwise_not(word).bitwiseAND(long(full))

    def chars(x: Column, y: Column) -> Column:
        m, n = F.size(x), F.size(y)

        def step(s: Column, j: Column) -> Column:
            match = long(0)
            for r in range(width):
                at = j - k + r
                same = (at >= 1) & (F.get(x, at - 1) == F.get(y, j - 1))
                match = match + F.when(same, long(1 << r)).otherwise(long(0))
            free = lambda e: (
                e.bitwiseAND(s["p"]) + s["p"]
            ).bitwiseXOR(s["p"]).bitwiseOR(e).bitwiseOR(s["n"]).bitwiseAND(long(full))

            def cells(d: Column) -> Column:
                right = s["n"].bitwiseOR(other(d.bitwiseOR(s["p"])))
                left = d.bitwiseAND(s["p"])
                below = F.shiftright(d, 1)
                row = (m - j + k).cast("int")
                move = F.when(
                    j <= m - k, F.when(d >= lowest, long(0)).otherwise(long(1))
                ).otherwise(bit(right, row) - bit(left, row))
                return F.struct(
                    left.bitwiseOR(other(below.bitwiseOR(right))).alias("p"),
                    below.bitwiseAND(right).alias("n"),
                    (s["d"] + move).alias("d"),
                )

            return let(match, lambda e: let(free(e), cells))

        start = F.struct(
            long(full & ~((1 << k) - 1)).alias("p"), long(0).alias("n"), long(k).alias("d")
        )
        found = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["d"])
        return F.when(F.abs(m - n) > k, None).when(n == 0, m).otherwise(found)

    split = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    banded = let(split(a), lambda x: let(split(b), lambda y: chars(x, y)))
    plain = F.levenshtein(a, b, k)
    d = F.when(F.char_length(a) < k, plain).otherwise(banded.cast("int"))
    return let(d, lambda v: F.when((v >= 0) & (v <= k), v))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, at, line, lid): the lines with a word."""
    every = docs.select("doc_id", "fp", F.posexplode(F.split("t", "\n", -1)).alias("at", "line"))
    some = every.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return some.withColumn("lid", F.unhex(F.md5(F.col("line").cast("binary"))))


def _roles(edits: int) -> list[tuple[int, int, int]]:
    """(shorter, i, shift) of each key that a line gives: as a line that is compared
    with indexed lines ``shorter`` than it, its text where their segment i would be
    after ``shift``. The first ``edits`` + 1 are the line's own segments.

    Of two lines within ``edits``, take the first segment i of the shorter one up to
    whose end there are at most i edits. It has none, and exactly i are before it, so
    it has moved by i places at most, and ``edits`` - i edits are left behind it.
    """
    every = [
        (shorter, i, shift)
        for shorter in range(edits + 1)
        for i in range(edits + 1)
        for shift in range(-i, i + 1)
        if abs(shorter - shift) <= edits - i
    ]
    return sorted(every, key=lambda role: (role[0] or role[2]) != 0)


def _segment_keys(line: Column, edits: int) -> Column:
    """The hashes of ``_roles``, null where the indexed line would be too short."""
    out = []
    for shorter, i, shift in _roles(edits):
        length = F.char_length(line) - shorter
        start, end = (F.floor(length * j / (edits + 1)).cast("int") for j in (i, i + 1))
        key = F.xxhash64(length, F.lit(i), F.substring(line, start + shift + 1, end - start))
        out.append(F.when(length >= MIN_CHARS, key))
    return F.array(*out)


def _gap(at: Column, size: Column, want: Column, bound: Column) -> Column:
    """Text that is still open: where it lies in the line, the size it has in the
    indexed line, and how many edits it may hold."""
    return F.struct(
        at.cast("int").alias("at"), size.cast("int").alias("size"),
        want.cast("int").alias("want"), bound.cast("int").alias("bound"),
    )


def _open(gaps: Column) -> Column:
    return F.filter(gaps, lambda g: g["bound"] > 0)


def _first_gaps(role: Column, length: Column, edits: int) -> Column:
    """The open text on both sides of the segment of a role."""
    of = lambda n: F.get(F.array(*[F.lit(r[n]) for r in _roles(edits)]), role)
    want, i, shift = length - of(0), of(1), of(2)
    start, end = (F.floor(want * j / (edits + 1)).cast("int") for j in (i, i + 1))
    return _open(F.array(
        _gap(F.lit(0), start + shift, start, i),
        _gap(end + shift, length - end - shift, want - end, edits - i),
    ))


def _widest() -> Column:
    """(w, j): the gap j with the longest segments, of w characters; no gap can be cut
    where w is 0. Both lines of a pair choose the same."""
    return F.array_max(F.transform("gaps", lambda g, j: F.struct(
        F.floor(g["want"] / (g["bound"] + 1)).alias("w"), j.alias("j")
    )))


def _narrowed(crowded: DataFrame, edits: int) -> DataFrame:
    """Rows of crowded keys, once for each segment of their widest gap, which must
    agree too: the gap is searched as a line of its own with its own bound."""
    cut = crowded.withColumn("j", _widest()["j"]).withColumn("g", F.get("gaps", F.col("j")))
    size, want, bound = F.col("g.size"), F.col("g.want"), F.col("g.bound")
    choices = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(shift).alias("shift"))
        for i in range(edits + 1) for shift in range(-i, i + 1)
    ])
    fits = lambda c: (c["i"] <= bound) & (F.abs(size - want - c["shift"]) <= bound - c["i"])
    rows = cut.withColumn("c", F.explode(F.filter(choices, fits)))
    i, shift = F.col("c.i"), F.col("c.shift")
    rows = rows.withColumns({
        f"s{n}": F.floor(want * j / (bound + 1)).cast("int") for n, j in enumerate((i, i + 1))
    })
    at, end = F.col("g.at") + F.col("s0") + shift, F.col("s1") + shift
    left = _gap(F.col("g.at"), F.col("s0") + shift, F.col("s0"), i)
    right = _gap(F.col("g.at") + end, size - end, want - F.col("s1"), bound - i)
    others = F.filter("gaps", lambda _, n: n != F.col("j"))
    return rows.select(
        "lid", "line", (F.col("indexed") & (shift == 0)).alias("indexed"),
        F.concat(others, _open(F.array(left, right))).alias("gaps"),
        F.xxhash64("key", i, F.substring(F.col("line"), at + 1, F.col("s1") - F.col("s0"))).alias("key"),
    )


def _likely(a: Column, b: Column, bound: Column, edits: int) -> Column:
    """False only for texts more than ``bound`` edits apart: of many segments of ``a``
    all but ``bound`` stand in ``b``, up to ``bound`` places away."""
    many, n = 3 * (edits + 1), F.char_length(a)
    missing = F.lit(0)
    for i in range(many):
        start, end = (F.floor(n * j / many).cast("int") for j in (i, i + 1))
        low = F.greatest(start - bound, F.lit(0))
        around = F.substring(b, low + 1, end + bound - low)
        there = F.instr(around, F.substring(a, start + 1, end - start)) > 0
        missing = missing + F.when(there, 0).otherwise(1)
    return missing <= bound


def _shared(rows: DataFrame, indexed: Column) -> DataFrame:
    """With the number of rows of the key, where there are several and one of them
    at least is of an indexed line."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(indexed).alias("indexed"))
    return rows.join(counts.where("n > 1 and indexed").drop("indexed"), "key")


def _close_lines(docs: DataFrame, classes: DataFrame, edits: int) -> DataFrame:
    """(a, b): the distinct lines up to ``edits`` apart, each pair once."""
    keyed = classes.select("lid", "first", "length", F.posexplode("keys").alias("role", "key"))
    keyed = keyed.where("key is not null")
    found = materialize(_shared(keyed, F.col("role") <= edits), "segments")
    places = found.select("lid", "first.*").distinct().groupBy("doc_id", "fp").agg(
        F.collect_list(F.struct("at", "lid")).alias("places")
    )
    places = materialize(places, "places").withColumnsRenamed({"doc_id": "d", "fp": "f"})
    wanted = materialize(places.select(F.col("f").alias("fp")).distinct(), "wanted")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fp") == F.col("f"))
    lines_of = lambda l: F.transform(  # noqa: E731, E741
        "places", lambda p: F.struct(p["lid"].alias("lid"), F.get(l, p["at"]).alias("line"))
    )
    texts = docs.join(wanted, "fp", "left_semi").join(places, same).select(
        F.explode(let(F.split("t", "\n", -1), lines_of)).alias("x")
    ).select("x.*")
    texts = materialize(texts.dropDuplicates(["lid"]), "texts")

    rows = found.select(
        "lid", (F.col("role") <= edits).alias("indexed"),
        _first_gaps(F.col("role"), F.col("length"), edits).alias("gaps"), "key", "n",
    ).join(texts, "lid")
    done = None
    columns = ["lid", "line", "indexed", "gaps", "key"]
    splits = (F.col("n") > CROWD * len(_roles(edits))) & (_widest()["w"] > 0)
    while True:
        rows = materialize(rows.select(*columns, "n"), "rows")
        settled = rows.where(~splits).select(columns)
        done = settled if done is None else done.union(settled)
        crowded = rows.where(splits)
        if crowded.isEmpty():
            break
        rows = _shared(_narrowed(crowded, edits), F.col("indexed"))

    one = done.where("indexed")
    other = done.select(*[F.col(c).alias(f"o_{c}") for c in columns])
    size, o_size = F.char_length("line"), F.char_length("o_line")
    later = (o_size > size) | ((o_size == size) & (F.col("lid") < F.col("o_lid")))
    pairs = one.join(other, (F.col("key") == F.col("o_key")) & later)
    part = lambda c, g: F.substring(F.col(c), g["at"] + 1, g["size"])
    close = lambda a, b, bound: F.when(
        _likely(a, b, bound, edits), F.coalesce(edit_distance(a, b, edits) <= bound, F.lit(False))
    ).otherwise(F.lit(False))
    near = F.zip_with("gaps", "o_gaps", lambda g, o: let(
        part("line", g), lambda a: let(part("o_line", o), lambda b: close(a, b, g["bound"]))
    ))
    pairs = pairs.where(F.forall(near, lambda x: x))
    return materialize(
        pairs.select(F.col("lid").alias("a"), F.col("o_lid").alias("b")).distinct(), "links"
    )


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = column(text)
    return docs.select(
        column(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(t).alias("fp"),
        F.coalesce(t, F.lit("")).alias("t"),
    )


def line_matches(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS
) -> DataFrame:
    """(doc_id, fp, at, first, links, short): the lines that have a copy or a close line.

    ``docs`` has one row per document; lines are numbered by ``at`` from 0.
    ``first`` is the (doc_id, fp, at) where the line's class begins; ``links``
    counts the different lines up to ``edits`` away. ``short`` lines, of less than
    ``MIN_CHARS`` characters, have copies only.
    """
    if not 1 <= edits < MIN_CHARS:
        raise ValueError(f"edits must be 1 to {MIN_CHARS - 1}")
    docs = _keyed(docs, doc_id, text)
    lines = _lines(docs)
    classes = lines.groupBy("lid").agg(
        F.min(F.struct("doc_id", "fp", "at")).alias("first"),
        F.count(F.lit(1)).alias("n"),
        F.first(F.char_length("line")).alias("length"),
        F.first(F.when(F.char_length("line") >= MIN_CHARS, _segment_keys(F.col("line"), edits))).alias("keys"),
    )
    classes = materialize(classes, "lines")
    links = _close_lines(docs, classes, edits)
    both = links.union(links.select("b", "a"))
    degree = both.groupBy(F.col("a").alias("lid")).agg(F.count(F.lit(1)).alias("links"))
    linked = components(links).withColumnRenamed("node", "lid").join(degree, "lid")
    linked = linked.join(classes.select("lid", "first"), "lid")
    begins = linked.groupBy("component").agg(F.min("first").alias("begins"))
    linked = materialize(linked.join(begins, "component").select("lid", "begins", "links"), "linked")
    active = classes.join(linked, "lid", "left").where("n > 1 or begins is not null").select(
        "lid", F.coalesce("begins", "first").alias("first"),
        F.coalesce("links", F.lit(0).cast("bigint")).alias("links"),
        (F.col("length") < MIN_CHARS).alias("short"),
    )
    return lines.select("doc_id", "fp", "at", "lid").join(active, "lid").select(
        "doc_id", "fp", "at", "first", "links", "short"
    )


def _per_document(matches: DataFrame) -> DataFrame:
    """One row per document (d, f) with a match; the short lines in columns of their own."""
    here = F.struct("doc_id", "fp", "at")
    repeat = ~(F.col("first").eqNullSafe(here))
    grouped = matches.groupBy("doc_id", "fp").agg(
        F.sort_array(F.collect_set(F.when(repeat & ~F.col("short"), F.col("at")))).alias("repeats"),
        F.sort_array(F.collect_set(F.when(repeat & F.col("short"), F.col("at")))).alias("short_repeats"),
        F.sort_array(F.collect_set(F.struct("at", F.col("first.doc_id").alias("doc"), "links", "short"))).alias("all"),
    ).select(
        "*", F.filter("all", lambda x: ~x["short"]).alias("m"), F.filter("all", lambda x: x["short"]).alias("s"),
    )
    return grouped.select(
        F.col("doc_id").alias("d"), F.col("fp").alias("f"), "repeats",
        F.transform("m", lambda x: x["at"]).alias("lines"),
        F.transform("m", lambda x: x["doc"]).alias("class_docs"),
        F.transform("s", lambda x: x["at"]).alias("short_lines"),
        F.transform("s", lambda x: x["doc"]).alias("short_class_docs"), "short_repeats",
        F.aggregate("m", F.lit(0).cast("bigint"), lambda a, x: a + x["links"]).alias("n_links"),
    )


def line_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS
) -> DataFrame:
    """(doc_id, fp, n_lines, n_links, lines, class_docs, repeats, short_lines,
    short_class_docs, short_repeats) of each document.

    Lines end at line feeds. Lines of 20 characters or more with a word are
    compared with all such lines of all documents; those that are equal, or up to
    ``edits`` insertions, deletions and substitutions apart, are linked, and linked
    lines form classes. ``lines`` numbers (from 0) the document's lines whose class holds
    more than this one line, ``class_docs`` has for each of them the document
    where its class begins, ``n_links`` is the sum over them of the different
    lines that near, and ``repeats`` numbers the lines that are not the first
    of their class, in the order of (doc_id, hash of the text, line number). The
    last three columns say the same of shorter lines with a word, whose classes
    are their exact copies.

    Distinct lines are found by grouping on a 128-bit hash, so a line that fills
    a third of all rows costs one row per task. Each distinct line is indexed by
    ``edits`` + 1 segments, one of which any line that near leaves untouched, and
    probes the segments of lines its own length and up to ``edits`` shorter, moved by
    the places that the edits before and behind them allow. Keys held by more than
    16 lines for each of these keys (64 at one edit) are cut further: the rest of the line on either side has its own bound, and
    the widest rest is searched in the same way until keys are small or no rest can be
    cut, so crowded segments are not multiplied out. Pairs are confirmed, rest by
    rest, by the banded bit-parallel distance. Keys per line grow with the cube of
    ``edits``: 4, 12, 26 and 82 for 1, 2, 3 and 5.

    A null text has one empty line. Rows alike in id and text are one document
    and get equal results; a null id sorts first. Other columns play no part. An
    empty table gives an empty one.
    """
    keyed = _keyed(docs, doc_id, text).select(
        "doc_id", "fp", F.size(F.split("t", "\n", -1)).cast("bigint").alias("n_lines")
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fp") == F.col("f"))
    out = keyed.join(_per_document(line_matches(docs, doc_id, text, edits)), same, "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return out.select(
        "doc_id", "fp", "n_lines",
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce("lines", none("int")).alias("lines"),
        F.coalesce("class_docs", none("bigint")).alias("class_docs"),
        F.coalesce("repeats", none("int")).alias("repeats"),
        F.coalesce("short_lines", none("int")).alias("short_lines"),
        F.coalesce("short_class_docs", none("bigint")).alias("short_class_docs"),
        F.coalesce("short_repeats", none("int")).alias("short_repeats"),
    )


def drop_repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS
) -> DataFrame:
    """``docs`` without the repeated lines, and without the rows that had a word
    in their text and lost every line with one. Lines of less than 20 characters
    stay, copies too. Columns stay as they came."""
    repeats = _per_document(line_matches(docs, doc_id, text, edits)).where("size(repeats) > 0")
    repeats = materialize(repeats.select("d", "f", "repeats"), "repeats")
    t = column(text)
    rows = docs.select(
        F.struct(*[column(c) for c in docs.columns]).alias("row"), t.alias("t"),
        column(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(t).alias("fp"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fp") == F.col("f"))
    rows = rows.join(repeats, same, "left").select("row", "t", "repeats", F.split("t", "\n", -1).alias("l"))
    left = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), F.col("repeats"))
    cut = let(F.col("l"), lambda l: F.array_join(F.transform(left, lambda i: F.get(l, i)), "\n"))  # noqa: E741
    rows = rows.select("row", F.when(F.col("repeats").isNull(), F.col("t")).otherwise(cut).alias("t"),
                       F.col("repeats").isNotNull().alias("cut"))
    rows = rows.where(~F.col("cut") | F.col("t").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(*[
        F.col("t").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns
    ])
