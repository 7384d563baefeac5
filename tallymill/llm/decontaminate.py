"""Benchmark decontamination by a positional inverted index of the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallymill.llm.common import ascii_lower, column, let
from tallymill.sources.scratch import materialize

# A word: digits, letters, and everything beyond ASCII, after A-Z became a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same before A-Z became a-z.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
# Rarest words of a window whose postings are stored and intersected.
ANCHORS = 3
# Documents with a word for each part that the word's postings are dealt to.
DEALT = 256


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, phrase): each distinct window of consecutive words of an item; an
    item shorter than a window is one window. A null id becomes ''."""
    w = items.select(
        F.coalesce(column(item_id).cast("string"), F.lit("")).alias("item"),
        plain_words(column(text)).alias("w"),
    ).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.size("w") - F.least(F.size("w"), F.lit(WINDOW)))
    return w.select("item", "w", F.explode(starts).alias("s")).select(
        "item", F.array_join(F.slice("w", F.col("s") + 1, WINDOW), " ").alias("phrase")
    ).distinct()


def search_plan(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(phrase, pid, length, anchors): the windows that can occur, by text and by a
    128-bit hash of it, with their rarest words (df, off, term), rarest first, by the
    number of documents with the word.

    ``docs`` has ``t``. A window with a word that no document has is left out.
    """
    phrases = windows.select("phrase").distinct().withColumn("terms", F.split("phrase", " "))
    placed = materialize(
        phrases.select("phrase", F.size("terms").alias("length"), F.posexplode("terms").alias("off", "term")),
        "placed",
    )
    vocabulary = materialize(placed.select("term").distinct(), "vocabulary")
    found = docs.select(F.explode(F.array_distinct(plain_words(F.col("t")))).alias("term"))
    df = found.join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ranked = placed.join(df, "term").groupBy("phrase", "length").agg(
        F.sort_array(F.collect_list(F.struct("df", "off", "term"))).alias("anchors")
    )
    plan = ranked.where(F.size("anchors") == F.col("length")).select(
        "phrase", F.unhex(F.md5(F.col("phrase").cast("binary"))).alias("pid"), "length",
        F.slice("anchors", 1, ANCHORS).alias("anchors"),
    )
    return materialize(plan, "plan")


def _parts(df: Column) -> Column:
    return F.ceil(df / DEALT)


def postings_of(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """(term, part, doc_id, fp, pos): the index, written, of the words that are
    anchors. The postings of a frequent word are dealt to parts, more as more
    documents have it."""
    anchors = plan.select(F.explode("anchors").alias("a")).select("a.term", "a.df").distinct()
    anchors = materialize(anchors, "anchors")
    at = docs.select("doc_id", "fp", F.posexplode(plain_words(F.col("t"))).alias("pos", "term"))
    part = F.pmod(F.xxhash64("doc_id", "fp", "pos"), _parts(F.col("df")))
    return materialize(at.join(anchors, "term").select("term", part.alias("part"), "doc_id", "fp", "pos"), "postings")


def intersected(plan: DataFrame, postings: DataFrame, slop: int = 0) -> DataFrame:
    """(phrase, length, doc_id, fp, start): places where the anchors of a
    window stand as in the window, each up to ``slop`` words off its place.

    Begins with the postings of the rarest anchor, moved by its offset, and keeps
    those that the next anchors' postings meet. A window meets its first word's
    postings once in each part of them. Later places are joined by document,
    word and stretch of positions, so long documents and frequent words spread;
    until then a window goes by its hash.
    """
    anchor = F.col("anchors")[0]
    dealt = plan.select(
        "pid", "anchors", anchor["term"].alias("term"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), _parts(anchor["df"]) - 1)).alias("part"),
    )
    c = dealt.join(postings, ["term", "part"]).select(
        "pid", "anchors", "doc_id", "fp",
        (F.col("pos") - anchor["off"]).alias("start"),
    )
    if not slop:
        c = c.where("start >= 0")
    stretch = 2 * slop + 1
    other = postings.select(
        F.col("doc_id").alias("d"), F.col("fp").alias("f"), F.col("term").alias("word"),
        F.floor(F.col("pos") / stretch).alias("s"), F.col("pos").alias("p"),
    )
    for k in range(1, ANCHORS):
        anchor = F.col("anchors")[k]
        place = F.col("start") + anchor["off"]
        around = F.sequence(F.floor((place - slop) / stretch), F.floor((place + slop) / stretch))
        more = c.where(F.size("anchors") > k).select("*", F.explode(around).alias("stretch"))
        met = more.join(
            other,
            F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fp") == F.col("f"))
            & (anchor["term"] == F.col("word")) & (F.col("stretch") == F.col("s"))
            & (F.abs(F.col("p") - place) <= slop),
        )
        c = c.where(F.size("anchors") <= k).union(met.select(c.columns))
    return c.join(plan.select("pid", "phrase", "length"), "pid").drop("pid", "anchors")


def _covered(spans: Column) -> Column:
    """Words under the sorted (start, length) spans."""
    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def add(a, x):
        end = x["start"] + x["length"]
        new = F.greatest(end - F.greatest(a["end"], x["start"]), F.lit(0))
        return F.struct(F.greatest(end, a["end"]).alias("end"), (a["n"] + new).alias("n"))

    return F.aggregate(spans, state, add, lambda a: a["n"])


def _stands(w: Column, x: Column) -> Column:
    """Whether the phrase of place ``x`` is in the words ``w``, word for word."""
    there = F.array_join(F.slice(w, F.greatest(x["start"], F.lit(0)) + 1, x["length"]), " ")
    return (x["start"] >= 0) & (there == x["phrase"])


def _stands_near(w: Column, x: Column, slop: int) -> Column:
    """Whether each word of the phrase stands up to ``slop`` words off its place."""

    def near(terms: Column) -> Column:
        around = lambda i: F.sequence(x["start"] + i - slop, x["start"] + i + slop)
        at = lambda i: F.exists(around(i), lambda p: (p >= 0) & (F.get(w, p) == F.get(terms, i)))
        return F.forall(F.sequence(F.lit(0), F.size(terms) - 1), at)

    return let(F.split(x["phrase"], " "), near)


def _confirmed(docs: DataFrame, places: DataFrame, slop: int) -> DataFrame:
    """(doc_id, fp, n_hit, phrases, near): the phrases that stand at one of the places,
    the words under them, and the phrases that stand near one; read off the
    documents' words."""
    wanted = places if slop else places.where("start >= 0")
    per_doc = wanted.groupBy("doc_id", "fp").agg(
        F.collect_set(F.struct("start", "length", "phrase")).alias("places")
    )
    per_doc = materialize(per_doc, "places").withColumnsRenamed({"doc_id": "d", "fp": "f"})
    texts = materialize(per_doc.select(F.col("f").alias("fp")).distinct(), "texts")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fp") == F.col("f"))
    found = docs.join(texts, "fp", "left_semi").join(per_doc, same)

    def read(w: Column) -> Column:
        exact = F.filter("places", lambda x: _stands(w, x))
        near = F.filter("places", lambda x: _stands_near(w, x, slop)) if slop else exact
        return F.struct(exact.alias("exact"), F.array_distinct(near["phrase"]).alias("near"))

    found = found.select("doc_id", "fp", let(plain_words(F.col("t")), read).alias("x"))
    spans = F.sort_array(F.transform("x.exact", lambda x: F.struct(x["start"], x["length"])))
    found = found.where("size(x.exact) > 0 or size(x.near) > 0").select(
        "doc_id", "fp", _covered(spans).alias("n_hit"),
        F.array_distinct("x.exact.phrase").alias("phrases"), "x.near",
    )
    return materialize(found.dropDuplicates(["doc_id", "fp"]), "hits")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    slop: int | None = None,
) -> DataFrame:
    """(doc_id, fp, n_words, n_hit, items, contaminated) of each row of ``docs``.

    ``n_hit`` counts the words under an occurrence of any window of 13 words of
    an item; ``items`` are the sorted ids, as strings, of the items concerned;
    ``contaminated`` means one word in twenty or more is hit. With ``slop``, the
    column ``near_items`` lists the items with a window whose words all stand up
    to ``slop`` words off their places, counted from its rarest word (exact ones
    included).

    Four passes over ``docs``: document frequencies of the items' words; postings
    of each window's rarest words, written; the documents in which those meet,
    where the whole phrase is confirmed, in place or near it; and the word counts. Only small tables
    are joined with the documents' words. They are written first, so Spark knows
    their size and broadcasts them only below its threshold.

    Null texts, of documents or items, have no words. Items that share an id are
    one item. Repeated rows get equal results, and other columns play no part.
    Empty tables, on either side, give no hits.
    """
    t = column(text)
    docs = docs.select(column(doc_id).alias("doc_id"), F.xxhash64(t).alias("fp"), t.alias("t"))
    windows = materialize(item_windows(items, item_id, item_text), "windows")
    plan = search_plan(docs, windows)
    hits = _confirmed(docs, intersected(plan, postings_of(docs, plan), slop or 0), slop or 0)

    def listed(phrases: str, name: str) -> DataFrame:
        found = hits.select("doc_id", "fp", F.explode(phrases).alias("phrase"))
        named = found.join(windows, "phrase").select("doc_id", "fp", "item").distinct()
        named = named.groupBy("doc_id", "fp").agg(F.sort_array(F.collect_list("item")).alias(name))
        return named.withColumnsRenamed({"doc_id": "d", "fp": "f"})

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fp") == F.col("f"))
        return left.join(right, same, "left").drop("d", "f")

    n_words = F.coalesce(F.regexp_count("t", F.lit(ANY_CASE_WORD)), F.lit(0)).cast("bigint")
    counted = docs.select("doc_id", "fp", n_words.alias("n_words"))
    n_hit = hits.select(F.col("doc_id").alias("d"), F.col("fp").alias("f"), "n_hit")
    out = beside(beside(counted, n_hit), listed("phrases", "items"))
    n = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    none = F.array().cast("array<string>")
    out = out.withColumns({
        "n_hit": n, "items": F.coalesce("items", none),
        "contaminated": (n > 0) & (20 * n >= F.col("n_words")),
    })
    if slop:
        out = beside(out, listed("near", "near_items"))
        out = out.withColumn("near_items", F.coalesce("near_items", none))
    return out


def drop_contaminated(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    gone = contamination(docs, items, doc_id, text, **options).where("contaminated")
    gone = materialize(gone.select(F.col("doc_id").alias("_gone_id"), F.col("fp").alias("_gone_fp")), "gone")
    row = docs.select(
        F.struct(*[column(c) for c in docs.columns]).alias("row"),
        column(doc_id).alias("_id"), F.xxhash64(column(text)).alias("_fp"),
    )
    same = F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_fp") == F.col("_gone_fp"))
    return row.join(gone, same, "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
