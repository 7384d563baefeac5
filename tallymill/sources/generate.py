"""Distributed generators of workload inputs.

Every generated row depends on its id and the seed alone, so the output is the
same at any parallelism and after any task retry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallymill.functions.arith import near_normal, scatter
from tallymill.functions.ranking import range_positions
from tallymill.sources.scratch import materialize

# What one task writes, about, unless the number of parts is given.
BYTES_PER_PART = 256 << 20
ROW_BYTES = {"lineitem": 130, "rating": 12}


def _ids(spark: SparkSession, n: int, parts: int | None, row_bytes: float) -> DataFrame:
    """0 to n - 1 in ``parts`` partitions: by default as many as the bytes ask for,
    and one per core at least. The rows do not depend on it."""
    wanted = math.ceil(n * row_bytes / BYTES_PER_PART)
    return spark.range(0, n, 1, parts or max(wanted, spark.sparkContext.defaultParallelism))


def _broadcast_bytes(spark: SparkSession) -> int:
    """Up to which size Spark broadcasts a table."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit)


def gen_word_lines(
    spark: SparkSession,
    vocab: DataFrame,
    num_lines: int = 500,
    words: int = 15,
    seed: int = 0,
    parts: int | None = None,
) -> DataFrame:
    """(id, line): lines of ``words`` evenly picked words, joined by a space.

    ``vocab`` is (word), distinct. A word's number is its place in sorted order;
    numbers are drawn and joined with the numbered words. Picks outnumber words by far
    and Spark cannot tell, as they come of an explode. So the dictionary is stored
    first, which makes its size known, and is the optional side of an outer join, the
    only one that can be broadcast. Then picks stay where their line is, and the
    grouping by line needs no exchange. A larger dictionary parts picks from their
    lines; they go back as plain rows, since lists of one word each, which a grouping
    would make before its exchange, weigh several times as much.
    """
    size, chars = vocab.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))
    ).first()
    if size == 0:
        raise ValueError("the dictionary is empty")
    ids = _ids(spark, num_lines, parts, words * (chars / size + 1))
    picks = [scatter("id", j, seed) % size for j in range(words)]
    numbered = materialize(range_positions(vocab, ["word"], number="idx"), "numbered")
    stored = numbered.select("_metadata.file_path", "_metadata.file_size").distinct()
    held = stored.agg(F.sum("file_size")).first()[0]
    picked = ids.select("id", F.posexplode(F.array(*picks)).alias("j", "idx")).join(numbered, "idx", "left")
    if held > _broadcast_bytes(spark):
        picked = picked.select("id", "j", "word").repartition("id")
    return (
        picked.groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("j", "word"))).alias("picked"))
        .select("id", F.array_join(F.col("picked.word"), " ").alias("line"))
    )


def lines_for_size(vocab: DataFrame, size_bytes: int, words_per_line: int) -> int:
    """How many lines of evenly picked words make up ``size_bytes``, rounded down."""
    size, chars = vocab.agg(F.count(F.lit(1)), F.sum(F.octet_length("word"))).first()
    return size_bytes * size // (words_per_line * (chars + size))


def gen_text(
    spark: SparkSession,
    vocab: DataFrame,
    size_bytes: int,
    parts: int | None = None,
    words_per_line: int = 20,
    seed: int = 0,
) -> DataFrame:
    """(value): about ``size_bytes`` of text."""
    lines = lines_for_size(vocab, size_bytes, words_per_line)
    made = gen_word_lines(spark, vocab, lines, words_per_line, seed, parts)
    return made.select(F.col("line").alias("value"))


def _coprimes(n: int, wanted: int = 64) -> list[int]:
    """Up to ``wanted`` steps coprime to ``n``, spread over its range."""
    found: list[int] = []
    for i in range(wanted):
        step = max(1, n * (2 * i + 1) // (2 * wanted))
        while math.gcd(step, n) != 1:
            step += 1
        if step not in found:
            found.append(step)
    return found


def gen_ratings(
    spark: SparkSession,
    rows: int,
    cols: int,
    mean: float,
    variance: float,
    row_mean: float,
    row_variance: float,
    seed: int = 0,
    parts: int | None = None,
) -> DataFrame:
    """(user, item, rating): a sparse matrix with near-normal entries.

    A row has near-normally many entries, between none and ``cols``. Its columns
    are distinct: they are ``start + step * j`` modulo ``cols``, with a start and
    a step, coprime to ``cols``, of the row's own.
    """
    steps = _coprimes(cols)
    ids = _ids(spark, rows, parts, row_mean * ROW_BYTES["rating"])
    entries = F.floor(
        F.lit(float(row_mean)) + F.lit(math.sqrt(row_variance)) * near_normal("id", 0, seed) + 0.5
    )
    start = scatter("id", 0, seed + 12) % cols
    step = F.element_at(
        F.array(*[F.lit(s).cast("bigint") for s in steps]),
        (scatter("id", 0, seed + 13) % len(steps) + 1).cast("int"),
    )
    sized = ids.select(
        "id",
        F.least(F.greatest(entries, F.lit(0)), F.lit(cols)).alias("entries"),
        start.alias("start"),
        step.alias("step"),
    ).where("entries > 0")
    cells = sized.select(
        "id", "start", "step", F.explode(F.expr("sequence(0L, entries - 1)")).alias("j")
    )
    value = F.lit(float(mean)) + F.lit(math.sqrt(variance)) * near_normal("id", "j", seed + 14)
    return cells.select(
        F.col("id").cast("int").alias("user"),
        ((F.col("start") + F.col("step") * F.col("j")) % cols).cast("int").alias("item"),
        value.cast("float").alias("rating"),
    )


# Fixed values of TPC-H.
SHIP_INSTRUCTIONS = ["DELIVER IN PERSON", "COLLECT COD", "NONE", "TAKE BACK RETURN"]
SHIP_MODES = ["REG AIR", "AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "FOB"]
FIRST_ORDER_DATE = "1992-01-01"
CURRENT_DATE = "1995-06-17"
ORDER_DAYS = 2406
LINES_PER_SCALE = 6_000_000
PARTS_PER_SCALE = 200_000
SUPPLIERS_PER_SCALE = 10_000

COMMENT_WORDS = [
    ["quickly", "slowly", "carefully", "furiously", "blithely", "evenly", "daringly"],
    ["final", "regular", "special", "bold", "ironic", "pending", "express", "silent"],
    ["packages", "requests", "accounts", "deposits", "theodolites", "ideas", "foxes"],
]


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def gen_lineitem(
    spark: SparkSession, scale_factor: float = 1.0, parts: int | None = None, seed: int = 0
) -> DataFrame:
    """The 16 lineitem columns of TPC-H, four lines per order."""
    n = round(LINES_PER_SCALE * scale_factor)
    n_parts = max(1, round(PARTS_PER_SCALE * scale_factor))
    n_suppliers = max(4, round(SUPPLIERS_PER_SCALE * scale_factor))
    ids = _ids(spark, n, parts, ROW_BYTES["lineitem"])
    row = F.col("id")

    def draw(salt: int, choices: int) -> Column:
        return scatter("id", 0, seed + salt) % choices

    part = F.col("l_partkey")
    keyed = ids.select(
        "id",
        (F.shiftright(row, 2) + 1).alias("l_orderkey"),
        (draw(1, n_parts) + 1).alias("l_partkey"),
        (row % 4 + 1).cast("int").alias("l_linenumber"),
        (draw(2, 50) + 1).alias("quantity"),
        (scatter("shiftright(id, 2)", 0, seed) % ORDER_DAYS).cast("int").alias("order_day"),
        (draw(3, 121) + 1).cast("int").alias("to_ship"),
        (draw(4, 61) + 30).cast("int").alias("to_commit"),
        (draw(5, 30) + 1).cast("int").alias("to_receipt"),
    )
    ordered = F.date_add(F.lit(FIRST_ORDER_DATE).cast("date"), F.col("order_day"))
    dated = keyed.select(
        "*",
        F.date_add(ordered, F.col("to_ship")).alias("l_shipdate"),
        F.date_add(ordered, F.col("to_commit")).alias("l_commitdate"),
        F.date_add(ordered, F.col("to_ship") + F.col("to_receipt")).alias("l_receiptdate"),
    )
    retail_cents = F.expr("90000 + (l_partkey div 10) % 20001 + 100 * (l_partkey % 1000)")
    supplier = (
        part
        + draw(6, 4) * (F.lit(n_suppliers // 4) + F.expr(f"(l_partkey - 1) div {n_suppliers}"))
    ) % n_suppliers + 1
    today = F.lit(CURRENT_DATE).cast("date")
    return dated.select(
        "l_orderkey",
        "l_partkey",
        supplier.alias("l_suppkey"),
        "l_linenumber",
        F.col("quantity").cast("double").alias("l_quantity"),
        (F.col("quantity") * retail_cents / F.lit(100.0)).alias("l_extendedprice"),
        (draw(7, 11) / F.lit(100.0)).alias("l_discount"),
        (draw(8, 9) / F.lit(100.0)).alias("l_tax"),
        F.when(F.col("l_receiptdate") > today, F.lit("N"))
        .otherwise(_pick(["R", "A"], draw(9, 2)))
        .alias("l_returnflag"),
        F.when(F.col("l_shipdate") > today, F.lit("O")).otherwise(F.lit("F")).alias("l_linestatus"),
        "l_shipdate",
        "l_commitdate",
        "l_receiptdate",
        _pick(SHIP_INSTRUCTIONS, draw(10, 4)).alias("l_shipinstruct"),
        _pick(SHIP_MODES, draw(11, 7)).alias("l_shipmode"),
        F.concat_ws(
            " ", *[_pick(w, scatter("id", 0, seed + 12 + i)) for i, w in enumerate(COMMENT_WORDS)]
        ).alias("l_comment"),
    )
