"""Secret scans: fixed patterns, and Markov models of random and ordinary strings."""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from tallymill.llm.common import column, let, prefix_sums

# The patterns, and the least length of a match or of its value.
ASSIGN = (
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# A run of hexadecimal digits is a match as a whole or not at all.
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]{24,}"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

# What the models look at: runs of these characters that no assignment begins.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
CANDIDATE = f"{ASSIGN}|({RUN})"
ORDINARY = r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]{7,}(?![A-Za-z0-9_])"

# Characters with a state of their own; all others share one more.
STATES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Random strings made for the models.
SAMPLE_RANDOM = 4_000
# Added to every count of a transition.
SMOOTHING = 0.5
# Mean log-likelihood ratio per transition above which a run counts as random.
THRESHOLD = 0.25

KINDS = ("assign", "access", "hex", "random")


def _state(char: Column) -> Column:
    return F.instr(F.lit(STATES), char)


def _transitions(text: Column) -> Column:
    """Numbers of the transitions between neighbouring characters."""
    state = lambda i: _state(F.substring(text, i, F.lit(1)))
    width = len(STATES) + 1
    steps = F.transform(
        F.sequence(F.lit(1), F.char_length(text) - 1), lambda i: state(i) * width + state(i + 1)
    )
    return F.when(F.char_length(text) > 1, steps).otherwise(F.array().cast("array<int>"))


def train(docs: DataFrame, text: str = "text") -> list[float]:
    """Log-likelihood ratio, random over ordinary, of each transition.

    Labelled strings are taken from all documents: values that the patterns find
    count as random, as do
    ``SAMPLE_RANDOM`` digests spelt in hexadecimal and base 64; identifiers of
    eight characters or more with neither a pattern nor a digit count as ordinary.
    Transitions are counted in each task before the shuffle; only their table, of
    fixed size, comes to the driver.
    """
    t = column(text)
    some = docs.where(t.isNotNull()).select(t.alias("t"))
    found = lambda pattern, group: F.regexp_extract_all("t", F.lit(pattern), F.lit(group))
    values = F.concat(
        F.filter(found(ASSIGN, 2), lambda v: F.char_length(v) >= MIN_ACCESS),
        F.filter(found(ACCESS, 0), lambda v: F.char_length(v) >= MIN_ACCESS),
        found(HEX, 0),
    )
    plain = F.filter(found(ORDINARY, 0), lambda v: ~v.rlike(r"[0-9]|AKIA"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = docs.sparkSession.range(SAMPLE_RANDOM // 2).select(
        F.explode(F.array(F.substring(digest, 1, 40), F.base64(F.unhex(digest)))).alias("v")
    )
    labelled = (
        some.select(F.explode(values).alias("v"), F.lit(1).alias("random"))
        .union(made.select("v", F.lit(1)))
        .union(some.select(F.explode(plain), F.lit(0)))
    )
    steps = labelled.select("random", F.explode(_transitions(F.col("v"))).alias("step"))
    width = len(STATES) + 1
    counts = [Counter(), Counter()]
    for row in steps.groupBy("random", "step").count().collect():
        counts[row["random"]][row["step"]] = row["count"]

    def chance(of: Counter, step: int) -> float:
        row = step - step % width
        return (of[step] + SMOOTHING) / (sum(of[s] for s in range(row, row + width)) + SMOOTHING * width)

    return [math.log(chance(counts[1], s) / chance(counts[0], s)) for s in range(width * width)]


def _spans(docs: DataFrame, kind: int, pattern: str, value: int, least: int, extra=None) -> DataFrame:
    """Adds ``k<kind>``: (start, kind, end) of the matches whose group ``value`` has
    ``least`` characters and passes ``extra``.

    Matches and the text between them give the places: a match starts where the
    lengths before it end.
    """
    kept, name = [c for c in docs.columns], f"k{kind}"
    hit = F.col("t").rlike(pattern)
    parts = docs.select(
        *kept,
        F.when(hit, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).alias("m"),
        F.when(hit, F.regexp_extract_all("t", F.lit(pattern), F.lit(value))).alias("v"),
        F.when(hit, F.split("t", pattern, -1)).alias("gaps"),
    )
    parts = parts.select(
        *kept, "m", "v", "gaps",
        F.zip_with("m", F.slice("gaps", F.lit(1), F.size("m")),
                   lambda m, g: (F.char_length(m) + F.char_length(g)).cast("bigint")).alias("lengths"),
    )
    keep = lambda x: F.char_length(x["v"]) >= least
    passes = (lambda x: keep(x) & extra(x["v"])) if extra else keep
    bare = lambda x: F.struct(x["start"], x["kind"], x["end"])

    def spans_of(before: Column, gaps: Column, values: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            start = F.get(before, i) + F.char_length(F.get(gaps, i))
            return F.struct(
                start.alias("start"), F.lit(kind).alias("kind"),
                (start + F.char_length(m)).alias("end"), F.get(values, i).alias("v"),
            )

        return F.transform(F.filter(F.transform("m", span), passes), bare)

    spans = let(prefix_sums(F.col("lengths")), lambda b: let(F.col("gaps"), lambda g: let(
        F.col("v"), lambda v: spans_of(b, g, v)
    )))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return parts.select(*kept, F.coalesce(spans, none).alias(name))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(
        F.sort_array(spans), lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])
    ), ",")


def secret_spans(
    docs: DataFrame, model: list[float], doc_id: str = "doc_id", text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans) of each row.

    Spans are ``kind:start:end`` in code points, by start and then kind, joined by
    commas. ``base_spans`` are those of the three patterns. The model adds runs of
    20 characters or more, part of no assignment and without a key or hexadecimal
    string in them, whose transitions are likelier in random strings than in
    ordinary identifiers by ``threshold`` on average.

    One projection without shuffle. Null and empty texts have no spans; repeated
    rows get equal results; other columns play no part; no row in, no row out.
    """
    rows = docs.select(column(doc_id).alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("t"))
    weights = F.from_json(F.lit(json.dumps(model)), "array<double>")

    def random(v: Column) -> Column:
        steps = _transitions(v)
        score = F.aggregate(steps, F.lit(0.0), lambda a, s: a + F.get(weights, s))
        mean = score / (F.char_length(v) - 1)
        return ~v.rlike(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}") & (mean > threshold)

    rows = _spans(rows, 0, ASSIGN, 2, MIN_VALUE)
    rows = _spans(rows, 1, ACCESS, 0, MIN_ACCESS)
    rows = _spans(rows, 2, HEX, 0, MIN_HEX)
    rows = _spans(rows, 3, CANDIDATE, 3, MIN_ACCESS, random)
    n = lambda k: F.size(f"k{k}").cast("bigint")
    return rows.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        n(3).alias("n_random"), _joined(F.concat("k0", "k1", "k2")).alias("base_spans"),
        _joined(F.concat("k0", "k1", "k2", "k3")).alias("spans"),
    )
