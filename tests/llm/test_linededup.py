import random
import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
import pytest  # noqa: E402
from tallymill.llm import linededup  # noqa: E402
from tallymill.llm.queries import QUERIES  # noqa: E402
from tallymill.sources.tables import read_table  # noqa: E402


def _found(df):
    return {
        r.doc_id: (r.n_lines, r.n_links, list(r.lines), list(r.class_docs), list(r.repeats))
        for r in df.collect()
    }


def test_whole_table_like_brute_force(spark, medium):
    docs = {r.doc_id: r.text for r in read_table(spark, medium, "documents").collect()}
    assert _found(QUERIES["op6_line_dedup"](spark, medium)) == brute.line_classes(docs)


def test_crowded_halves(spark):
    """Hundreds of lines share a half, some of them one edit apart."""
    rng, docs = random.Random(5), {}
    base = "".join(rng.choice("abcdefgh ") for _ in range(90))
    for i in range(400):
        at = rng.randrange(45, 88)
        line = base[:at] + "".join(rng.choice("xyz") for _ in range(rng.randrange(3))) + base[at + rng.randrange(3):]
        docs[i] = line + "\nno\n" + rng.choice([base, line, base[1:], "é" * 25])
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    assert _found(linededup.line_classes(df)) == brute.line_classes(docs)


def _edited(rng, line, edits, letters):
    line = list(line)
    for _ in range(edits):
        at = rng.randrange(len(line))
        line[at : at + rng.randrange(2)] = [rng.choice(letters)] * rng.randrange(2)
    return "".join(line)


@pytest.mark.parametrize("edits,crowd", [(1, 1), (2, 16), (2, 1), (3, 1), (4, 2), (5, 16)])
def test_every_threshold_like_brute_force(spark, monkeypatch, edits, crowd):
    """Lines of few letters and templates with a changed word, keys crowded and not."""
    monkeypatch.setattr(linededup, "CROWD", crowd)
    rng, docs = random.Random(edits), {}
    bases = ["".join(rng.choice("ab ") for _ in range(n)) for n in (19, 20, 21, 24, 33, 60, 61, 90)]
    for i in range(160 if edits < 4 else 40):
        line = _edited(rng, rng.choice(bases), rng.randrange(edits + 2), "abß😀")
        words = "all of the lines are alike but for one word of it".split()
        words[rng.randrange(len(words))] = "".join(rng.choice("xyz") for _ in range(rng.randrange(1, 5)))
        docs[i] = line + "\n" + " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    wanted = brute.line_classes(docs, edits)
    assert _found(linededup.line_classes(df, edits=edits)) == wanted
    assert sum(n for _, n, *_ in wanted.values()) > 20


def test_thresholds_out_of_range(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    for edits in (0, 20):
        with pytest.raises(ValueError):
            linededup.line_classes(df, edits=edits)


def test_distance(spark):
    rng, rows = random.Random(1), []
    for _ in range(3000):
        a = [rng.choice("abß😀") for _ in range(rng.randrange(0, 12))]
        b = list(a)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.choice("abß😀")] * rng.randrange(2)
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for k in (1, 2, 3):
        plain = F.levenshtein("a", "b", k)
        wanted = F.when(plain >= 0, plain)
        found = linededup.edit_distance(F.col("a"), F.col("b"), k)
        assert df.where(~found.eqNullSafe(wanted)).count() == 0


def test_short_copies_have_their_classes(spark, medium):
    docs = {r.doc_id: r.text for r in read_table(spark, medium, "documents").collect()}
    at = {}
    for d, text in sorted(docs.items()):
        for i, line in enumerate((text or "").split("\n")):
            if len(line) < 20 and line.strip(" \t\n\x0b\x0c\r"):
                at.setdefault(line, []).append((d, i))
    wanted = {d: ([], [], []) for d in docs}
    for places in at.values():
        for d, i in places if len(places) > 1 else []:
            wanted[d][0].append((i, places[0][0]))
            if (d, i) != places[0]:
                wanted[d][2].append(i)
    wanted = {d: ([i for i, _ in sorted(m)], [c for _, c in sorted(m)], sorted(r)) for d, (m, _, r) in wanted.items()}
    found = QUERIES["op6_line_dedup"](spark, medium).collect()
    assert {r.doc_id: (list(r.short_lines), list(r.short_class_docs), list(r.short_repeats)) for r in found} == wanted
    assert any(r for _, _, r in wanted.values())


def test_nulls_repeats_and_clashing_names(spark):
    long = "lorem ipsum dolor sit " * 5000
    line = "a line that is long enough to be compared"
    rows = [
        (1, None, "x"), (2, "", "x"), (3, line + "\nown words of three, at length", "x"),
        (4, line + "!\nshort\nown words of four, at length", "x"), (5, "short\n" + line, "x"),
        (5, "short\n" + line, "x"), (None, line, "x"), (6, long, "x"), (7, long + "\nz", "x"),
        (8, line, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lid string")
    kept = linededup.drop_repeated_lines(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id or 0), r.text) for r in kept.collect() if r.text) == [
        (0, line), (3, "own words of three, at length"),
        (4, "short\nown words of four, at length"), (5, "short"), (5, "short"), (6, long), (7, "z"),
    ]
    assert sorted(r.doc_id for r in kept.where("coalesce(text, '') = ''").collect()) == [1, 2]
    assert linededup.line_classes(df.limit(0)).count() == 0
    assert linededup.drop_repeated_lines(df.limit(0)).count() == 0
