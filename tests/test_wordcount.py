import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import ROOT
from tallymill.operators import wordcount as wc
from tallymill.sources.text import read_words, write_words

TEXTS = ["To be, or not to be.", "", "---", "Ünder_score élan ÉLAN 42 to", "to\nto\tto"]
COUNTS = {"to": 6, "be": 2, "or": 1, "not": 1, "ünder_score": 1, "élan": 2, "42": 1}


def as_dict(df):
    return {r.word: r.n for r in df.collect()}


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "text string")


def test_all_forms_agree(texts):
    assert as_dict(wc.word_count(texts, "text")) == COUNTS
    assert as_dict(texts.transform(wc.tokenize("text")).transform(wc.count_by("word"))) == COUNTS
    for held in (1, 2, 50_000):
        assert as_dict(wc.word_count_combined(texts, "text", held)) == COUNTS


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "text string")
    assert wc.word_count(empty, "text").count() == 0
    assert wc.word_count_combined(empty, "text").count() == 0
    assert wc.count_windows(empty, "text", 2).count() == 0


def test_combine_is_bounded():
    """Partial counts are passed on whenever more words are held than allowed."""
    words = [f"w{i % 50}" for i in range(1_000)]
    batches = [
        pa.RecordBatch.from_pydict({"word": words[i : i + 20]}) for i in range(0, 1_000, 20)
    ]
    out = list(wc.combine_words(iter(batches), 30))
    assert max(b.num_rows for b in out) <= 50
    total = Counter()
    for batch in out:
        for row in batch.to_pylist():
            total[row["word"]] += row["n"]
    assert total == Counter(words)
    (whole,) = wc.combine_words(iter(batches), 1_000)
    assert whole.num_rows == 50


def test_hot_word_costs_a_row_per_task(spark):
    """A word that is most of the text is counted before the shuffle."""
    hot = spark.range(0, 200_000, 1, 6).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("w"), F.col("id") % 7)).otherwise("hot").alias("t")
    )
    assert as_dict(wc.word_count(hot, "t"))["hot"] == 180_000
    assert as_dict(wc.word_count_combined(hot, "t", 4))["hot"] == 180_000
    plan = wc.word_count(hot, "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange hashpartitioning(word")


@pytest.mark.parametrize("n, windows", [(9, 0), (10, 1), (19, 1), (20, 2), (21, 2)])
def test_count_windows(spark, n, windows):
    df = spark.createDataFrame([("a",)] * n + [("b",)] * 3, "k string")
    got = [(r.word, r.w, r.n) for r in wc.count_windows(df, "k", 10).orderBy("w").collect()]
    assert got == [("a", w, 10) for w in range(windows)]


def test_count_windows_of_a_very_frequent_word(spark):
    df = spark.range(0, 2_500_000).select(F.lit("a").alias("k"))
    out = wc.count_windows(df, "k", 1)
    found = out.agg(F.count("w"), F.countDistinct("w"), F.min("w"), F.max("w")).first()
    assert tuple(found) == (2_500_000, 2_500_000, 0, 2_499_999)


def test_time_windows_are_half_open(spark):
    rows = [("2024-01-01 00:59:59.999", "a"), ("2024-01-01 01:00:00", "a"), ("2024-01-01 01:30:00", "b")]
    df = spark.createDataFrame(rows, "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    out = wc.time_window_count(df, "ts", "k", "1 hour")
    got = {(str(r.window_start)[11:16], r.word, r.n) for r in
           out.withColumn("window_start", F.col("window_start").cast("string")).collect()}
    assert got == {("00:00", "a", 1), ("01:00", "a", 1), ("01:00", "b", 1)}


def test_normalize_words(spark):
    rows = [("house/SM",), ("house",), ("car/a/b",), ("/x",)]
    df = spark.createDataFrame(rows, "e string")
    assert sorted(r.word for r in wc.normalize_words(df, "e").collect()) == ["", "car", "house"]


def test_dictionary_in_latin1(spark, path):
    file = Path(path("words"))
    file.write_bytes("café/S\nnaïve\ncafé\n".encode("iso-8859-1"))
    words = wc.normalize_words(read_words(spark, str(file)), "entry")
    assert sorted(r.word for r in words.collect()) == ["café", "naïve"]


def test_workers_need_not_have_the_package(tmp_path):
    """From another folder, with the package on the driver's path only."""
    script = (
        f"import sys; sys.path.insert(0, {str(ROOT.parent)!r})\n"
        "from tallymill.session import build_session\n"
        "from tallymill.operators.wordcount import word_count_combined\n"
        "spark = build_session('local[1]', 'away', shuffle_partitions=1)\n"
        "df = spark.createDataFrame([('a b a',)], 't string')\n"
        "print({r.word: r.n for r in word_count_combined(df, 't').collect()})\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "{'a': 2, 'b': 1}" in run.stdout or "{'b': 1, 'a': 2}" in run.stdout, run.stderr[-2000:]


@pytest.mark.parametrize("encoding", ["ISO-8859-1", "US-ASCII", "UTF-8"])
def test_dictionary_files_keep_every_word(spark, path, encoding):
    """Characters that the encoding lacks, signs of other formats, and empty entries."""
    words = ["œuvre", "日本", "a,b", "", "café", 'say "x"', "back\\slash", "\\u{41}", "two\nlines", "cr\rhere", " x ",
             "😀/y", "\t", "#", "'", "\\", "a\\n"]
    df = spark.createDataFrame([(w,) for w in words + [None]], "w string")
    file = write_words(df, "w", path(), encoding)
    assert sorted(r.entry for r in read_words(spark, file, encoding, escaped=True).collect()) == sorted(words)
    raw = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(file).collect())
    assert raw.count(b"\n") == len(words) and b"?" not in raw
    assert (encoding != "ISO-8859-1") or "café".encode("latin-1") in raw


def test_a_dictionary_in_another_encoding_is_an_error(spark, path):
    with pytest.raises(ValueError, match="dictionary file"):
        write_words(spark.createDataFrame([("a",)], "w string"), "w", path(), "UTF-16")
