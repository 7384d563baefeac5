import random

from pyspark.sql import functions as F

from tallymill.operators.grep import grep, grep_list

LINES = ["these words", "a.b", "axb", "The", "tests and test", "", None]


def found(spark, words):
    df = spark.createDataFrame(list(enumerate(LINES)), "pos int, line string")
    return sorted((r.word, r.pos) for r in grep(df, "line", words).collect())


def test_one_row_per_word_and_line(spark):
    assert found(spark, ["these", "are", "test", "words"]) == [("test", 4), ("these", 0), ("words", 0)]


def test_words_are_literal_and_case_sensitive(spark):
    assert found(spark, ["a.b", "the", "[", "%"]) == [("a.b", 1), ("the", 0)]


def test_repeated_and_missing_words(spark):
    assert found(spark, ["test", "test"]) == [("test", 4)]
    assert found(spark, []) == []


def test_no_shuffle_and_no_join(spark):
    plan = grep(spark.range(9).select(F.col("id").cast("string").alias("line")), "line", ["1", "2"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text and "Python" not in text


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_list_of_words_is_an_index(spark):
    """Ten thousand words: no nested loop, and what the plain form finds."""
    rng = random.Random(2)
    letters = "abcde é日.*\\n'"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    lines = [(i, word(rng.choice([0, 1, 2, 30, 200]))) for i in range(400)] + [(400, None), (401, "ab" * 50_000)]
    df = spark.createDataFrame(lines, "id bigint, line string")
    words = [word(rng.choice([0, 1, 2, 3, 4, 5, 7])) for _ in range(10_000)]
    table = spark.createDataFrame([(w,) for w in words + words[:50] + [None]], "w string")
    found = grep_list(df, "line", table, "w")
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted((r.word, r.id) for r in found.select("word", "id").collect())
    assert got == sorted((w, i) for i, x in lines if x is not None for w in set(words) if w in x)
    few = words[:60]
    plain = sorted(map(tuple, grep(df, "line", few).collect()), key=str)
    indexed = grep_list(df, "line", spark.createDataFrame([(w,) for w in few], "word string"))
    assert indexed.columns == ["word", "id", "line"]
    assert sorted(map(tuple, indexed.collect()), key=str) == plain
    assert grep_list(df, "line", table.limit(0), "w").count() == 0
