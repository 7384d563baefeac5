import re
from collections import Counter

from tallymill.llm import quality
from tallymill.sources.tables import read_table


def _base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered |= set(range(i, i + 5))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered), failed,
    )


def test_measures_of_odd_texts(spark):
    texts = [
        None, "", " \n\t\x0b\x0c\r ", "a b c d e", "a b c d e a b c d e", "x " * 40, "é ü 😀#|<", "l l\nl l\n\nl l\r\n l l",
        "one two three four five six seven eight nine ten", "w " * 100000 + "end", "a b c d e f " * 3 + "z", "\x1c\x85 y",
    ]
    df = spark.createDataFrame([(i if i else None, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int")
    found = {r.row.doc_id: r for r in quality.quality_table(df).collect()}
    for i, t in enumerate(texts):
        r = found[i if i else None]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _base(t)
        assert r.row.n_words == 5 and not (r.kept and r.base_failed)
    assert quality.keep_good(df.limit(0)).columns == df.columns
    assert quality.quality_table(df.union(df)).count() == 2 * len(texts)
    assert quality.quality_table(df.limit(0)).count() == 0


def test_each_threshold(spark):
    good = "The house that was built by the river is one of the old houses of this town. " * 1
    texts = {
        "": good, "symbols": good.replace(" ", " ### "), "capitals": good.upper() + " the of and in the",
        "stop_words": "table chair window garden mountain village picture letter number station",
        "word_length": "the of and in " + "a" * 20 + (" " + "b" * 30) * 9,
        "repeated_lines": "this is it\n" + "to be\n" * 6 + "and so on it goes",
    }
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    rows = quality.quality_table(df, thresholds=(*quality.THRESHOLDS, quality.Rule("never", "n_words", 0, None)))
    for r in rows.collect():
        assert r.failed_rules == ([r.row.name] if r.row.name else []) and r.kept == (not r.row.name)


def test_agrees_with_labels(spark):
    big = "/root/testdata/sf0.1"
    kept = quality.keep_good(read_table(spark, big, "documents")).select("doc_id")
    labels = read_table(spark, big, "labels").where("quality is not null")
    counts = {r.quality: r["count"] for r in labels.join(kept, "doc_id").groupBy("quality").count().collect()}
    every = {r.quality: r["count"] for r in labels.groupBy("quality").count().collect()}
    assert counts[1] / every[1] > 0.97 and counts[0] / every[0] < 0.03
