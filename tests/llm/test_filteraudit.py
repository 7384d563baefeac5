import random
from itertools import permutations

import pytest

from tallymill.llm import filteraudit
from tallymill.llm.queries import QUERIES, table_bytes
from tallymill.sources.tables import read_table
from tallymill.sources.text import stream_table

DOCS = "doc_id bigint, text string, lang string, part string"
LABELS = "doc_id bigint, quality int, toxic int, id int"


def brute(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    rows = []
    for i, text, lang in docs:
        t = text or ""
        words = [w for w in t.replace("\t", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").replace("\n", " ").split(" ") if w]
        fails = set()
        fails |= {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and least[t] < i else set()
        rows.append((lang or "", fails, i in good, i in toxic))
    out, removed_by = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                gone = [r for r in mine if f in r[1] and not r[1] & before]
                kept = sum(not r[1] & (before | {f}) for r in mine)
                removed_by[part, f] = removed_by.get((part, f), 0) + len(gone)
                out[part, "".join(order), step + 1] = (
                    kept, len(gone), sum(f in r[1] and bool(r[1] & before) for r in mine),
                    sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone),
                )
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def table(rows):
    return {
        (r.part, r.filter_order, r.step): (
            r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley
        )
        for r in rows
    }


def made(seed, n=300):
    rng = random.Random(seed)
    texts = ["", None, "a B c", "A$ b", "x " * 120, " ".join(f"w{i}" for i in range(120)), "W " * 99 + "é\n\vz"]
    texts += [" ".join(f"u{rng.randrange(150)}" for _ in range(130)) for _ in range(20)]
    docs = [
        (rng.choice([None, *range(200)]), rng.choice(texts), rng.choice([None, "", "en", "fr"])) for _ in range(n)
    ]
    docs += [(2**62 + i, "x " * 120, "en") for i in range(3)] + [(-(2**62), "x " * 120, "fr")]
    labels = [(rng.randrange(200), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)]
    return docs, labels + [(None, 1, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_retracts_over_many_batches(spark, path, seed):
    """Ids fall from file to file, so that most batches bring a smaller one."""
    docs, labels = made(seed)
    docs.sort(key=lambda r: (r[0] is not None, -(r[0] or 0)))
    folder = path("table")
    for i in range(0, len(docs), 40):
        rows = [(*r, "clash") for r in docs[i : i + 40]]
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(f"{folder}/documents.parquet")
    schema = spark.createDataFrame([], DOCS).schema
    flags = spark.createDataFrame([(*r, 0) for r in labels], LABELS)
    stream = stream_table(spark, folder, "documents", schema, 1)  # one file a batch
    found = filteraudit.audit(stream, flags, 5)
    assert table(found.collect()) == brute(docs, labels)
    one = filteraudit.audit(stream_table(spark, folder, "documents", schema), flags, 1)
    assert table(one.collect()) == brute(docs, labels)


def test_retraction_of_one_text(spark):
    """The first so far is taken back and counted as a copy when a smaller id comes."""

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    import pandas as pd

    names = ["key", "mask", "known", "doc_id", "part", "good", "toxic", "n"]
    batch = lambda *rows: iter([pd.DataFrame([("k", *r) for r in rows], columns=names)])
    state, run = State(), filteraudit._retracted
    out = [f.values.tolist() for f in run((0,), batch((1, 1, 9, "en", 1, 0, 2)), state)]
    assert out == [[["en", 1, 1, 0, 2]]]
    out = [sorted(f.values.tolist()) for f in run((0,), batch((1, 1, 4, "fr", 0, 0, 1), (1, 1, 9, "en", 0, 0, 1)), state)]
    assert out == [[["en", 1, 1, 0, -2], ["en", 17, 0, 0, 1], ["en", 17, 1, 0, 2], ["fr", 1, 0, 0, 1]]]
    assert '"k":[4,' in state.get[0]


def test_empty_table_and_labels(spark, path):
    empty, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    folder = path("table")
    empty.write.parquet(f"{folder}/documents.parquet")
    assert filteraudit.audit(stream_table(spark, folder, "documents", empty.schema), labels, 3).count() == 0
    folder = path("table")
    spark.createDataFrame([(1, "a", None, "x")], DOCS).write.parquet(f"{folder}/documents.parquet")
    found = filteraudit.audit(stream_table(spark, folder, "documents", empty.schema), labels, 3)
    assert table(found.collect()) == brute([(1, "a", None)], [])


def test_registered_query_uses_several_batches(spark, small):
    docs = read_table(spark, small, "documents")
    assert table_bytes(docs) > 0
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in read_table(spark, small, "labels").collect()]
    assert table(QUERIES["op11_filter_interaction"](spark, small).collect()) == brute(rows, labels)
