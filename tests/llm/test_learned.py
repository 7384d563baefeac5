"""Language identification and the compression classifier."""

import math
import zlib

import numpy as np
import zstandard

from tallymill.llm import compression, langid
from tallymill.llm.queries import QUERIES
from tallymill.sources.tables import read_table

BIG = "/root/testdata/sf0.1"


def _held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_languages_of_the_held_out_quarter(spark):
    found = QUERIES["op3_language_id"](spark, BIG).collect()
    lang = {r.doc_id: r.lang for r in read_table(spark, BIG, "documents").collect()}
    assert len(found) == len(lang) and all(r.held_out == _held(r.doc_id) for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_odd_texts(spark, medium):
    texts = [None, "", "123 !? \t", "a", "THE " * 50000, "日本語", "the THE thing", "the THE thing"]
    df = spark.createDataFrame([(i if i else None, t, "") for i, t in enumerate(texts)], "doc_id bigint, text string, t string")
    profiles = langid.learn(read_table(spark, medium, "documents"))
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, profiles).collect()}
    assert [found[i] for i in (None, 1, 2)] == [("und", 0.0)] * 3
    assert found[4][0] == found[6][0] == "en" and found[6] == found[7] and found[5][0] in profiles
    assert langid.identify(df.limit(0), profiles).count() == 0
    assert {r.lang_pred for r in langid.identify(df, {}).collect()} == {"und"}


def test_every_labelled_row_is_bundled(spark):
    """A language of one text among 60,000 rows has its profile, as has one in copies."""
    rare = spark.createDataFrame([("ein seltener Text", "xx"), (None, "yy"), ("no language", None)], "text string, lang string")
    many = spark.range(60_000).selectExpr("concat('the text ', id) as text", "'en' as lang")
    copies = spark.range(200).selectExpr("'toujours le meme' as text", "'fr' as lang")
    profiles = langid.learn(many.union(copies).union(rare))
    assert set(profiles) == {"en", "fr", "xx"}
    one = langid.Grams().bundle("toujours le meme")
    assert np.allclose(profiles["fr"], 200 * one / np.linalg.norm(one), rtol=1e-4)


def test_bundle_is_the_sum_of_bound_letters():
    grams = langid.Grams()
    turn = lambda c, n: np.roll(grams.letter(ord(c)), n)
    wanted = 2 * turn(" ", 2) * turn("a", 1) * turn(" ", 0)
    assert (grams.bundle("A, a!") == wanted + turn("a", 2) * turn(" ", 1) * turn("a", 0)).all()


def _plain_bundle(text, letters, grams):
    """The sum over all three signs in a row of the product of their rotated vectors."""
    kept = "".join(c if c.isalnum() and not c.isdecimal() else " " for c in (text or "").lower())
    spaced = f" {' '.join(kept.split())} "
    total = np.zeros(langid.DIMENSIONS)
    for i in range(len(spaced) - 2):
        gram = spaced[i : i + 3]
        if gram not in grams:
            grams[gram] = np.prod([np.roll(letters.letter(ord(c)), 2 - k) for k, c in enumerate(gram)], axis=0)
        total += grams[gram]
    return total if len(spaced) > 2 else None


def test_languages_like_brute_force(spark, small):
    docs = read_table(spark, small, "documents").collect()
    letters, grams, profiles = langid.Grams(), {}, {}
    vectors = {r.doc_id: _plain_bundle(r.text, letters, grams) for r in docs}
    for r in docs:
        v = vectors[r.doc_id]
        if not _held(r.doc_id) and r.lang is not None and v is not None:
            profiles[r.lang] = profiles.get(r.lang, 0) + v / np.linalg.norm(v)
    found = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, small).collect()}
    assert set(found) == set(vectors)
    for doc, v in vectors.items():
        cosines = {k: float(p @ v / np.linalg.norm(p) / np.linalg.norm(v)) for k, p in profiles.items()}
        best = max(cosines, key=cosines.get)
        assert found[doc].lang_pred == best
        score = 1 / sum(np.exp(langid.SHARPNESS * (c - cosines[best])) for c in cosines.values())
        assert abs(found[doc].score - score) < 1e-3


def _sample(monkeypatch, *args, **kwargs):
    """The texts that a classifier would be built from."""
    with monkeypatch.context() as m:
        m.setattr(compression, "build", lambda good, bad: (good, bad))
        return compression.learn(*args, **kwargs)


def test_quality_like_brute_force(spark, small, monkeypatch):
    """The sample by plain selection, the scores from compressed sizes one by one."""
    docs, labels = read_table(spark, small, "documents"), read_table(spark, small, "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.quality for r in labels.collect() if not _held(r.doc_id) and texts.get(r.doc_id) is not None}
    good, bad = _sample(monkeypatch, docs, labels)
    assert good == [texts[i] for i in sorted(marks) if marks[i] == 1]
    assert bad == [texts[i] for i in sorted(marks) if marks[i] == 0]
    model = compression.learn(docs, labels)
    assert model == compression.learn(docs.repartition(7), labels.repartition(3))
    for r in compression.quality_scores(docs, model).collect():
        data = (texts[r.doc_id] or "").encode()
        a, b = (
            len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d),
                                         write_content_size=False, write_dict_id=False).compress(data))
            for d in (model.good, model.bad)
        )
        d, s, n = (b - a) / (b + a), math.log((a + b) / 2 / (len(data) + 1)), math.log(len(data) + 1)
        x = [1, d, d * d, s, s * s, d * s, n, n * d]
        z = [min(max((v - m) / w, low), high) for v, m, w, low, high in zip(x, *model[2:6])]
        score = 1 / (1 + math.exp(-sum(v * w for v, w in zip(z, model.weights))))
        assert abs(r.score - score) < 1e-9 and r.predicted == int(score >= 0.7)


def test_the_sample_is_bounded(spark, monkeypatch):
    """By number and by bytes; repeated ids count once, ids with both labels not at all."""
    ids = [i for i in range(400) if not _held(i)]
    rows = [(i, f"{i} " + "text " * 20) for i in ids] + [(ids[0], "again"), (ids[1], None), (None, "no id")]
    rows += [(ids[2], "copy " * 10)] * 500 + [(ids[3], "w" * 10_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = [(i, i % 2, 0) for i in ids] * 3 + [(ids[0], 1 - ids[0] % 2, 0), (None, 1, 0), (ids[4], 5, 0)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    good, bad = _sample(monkeypatch, docs, labels, sample=30)
    assert len(good) == len(bad) == 30
    good, bad = _sample(monkeypatch, docs, labels, sample_bytes=1_000)
    assert 5 <= len(good) <= 10 and 5 <= len(bad) <= 10
    assert max(sum(map(len, texts)) for texts in (good, bad)) <= 1_000
    good, bad = _sample(monkeypatch, docs, labels)
    wanted = {i for i in ids[1:]}
    assert len(good) + len(bad) == len(wanted) and not any(t.startswith(f"{ids[0]} ") for t in good + bad)


def test_quality_of_the_held_out_quarter(spark):
    found = {r.doc_id: r for r in QUERIES["op9_quality_classifier"](spark, BIG).collect()}
    assert len(found) == read_table(spark, BIG, "documents").count()
    assert all(r.held_out == _held(r.doc_id) and 0 <= r.score <= 1 for r in found.values())
    assert all(r.predicted == int(r.score >= 0.7) for r in found.values())
    labels = [r for r in read_table(spark, BIG, "labels").collect() if _held(r.doc_id)]
    assert np.mean([found[r.doc_id].predicted == r.quality for r in labels]) > 0.95
    assert np.mean([found[r.doc_id].predicted for r in labels if r.quality == 1]) > 0.97


def test_quality_of_odd_texts(spark, medium):
    texts = [None, "", "x", "one line of text " * 30000, "same", "same"]
    df = spark.createDataFrame([(i if i else None, t, 0.0) for i, t in enumerate(texts)], "doc_id bigint, text string, score double")
    model = compression.learn(read_table(spark, medium, "documents"), read_table(spark, medium, "labels"))
    found = {r.doc_id: r.score for r in compression.quality_scores(df, model).collect()}
    assert len(found) == 6 and found[None] == found[1] and found[4] == found[5]
    assert compression.quality_scores(df.limit(0), model).count() == 0
    labels = read_table(spark, medium, "labels").limit(0)
    assert compression.learn(df, labels) is None
    assert {r.score for r in compression.quality_scores(df, None).collect()} == {0.5}
