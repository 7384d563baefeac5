import random
import re

from tallymill.llm import decontaminate as dec


def _words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(docs, items):
    """docs, items: id -> text. Id -> (words, hit words, items, contaminated)."""
    windows = {}
    for item, text in items.items():
        w = _words(text)
        for s in range(max(len(w) - 13, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + 13]), set()).add(str(item))
    out = {}
    for doc, text in docs.items():
        w, hit, found = _words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out[doc] = (len(w), len(hit), sorted(found), 0 < len(hit) and 20 * len(hit) >= len(w))
    return out


def test_random_texts_like_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["the", "of", "Ä", "é9", "x"] + [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([5, 65])]) for _ in range(n))
    items = {i: say(rng.choice([1, 2, 5, 12, 13, 14, 30])) for i in range(30)} | {90: None, 91: "!?", 92: "THE Of"}
    docs = {}
    for i in range(200):
        parts = [say(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            w = (items[rng.randrange(30)] or "").split()
            at = rng.randrange(len(w))
            parts += [" ".join(w[at:] if rng.random() < 0.5 else w), say(rng.randrange(150))]
        docs[i] = ", ".join(parts)
    docs |= {500: None, 501: "", 502: "the " * 30000}
    d = spark.createDataFrame([(k, v, "") for k, v in docs.items()], "doc_id bigint, text string, fp string")
    b = spark.createDataFrame([(k, v, 1) for k, v in items.items()], "item_id int, text string, doc_id int")
    found = dec.contamination(d, b).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in found} == contamination(docs, items)
    kept = dec.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if not r.contaminated}


def test_repeats_nulls_and_empty_tables(spark):
    d = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (1, "other")], "doc_id bigint, text string")
    b = spark.createDataFrame([(None, "A b"), (2, "b C"), (2, "zz")], "item_id bigint, text string")
    found = sorted((r.doc_id or 0, r.n_words, r.n_hit, list(r["items"])) for r in dec.contamination(d, b).collect())
    assert found == [(0, 3, 3, ["", "2"]), (1, 1, 0, []), (1, 3, 3, ["", "2"]), (1, 3, 3, ["", "2"])]
    assert dec.contamination(d.limit(0), b).count() == 0
    assert not any(r.contaminated for r in dec.contamination(d, b.limit(0)).collect())


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = {1: item, 2: item.replace("two", "two and a half"), 3: " ".join(reversed(item.split())), 4: item.replace("one", "uno")}
    rows = [(i, t) for i, t in docs.items()] + [(9, "two two")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    b = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    found = {r.doc_id: (list(r["items"]), list(r.near_items)) for r in dec.contamination(d, b, slop=3).collect()}
    assert found[1] == (["7"], ["7"]) and found[2] == ([], ["7"]) and found[3] == ([], []) and found[9] == ([], [])


def test_proximity_of_every_word(spark):
    """All words count, not the three rarest only, and documents may begin within a window."""
    w = [f"w{i}" for i in range(13)]
    rest = [x for x in w if x not in ("w1", "w5", "w9")]
    docs = {1: [w[1], w[0], *w[2:]], 2: rest[::-1], 4: rest[::-1] + ["z"],
            3: [x if x in ("w1", "w5", "w9") else f"x{i}" for i, x in enumerate(w)]}
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in docs.items()], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, " ".join(w))], "item_id bigint, text string")
    found = {r.doc_id: (list(r["items"]), list(r.near_items)) for r in dec.contamination(d, b, slop=3).collect()}
    assert found == {1: ([], ["7"]), 2: ([], []), 3: ([], []), 4: ([], [])}


def near_items(docs, items, slop):
    """Id -> items with a window whose words all stand up to ``slop`` off, as seen from
    the place of its rarest word, the first such word of the window."""
    said = {d: _words(t) for d, t in docs.items()}
    df = {}
    for w in said.values():
        for term in set(w):
            df[term] = df.get(term, 0) + 1
    out = {d: set() for d in docs}
    for item, text in items.items():
        w = _words(text)
        for s in range(max(len(w) - 13, 0) + 1 if w else 0):
            window = w[s : s + 13]
            if any(term not in df for term in window):
                continue
            off = min(range(len(window)), key=lambda i: (df[window[i]], i))
            for d, words in said.items():
                starts = [p - off for p, term in enumerate(words) if term == window[off]]
                near = lambda b, i: window[i] in words[max(b + i - slop, 0) : max(b + i + slop + 1, 0)]  # noqa: B023, E731
                if any(all(near(b, i) for i in range(len(window))) for b in starts):
                    out[d].add(str(item))
    return {d: sorted(x) for d, x in out.items()}


def test_random_near_places_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dec, "DEALT", 7)  # so frequent words' postings lie in many parts
    rng = random.Random(8)
    vocabulary = ["the", "of", "Ä"] + [f"w{i}" for i in range(40)]
    say = lambda n: [rng.choice(vocabulary[: rng.choice([3, 43])]) for _ in range(n)]
    items = {i: " ".join(say(rng.choice([1, 2, 5, 13, 15]))) for i in range(25)} | {90: None}
    docs = {}
    for i in range(150):
        w = items[rng.randrange(25)].split()
        for _ in range(rng.randrange(4)):  # words are moved, put in and left out
            at = rng.randrange(len(w) + 1)
            w = rng.choice([w[:at] + say(1) + w[at:], w[:at][:-1] + w[at:] + w[:at][-1:], w[:at] + w[at + 1 :]])
        docs[i] = " ".join(say(rng.randrange(4)) + w + say(rng.randrange(40)))
    docs |= {500: None, 501: "", 502: "the " * 5000}
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    b = spark.createDataFrame(list(items.items()), "item_id int, text string")
    for slop in (1, 2):
        found = dec.contamination(d, b, slop=slop).collect()
        near = near_items(docs, items, slop)
        assert {r.doc_id: list(r.near_items) for r in found} == near
        assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in found} == contamination(docs, items)
        assert sum(len(near[r.doc_id]) > len(r["items"]) for r in found) > 10
