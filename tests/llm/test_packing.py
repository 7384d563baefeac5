import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallymill.llm.packing import SEQUENCE, Packer, packed_pieces
from tallymill.llm.queries import QUERIES
from tallymill.llm.tokens import Tokens
from tallymill.sources.tables import read_table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _check(pieces, docs, crc=lambda p: p.ids_crc32):
    """Every id in one piece, sequences gapless, and none padded."""
    library = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(docs)
    for doc, parts in by_doc.items():
        ids = np.array(library.encode(docs[doc] or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert crc(p) == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= SEQUENCE and at & (at - 1) == 0


def test_whole_table(spark, medium):
    docs = {r.doc_id: r.text for r in read_table(spark, medium, "documents").collect()}
    _check(QUERIES["op4_packing"](spark, medium).collect(), docs)


def test_odd_texts(spark):
    docs = {
        1: None, 2: "", 3: " " * 5000 + "\n" * 5000, 4: "a" * 20000, 5: "x<|endoftext|>y <|endoftext|>",
        6: "naïve 😀 ñ\u0000\x1c it's IT'S  two", None: "no id", 8: "word " * 300000,
    }
    df = spark.createDataFrame([(k, v, 1) for k, v in docs.items()], "doc_id bigint, text string, ids int")
    _check(packed_pieces(df, PATH).collect(), docs, lambda p: zlib.crc32(p.ids))
    twice = packed_pieces(df.where("doc_id = 6").union(df.where("doc_id = 6")), PATH)
    assert len({(r.sequence_id, r.offset) for r in twice.collect()}) >= 2
    assert packed_pieces(df.limit(0), PATH).count() == 0


def test_levels_minimise_squares():
    rng, packer = random.Random(2), Packer(0, 40)
    for _ in range(500):
        size = rng.randrange(1, 41)
        counts = packer.count.copy()

        def squares(level):
            after = counts.copy()
            after[level] -= level > 0
            after[level + size] += level + size < 40
            return (after[1:40] ** 2).sum()

        if size < 40:
            fit = [h for h in range(40 - size + 1) if h == 0 or counts[h]]
            assert squares(packer.level_for(size)) == min(map(squares, fit))
        packer.place((0, 0, np.zeros(size, np.uint32), size))
        assert [len(w) for w in packer.open] == packer.count[:40].tolist()


def test_same_ids_as_the_library(spark, medium):
    library, own = Tokenizer.from_file(PATH), Tokens(PATH)
    for r in read_table(spark, medium, "pages").limit(100).collect():
        assert own.ids(r.html).tolist() == library.encode(r.html, add_special_tokens=False).ids
