"""Packing of documents into training sequences by the sum-of-squares rule."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame

from tallymill.llm.common import column
from tallymill.llm.tokens import Tokens

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEQUENCE, END = 1024, 0
# Sequence ids of different tasks are this far apart.
TASK_STRIDE = 1 << 40
# Documents handled before their finished pieces are handed on.
SLICE = 256

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


class Packer:
    """Open windows by fill level, and the number of windows at each level.

    A piece goes to the level that leaves the smallest sum of squared counts; an
    empty window is level 0 and counts nothing. A piece is (doc_id, start, ids,
    doc_tokens).
    """

    def __init__(self, first_id: int, capacity: int = SEQUENCE):
        self.capacity, self.next_id = capacity, first_id
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity)]

    def level_for(self, size: int) -> int:
        levels = np.arange(self.capacity - size + 1)
        leaving = 1 - 2 * self.count[levels]
        leaving[0] = 0
        arriving = 1 + 2 * self.count[levels + size]
        arriving[-1] = 0
        change = leaving + arriving
        change[1:][self.count[1 : self.capacity - size + 1] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(change[::-1].argmin())

    def place(self, piece: tuple) -> list[tuple]:
        """The rows of the window that this piece completes, if it does."""
        size = len(piece[2])
        level = 0 if size == self.capacity else self.level_for(size)
        window = []
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
        window.append(piece)
        if level + size == self.capacity:
            return self.rows(window)
        self.open[level + size].append(window)
        self.count[level + size] += 1
        return []

    def rows(self, window: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for doc, start, ids, tokens in window:
            out.append((doc, start, len(ids), ids.tobytes(), tokens, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1
        return out

    def close(self) -> Iterator[list[tuple]]:
        """The rows of the windows still open: the fullest are filled up with
        what the emptiest hold, cut where needed. What is left at the end goes
        to sequences whose sizes are powers of two, so nothing is padded."""
        windows = [w for level in self.open for w in level]
        while windows:
            window = windows.pop()
            room = self.capacity - sum(len(p[2]) for p in window)
            while room and windows:
                doc, start, ids, tokens = windows[0].pop()
                taken, kept = ids[max(0, len(ids) - room) :], ids[: max(0, len(ids) - room)]
                window.append((doc, start + len(kept), taken, tokens))
                room -= len(taken)
                if len(kept):
                    windows[0].append((doc, start, kept, tokens))
                if not windows[0]:
                    windows.pop(0)
            if not room:
                yield self.rows(window)
                continue
            while window:
                size = 1 << (sum(len(p[2]) for p in window).bit_length() - 1)
                part, filled = [], 0
                while filled < size:
                    doc, start, ids, tokens = window.pop(0)
                    part.append((doc, start, ids[: size - filled], tokens))
                    if len(ids) > size - filled:
                        window.insert(0, (doc, start + size - filled, ids[size - filled :], tokens))
                    filled += len(part[-1][2])
                yield self.rows(part)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW
    )


def _packed(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        packer = Packer(TaskContext.get().partitionId() * TASK_STRIDE)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part, rows = batch.slice(at, SLICE), []
                for doc, text in zip(part["doc_id"].to_pylist(), part["t"]):
                    ids = np.append(tokens.ids(text.as_py() or ""), END).astype("<u4")
                    for start in range(0, len(ids), SEQUENCE):
                        piece = ids[start : start + SEQUENCE]
                        rows += packer.place((doc, start, piece, len(ids)))
                yield _batch(rows)
        for rows in packer.close():
            yield _batch(rows)

    return run


def packed_pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) per piece.

    A document's tokens are its ids in ``vocabulary`` (a file every worker can
    read), then one end token; ``ids`` holds the piece's as little-endian 32-bit
    numbers, ``start`` counts the document's tokens before it, ``offset`` those
    before it in its sequence. Full windows of a long document are sequences of
    their own; the rest of it, like every shorter document, is placed online at
    the fill level with the smallest sum of squares. Each task packs its own
    share of ``docs`` in one pass and holds only its open windows; when its input
    ends, open windows fill each other up, which cuts a few more documents, and
    the remainder forms sequences of powers of two. No sequence needs padding.

    Null and empty texts are one end token. Repeated rows are packed each for
    itself, a null ``doc_id`` stays null, other columns play no part, and an
    empty table gives no piece. A repeated task gives the same sequences, as long
    as its input is stored and not the result of an unordered shuffle.
    """
    rows = docs.select(column(doc_id).cast("bigint").alias("doc_id"), column(text).alias("t"))
    return rows.mapInArrow(_packed(vocabulary), PIECES)
