"""Packing token sequences by the sum-of-squares rule.

Each document (its ids and an end id) is cut into full sequences and one remainder. Remainders go,
online, to open sequences. A remainder of r ids moves a sequence of fill level h to the level h + r;
beyond the capacity it is cut, fills the sequence, and its rest opens another at h + r less the
capacity, so the move is one between levels either way. Of the levels that are there, and a new
sequence, the rule takes the one that minimises the sum over levels of (number of open sequences
at that level) squared; of equal ones first a move without a cut, then the fullest. The counts are
kept in an array by level.

At most OPEN sequences are open: with as many, none is begun anew, which cutting always allows. So a
worker holds OPEN * capacity ids beside its batch. Each input partition packs its own documents, so
nothing is shuffled and no key can be hot. When a partition ends, the emptiest open sequence is
undone and its pieces are placed by the same rule, again and again; what is left of the last one
becomes sequences whose lengths are powers of two. Nothing is padded.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vitrine.llm import common
from vitrine.llm.wordids import word_ids

OPEN = 64
SEQUENCE_BITS = 32  # of a sequence id; the partition's number stands above them


class Piece:
    __slots__ = ("doc", "start", "ids", "doc_tokens")

    def __init__(self, doc, start: int, ids: bytes, doc_tokens: int):
        self.doc, self.start, self.ids, self.doc_tokens = doc, start, ids, doc_tokens

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: 4 * n], self.doc_tokens), Piece(self.doc, self.start + n, self.ids[4 * n :], self.doc_tokens)


class Packer:
    """Sum-of-squares packing of one partition; closed sequences are taken from .closed."""

    def __init__(self, capacity: int, most_open: int = OPEN):
        self.capacity, self.most_open, self.count = capacity, most_open, 0
        self.levels = np.zeros(capacity + 1, dtype=np.int64)  # open sequences at each fill level
        self.open: dict[int, list[list[Piece]]] = defaultdict(list)
        self.closed: list[list[Piece]] = []

    def add(self, doc, ids: bytes) -> None:
        n, c = len(ids) // 4, self.capacity
        for start in range(0, n - n % c, c):
            self.closed.append([Piece(doc, start, ids[4 * start : 4 * (start + c)], n)])
        if n % c:
            self.place(Piece(doc, n - n % c, ids[4 * (n - n % c) :], n), self.count < self.most_open)

    def choose(self, size: int, new: bool) -> int:
        """The level that size ids, under the capacity, are added to; 0: a new sequence."""
        c, levels = self.capacity, self.levels
        here = np.flatnonzero(levels[:c])
        if not len(here):
            return 0
        to = here + size
        change = 2 * (levels[to % c] - levels[here]) + 2
        change[to == c] -= 2 * levels[0] + 1  # a full sequence is no level any more
        cost = (2 * change + (to > c)) * c - here
        k = int(cost.argmin())
        return 0 if new and 2 * levels[size] + 1 < change[k] else int(here[k])

    def place(self, piece: Piece, new: bool) -> None:
        level, c = self.choose(len(piece), new), self.capacity
        sequence: list[Piece] = []
        if level:
            sequence = self.open[level].pop()
            self.levels[level] -= 1
            self.count -= 1
        rest = None
        if level + len(piece) > c:
            piece, rest = piece.cut(c - level)
        sequence.append(piece)
        level += len(piece)
        if level == c:
            self.closed.append(sequence)
            sequence, level = ([rest], len(rest)) if rest else ([], 0)
        if sequence:
            self.open[level].append(sequence)
            self.levels[level] += 1
            self.count += 1

    def finish(self) -> None:
        while self.count:
            level = int(np.flatnonzero(self.levels)[0])
            sequence = self.open[level].pop()
            self.levels[level] -= 1
            self.count -= 1
            if self.count:
                for piece in sequence:
                    self.place(piece, not self.count)
            else:
                self.closed += powers_of_two(sequence)


def powers_of_two(sequence: list[Piece]) -> list[list[Piece]]:
    """One sequence cut into some whose lengths are the powers of two that its length is the sum of."""
    total, pieces, out = sum(map(len, sequence)), sequence[::-1], []
    for bit in reversed(range(total.bit_length())):
        want = total & 1 << bit
        if want:
            out.append([])
        while want:
            piece = pieces.pop()
            if len(piece) > want:
                piece, rest = piece.cut(want)
                pieces.append(rest)
            out[-1].append(piece)
            want -= len(piece)
    return out


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every id of every document in exactly one piece: a row (key, start, length, ids_crc32,
    doc_tokens, sequence_id, offset) for each.

    Null and empty texts are the end id alone. Repeated rows and equal or null keys are packed as
    documents of their own. A text of any length is cut into full sequences. An empty table gives
    no rows. Only key and text are read, so other columns cannot clash. Sequence ids are unique but
    not dense: the partition's number stands in the upper bits. Open sequences are held in memory, at
    most OPEN of a worker.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    fields = [(key, None), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = word_ids(tokenizer), Packer(capacity)
        sequence, kind = TaskContext.get().partitionId() << SEQUENCE_BITS, None

        def rows() -> pa.RecordBatch:
            nonlocal sequence
            out: list[tuple] = []
            for pieces in packer.closed:
                at = 0
                for p in pieces:
                    out.append((p.doc, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, sequence, at))
                    at += len(p)
                sequence += 1
            packer.closed.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t or kind) for x, (_, t) in zip(zip(*out, strict=True) if out else [[]] * len(fields), fields, strict=True)], names=[n for n, _ in fields])

        for batch in batches:
            kind = batch.column(0).type
            for part in common.slices(batch, 1):
                for doc, ids in zip(part.column(0).to_pylist(), words.each(part.column(1).to_pylist()), strict=True):
                    packer.add(doc, ids.tobytes() + end)
                    if len(packer.closed) >= 2000:
                        yield rows()
        packer.finish()
        if packer.closed:
            yield rows()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(pack, f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
