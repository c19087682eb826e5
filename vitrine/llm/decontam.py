"""Benchmark passages in documents by CGK embedding and bit-sampling LSH.

Texts are sequences of lower-case words. The CGK walk (Chakraborty, Goldenberg and Koucky 2016)
reads a window with a pointer that stays or advances by a random bit of (step, word). Two windows
at a small edit distance fall into step again after each edit, so the sequences that the walk
reads have a small Hamming distance. LSH for that distance samples steps of the walk.

Windows have the item's size: an item of n words is compared with windows of n words. Each
repetition draws its own bits and samples two steps of the walk. All repetitions of a size walk at
once; a window leaves a repetition at the first sample that no item has there. How many repetitions
a size needs for the target recall, with as many edits as verification accepts, is found by walking
over edited sequences, drawn anew from a fixed seed for that size.

Steps sampled from a walk lie near a window's beginning, so long items are searched for by parts too, of
at most PART words: where a match has few enough edits for the item, one part at least has few enough for its
own words, wherever in the item the edits are.

A window is walked only if it can hold a match: of an item's n - 1 neighbouring pairs of words each
edit takes two away at most, so windows with fewer than n - 1 - 2 * edits of them hold none.
Where that says nothing, single words are counted, or all windows are walked.

Windows that agree on a repetition's samples are verified exactly: the least edit distance, in
words, of the item to any stretch of the document there must be at most (1 - similarity) of the
item's words. The distances of all candidates of an item are worked out at once, a row for each of
its words.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import common

WORD = re.compile(r"[^\W_]+")
#: For texts in Latin-1: each letter or digit lower-cased, a blank for all else; so words are what blanks leave.
LATIN = bytes(ord(c.lower()) if WORD.match(c) else 32 for c in map(chr, range(256)))
RECALL = 0.98
#: Samples are taken from so many first steps of a walk, where edits have driven the fewest walks apart.
STEPS = 32
#: Words of a part of an item at most: as many as a walk of STEPS reads.
PART = 16
#: Walks and edited sequences that measure how often a repetition finds an item.
TRIALS, WALKS = 150, 64
#: Bytes of items that are searched for in one pass; more items take more passes.
PASS_BYTES = 8 << 20
#: Pairs of window and repetition that walk at once.
PAIRS = 1 << 18
EDIT = np.int64(1) << 32  # an edit's worth beside the place of a match's first word


def accepted(n: int, similarity: float) -> int:
    """Edits that verification accepts for an item of n words."""
    return int((1 - similarity) * n + 1e-9)


def multipliers(n: int, rounds: int, seed: int = 20240) -> np.ndarray:
    """An odd 64-bit number for each (repetition, step) of a walk over n words."""
    return np.random.default_rng([seed, n]).integers(0, 2**64, (rounds, min(2 * n, STEPS)), dtype=np.uint64) | np.uint64(1)


def advances(words: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The walk's random bit for words under the factors of their repetition and step."""
    return ((words.astype(np.uint64) + np.uint64(1)) * factors >> np.uint64(63)).astype(np.int64)


def walked(rows: np.ndarray, factors: np.ndarray, pad: int) -> np.ndarray:
    """(rows, repetitions, steps): the words that each row's walks read; pad after its end."""
    count, n = rows.shape
    rounds, steps = factors.shape
    padded = np.concatenate([rows, np.full((count, 1), pad, dtype=rows.dtype)], axis=1)
    place = np.zeros((count, rounds), dtype=np.int64)
    out = np.empty((count, rounds, steps), dtype=np.int64)
    for t in range(steps):
        out[:, :, t] = read = np.take_along_axis(padded, place, axis=1)
        place = np.minimum(place + advances(read, factors[:, t]), n)
    return out


@cache
def repetitions(n: int, similarity: float, recall: float = RECALL) -> int:
    """Repetitions of two samples for items of n words, with the edits that are accepted at random places.

    Beyond 32 words sizes are rounded up to a power of two.
    """
    if n > 32:
        n = 1 << (n - 1).bit_length()
    edits = accepted(n, similarity)
    if not edits:
        return 1
    rng = np.random.default_rng([7, n])
    want, near = np.arange(1, n + 1), np.empty((TRIALS, n), dtype=np.int64)
    for i in range(TRIALS):
        words: list[int] = []
        kinds = dict(zip(rng.choice(n, edits, replace=False).tolist(), rng.integers(0, 3, edits).tolist(), strict=True))
        for k, w in enumerate(want.tolist()):
            kind = kinds.get(k)
            words += [w] if kind is None else [[n + 1 + k], [], [w, n + 1 + k]][kind]
        near[i] = (words + list(range(3 * n, 4 * n)))[:n]
    factors = multipliers(n, WALKS, 11)
    agree = walked(near, factors, -1) == walked(want[None, :], factors, -1)
    same, steps = agree.sum(axis=2), agree.shape[2]
    found = (same * (same - 1)).mean(axis=1) / (steps * (steps - 1))  # by an edited sequence: one repetition's chance
    rounds = 1
    while ((1 - found) ** rounds).mean() > 1 - recall and rounds < 4096:
        rounds += 1 + rounds // 16
    return rounds


class Size:
    """The repetitions for all items of n words, compiled."""

    def __init__(self, n: int, rows: np.ndarray, members: list[int], similarity: float, pad: int, rounds: int | None):
        self.n, self.pad, self.edits = n, pad, accepted(n, similarity)
        self.rounds = rounds or repetitions(n, similarity)
        self.factors = multipliers(n, self.rounds)
        steps = self.factors.shape[1]
        rng = np.random.default_rng([3, n])
        picked = np.sort(np.argsort(rng.random((self.rounds, steps)), axis=1)[:, :2], axis=1)
        self.due = np.zeros((steps, self.rounds), dtype=np.int8)  # 1, 2: the first, second sample is taken here
        each = np.arange(self.rounds)
        self.due[picked[:, 0], each], self.due[picked[:, 1], each] = 1, 2
        read = np.concatenate([walked(rows[i : i + 256], self.factors, pad)[:, each[:, None], picked] for i in range(0, len(rows), 256)])
        first = (each[None, :] * (pad + 1) + read[:, :, 0]).reshape(-1)
        self.first, state = np.unique(first, return_inverse=True)
        second = state * (pad + 1) + read[:, :, 1].reshape(-1)
        owner = np.repeat(np.array(members), self.rounds)
        order = np.argsort(second, kind="stable")
        self.second, at = np.unique(second[order], return_index=True)
        self.owners, self.ends = owner[order], np.append(at, len(order))

    def candidates(self, row: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, item) of the windows of row at places that agree with an item."""
        found = [self._walk(row, places[i : i + max(1, PAIRS // self.rounds)]) for i in range(0, len(places), max(1, PAIRS // self.rounds))]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def _walk(self, row: np.ndarray, places: np.ndarray) -> np.ndarray:
        begin, r = np.repeat(places, self.rounds), np.tile(np.arange(self.rounds), len(places))
        at, state = np.zeros(len(begin), dtype=np.int64), np.zeros(len(begin), dtype=np.int64)
        hits = [np.empty((0, 2), dtype=np.int64)]
        for t in range(len(self.due)):
            if not len(begin):
                break
            read = np.where(at < self.n, row[np.minimum(begin + at, len(row) - 1)], self.pad).astype(np.int64)
            due = self.due[t][r]
            if due.any():
                stays = due == 0
                one = np.flatnonzero(due == 1)
                key = r[one] * (self.pad + 1) + read[one]
                where = np.minimum(np.searchsorted(self.first, key), len(self.first) - 1)
                good = self.first[where] == key
                state[one[good]] = where[good]
                stays[one[good]] = True
                two = np.flatnonzero(due == 2)
                key = state[two] * (self.pad + 1) + read[two]
                where = np.minimum(np.searchsorted(self.second, key), len(self.second) - 1)
                good = self.second[where] == key
                if good.any():
                    low, many = self.ends[where[good]], np.diff(self.ends)[where[good]]
                    leaf = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
                    hits.append(np.stack([np.repeat(begin[two[good]], many), self.owners[leaf]], axis=1))
                begin, r, at, state, read = begin[stays], r[stays], at[stays], state[stays], read[stays]
            at = np.minimum(at + advances(read, self.factors[r, t]), self.n)
        return np.concatenate(hits)


def windows(hits: np.ndarray, least: int, span: int) -> np.ndarray:
    """First words of windows that hold at least so many of the ascending places, the last one at most span after the first word."""
    low, high = np.maximum(hits[least - 1 :] - span, 0), hits[: max(0, len(hits) - least + 1)]
    good = low <= high
    low, high = low[good], high[good]
    if not len(low):
        return low
    low = np.maximum(low, np.append(-1, high[:-1]) + 1)  # intervals in order, without what the one before has
    many = np.maximum(high - low + 1, 0)
    return np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())


class Search:
    """Compiled for a group of items: {item: text}."""

    def __init__(self, items: dict[int, str], similarity: float = 0.8, rounds: int | None = None):
        self.similarity = similarity
        self.words = {i: WORD.findall(lowered(t)) for i, t in items.items()}
        self.vocabulary: dict[str, int] = {}
        for words in self.words.values():
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.latin = {w.encode("latin-1"): k for w, k in self.vocabulary.items() if ord(max(w)) < 256}
        self.pad = len(self.vocabulary) + 1
        self.numbers = {i: np.array([self.vocabulary[w] for w in words], dtype=np.int64) for i, words in self.words.items()}
        # (item, first word, end) of whole items and of parts
        self.parts = [(i, 0, len(words)) for i, words in self.words.items() if words]
        for i, _, n in [x for x in self.parts if x[2] > PART]:
            cuts = [n * k // -(-n // PART) for k in range(-(-n // PART) + 1)]
            self.parts += [(i, a, b) for a, b in zip(cuts, cuts[1:])]
        self.item_of, self.first_of, self.end_of = (np.array(x, dtype=np.int64) for x in (zip(*self.parts, strict=True) if self.parts else ([], [], [])))
        self.pieces = [self.numbers[i][a:b] for i, a, b in self.parts]
        sizes = defaultdict(list)
        for p, x in enumerate(self.pieces):
            sizes[len(x)].append(p)
        self.sizes = [Size(n, np.stack([self.pieces[p] for p in own]), own, similarity, self.pad, rounds) for n, own in sorted(sizes.items())]
        # what windows are chosen by: 2 pairs of words, 1 words, 0 nothing; and how many of them
        self.grain = [2 if s.n - 1 - 2 * s.edits >= 1 else 1 if s.n - s.edits >= 1 else 0 for s in self.sizes]
        self.least = [[1, s.n - s.edits, s.n - 1 - 2 * s.edits][g] for s, g in zip(self.sizes, self.grain, strict=True)]
        self.known = [self._known(g) for g in (1, 2)]

    def _known(self, grain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, sizes that have them, where those of each key end) of single words or pairs of words."""
        found = [np.empty((0, 2), dtype=np.int64)]
        for k, s in enumerate(self.sizes):
            if self.grain[k] == grain:
                for i in s.owners[np.unique(s.owners, return_index=True)[1]].tolist():
                    x = self.pieces[i]
                    keys = x if grain == 1 else x[:-1] * self.pad + x[1:]
                    found.append(np.stack([keys, np.full(len(keys), k)], axis=1))
        both = np.unique(np.concatenate(found), axis=0)
        keys, at = np.unique(both[:, 0], return_index=True)
        return keys, both[:, 1], np.append(at, len(both))

    def candidates(self, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first word, part) for windows of row, word numbers with a 0 after each text and for strangers."""
        by_size: dict[int, list[np.ndarray]] = defaultdict(list)
        for grain, (known, sizes, ends) in zip((1, 2), self.known, strict=True):
            if not len(known):
                continue
            at = np.flatnonzero(row) if grain == 1 else np.flatnonzero((row[:-1] > 0) & (row[1:] > 0))
            key = row[at].astype(np.int64) if grain == 1 else row[at].astype(np.int64) * self.pad + row[at + 1]
            where = np.minimum(np.searchsorted(known, key), len(known) - 1)
            good = known[where] == key
            at, where = at[good], where[good]
            many = np.diff(ends)[where]
            own = sizes[np.repeat(ends[where] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            at = np.repeat(at, many)
            order = np.argsort(own, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                if len(part):
                    by_size[int(own[part[0]])].append(at[part])
        for k, s in enumerate(self.sizes):
            if self.grain[k] == 0:
                yield s.candidates(row, np.arange(len(row)))
            elif k in by_size:
                yield s.candidates(row, windows(by_size[k][0], self.least[k], s.n - self.grain[k]))

    def verified(self, item: int, row: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
        """(first word, end, edits) of the best match that ends at each word of the ranges of row, if it has few enough edits."""
        want = self.numbers[item]
        most = accepted(len(want), self.similarity)
        sizes = np.array([b - a + 1 for a, b in ranges])
        ends = np.cumsum(sizes)
        first = ends - sizes  # each range has a column for the place before its first word
        total = int(ends[-1])
        lead = np.repeat(np.array([a for a, _ in ranges]) - first, sizes)  # from columns to places in row
        words = np.zeros(total, dtype=np.int64)
        inner = np.ones(total, dtype=bool)
        inner[first] = False
        column = np.arange(total)
        words[inner] = row[(column + lead)[inner] - 1]
        far = (column + np.repeat(np.arange(len(ranges)) * 2 * (len(want) + 2), sizes)) * EDIT
        now = (np.int64(1) << 31) - column  # no edits; of equal ones the match that begins last
        for w in want.tolist():
            changed = np.empty(total, dtype=np.int64)
            changed[1:] = now[:-1] + EDIT * (words[1:] != w)
            changed[first] = now[first] + EDIT
            now = np.minimum.accumulate(np.minimum(changed, now + EDIT) - far) + far
        edits = now >> 32
        good = np.flatnonzero((edits <= most) & inner)
        begin = (np.int64(1) << 31) - (now[good] & (EDIT - 1))
        return np.stack([begin + lead[good], good + lead[good], edits[good]], axis=1)

    def read(self, text: str) -> np.ndarray:
        """The numbers of a text's words, 0 for strangers."""
        try:
            own, get = text.encode("latin-1").translate(LATIN).split(), self.latin.get
        except UnicodeEncodeError:
            own, get = WORD.findall(lowered(text)), self.vocabulary.get
        return np.fromiter(map(get, own, repeat(0)), dtype=np.int32, count=len(own))

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text its matches (item, begin, end, edits) in code points, those of an item without overlaps."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not self.sizes:
            return out
        rows, sizes = [], []
        gap = np.zeros(1, dtype=np.int32)
        for t in texts:
            rows += [self.read(t or ""), gap]
            sizes.append(len(rows[-2]))
        if not sizes:
            return out
        row = np.concatenate(rows)
        last = np.cumsum(np.array(sizes) + 1) - 1  # where each text ends
        begin = last - np.array(sizes)
        by_item: dict[int, list[np.ndarray]] = defaultdict(list)
        for places, parts in self.candidates(row):
            items, shift = self.item_of[parts], self.first_of[parts]
            # a window belongs to the text that holds its middle
            text = np.minimum(np.searchsorted(last, places + (self.end_of[parts] - shift) // 2), len(last) - 1)
            places = np.stack([places - shift, text])
            order = np.argsort(items, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(items[order])) + 1):
                if len(part):
                    by_item[int(items[part[0]])].append(places[:, part])
        seen: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        for item, found in by_item.items():
            places, text = np.concatenate(found, axis=1)
            n = len(self.words[item])
            most = accepted(n, self.similarity)
            low, high = np.maximum(places - 2 * most, begin[text]), np.minimum(places + n + 2 * most, last[text])
            order = np.lexsort((low, text))
            low, high = low[order], np.maximum.accumulate(high[order])
            cuts = np.flatnonzero(low[1:] > high[:-1]) + 1  # texts are apart, so ranges of two never meet
            ranges = [(int(p[0]), int(q[-1])) for p, q in zip(np.split(low, cuts), np.split(high, cuts), strict=True) if len(p) and q[-1] > p[0]]
            if not ranges:
                continue
            taken: list[tuple[int, int]] = []  # ascending and apart
            got = self.verified(item, row, ranges)
            got = got[got[:, 1] > got[:, 0]]
            for a, b, edits in got[np.lexsort((got[:, 1], got[:, 0], got[:, 2]))].tolist():
                at = bisect(taken, (a, b))
                if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                    taken.insert(at, (a, b))
                    i = int(np.searchsorted(last, a))
                    seen[i].append((item, a - int(begin[i]), b - int(begin[i]), edits))
        for i, found in seen.items():
            spans = [m.span() for m in WORD.finditer(lowered(texts[i] or ""))]
            out[i] = [(item, spans[a][0], spans[b - 1][1], edits) for item, a, b, edits in sorted(found, key=lambda x: (x[0], x[3], x[1], x[2]))]
        return out


def lowered(text: str) -> str:
    """Lower case without a change of length, so that places in it are places in the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def searches(items: DataFrame, similarity: float, text: str = "text", key: str = "item_id") -> Iterator[tuple[Search, list[int | None]]]:
    """Items in groups of about PASS_BYTES, each compiled, and the ids of its items, which it knows by number.

    Each distinct (id, text) is an item. The driver holds one group at a time.
    """
    rows = items.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    groups = max(1, -(-total // PASS_BYTES))
    for g in range(groups):
        own = rows if groups == 1 else rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(groups)) == g)
        found = own.orderBy("k", "t").collect()
        yield Search({i: r.t for i, r in enumerate(found)}, similarity), [r.k for r in found]


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row (key, item_id, begin, end, edits) for each benchmark passage found in each row of docs.

    begin and end are code points of the whole text; edits are words. Null and empty texts, and
    items without words, match nothing. Items with equal ids or none are searched for one by one, and
    reported with the id they have. Repeated rows are searched one by one. Only key and text are read. No shuffle; one pass for each group of items.
    """
    spark, parts = docs.sparkSession, []
    kind = docs.schema[key].dataType.simpleString()
    for search, names in searches(items, similarity):
        held = spark.sparkContext.broadcast((search, names))

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            search, names = held.value
            for batch in batches:
                for part in common.slices(batch, 1):
                    ids = part.column(0).to_pylist()
                    rows = [(d, names[i], *m) for d, found in zip(ids, search.matches(part.column(1).to_pylist()), strict=True) for i, *m in found]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (part.column(0).type, *[pa.int64()] * 4), strict=True)], names=[key, "item_id", "begin", "end", "edits"])

        parts.append(docs.select(key, text).mapInArrow(find, f"{key} {kind}, item_id long, begin long, end long, edits long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, in whose whole text no benchmark passage is found."""
    spark = docs.sparkSession
    for search, _ in searches(items, similarity):
        docs = docs.where(_clean(spark.sparkContext.broadcast(search))(F.col(text)))
    return docs


def _clean(held):
    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            marks: list[bool] = []
            one = pa.RecordBatch.from_arrays([texts], names=["t"])
            for part in common.slices(one, 0):
                marks += [not m for m in held.value.matches(part.column(0).to_pylist())]
            yield pa.array(marks, pa.bool_())

    return clean
