"""Pairs of names within EDITS edits, exactly, by what deletions leave, block against block.

If the longer of two names of m characters is at most three edits from the other, deleting three of its
characters can leave what deleting some of the other's leaves, m - 3 characters in both. Each name
has a 64-bit number for each of its leavings: a sum of three terms, one for each deletion, so numbers of many
names are worked out at once. Names are dealt to blocks, and each pair of blocks meets in one task: it holds
the numbers of one block, sorted, and looks up those of the others. Pairs that meet are compared at once, one bit
for each character (Myers 1999). So each pair comes up in one place, nothing but names is shuffled, no row
is made for a leaving, and a task's memory goes by BLOCK alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of a block, of a row in the shuffle, and numbers or pairs that are worked on at once.
BLOCK, PACKET, AT_ONCE = 1 << 15, 1 << 13, 1 << 17
#: Edits; characters of the longer name of a pair at least, and of any name at most.
EDITS, LEAST, MOST = 3, 8, 31
#: Links that are held before they become stars.
HELD = 1 << 21
MARK, PLACE = 25, 23  # leading bits of a number that say whether, and about where, it is held
OWNER = np.uint64(17)  # last bits of a held number, which give way to its name's place and mark

_DRAWN = np.random.default_rng(20240).integers(0, 2**64, 257, dtype=np.uint64)
LETTER, BASE = _DRAWN[:256], int(_DRAWN[256]) | 1
POWERS = np.array([pow(BASE, i, 2**64) for i in range(MOST + 1)], dtype=np.uint64)
BACK = np.array([pow(BASE, -i, 2**64) for i in range(EDITS + 1)], dtype=np.uint64)
DELETED = {n: [np.array(list(combinations(range(n), k)), dtype=np.int64).reshape(comb(n, k), k) for k in range(EDITS + 1)] for n in range(LEAST - EDITS, MOST + 1)}


class Names:
    """Names as rows of bytes, with their ranks and kinds."""

    def __init__(self, ranks: np.ndarray, names: list[str], kinds: np.ndarray):
        each = [x.encode() for x in names]
        self.ranks, self.kinds = ranks, kinds
        self.sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        self.bytes = np.zeros((len(each), MOST), dtype=np.uint8)
        self.bytes[np.arange(MOST) < self.sizes[:, None]] = np.frombuffer(b"".join(each), dtype=np.uint8)

    def numbers(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(names, numbers with a row for each of them, which columns leave more than EDITS deletions do)."""
        for n in np.unique(self.sizes).tolist():
            if n < LEAST - EDITS:
                continue
            levels = [k for k in range(EDITS + 1) if n - k >= LEAST - EDITS]
            deleted = [DELETED[n][k] for k in levels]
            more = np.repeat([k < EDITS for k in levels], [len(x) for x in deleted])
            every, step = np.flatnonzero(self.sizes == n), max(1, AT_ONCE // len(more))
            for at in (every[i : i + step] for i in range(0, len(every), step)):
                sums = np.zeros((len(at), n + 1), dtype=np.uint64)
                np.cumsum(LETTER[self.bytes[at, :n]] * POWERS[:n], axis=1, out=sums[:, 1:])
                moved = [sums * BACK[k] for k in range(EDITS + 1)]
                terms = [moved[k][:, :-1] - moved[k + 1][:, 1:] for k in range(EDITS)]
                parts = []
                for k, places in zip(levels, deleted, strict=True):
                    part = np.repeat((moved[k][:, -1] + self.kinds[at])[:, None], len(places), axis=1)
                    for i in range(k):
                        part += terms[i][:, places[:, i]]
                    parts.append(part)
                yield at, np.concatenate(parts, axis=1), more


def distances(masks: np.ndarray, i: np.ndarray, sizes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Edits between names of given sizes, whose letters' places are in rows i of masks, and texts, rows of bytes of one length."""
    begin, letters = i * masks.shape[1], np.ascontiguousarray(texts.T)
    flat, one = masks.ravel(), np.uint32(1)
    plus, minus = np.full(len(i), 0xFFFFFFFF, dtype=np.uint32), np.zeros(len(i), dtype=np.uint32)
    for letter in letters:
        same = flat.take(begin + letter)
        across = (((same & plus) + plus) ^ plus) | same
        up, down = minus | ~(across | plus), plus & across
        same |= minus
        up = (up << one) | one
        plus = (down << one) | ~(same | up)
        minus = up & same
    whole = (one << sizes.astype(np.uint32)) - one  # steps down the last column sum up to the distance
    return len(letters) + np.bitwise_count(plus & whole).astype(np.int32) - np.bitwise_count(minus & whole)


class Block:
    """The numbers of a block's names, to be looked up."""

    def __init__(self, names: Names):
        self.names = names
        keys = [np.empty(0, np.uint64)]
        for at, numbers, more in names.numbers():
            owner = (at[:, None] * 2 + more[None, :]).astype(np.uint64)
            keys.append((numbers >> OWNER << OWNER | owner).ravel())
        self.keys = np.concatenate(keys)
        del keys
        self.keys.sort()
        self.marks = np.zeros(1 << MARK, dtype=bool)
        self.marks[self.keys >> np.uint64(64 - MARK)] = True
        self.begins = np.searchsorted(self.keys, np.arange(1 << PLACE, dtype=np.uint64) << np.uint64(64 - PLACE)).astype(np.int32)
        self.begins = np.append(self.begins, np.int32(len(self.keys)))
        self.masks = np.zeros((len(names.sizes), 128), dtype=np.uint32)
        for t in range(MOST):
            here = np.flatnonzero(names.sizes > t)
            self.masks[here, names.bytes[here, t]] |= np.uint32(1 << t)

    def close(self, other: Names) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(name here, name of the other, edits) of pairs of a kind with at most EDITS edits; of the block itself, each once."""
        waiting, held, size = [], 0, 0
        for at, numbers, more in other.numbers():
            if held >= AT_ONCE or held and other.sizes[at[0]] != size:
                yield from self._compared(other, np.concatenate(waiting))
                waiting, held = [], 0
            size = other.sizes[at[0]]
            flat = numbers.ravel()
            some = np.flatnonzero(self.marks[flat >> np.uint64(64 - MARK)])
            key = flat[some]
            place = (key >> np.uint64(64 - PLACE)).astype(np.int32)
            begin = self.begins[place]
            many = self.begins[place + 1] - begin
            which = np.repeat(np.arange(len(some)), many)
            where = np.arange(len(which)) + np.repeat(begin - (np.cumsum(many) - many), many)
            near = self.keys[where]
            good = (near ^ key[which]) >> OWNER == 0
            owner, found = (near[good] & ((np.uint64(1) << OWNER) - np.uint64(1))).astype(np.int64), some[which[good]]
            row, column = np.divmod(found, len(more))
            mine, theirs = owner >> 1, at[row]
            good = ~(more[column] & (owner & 1 == 1))  # where both lack fewer, others of their leavings meet too
            if other is self.names:
                good &= mine < theirs
            pairs = np.sort(mine[good] << 32 | theirs[good])
            waiting.append(pairs[np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)]])
            held += len(waiting[-1])
        if held:
            yield from self._compared(other, np.concatenate(waiting))

    def _compared(self, other: Names, pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of pairs with names of one length of the other."""
        n = int(other.sizes[pairs[0] & 0xFFFFFFFF])
        for k in range(0, len(pairs), AT_ONCE // 8):
            i, j = pairs[k : k + AT_ONCE // 8] >> 32, pairs[k : k + AT_ONCE // 8] & 0xFFFFFFFF
            sizes = self.names.sizes[i]
            far = distances(self.masks, i, sizes, other.bytes[j, :n])
            good = (far <= EDITS) & (self.names.kinds[i] == other.kinds[j]) & (np.maximum(sizes, n) >= LEAST)
            yield i[good], j[good], far[good]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links but the smallest of its component, and that smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least, before = np.minimum(label[x], label[y]), label.copy()
        for end in (x, y):
            np.minimum.at(label, before[end], least)
            np.minimum.at(label, end, least)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def close_names(tags: DataFrame, connected: bool = False, block: int = BLOCK) -> DataFrame:
    """(rank1, rank2, dist) of tags (rank, name, kind) of a kind at most EDITS edits apart, one of LEAST characters or more, each pair once.

    Names are of single bytes and have at most MOST. connected: stars that connect what the pairs do, instead of the pairs.
    """
    h, n = F.xxhash64("rank"), tags.count()
    blocks, parts = max(1, -(-n // block)), max(1, -(-block // PACKET))
    named = tags.select(F.pmod(h, F.lit(blocks)).cast("int").alias("own"), F.pmod(F.xxhash64(h), F.lit(parts)).alias("part"), F.struct("rank", "name", F.xxhash64("kind").alias("kind")).alias("tag"))
    packets = named.groupBy("own", "part").agg(F.collect_list("tag").alias("tags"))
    # each block meets itself and the next half of them, in the order of a ring
    met = packets.withColumn("ahead", F.explode(F.sequence(F.lit(0), F.lit(blocks // 2)))).withColumn("at", F.pmod(F.col("own") - F.col("ahead"), F.lit(blocks)))
    if blocks % 2 == 0:
        met = met.where((2 * F.col("ahead") < blocks) | (2 * F.col("at") < blocks))

    def names(column: pa.Array, rows: np.ndarray) -> Names:
        flat = column.take(pa.array(rows)).flatten()
        return Names(flat.field("rank").to_numpy().astype(np.int64), flat.field("name").to_pylist(), flat.field("kind").to_numpy().view(np.uint64))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, held, links, n_links = None, [], None, [], 0

        def batch_of(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).astype(np.int32)), pa.array(np.maximum(a, b).astype(np.int32)), pa.array(far.astype(np.int32))], names=["rank1", "rank2", "dist"])

        def thinned() -> tuple[np.ndarray, np.ndarray]:
            return stars(np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))

        def found(other: Names) -> Iterator[pa.RecordBatch]:
            nonlocal links, n_links
            for i, j, far in held.close(other):
                a, b = held.names.ranks[i], other.ranks[j]
                if not connected:
                    yield batch_of(a, b, far)
                    continue
                links.append((a, b))
                n_links += len(a)
                if n_links >= HELD:
                    links = [thinned()]
                    n_links = len(links[0][0])

        def built() -> Iterator[pa.RecordBatch]:
            nonlocal held, own
            if own:
                held = Block(Names(np.concatenate([x.ranks for x in own]), [bytes(r[:s]).decode() for x in own for r, s in zip(x.bytes, x.sizes.tolist(), strict=True)], np.concatenate([x.kinds for x in own])))
                own = []
                yield from found(held.names)

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal held, links, n_links
            yield from built()
            if links:
                a, b = thinned()
                yield batch_of(a, b, np.zeros(len(a)))
            held, links, n_links = None, [], 0

        for batch in batches:
            where, ahead = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for r in range(batch.num_rows):
                if where[r] != at:
                    yield from ended()
                    at = where[r]
                packet = names(batch.column(2), np.array([r]))
                if not ahead[r]:
                    own.append(packet)
                    continue
                yield from built()
                if held is not None:
                    yield from found(packet)
        yield from ended()

    dealt = met.select("at", "ahead", "tags").repartition(blocks, "at").sortWithinPartitions("at", "ahead")
    return dealt.mapInArrow(compare, "rank1 int, rank2 int, dist int")
