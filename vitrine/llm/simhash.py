"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints. A bit is set if more than half of the text's shingle hashes have it set.

Candidates. Fingerprints that agree on one of several sets of bit positions meet in a bucket. With
64 bits and radius 2, four segments of which two must agree make this exact. For larger radii,
bands are chosen for recall.

Comparison. The fingerprints of a bucket are stored as bit planes: word j of plane i holds bit i of
64 of them. A fingerprint is compared with 64 others at once: its bit i, spread over a word, xor
plane i marks who differs, and carry-save adders count the marks in bit-sliced counters. When all 64
distances exceed the radius, the block is abandoned. Within a bucket only a spanning set of links is
kept. Buckets of more than BUCKET fingerprints are cut into blocks by hash and each pair of blocks
is compared in a place of its own, so no link is lost and no task gets an unbounded group.

Equal fingerprints are one row from the start, so copies cost nothing.

Where a Jaccard bound is asked for, fingerprints only find candidates, in a radius that leaves room
for their error, and whose sets are not too unlike in size. A link counts if the shingle sets
themselves reach the bound. Three rounds verify all candidates that matter. In the first, over a share
of the bands, each text tries its nearest few, which join most of what belongs together. In the second,
over all bands, each tries the nearest few outside its component; texts without any are done. The last
one tries every candidate pair whose ends are not yet in one component. There texts carry 16 bits of
each shingle's hash, which bound what two sets share from above, so that groups of texts just below the
similarity are told apart within a bucket and only pairs that pass the bound leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm import common
from vitrine.operators.graph import components

BUCKET = 1024
#: Bands of candidates have so many bits at least; beyond, buckets hold 2^BUCKET_BITS fingerprints of unlike texts.
LEAST_WIDTH, BUCKET_BITS = 13, 5
#: Buckets above BUCKET whose keys may be broadcast; with more of them the join shuffles.
BROADCAST_KEYS = 200_000
#: Nearest candidates that each text tries in a round but the last, and the part of the bands that the first takes.
TRIES, EARLY = 3, 4
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str | None, size: int) -> list[bytes]:
    """Shingles of a text's words, A-Z lower-cased, repeats included; of fewer words, all of them."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits from each hash: for k = 0 the hash itself."""
    if not k:
        return h
    h = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def fingerprint(text: str | None, size: int = 3, words: int = 1) -> bytes:
    """64 * words bits, little-endian; all zero for a text without words."""
    return majority(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(text, size)], dtype=np.uint64), words)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in set(shingles(text, size))], dtype=np.uint64))


def majority(hashes: np.ndarray, words: int) -> bytes:
    n, out = len(hashes), []
    for k in range(words):
        total = np.zeros(64, dtype=np.int64)
        for i in range(0, n, 1 << 16):
            bits = np.unpackbits(_mixed(hashes[i : i + (1 << 16)], k).astype("<u8").view(np.uint8), bitorder="little")
            total += bits.reshape(-1, 64).sum(axis=0, dtype=np.int32)
        out.append(np.packbits(2 * total > n, bitorder="little").tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, size: int, words: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, fp) for each row of docs, in one pass."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), size, words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], names=["id", "fp"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(each, "id long, fp binary")


def exact_keys(radius: int = 2, segments: int = 4, bits: int = 64) -> list[np.ndarray]:
    """Sets of bit positions: with at most radius differing bits, one set at least agrees."""
    width = bits // segments
    return [np.concatenate([np.arange(s * width, (s + 1) * width) for s in chosen]) for chosen in combinations(range(segments), segments - radius)]


def bands(bits: int, width: int) -> list[np.ndarray]:
    return [np.arange(i, i + width) for i in range(0, bits - width + 1, width)]


def add(counters: list[np.ndarray], a: np.ndarray, at: int = 0) -> None:
    """Adds the marks a, worth 2^at, to bit-sliced counters; the last one saturates."""
    for i in range(at, len(counters)):
        if i == len(counters) - 1:
            counters[i] |= a
        else:
            carry = counters[i] & a
            counters[i] ^= a
            a = carry


def exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    over, same = np.zeros_like(counters[0]), np.full_like(counters[0], ONES)
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            same &= counters[i]
        else:
            over |= same & counters[i]
            same &= ~counters[i]
    return over


def close_pairs(cells: np.ndarray, fps: np.ndarray, radius: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Indices (a, b), a < b, of rows of the same cell that differ in at most radius bits.

    cells: sorted cell of each row; fps: (rows, bytes) fingerprints. Bit-sliced as said above.
    """
    n, bits = len(cells), fps.shape[1] * 8
    first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    sizes = np.diff(np.r_[first, n])
    cell = np.repeat(np.arange(len(first)), sizes)
    place = np.arange(n) - first[cell]
    per_cell = -(-sizes // 64)
    word_first = np.cumsum(per_cell) - per_cell
    opened = np.unpackbits(fps, axis=1, bitorder="little")
    lane = (place % 64).astype(np.uint64)
    word_begin = np.flatnonzero(place % 64 == 0)
    planes = np.empty((bits, len(word_begin)), dtype=np.uint64)
    for i in range(bits):
        planes[i] = np.bitwise_or.reduceat(opened[:, i].astype(np.uint64) << lane, word_begin)
    in_word = np.diff(np.r_[word_begin, n])
    valid = np.where(in_word == 64, ONES, (np.uint64(1) << (in_word % 64).astype(np.uint64)) - np.uint64(1))
    # a row of comparison: one fingerprint against one word of its cell, from its own word on
    mine = word_first[cell] + place // 64
    left = per_cell[cell] - place // 64
    who = np.repeat(np.arange(n), left)
    word = np.repeat(mine, left) + np.arange(len(who)) - np.repeat(np.cumsum(left) - left, left)
    levels = (radius + 1).bit_length() + 1
    found_a, found_b = [], []
    for begin in range(0, len(who), 1 << 15):
        a, w = who[begin : begin + (1 << 15)], word[begin : begin + (1 << 15)]
        counters = [np.zeros(len(a), dtype=np.uint64) for _ in range(levels)]
        over = None
        for i in range(0, bits, 2):
            x = planes[i, w] ^ (ONES * opened[a, i])
            y = planes[i + 1, w] ^ (ONES * opened[a, i + 1])
            low = counters[0] ^ x  # a carry-save adder: three marks in, a sum and a carry out
            carry = counters[0] & x | low & y
            counters[0] = low ^ y
            add(counters, carry, 1)
            if (i + 2) % step == 0 or i + 2 == bits:
                over = exceeds(counters, radius) | ~valid[w]
                live = over != ONES
                if not live.all():
                    a, w, over = a[live], w[live], over[live]
                    counters = [c[live] for c in counters]
                if not len(a):
                    break
        if len(a):
            hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, bit = np.nonzero(hit)
            x, y = a[r], word_begin[w[r]] + bit
            found_a.append(x[x < y])
            found_b.append(y[x < y])
    empty = np.empty(0, dtype=np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (empty, empty)


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the first row that links lead to."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        np.minimum.at(label, before[a], least)
        np.minimum.at(label, before[b], least)
        label = label[label]
        if (label == before).all():
            break
    return label


def connecting(t: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links to the first row that close pairs lead to. t: the columns of the rows, a and b the pairs' places."""
    label = spanning(len(t["rep"]), a, b)
    moved = label != np.arange(len(label))
    return t["rep"][moved], t["rep"][label[moved]], np.zeros(moved.sum(), dtype=np.int64)


def possible(t: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that can reach the similarity by their sets' sizes and whose components differ, and their distances."""
    low, high = np.minimum(t["size"][a], t["size"][b]), np.maximum(t["size"][a], t["size"][b])
    good = (low >= similarity * high - 1e-9) & (t["own"][a] != t["own"][b])
    a, b = a[good], b[good]
    return a, b, np.bitwise_count(t["fp"][a] ^ t["fp"][b]).sum(axis=1, dtype=np.int64)


def nearest(similarity: float):
    """For each row of a cell its nearest partner among the possible ones."""

    def pick(t: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b, far = possible(t, a, b, similarity)
        row, other, far = np.r_[a, b], np.r_[b, a], np.r_[far, far]
        order = np.lexsort((_mixed(t["rep"].view(np.uint64), 1)[other], far, row))  # ties: the same rows, wherever they meet
        first = order[np.r_[True, np.diff(row[order]) != 0][: len(order)]]
        return t["rep"][row[first]], t["rep"][other[first]], far[first]

    return pick


def bounded(similarity: float):
    """All possible pairs whose sets can share enough, by the 16 bits of their hashes."""

    def pick(t: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b, far = possible(t, a, b, similarity)
        order = np.argsort(a, kind="stable")
        a, b, far = a[order], b[order], far[order]
        good, held = np.zeros(len(a), dtype=bool), np.zeros(1 << 16, dtype=bool)
        parts = [np.frombuffer(x, dtype="<u2") for x in t["sketch"]]
        for at in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1):
            for k in range(0, len(at), 1024):
                some = at[k : k + 1024]
                if not len(some):
                    continue
                held[parts[a[some[0]]]] = True
                others = [parts[x] for x in b[some].tolist()]
                sizes = np.array([len(x) for x in others])
                marks = np.append(0, np.cumsum(held[np.concatenate(others)]))
                ends = np.cumsum(sizes)
                both = np.minimum(marks[ends] - marks[ends - sizes], t["size"][a[some]])
                good[some] = both * (1 + similarity) >= similarity * (t["size"][a[some]] + t["size"][b[some]]) - 1e-6
                held[parts[a[some[0]]]] = False
        a, b, far = a[good], b[good], far[good]
        return t["rep"][a], t["rep"][b], far

    return pick


def few(pairs: DataFrame, most: int) -> DataFrame:
    """(a, b): of each a's pairs (a, b, far) the nearest, each pair once."""
    order = Window.partitionBy("a").orderBy("far", F.xxhash64("b"), "b")
    best = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(reps: DataFrame, radius: int, keys: list[np.ndarray], bucket: int = BUCKET, pick=connecting) -> DataFrame:
    """Links (a, b, far) between close fingerprints of reps (rep long, fp binary, perhaps own and size long and sketch binary), as picked in each cell.

    By default they connect whatever fingerprints are linked.
    """
    also = {c: t for c, t in (("own", "long"), ("size", "long"), ("sketch", "binary")) if c in reps.columns}
    more = "".join(f", {c} {t}" for c, t in also.items())

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                fps = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)
                opened = np.unpackbits(fps, axis=1, bitorder="little")
                for k, at in enumerate(keys):
                    value = opened[:, at].astype(np.int64) @ (np.int64(1) << np.arange(len(at), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(value * len(keys) + k), *part.columns], names=["key", "rep", "fp", *also])

    rows = reps.select("rep", "fp", *also).mapInArrow(keyed, "key long, rep long, fp binary" + more)
    hot = common.written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket), "hot-buckets")
    if hot.count() <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    blocks = F.coalesce(F.ceil(F.col("n") / (bucket / 2)), F.lit(1)).cast("int")
    dealt = rows.join(hot, "key", "left").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int"))
    # blocks i and j meet in cell (i, j); with one block there is one cell
    dealt = dealt.select("key", "rep", "fp", *also, "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "rep", "fp", *also)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
            cells = t.column(0).to_numpy()
            again = np.r_[False, cells[1:] == cells[:-1]]
            keep = again | np.r_[again[1:], False]  # cells of one fingerprint have nothing to compare
            if not keep.any():
                return
            body = t.column(2).filter(pa.array(keep)).to_pylist()
            fps = np.frombuffer(b"".join(body), dtype=np.uint8).reshape(len(body), -1)
            a, b = close_pairs(cells[keep], fps, radius)
            columns = {c: t.column(c).to_numpy()[keep] for c in ("rep", *also) if c != "sketch"}
            if "sketch" in also:
                columns["sketch"] = t.column("sketch").filter(pa.array(keep)).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pick(columns | {"fp": fps}, a, b)], names=["a", "b", "far"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, t]) if held is not None else t
            cells = held.column(0).to_numpy()
            last = int(np.searchsorted(cells, cells[-1], side="left"))  # the last cell may go on
            if last:
                yield from found(held.slice(0, last))
                held = held.slice(last).combine_chunks()
        if held is not None:
            yield from found(held)

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long, far long").distinct()


def classes(fps: DataFrame, radius: int, keys: list[np.ndarray]) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable over links."""
    reps = common.written(fps.groupBy("fp").agg(F.min("id").alias("rep")), "fingerprints")
    found = components(links(reps.where(F.col("rep").isNotNull()), radius, keys))
    named = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select("id", "fp", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) for each row: 3-word shingles, 64 bits, links at 2 or fewer.

    Texts without words, null ones too, have fingerprint zero and are linked like any other.
    Repeated rows stay rows of their own. A null key stays null and never names a component, unless
    all rows of it have null keys. Only key and text are read, so other columns cannot clash.
    """
    fps = common.written(fingerprints(docs, 3, text=text, key=key), "doc-fingerprints")
    hexed = F.lower(F.hex(_reversed("fp")))
    return classes(fps, 2, exact_keys(2)).select(F.col("id").alias(key), hexed.alias("fingerprint"), "component_id")


def _reversed(column: str):
    """The bytes of an 8-byte column from last to first, for writing a little-endian number."""
    return F.concat(*[F.substring(column, i, 1) for i in range(8, 0, -1)])


def similar(bits: int, similarity: float) -> int:
    """A radius for candidates: where the angle of sets of that Jaccard similarity lies for that many bits, and three deviations more."""
    cosine = 2 * similarity / (1 + similarity)
    differ = float(np.arccos(cosine)) / np.pi
    return int(round(bits * differ + 3 * (bits * differ * (1 - differ)) ** 0.5))


def banding(n: int, similarity: float, recall: float, least: int = LEAST_WIDTH) -> tuple[int, int]:
    """(width, count) of bands for n fingerprints: buckets stay of one size on average, whatever n is.

    Two bits agree as often as the angle of sets of that similarity leaves them, so a band of width
    bits does with the width's power of that, and as many bands as the recall takes are drawn. Copies
    of a fingerprint grow with n to the power of log(agree) / log(1/2), 0.24 at 0.8.
    """
    agree = 1 - float(np.arccos(2 * similarity / (1 + similarity))) / np.pi
    width = max(least, n.bit_length() - BUCKET_BITS)
    alone = agree**width
    return width, 1 if alone > 1 - 1e-9 else int(np.ceil(np.log(1 - recall) / np.log1p(-alone)))


def drawn(bits: int, width: int, count: int) -> list[np.ndarray]:
    """count sets of bit positions: bands of as many permutations as it takes, always the same."""
    rng, found = np.random.default_rng(20240), []
    while len(found) < count:
        order = rng.permutation(bits)
        found += [np.sort(order[at]) for at in bands(bits, width)]
    return found[:count]


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets, sorted, have that Jaccard similarity or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (rep long, held binary) are alike. Rows of a hot a meet its set before they get their own."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (2, 3))
            good = [alike(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), similarity) for p, q in zip(x, y, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("held").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(each, "a long, b long")


def one_of_each(docs: DataFrame, similarity: float = 0.8, size: int = 5, words: int = 5, recall: float = 0.997, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs, all columns as they are, with the row of smallest key from each group of near-duplicates.

    Rows are linked if their sets of size-word shingles (by 64-bit hashes) have that Jaccard similarity
    or more. Candidates differ in few of 64 * words fingerprint bits and agree on one of some sets of
    bits, of which there are as many as the recall at that similarity takes (radius and bands together:
    99 in 100 pairs of 0.8). Null and empty texts and those without words are one group. Rows that share
    a key share their fate; rows with null keys stay. Texts of any length are read whole; an empty table
    stays empty.
    """
    bits = 64 * words
    radius = similar(bits, similarity)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), size) for t in batch.column(1)]
            same = [xxhash.xxh64_intdigest(x.tobytes()) - 2**63 for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([majority(x, words) for x in found], pa.binary()), pa.array(same, pa.int64()), pa.array([len(x) for x in found], pa.int64())], names=["id", "fp", "same", "size"])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 0):
                found = [shingle_set(t.as_py(), size).tobytes() for t in part.column(0)]
                same = [xxhash.xxh64_intdigest(x) - 2**63 for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(same, pa.int64()), pa.array(found, pa.binary())], names=["same", "held"])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x, dtype="<u8").astype("<u2").tobytes() for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(parts, pa.binary())], names=["rep", "fp", "own", "size", "sketch"])

    fps = common.written(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(marked, "id long, fp binary, same long, size long"), "doc-fingerprints")
    reps = common.written(fps.groupBy("same").agg(F.min("id").alias("rep"), F.min("fp").alias("fp"), F.min("size").alias("size")), "fingerprints")
    nodes = reps.where(F.col("rep").isNotNull()).withColumn("own", F.col("rep"))
    keys = drawn(bits, *banding(nodes.count(), similarity, recall))

    def candidates(rows: DataFrame, keys: list[np.ndarray]) -> tuple[DataFrame, DataFrame]:
        """(pairs, the rows in them)"""
        pairs = common.written(links(rows, radius, keys, pick=nearest(similarity)), "candidates")
        ends = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
        return pairs, common.written(nodes.drop("own").join(ends, "rep", "left_semi"), "near")

    def sets_of(rows: DataFrame) -> DataFrame:
        found = docs.select(F.col(text).alias("t")).mapInArrow(held, "same long, held binary").join(rows.select("same", "rep"), "same")
        return common.written(found.groupBy("same", "rep").agg(F.first("held").alias("held")).select("rep", "held"), "shingle-sets")

    def outside(rows: DataFrame, good: DataFrame) -> DataFrame:
        own = components(good).withColumnRenamed("node", "rep")
        return common.written(rows.join(own, "rep", "left").select("rep", "fp", F.coalesce("component", "rep").alias("own"), "size"), "near")

    pairs, near = candidates(nodes, keys[: -(-len(keys) // EARLY)])
    sets = sets_of(near)
    good = common.written(verified(few(pairs, TRIES), sets, similarity), "links")
    pairs, near = candidates(outside(nodes.drop("own"), good), keys)
    sets = sets.union(sets_of(near.join(sets, "rep", "left_anti")))
    good = common.written(good.union(verified(few(pairs, TRIES), sets, similarity)), "links")
    open_ = outside(near, good).join(sets, "rep").select("rep", "fp", "own", "size", "held").mapInArrow(sketched, "rep long, fp binary, own long, size long, sketch binary")
    rest = links(common.written(open_, "open"), radius, keys, pick=bounded(similarity)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    good = good.union(verified(rest, sets, similarity))
    found = components(good)
    named = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("same", F.coalesce("component", "rep").alias("component_id"))
    (lost,) = common.fresh(docs, "lost")
    gone = fps.join(named, "same").where("id <> component_id").select(F.col("id").alias(lost)).distinct()
    return docs.join(gone, docs[key].cast("long") == gone[lost], "left_anti")
