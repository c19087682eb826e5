"""Line dedup with a sharded minimal perfect hash.

Pass 1 hashes each line's key (128 bits) and counts, by key, the documents that hold it and the
largest of their ids. Keys in too few documents are dropped there. The rest are dealt to shards by
their hash. Each shard builds a minimal perfect hash over its keys and, in the places it gives,
arrays of fingerprints (the hash's other half), counts and largest ids.
Pass 2 hashes the lines of each document again and probes the arrays: the first half of the hash
gives shard and place, the fingerprint there tells members from strangers. No line is joined.

The arrays hold frequent lines alone. Their size is known from a count before they are collected:
shards are taken in groups of at most INDEX_BYTES, and a group's arrays are broadcast. With more than
one group, documents probe them in turn, and only marks of the lines to drop go along.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import common
from vitrine.llm.mphf import Mphf

INDEX_BYTES = 96 << 20
KEY_BYTES = 32  # of the arrays and bits for each key, rounded up
SHARD_KEYS = 1 << 16
NO_ID = -(1 << 63)
WHITE = b" \t\n\x0b\x0c\r"


def keys_of(text: str | None, least: int) -> list[bytes | None]:
    """For each line its key's hash, or None if the key has fewer than least code points."""
    out: list[bytes | None] = []
    for line in (text or "").encode().lower().split(b"\n"):
        line = line.strip(WHITE)
        short = len(line) < least or (not line.isascii() and len(line.decode()) < least)
        out.append(None if short else xxhash.xxh3_128_digest(line))
    return out


def halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


def frequent_lines(docs: DataFrame, least: int, documents: int, text: str, key: str) -> DataFrame:
    """(h1, h2, n, last): keys in at least so many documents and the largest id that holds each.

    Documents are told apart by their ids: rows with equal ids are one, and rows without an id are one,
    whose id counts as the smallest.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 1):
                ids, found = [], []
                for doc, body in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    own = set(keys_of(body.as_py(), least)) - {None}
                    found += own
                    ids += [doc] * len(own)
                if found:
                    h1, h2 = halves(found)
                    yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids, pa.int64())], names=["h1", "h2", "id"])

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("k"), F.col(text).alias("t")).mapInArrow(hashed, "h1 long, h2 long, id long")
    return rows.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last")).where(F.col("n") >= documents)


class Index:
    """Shards of frequent lines. dropped() says for lines and their documents which go."""

    def __init__(self, shards: dict[int, tuple], count: int):
        self.shards, self.count = shards, count

    @staticmethod
    def shard_of(h1: np.ndarray, count: int) -> np.ndarray:
        return (h1 >> np.uint64(32)).astype(np.int64) % count

    @staticmethod
    def built(h1: np.ndarray, h2: np.ndarray, n: np.ndarray, last: np.ndarray) -> tuple:
        hash_ = Mphf(np.unique(h1))
        place = hash_.places(h1)
        order = np.argsort(place, kind="stable")
        place, h2, n, last = place[order], h2[order], n[order], last[order]
        once = np.r_[True, place[1:] != place[:-1]]
        spare = {(int(p), int(f)): int(v) for p, f, v in zip(place[~once], h2[~once], last[~once], strict=True)}  # keys that share h1
        return hash_, h2[once], n[once].clip(0, 0xFFFFFFFF).astype(np.uint32), last[once], spare

    def dropped(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), dtype=bool)
        if not len(h1) or not self.shards:
            return out
        shard = self.shard_of(h1, self.count)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0])
        for rows in np.split(order, cuts[1:]):
            found = self.shards.get(int(shard[rows[0]]))
            if found is None:
                continue
            hash_, fingerprints, _, last, spare = found
            place = hash_.places(h1[rows])
            known = place >= 0
            rows, place = rows[known], place[known]
            same = fingerprints[place] == h2[rows]
            out[rows[same]] = last[place[same]] != ids[rows[same]]
            if spare:
                for r, p in zip(rows[~same].tolist(), place[~same].tolist(), strict=True):
                    v = spare.get((p, int(h2[r])))
                    out[r] = v is not None and v != ids[r]
        return out


def index_of(frequent: DataFrame, shards: int, group: range) -> Index:
    """The arrays of a group of shards; no more than that many bytes come to the driver."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [pa.Table.from_batches([b]) for b in batches]
        if not parts:
            return
        t = pa.concat_tables(parts)
        if not t.num_rows:
            return
        h1, h2 = (t.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        n, last, own = t.column("n").to_numpy(), t.column("last").to_numpy(), Index.shard_of(h1, shards)
        for s in np.unique(own).tolist():
            at = own == s
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pickle.dumps(Index.built(h1[at], h2[at], n[at], last[at]))], pa.binary())], names=["shard", "image"])

    own = F.pmod(F.shiftrightunsigned("h1", 32), F.lit(shards))
    images = frequent.where(own.between(group[0], group[-1])).repartition(own).mapInArrow(build, "shard int, image binary")
    return Index({r.shard: pickle.loads(r.image) for r in images.toLocalIterator()}, shards)


def kept_lines(docs: DataFrame, least: int, documents: int, text: str, key: str) -> tuple[DataFrame, str]:
    """docs with a struct column more, and its name: kept (the text), lines and dropped (their numbers).

    Null and empty texts are one empty line; repeated rows are treated alike; an empty table stays empty.
    """
    frequent = common.written(frequent_lines(docs, least, documents, text, key), "frequent-lines")
    marks, probed = common.fresh(docs, "marks", "probed")
    ids = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))
    shards = max(1, -(-frequent.count() // SHARD_KEYS))
    step = max(1, INDEX_BYTES // (SHARD_KEYS * KEY_BYTES))
    groups = [range(i, min(i + step, shards)) for i in range(0, shards, step)]
    columns, earlier = docs.columns, F.lit(None).cast("binary")
    for group in groups:
        held = docs.sparkSession.sparkContext.broadcast(index_of(frequent, shards, group))
        if group is groups[-1]:
            probe = _probing(held, least, "kept string, lines long, dropped long")
            return docs.select(*[F.col(f"`{c}`") for c in columns], probe(F.col(f"`{text}`"), ids, earlier).alias(probed)), probed
        probe = _probing(held, least, "binary")
        docs = common.written(docs.select(*[F.col(f"`{c}`") for c in columns], probe(F.col(f"`{text}`"), ids, earlier).alias(marks)), "line-marks")
        earlier = F.col(marks)
    raise AssertionError("there is a group at least")


def _answer(texts: list, marks: list[list[bool]]) -> pa.StructArray:
    kept, lines, dropped = [], [], []
    for text, gone in zip(texts, marks, strict=True):
        if any(gone):
            kept.append("\n".join(x for x, g in zip(text.split("\n"), gone, strict=True) if not g))
        else:
            kept.append(text or "")
        lines.append(len(gone))
        dropped.append(sum(gone))
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=["kept", "lines", "dropped"])


def _probing(held, least: int, shape: str):
    """An Arrow UDF (text, id, marks so far): marks of lines to drop, or the answer from them."""

    @F.arrow_udf(shape)
    def probe(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ids, earlier in batches:
            texts, ids = texts.to_pylist(), ids.to_pylist()
            marks: list[list[bool]] = []
            flat: list[bytes] = []
            at: list[tuple[int, int]] = []
            who: list[int] = []
            for i, (text, known) in enumerate(zip(texts, earlier.to_pylist(), strict=True)):
                keys = keys_of(text, least)
                marks.append([False] * len(keys) if known is None else [x == 1 for x in known])
                for j, k in enumerate(keys):
                    if k is not None:
                        flat.append(k)
                        at.append((i, j))
                        who.append(ids[i])
            if flat:
                h1, h2 = halves(flat)
                for r in np.flatnonzero(held.value.dropped(h1, h2, np.array(who, dtype=np.int64))).tolist():
                    marks[at[r][0]][at[r][1]] = True
            yield pa.array(map(bytes, marks), pa.binary()) if shape == "binary" else _answer(texts, marks)

    return probe


def line_report(docs: DataFrame, least: int = 20, documents: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_lines, n_dropped, kept_sha256) for each row of docs.

    A null or empty text is one empty line. Rows with equal ids count as one document; they all
    keep its lines if theirs is the largest id. Rows without an id are one document of the smallest. A
    document that loses all its lines keeps the empty text. Only key and text are read.
    """
    rows, probed = kept_lines(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), least, documents, "t", "k")
    p = F.col(probed)
    return rows.select(F.col("k").alias(key), p["lines"].alias("n_lines"), p["dropped"].alias("n_dropped"), F.sha2(p["kept"].cast("binary"), 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame, least: int = 20, documents: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs, all columns as they are, with texts that lost their repeated lines.

    Texts that lose nothing stay as they are, null ones too. Rows with equal ids or none are told
    apart as in line_report().
    """
    rows, probed = kept_lines(docs, least, documents, text, key)
    changed = F.when(F.col(probed)["dropped"] > 0, F.col(probed)["kept"]).otherwise(F.col(text))
    return rows.select(*[changed.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
