"""Token-id files: Simple-8b images of documents in ascending key order.

An image holds whole documents, MOST_IDS ids or one document more: a head, then as Simple-8b streams the keys
(zigzag differences), the lengths and the ids. Documents without a key come first. Each stream has its words, escapes and block
offsets, so that any block of ids can be decoded alone. Images are rows of a Parquet table, so
that any store Spark can write to will do: (shard, part, image). Shards are ranges of keys in
ascending order, parts count within a shard. An image's head says how many ids of its shard stand
before it; how many stand before a shard is summed up from one row per shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import common, simple8b
from vitrine.llm.wordids import word_ids

MAGIC = np.uint64(0x38425F53_44495F54)
MOST_IDS = 1 << 16
#: Bytes of a row group: writers and readers hold one in memory.
ROW_GROUP = 4 << 20
SCHEMA = "shard int, part int, n_docs long, n_ids long, image binary"


def _stream(values: np.ndarray) -> list[np.ndarray]:
    words, escapes, offsets = simple8b.encode(values)
    return [np.array([len(words), len(escapes), len(offsets)], dtype=np.uint64), words, escapes, offsets]


def image_of(keys: list[int | None], lengths: list[int], ids: np.ndarray, before: int) -> bytes:
    """One image; before: ids of its shard ahead of it. Null keys stand first; they are counted in the head."""
    known = [k for k in keys if k is not None]
    gaps = np.diff(np.array([0, *known], dtype=np.int64))
    zigzag = (gaps << 1 ^ gaps >> 63).view(np.uint64)
    head = np.array([MAGIC, len(keys), before, len(keys) - len(known)], dtype=np.uint64)
    return b"".join(x.astype("<u8").tobytes() for x in [head, *_stream(zigzag), *_stream(np.array(lengths, dtype=np.uint64)), *_stream(ids)])


class Image:
    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, dtype="<u8")
        if not len(self.data) or self.data[0] != MAGIC:
            raise ValueError("this is no token-id image")
        self.before, self.unknown, at, self.streams = int(self.data[2]), int(self.data[3]), 4, []
        for _ in range(3):
            w, e, o = map(int, self.data[at : at + 3])
            at += 3
            self.streams.append((self.data[at : at + w], self.data[at + w : at + w + e], self.data[at + w + e : at + w + e + o]))
            at += w + e + o

    def keys(self) -> pa.Array:
        z = simple8b.decode(*self.streams[0][:2])
        known = np.cumsum((z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64))
        return pa.concat_arrays([pa.nulls(self.unknown, pa.int64()), pa.array(known, pa.int64())])

    def lengths(self) -> np.ndarray:
        return simple8b.decode(*self.streams[1][:2]).view(np.int64)

    def ids_between(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the image, from the blocks that hold them alone."""
        words, escapes, offsets = self.streams[2]
        a = max(0, int(np.searchsorted(offsets, start, side="right")) - 1)
        b = int(np.searchsorted(offsets, stop, side="left"))
        first = a * simple8b.BLOCK
        earlier = int((words[:first] >> np.uint64(60) == simple8b.ESCAPE).sum())
        got = simple8b.decode(words[first : b * simple8b.BLOCK], escapes, earlier)
        skip = start - int(offsets[a]) if len(offsets) else 0
        return got[skip : skip + stop - start]

    def checksums(self) -> list[int]:
        """crc32 of each document's ids, decoded by some MOST_IDS ids at a time."""
        out, stops = [], np.cumsum(self.lengths()).tolist()
        held, low, high = b"", 0, 0
        for begin, end in zip([0, *stops[:-1]], stops, strict=True):
            crc = 0
            while begin < end:
                if begin >= high:
                    low, high = begin, min(begin + MOST_IDS, stops[-1])
                    held = self.ids_between(low, high).astype("<u4").tobytes()
                step = min(end, high)
                crc = zlib.crc32(held[4 * (begin - low) : 4 * (step - low)], crc)
                begin = step
            out.append(crc)
        return out


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, text: str = "text", key: str = "doc_id") -> None:
    """Writes the ids of all whole texts, each followed by end_id, in ascending key order to path.

    Null and empty texts are the end id alone. Rows with equal keys are kept, ordered by their
    text's hash. Rows without a key come before all others, in the same order. Texts of any length
    stay whole within an image; a worker holds one image's ids. An empty table makes an empty set of
    files. Only key and text are read, so other columns cannot clash.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard = word_ids(tokenizer), TaskContext.get().partitionId()
        keys: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []
        part = before = have = 0

        def row() -> pa.RecordBatch:
            nonlocal part, before, have
            image = image_of(keys, lengths, np.frombuffer(b"".join(held), dtype="<u4"), before)
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([have], pa.int64()), pa.array([image], pa.binary())], names=["shard", "part", "n_docs", "n_ids", "image"])
            part, before, have = part + 1, before + have, 0
            keys.clear(), lengths.clear(), held.clear()
            return out

        for batch in batches:
            for piece in common.slices(batch, 1):
                for doc, ids in zip(piece.column(0).to_pylist(), words.each(piece.column(1).to_pylist()), strict=True):
                    keys.append(doc)
                    lengths.append(len(ids) + 1)
                    held += [ids.tobytes(), end]
                    have += len(ids) + 1
                    if have >= MOST_IDS:
                        yield row()
        if keys:
            yield row()

    ordered = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange(F.col("k"), F.xxhash64("t")).sortWithinPartitions(F.col("k"), F.xxhash64("t"))
    ordered.mapInArrow(images, SCHEMA).write.option("parquet.block.size", ROW_GROUP).option("parquet.enable.dictionary", "false").parquet(path)


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """A row (key, start, n_tokens, ids_crc32) for each document of the files, decoded from them.

    Documents without a key are rows with a null one; files without images give no rows. The driver keeps one number for each shard; there are as many shards as the writer had ranges.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = sorted(files.groupBy("shard").agg(F.sum("n_ids")).collect())
    ends = np.cumsum([n for _, n in totals])
    bases = spark.sparkContext.broadcast({shard: int(e) - n for (shard, n), e in zip(totals, ends, strict=True)})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                image = Image(data.as_py())
                lengths = image.lengths()
                stops = np.cumsum(lengths)
                starts = stops - lengths + (bases.value[shard] + image.before)
                yield pa.RecordBatch.from_arrays([image.keys(), pa.array(starts), pa.array(lengths), pa.array(image.checksums(), pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    return files.select("shard", "image").mapInArrow(rows, f"{key} long, start long, n_tokens long, ids_crc32 long")
