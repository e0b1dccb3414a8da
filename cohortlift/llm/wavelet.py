"""Token ids in files that are wavelet matrices.

A shard holds the ids of consecutive documents. Bit-plane after bit-plane,
from the highest, the ids' bits are written down and the ids then sorted
stably by that bit. With counts of ones per block, one can read the id at a
place, count an id and find its n-th occurrence from the planes alone.

File: magic, header length, JSON header, then compressed sections. Each plane
is cut into blocks of ``BLOCK`` bits that are compressed on their own; the
directory has where each block starts and how many ones come before it, so a
lookup decompresses one block a plane.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlift.llm.files import make_folder, read_range, write_file
from cohortlift.llm.shared import portions, shared_folder, shards_for, stored
from cohortlift.llm.tokens import AT_ONCE, encoder, little_endian, record_batch, rows_to_encode

MAGIC = b"WVLTIDS1"
BLOCK = 1 << 16
SHARD_IDS = 1 << 21     # ids after which a shard is closed
TASK_CHARS = 24_000_000  # text a task gets to write


def build(ids: np.ndarray, lengths: np.ndarray, doc_ids: list, planes: int) -> bytes:
    """The file for the ids of documents, one after another."""
    press = zstandard.ZstdCompressor(level=1).compress
    sections, zeros, starts, ones, at = [], [], [], [], 0

    def put(data: bytes) -> int:
        nonlocal at
        sections.append(data)
        at += len(data)
        return at - len(data)

    current = ids
    for plane in range(planes - 1, -1, -1):
        mask = (current & current.dtype.type(1 << plane)) != 0
        packed = np.packbits(mask, bitorder="little")
        step = BLOCK // 8
        blocks = [packed[a:a + step] for a in range(0, len(packed), step)]
        counts = [int(np.bitwise_count(b).sum(dtype=np.int64)) for b in blocks]
        ones.append([0, *np.cumsum(counts).tolist()])
        starts.append([put(press(b.tobytes())) for b in blocks] + [at])
        zeros.append(len(current) - ones[-1][-1])
        current = np.concatenate([np.compress(~mask, current), np.compress(mask, current)])
    docs = put(press(lengths.astype("<i8").tobytes()))
    names = put(press(json.dumps(doc_ids).encode()))
    header = press(json.dumps({
        "n": len(ids), "planes": planes, "kind": ids.dtype.str, "zeros": zeros, "starts": starts,
        "ones": ones, "docs": [docs, names, at]}).encode())
    return b"".join([MAGIC, struct.pack("<q", len(header)), header, *sections])


class Shard:
    """One file, opened for lookups; reads only what a lookup needs."""

    def __init__(self, uri: str):
        self.uri = uri
        head = read_range(uri, 0, 16)
        if head[:8] != MAGIC:
            raise ValueError(f"{uri} is not a shard of token ids")
        size = struct.unpack("<q", head[8:])[0]
        self.base = 16 + size
        self.head = json.loads(zstandard.decompress(read_range(uri, 16, size)))
        self._block = lru_cache(maxsize=256)(self._read_block)

    def __len__(self) -> int:
        return self.head["n"]

    def _section(self, start: int, end: int) -> bytes:
        return zstandard.decompress(read_range(self.uri, self.base + start, end - start))

    def _read_block(self, plane: int, block: int) -> np.ndarray:
        a, b = self.head["starts"][plane][block:block + 2]
        return np.frombuffer(self._section(a, b), np.uint8)

    def documents(self) -> tuple[np.ndarray, list]:
        """(lengths, ids) of the shard's documents."""
        a, b, c = self.head["docs"]
        return np.frombuffer(self._section(a, b), "<i8"), json.loads(self._section(b, c))

    def _ones_before(self, plane: int, place: int) -> int:
        block, rest = divmod(place, BLOCK)
        total = self.head["ones"][plane][block]
        if rest:
            data = self._block(plane, block)
            total += int(np.bitwise_count(data[:rest // 8]).sum(dtype=np.int64))
            if rest % 8:
                total += bin(int(data[rest // 8]) & ((1 << rest % 8) - 1)).count("1")
        return total

    def _bit(self, plane: int, place: int) -> int:
        block, rest = divmod(place, BLOCK)
        return int(self._block(plane, block)[rest // 8]) >> (rest % 8) & 1

    def access(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < len(self):
            raise IndexError(place)
        value = 0
        for plane, zeros in enumerate(self.head["zeros"]):
            bit, ones = self._bit(plane, place), self._ones_before(plane, place)
            value = value << 1 | bit
            place = zeros + ones if bit else place - ones
        return value

    def _range(self, token: int, end: int) -> tuple[int, int, list[int]]:
        """Where the token's occurrences before ``end`` lie below the last plane."""
        start, path, top = 0, [], self.head["planes"] - 1
        if token >> (top + 1):
            return 0, 0, path
        for plane, zeros in enumerate(self.head["zeros"]):
            path.append(start)
            a, b = self._ones_before(plane, start), self._ones_before(plane, end)
            if token >> (top - plane) & 1:
                start, end = zeros + a, zeros + b
            else:
                start, end = start - a, end - b
        return start, end, path

    def rank(self, token: int, end: int) -> int:
        """How often the token occurs before place ``end``."""
        start, end, _ = self._range(token, end)
        return end - start

    def count(self, token: int) -> int:
        return self.rank(token, len(self))

    def select(self, token: int, nth: int) -> int:
        """The place of the token's n-th occurrence, from 0."""
        start, end, _ = self._range(token, len(self))
        if not 0 <= nth < end - start:
            raise IndexError(nth)
        place, top = start + nth, self.head["planes"] - 1
        for plane in range(top, -1, -1):
            zeros = self.head["zeros"][plane]
            one = token >> (top - plane) & 1
            place = self._nth(plane, place - zeros if one else place, one)
        return place

    def _nth(self, plane: int, nth: int, bit: int) -> int:
        """The place of the n-th bit of this kind in a plane."""
        ones = np.array(self.head["ones"][plane])
        sizes = np.minimum(np.arange(len(ones)) * BLOCK, len(self))
        before = ones if bit else sizes - ones
        block = int(np.searchsorted(before, nth, side="right")) - 1
        bits = np.unpackbits(self._block(plane, block), bitorder="little")
        bits = bits[:min(BLOCK, len(self) - block * BLOCK)]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[nth - int(before[block])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids, plane by plane from the lowest."""
        n, kind = len(self), np.dtype(self.head["kind"])
        data = read_range(self.uri, self.base, self.head["docs"][0])
        current = np.zeros(n, kind)
        for plane in range(self.head["planes"] - 1, -1, -1):
            starts = self.head["starts"][plane]
            packed = b"".join(zstandard.decompress(data[a:b]) for a, b in zip(starts, starts[1:]))
            mask = np.unpackbits(np.frombuffer(packed, np.uint8), count=n, bitorder="little").view(bool)
            zeros = self.head["zeros"][plane]
            above = np.empty(n, kind)
            above[np.flatnonzero(~mask)] = current[:zeros]
            above[np.flatnonzero(mask)] = current[zeros:]
            # Below this plane the ids hold the lower bits; add this plane's.
            above |= mask.astype(kind) << kind.type(self.head["planes"] - 1 - plane)
            current = above
        return current


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id",
                 text_column: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode, write the shards in ascending id order, return their index.

    The index has a row per file: part, number, uri, n_docs, n_ids. Parts and
    numbers in them are in the order of ids. Null ids come last; a null or
    empty text has the end id alone. Rows that repeat an id are written next
    to each other, in the order of their texts. An empty table writes nothing.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    make_folder(folder)
    rows = rows_to_encode(docs, id_column, text_column).withColumn("none", F.col("id").isNull())
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    order = ["none", "id", "text"]
    placed = rows.repartitionByRange(
        shards_for(spark, chars, TASK_CHARS), "none", "id").sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        planes = max(enc.tokenizer.get_vocab_size() - 1, end_id, 1).bit_length()
        held, names, size, number = [], [], 0, 0

        def shard() -> pa.RecordBatch:
            nonlocal held, names, size, number
            lengths = np.fromiter(map(len, held), np.int64, len(held))
            uri = write_file(folder, ".wvlt", build(np.concatenate(held), lengths, names, planes))
            row = {"part": part, "number": number, "uri": uri, "n_docs": len(held), "n_ids": size}
            held, names, size, number = [], [], 0, number + 1
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("part", pa.int32()), ("number", pa.int32()), ("uri", pa.string()),
                ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in portions(batches, "text", AT_ONCE):
            for name, found in zip(batch.column("id").to_pylist(), enc.encode(batch.column("text"))):
                held.append(np.append(found, enc.kind(end_id)))
                names.append(name)
                size += len(held[-1])
                if size >= shard_ids:
                    yield shard()
        if held:
            yield shard()

    return stored(placed.select("id", "text").mapInArrow(
        work, "part int, number int, uri string, n_docs bigint, n_ids bigint"))


def with_offsets(index: DataFrame) -> DataFrame:
    """Add ``before``: the ids in all earlier files.

    Sums go over a part's files, and over one row per part.
    """
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, rows = 0, []
    for row in parts:
        rows.append((row["part"], before))
        before += row["n"]
    spark: SparkSession = index.sparkSession
    earlier = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return (
        index.withColumn("inside", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
        .join(F.broadcast(spark.createDataFrame(rows, "part int, base bigint")), "part")  # a row per task
        .withColumn("before", F.col("base") + F.col("inside")).drop("base", "inside"))


def read_shards(index: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Read all files back: doc_id, start, n_tokens, ids_crc32 per document."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["uri"])
                ids = shard.decode()
                lengths, names = shard.documents()
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(little_endian(ids[a:b]))
                        for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                yield record_batch({
                    "doc_id": pa.array(names, pa.int64() if id_type == "bigint" else None),
                    "start": pa.array(row["before"] + ends - lengths, pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array(crcs, pa.int64())})

    files = with_offsets(index)
    return files.select("uri", "before").repartition(
        shards_for(index.sparkSession, index.count(), 4), "uri").mapInArrow(
        work, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
