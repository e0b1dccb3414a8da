"""Packing documents along a space-filling curve.

A document's token ids are hashed into a vector, the vector is projected to
four dimensions, each dimension is ranked, and the ranks give a place on a
Hilbert curve. Documents are range-sorted by that place and laid end to end,
so a sequence holds documents that are alike. Sequences are cut at their full
length; only the very last one is shorter, and it is cut at powers of two, so
no id is padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.llm.shared import portions, stored
from cohortlift.llm.tokens import AT_ONCE, encoder, little_endian, record_batch, rows_to_encode

SEQUENCE = 2048
BUCKETS = 1024          # of the hashed vector
DIMENSIONS = 4
CURVE_BITS = 8          # per dimension
RANK_ACCURACY = 10_000  # of the quantiles
GROUP_IDS = 1 << 21     # ids a task packs at once


def projection(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS))


def hilbert_keys(places: np.ndarray, bits: int) -> np.ndarray:
    """The place on a Hilbert curve of each row of coordinates below 2^bits.

    Skilling's transform (2004), over all rows at once.
    """
    x = places.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """(id, ids, n, v0..v3): the ids with the end id, and the projected vector."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, project = encoder(tokenizer), projection()
        size = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        mixed = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        bucket = (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS
        sign = np.where(mixed >> np.uint64(63), 1.0, -1.0)
        vectors = (sign[:, None] * project[bucket]).T.copy()     # each id's share of the projection
        for batch in portions(batches, "text", AT_ONCE):
            held = [np.append(f, enc.kind(end_id)) for f in enc.encode(batch.column("text"))]
            lengths = np.fromiter(map(len, held), np.int64, len(held))
            flat, row = np.concatenate(held), np.repeat(np.arange(len(held)), lengths)
            places = [np.bincount(row, v[flat], len(held)) / lengths for v in vectors]
            yield record_batch({
                "id": batch.column("id"),
                "ids": pa.array([ids.tobytes() for ids in held], pa.binary()),
                "width": pa.array([ids.itemsize for ids in held], pa.int32()),
                "n": pa.array(lengths),
                **{f"v{k}": pa.array(place) for k, place in enumerate(places)}})

    rows = rows_to_encode(docs, id_column, text_column)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, ids binary, width int, n bigint, " + ", ".join(
        f"v{k} double" for k in range(DIMENSIONS))
    return rows.mapInArrow(work, schema)


def on_curve(rows: DataFrame) -> DataFrame:
    """Add ``key``: the Hilbert place in the high bits, a hash of the row in the low ones.

    Ranks come from quantiles over all rows. The hash spreads copies, which
    share a place, so that no range of keys is all one text.
    """
    steps = [k / (1 << CURVE_BITS) for k in range(1, 1 << CURVE_BITS)]
    found = rows.agg(*[
        F.percentile_approx(f"v{k}", steps, RANK_ACCURACY).alias(f"v{k}")
        for k in range(DIMENSIONS)]).first()
    cuts = [np.array(found[f"v{k}"] or []) for k in range(DIMENSIONS)]

    # A column and not a pass over whole rows: where only the key is asked for,
    # the ids are not even read.
    @F.pandas_udf("bigint")
    def place(v0: pd.Series, v1: pd.Series, v2: pd.Series, v3: pd.Series, spread: pd.Series) -> pd.Series:
        places = np.stack([np.searchsorted(cut, v.to_numpy(), side="right")
                           for cut, v in zip(cuts, (v0, v1, v2, v3))], axis=1)
        return pd.Series(hilbert_keys(places, CURVE_BITS) << 31 | (spread.to_numpy() & ((1 << 31) - 1)))

    return rows.select("id", "ids", "width", "n", place(
        "v0", "v1", "v2", "v3", F.xxhash64("id", "n", "v0")).alias("key"))


class Sequences:
    """Where places along the curve lie: full sequences, then the rest cut into powers of two, the largest first."""

    def __init__(self, total: int, sequence: int):
        self.total, self.sequence, self.full = total, sequence, total // sequence
        tail, at = total % sequence, self.full * sequence
        cuts = []
        for bit in range(sequence.bit_length() - 1, -1, -1):
            if tail >> bit & 1:
                cuts.append(at)
                at += 1 << bit
        self.cuts = np.array([*cuts, total], np.int64)    # begin of each of the rest, and the end

    def number(self, place: np.ndarray) -> np.ndarray:
        rest = np.searchsorted(self.cuts, place, side="right") - 1
        return np.where(place < self.full * self.sequence, place // self.sequence, self.full + rest)

    def begin(self, number: np.ndarray) -> np.ndarray:
        rest = np.clip(number - self.full, 0, len(self.cuts) - 1)
        return np.where(number < self.full, number * self.sequence, self.cuts[rest])

    def pieces(self, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, start, length, sequence_id, offset) of every piece of documents that begin at ``first``."""
        lowest, highest = self.number(first), self.number(first + lengths - 1)
        count = highest - lowest + 1
        source = np.repeat(np.arange(len(first)), count)
        number = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count) + lowest[source]
        begin = self.begin(number)
        a = np.maximum(begin, first[source])
        b = np.minimum(self.begin(number + 1), (first + lengths)[source])
        return source, a - first[source], b - a, number, a - begin


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, sequence: int = SEQUENCE,
           id_column: str = "doc_id", text_column: str = "text", group_ids: int = GROUP_IDS) -> DataFrame:
    """One row per piece: id, start, length, ids, doc_tokens, sequence_id, offset.

    ``sequence`` is a power of two. Null text counts as empty and leaves the
    end id alone. Null ids and repeated rows are packed like any other row;
    equal rows are interchangeable. An empty table gives no piece. ``ids`` is
    the piece's ids as little-endian unsigned 32-bit integers. Other columns
    are not read.
    """
    if sequence < 1 or sequence & (sequence - 1):
        raise ValueError("sequence must be a power of two")
    rows = stored(encoded(docs, tokenizer, end_id, id_column, text_column))
    spark = rows.sparkSession
    kind = rows.schema["id"].dataType.simpleString()
    schema = (f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, "
              "sequence_id bigint, offset bigint")
    total = rows.agg(F.sum("n")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_column)
    keyed = on_curve(rows)
    # Bounds of the groups along the curve, then what comes before each group:
    # a row per group, fixed before any id is moved.
    groups = max(1, -(-total // group_ids))
    bounds = sorted(set(keyed.select("key").agg(F.percentile_approx(
        "key", [k / groups for k in range(1, groups)] or [0.5], max(RANK_ACCURACY, 20 * groups))
    ).first()[0])) if groups > 1 else []
    cuts = np.array(bounds, np.int64)

    @F.pandas_udf("bigint")
    def group(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="right"))

    grouped = keyed.withColumn("grp", group("key"))
    sums = {r["grp"]: r["n"] for r in grouped.groupBy("grp").agg(F.sum("n").alias("n")).collect()}
    before, running = {}, 0
    for number in sorted(sums):
        before[number] = running
        running += sums[number]

    places = Sequences(total, sequence)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place = None, 0
        for batch in portions(batches, "ids"):
            grp, lengths = batch.column("grp").to_numpy(), batch.column("n").to_numpy()
            begins = np.flatnonzero(np.diff(grp, prepend=grp[0] - 1))     # rows where a group begins
            first = np.cumsum(lengths) - lengths
            base = np.array([place if g == current else before[g] for g in grp[begins].tolist()], np.int64)
            first += np.repeat(base - first[begins], np.diff(begins, append=len(grp)))
            current, place = grp[-1], first[-1] + lengths[-1]
            source, start, length, number, offset = places.pieces(first, lengths)
            kind = np.uint16 if batch.column("width")[0].as_py() == 2 else np.uint32     # one tokenizer, one width
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind).astype("<u4")
            ends = np.concatenate([[0], np.cumsum(length)]) * 4      # pieces follow each other
            yield record_batch({
                "id": batch.column("id").take(pa.array(source)),
                "start": pa.array(start), "length": pa.array(length),
                "ids": pa.Array.from_buffers(pa.binary(), len(source), [
                    None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)]),
                "doc_tokens": pa.array(lengths[source]),
                "sequence_id": pa.array(number), "offset": pa.array(offset)})

    # A row each of bounds and sums comes to the driver per group of 2 million ids.
    moved = grouped.repartition(groups, "grp").sortWithinPartitions("grp", "key", "id", "ids")
    return moved.mapInArrow(pack, schema).withColumnRenamed("id", id_column)


def digest(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ids_crc32 in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(little_endian(ids))
