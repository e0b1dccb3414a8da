"""Benchmark items inside documents, by size-partitioned MinHash containment.

Items are put into classes by size. For each class a document is cut into
overlapping windows twice as long as the class's largest item, so an item and
the window around it are of like size and their Jaccard similarity stays high,
however long the document is. MinHash values of the windows are looked up
among the items' values; every candidate is then verified by the exact share
of the item's shingles that the whole document contains.

With 64 values, an item of which four fifths lie in one window (similarity
0.19 or more) is missed with a chance of about one in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.llm.shared import portions, stored, text_of

WORDS = 5
SHARE = 0.8
VALUES = 64
BLOCK = 8                    # shingles in the smallest block; classes end at 8, 16, 32, ...
LOW_BITS = 22
ITEMS_AT_ONCE = 2_000_000    # shingles of items sent to every task at once (about 100 MB)

PUNCTUATION = rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""   # counts as white space
_TABLE = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))


def shingles(text: str, words: int = WORDS) -> list[bytes]:
    """Shingles of the lower-cased text, ASCII punctuation left out.

    Fewer words than that are one shingle; no word gives none.
    """
    split = text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()
    if not split:
        return []
    joined = b" ".join(split)
    if len(split) <= words:
        return [joined]
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[a:b] for a, b in zip(
        starts[:len(split) - words + 1].tolist(), ends[words - 1:].tolist())]


def hashed(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))


def multipliers(values: int = VALUES, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, values, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def block_minima(hashes: np.ndarray, factors: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """MinHash values (rows) of consecutive blocks (columns)."""
    step = max(1, 16_384 // block) * block      # long texts a stretch at a time
    parts = []
    for a in range(0, len(hashes), step):
        stretch = hashes[a:a + step]
        parts.append(np.minimum.reduceat(
            stretch[None, :] * factors[:, None], np.arange(0, len(stretch), block), axis=1))
    return np.concatenate(parts, axis=1)


def window_minima(blocks: np.ndarray, width: int) -> np.ndarray:
    """Values of windows of ``2 * width`` blocks, one every ``width`` blocks."""
    n = blocks.shape[1]
    joined = np.minimum.reduceat(blocks, np.arange(0, n, width), axis=1)
    return joined if joined.shape[1] == 1 else np.minimum(joined[:, :-1], joined[:, 1:])


class Items:
    """A block of items, by class: value to items, and each item's shingles."""

    def __init__(self, rows: list[tuple[object, list[bytes]]], values: int):
        self.factors = multipliers(values)
        self.ids, self.sets = [], []
        by_class: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, parts in rows:
            unique = sorted(set(parts))
            hashes = hashed(unique)
            width = 1
            while width * BLOCK < len(parts):
                width *= 2
            self.ids.append(item)
            self.sets.append(frozenset(unique))
            minima = block_minima(hashes, self.factors, len(hashes))[:, 0]
            by_class.setdefault(width, []).append((len(self.ids) - 1, minima))
        # Per class all values of its items, sorted, with the item, and a bit
        # map of their low bits that tells most other values apart. Values of
        # different factors never meet but by chance, and that is verified.
        self.classes = {}
        for width, held in by_class.items():
            flat = np.concatenate([m for _, m in held])
            order = np.argsort(flat, kind="stable")
            seen = np.zeros(1 << LOW_BITS, bool)
            seen[(flat >> np.uint64(64 - LOW_BITS)).astype(np.int64)] = True
            owner = np.repeat([i for i, _ in held], values)
            self.classes[width] = (flat[order], owner[order], seen)

    def candidates(self, hashes: np.ndarray) -> set[int]:
        blocks = block_minima(hashes, self.factors)
        found: set[int] = set()
        for width, (table, owner, seen) in self.classes.items():
            windows = window_minima(blocks, width).ravel()
            values = windows[seen[(windows >> np.uint64(64 - LOW_BITS)).astype(np.int64)]]
            low = np.searchsorted(table, values)
            high = np.searchsorted(table, values, side="right")
            for a, b in set(zip(low[high > low].tolist(), high[high > low].tolist())):
                found.update(owner[a:b].tolist())
        return found

    def matches(self, text: str, words: int, share: float) -> list[tuple[int, float]]:
        parts = shingles(text, words)
        if not parts or not self.ids:
            return []
        out = []
        chosen = self.candidates(hashed(parts))
        if chosen:
            whole = set(parts)
            for i in sorted(chosen):
                part = len(self.sets[i] & whole) / len(self.sets[i])
                if part >= share:
                    out.append((i, part))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, share: float = SHARE,
                 values: int = VALUES, at_once: int = ITEMS_AT_ONCE, id_column: str = "doc_id",
                 text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """(doc_id, item_id, containment) where a document holds ``share`` of an item's shingles.

    An item of fewer than ``words`` words is one shingle and matches only a
    document that is those words. Items and documents without words match
    nothing, null texts among them. Null ids are carried along. Rows repeated
    in either table give a row each. Either table may be empty.

    Items go to the tasks in blocks of at most ``at_once`` shingles, whatever
    their number; documents are read once a block and never shuffled.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    kind, item_kind = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, containment double"
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def searched(block: list[tuple[object, list[bytes]]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)   # at most at_once shingles

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, values)
            for batch in portions(batches, "text"):
                at, item, part = [], [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    for i, containment in items.matches(text, words, share):
                        at.append(k)
                        item.append(items.ids[i])
                        part.append(containment)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())),
                     pa.array(item, arrow[item_kind]), pa.array(part, pa.float64())],
                    names=["id", "item", "containment"])

        return rows.mapInArrow(work, schema)

    out, block, size = None, [], 0
    for item, text in benchmark.select(item_column, text_of("text")).toLocalIterator():
        parts = shingles(text, words)
        if not parts:
            continue
        if block and size + len(parts) > at_once:
            found = stored(searched(block))
            out, block, size = found if out is None else out.unionByName(found), [], 0
        block.append((item, parts))
        size += len(parts)
    last = searched(block)
    out = last if out is None else out.unionByName(last)
    return out.select(F.col("id").alias(id_column), F.col("item").alias(item_column), "containment")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", **settings) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; null ids stay."""
    found = stored(contaminated(docs, benchmark, id_column=id_column, **settings)
                   .select(id_column).filter(F.col(id_column).isNotNull()).distinct())
    return docs.join(found, id_column, "left_anti")
