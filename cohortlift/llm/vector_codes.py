"""Product-quantised codes of vectors, trained by ball k-means over all rows.

Each part position has its own codebook. An entry with its parts is a ball: its
radius tells which other entries can be nearer to any of its parts (two balls'
centres over twice the radius apart never compete). Sorted by distance, these
neighbours cut the ball into rings: a part nearer to its entry than half the
way to the first neighbour lies in the stable core and needs no search; one
beyond half the way to the k-th competes with the first k alone. All distances
are exact integers, so codes equal those of a full search, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlift.llm.shared import delete, stored_at

# Rows searched together; the memory of a task does not depend on its size.
BLOCK = 32_768
# Parts of one ring depth are searched together, to these depths.
DEPTHS = (4, 16, 64)


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, position]``, as integers."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class Balls:
    """The entries of one part position, and who competes with whom."""

    def __init__(self, entries: np.ndarray, reach: np.ndarray, moved: np.ndarray):
        """``reach``: no part of an entry is farther from it. ``moved``: since codes were last chosen."""
        self.entries = entries.astype(np.float64)
        self.squares = (self.entries ** 2).sum(axis=1)
        apart = self.squares[:, None] - 2 * self.entries @ self.entries.T + self.squares
        np.fill_diagonal(apart, np.inf)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        # Half the way to a neighbour is within the radius; the margin covers rounding of the root.
        self.neighbours = (self.apart <= 4 * (reach[:, None] * (1 + 1e-9) + 1e-6) ** 2).sum(axis=1)
        self.settled = np.array([
            not moved[i] and not moved[self.order[i, :n]].any() for i, n in enumerate(self.neighbours)], bool)

    def nearest(self, parts: np.ndarray) -> np.ndarray:
        """The nearest entry of each part by a search of all, the lower of equals."""
        return np.argmin(self.squares - 2 * parts @ self.entries.T, axis=1)

    def distances(self, parts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return ((parts - self.entries[codes]) ** 2).sum(axis=1)

    def reassigned(self, parts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """New codes, distances, and how many distances to other entries were computed."""
        best, chosen, searched = self.distances(parts, codes), codes.copy(), 0
        by_entry = np.argsort(codes, kind="stable")
        starts = np.searchsorted(codes[by_entry], np.arange(len(self.entries) + 1))
        for entry in np.flatnonzero(np.diff(starts)):
            near = self.neighbours[entry]
            if not near or self.settled[entry]:
                continue
            members = by_entry[starts[entry]:starts[entry + 1]]
            rings = np.searchsorted(self.apart[entry, :near], 4 * best[members], side="right")
            low = 0
            for depth in (*(d for d in DEPTHS if d < near), near):
                ring = members[(rings > low) & (rings <= depth)]
                low = depth
                if not len(ring):
                    continue
                rivals = np.sort(self.order[entry, :depth])
                own = parts[ring]
                far = (own ** 2).sum(axis=1)[:, None] - 2 * own @ self.entries[rivals].T + self.squares[rivals]
                searched += far.size
                place = np.argmin(far, axis=1)
                least, rival = far[np.arange(len(ring)), place], rivals[place]
                wins = (least < best[ring]) | ((least == best[ring]) & (rival < entry))
                best[ring[wins]], chosen[ring[wins]] = least[wins], rival[wins]
        return chosen, best, searched


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), kind))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            held.append(batch.slice(at, BLOCK))
            size += held[-1].num_rows
            if size >= BLOCK:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _assigner(balls_of, first: bool, shape: tuple[int, int, int], schema: T.StructType):
    """The task: new codes for all rows, and at its end the sums per entry as rows of their own."""
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        balls = balls_of()
        counts = np.zeros((parts, entries), np.int64)
        far = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), np.int64)

        def rows(columns: dict, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in target],
                schema=target)

        for block in _blocks(batches):
            vectors = _matrix(block.column("vector"), parts * width, np.float64)
            codes = np.empty((len(vectors), parts), np.int32)
            before = None if first else _matrix(block.column("codes"), parts, np.int64)
            errors = np.zeros(len(vectors), np.int64)
            for p in range(parts):
                own = np.ascontiguousarray(vectors[:, p * width:(p + 1) * width])
                if first:
                    chosen = balls[p].nearest(own)
                    away = balls[p].distances(own, chosen)
                else:
                    chosen, away, _ = balls[p].reassigned(own, before[:, p])
                away = away.astype(np.int64)
                codes[:, p], errors = chosen, errors + away
                counts[p] += np.bincount(chosen, minlength=entries)
                np.maximum.at(far[p], chosen, away)
                for k in range(width):
                    sums[p, :, k] += np.bincount(chosen, own[:, k], entries).astype(np.int64)
            yield rows({"id": block.column("id"), "label": block.column("label"), "vector": block.column("vector"),
                        "codes": _lists(codes, pa.int32()), "error": pa.array(errors)}, len(vectors))
        p, entry = np.nonzero(counts)
        if len(p):
            yield rows({"part": pa.array(p), "entry": pa.array(entry), "n": pa.array(counts[p, entry]),
                        "far": pa.array(far[p, entry]), "sums": _lists(sums[p, entry], pa.int64())}, len(p))

    return run


def _quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _guarded(vector: Column, limit: int) -> Column:
    fine = F.forall(vector, lambda x: F.abs(x) <= limit)
    return F.when(fine, vector).otherwise(
        F.raise_error(F.lit(f"a scaled component beyond {limit} has no exact distances")))


def ball_kmeans(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
                label_column: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4,
                scale: int = 1024) -> tuple[DataFrame, Codebooks]:
    """(id, label, vector, codes, error) per kept row, and the final codebooks.

    A component x counts as the integer floor(scale * x). Vectors are cut into
    ``parts`` equal consecutive parts. The codebook of a part position starts as
    that part of the vectors with the smallest ids; in each round every part
    takes the nearest entry (squared Euclidean distance, the lower index of
    equals) and each entry becomes the floored mean of its parts; unused
    entries stay. After the rounds parts are assigned once more. ``error`` is
    the squared distance summed over the parts.

    Rows whose vector is null or holds a null or non-finite component are left
    out. So are empty vectors and those of another length than the first kept
    one: they have no distance to the others. Null ids come after all others,
    equal ids in the order of their vectors, and repeated rows count each time.
    Fewer rows than entries give fewer entries. An empty table gives no rows
    and empty codebooks. A length that ``parts`` does not divide is an error,
    and so are components too large for exact distances (about 11,000 before
    scaling, at 16 components a part). Other columns are not read.

    Every round is one pass over a stored table, without a shuffle of rows: a
    task returns its rows and, per entry, their sums; the driver gets at most
    ``parts * entries`` of these, whatever the table's size.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_column)
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    kept = vectors.filter(vector.isNotNull() & (F.size(vector) > 0)).filter(sound).select(
        F.col(id_column).alias("id"), F.col(label_column).alias("label"), _quantised(vector, scale).alias("vector"))
    order = (F.col("id").asc_nulls_last(), F.col("vector"))
    schema = T.StructType([
        T.StructField("id", kept.schema["id"].dataType), T.StructField("label", kept.schema["label"].dataType),
        T.StructField("vector", T.ArrayType(T.IntegerType())), T.StructField("codes", T.ArrayType(T.IntegerType())),
        T.StructField("error", T.LongType()),
        T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("far", T.LongType()),
        T.StructField("sums", T.ArrayType(T.LongType()))])

    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        nothing = spark.createDataFrame([], schema).select("id", "label", "vector", "codes", "error")
        return nothing, Codebooks(np.zeros((parts, 0, 0), np.int64))
    length = len(first[0]["vector"])
    if length % parts:
        raise ValueError(f"vectors of length {length} cannot be cut into {parts} equal parts")
    width = length // parts
    limit = isqrt(2**53 // width) // 2 - 1
    kept = kept.filter(F.size("vector") == length).withColumn("vector", _guarded(F.col("vector"), limit))
    seeds = kept.orderBy(*order).limit(entries).collect()
    book = np.array([r["vector"] for r in seeds], np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2)
    shape = book.shape

    state = kept.select("id", "label", F.col("vector").cast("array<int>").alias("vector"))
    reach, moved, path = np.zeros(shape[:2]), np.ones(shape[:2], bool), None
    for turn in range(rounds + 1):
        def balls_of(book=book, reach=reach, moved=moved):
            return [Balls(*p) for p in zip(book, reach, moved)]

        columns = ["id", "label", "vector"] + (["codes"] if turn else [])
        done, at = stored_at(state.select(*columns).mapInArrow(_assigner(balls_of, not turn, shape, schema), schema))
        if path:    # the round before is no longer needed
            delete(spark, path)
        state, path = done.filter("part IS NULL"), at
        if turn == rounds:
            break
        totals = done.filter("part IS NOT NULL").groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.max("far").alias("far"),
            F.array(*[F.sum(F.col("sums")[k]) for k in range(width)]).alias("sums")).collect()
        after, reach = book.copy(), np.zeros(shape[:2])
        for r in totals:
            at_entry = r["part"], r["entry"]
            after[at_entry] = np.array(r["sums"], np.int64) // r["n"]
            drift = ((after[at_entry] - book[at_entry]) ** 2).sum()
            reach[at_entry] = np.sqrt(r["far"]) + np.sqrt(drift)
        moved, book = (after != book).any(axis=2), after
    return state.select("id", "label", "vector", "codes", "error"), Codebooks(book)


def coded(vectors: DataFrame, id_column: str = "vec_id", label_column: str = "label", **options) -> DataFrame:
    """One row per kept vector: id, code, error, label_error, codebooks_sha256.

    ``code`` has two hexadecimal digits per part; ``label_error`` sums the
    errors of equal labels, null labels together. See ``ball_kmeans`` for what
    is kept and for the options.
    """
    rows, book = ball_kmeans(vectors, id_column, label_column=label_column, **options)
    digits = F.array_join(F.transform(
        "codes", lambda c: F.lpad(F.lower(F.hex(c.cast("bigint"))), 2, "0")), "")
    totals = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return rows.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select(
        F.col("id").alias(id_column), digits.alias("code"), "error", "label_error",
        F.lit(book.sha256()).alias("codebooks_sha256"))
