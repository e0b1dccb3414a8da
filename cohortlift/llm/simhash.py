"""SimHash near duplicates by a generalised pigeonhole.

Two 64-bit fingerprints with at most ``distance`` differing bits differ, in
one of m parts, by at most that part's threshold, whenever the thresholds add
up to ``distance - m + 1``. Bits that go together are put into one part; the
thresholds are dealt by dynamic programming over the numbers of candidates
that the bit statistics of all fingerprints let expect. A fingerprint goes to
its own bucket in every part and probes the buckets within the threshold;
each bucket's homes are compared with its homes and probes.

Only different fingerprints are compared, so copies cost nothing beyond their
fingerprint. A bucket returns a spanning forest of its links and never all
pairs. Buckets over ``MEMBERS`` are cut into pieces, and pairs of pieces are
compared in separate tasks, so no link is lost and no task grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlift.llm.components import components
from cohortlift.llm.shared import portions, stored, text_of

BITS = 64
# A bucket up to this size is one list in one task (16 bytes a member).
MEMBERS = 65_536
# Cost of moving a probe, in comparisons of two fingerprints.
PROBE_COST = 300.0
SECOND = np.uint64(0x9E3779B97F4A7C15)   # odd; turns a hash into an independent one


def _majority(hashes: np.ndarray) -> int:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included."""
    split = text.encode("utf-8", "surrogatepass").lower().split()   # lower() of bytes: A-Z only
    if not split:
        return np.zeros(0, np.uint64)
    joined = b" ".join(split)
    if len(split) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], 42)
         for a, b in zip(starts[:len(split) - words + 1].tolist(), ends[words - 1:].tolist())],
        np.uint64)


def _mixed(hashes: np.ndarray) -> np.ndarray:
    mixed = hashes * SECOND
    mixed ^= mixed >> np.uint64(29)
    return mixed * SECOND


def fingerprints(docs: DataFrame, words: int, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """(id, fp, fp2) per row: the fingerprint, and a second independent one."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            pairs = []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, words)
                pairs.append((_majority(hashes), _majority(_mixed(hashes))) if len(hashes) else (0, 0))
            first, second = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(first, pa.int64()), pa.array(second, pa.int64())],
                names=["id", "fp", "fp2"])

    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, fp bigint, fp2 bigint")


# ---- the plan: parts and thresholds ----------------------------------------

def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are and how often two bits are set together.

    Each task sends one 64 x 64 table of counts, whatever it has read.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(
                values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            together += bits.T @ bits
            n += len(values)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, BITS * BITS), pa.int32()),
             pa.array([float(n), *together.ravel()], pa.float64())], names=["cell", "n"])

    cells = (prints.select("fp").mapInArrow(work, "cell int, n double")
             .groupBy("cell").agg(F.sum("n").alias("n")).collect())
    found = {row["cell"]: row["n"] for row in cells}
    together = np.array([found.get(i, 0.0) for i in range(BITS * BITS)]).reshape(BITS, BITS)
    return int(found.get(-1, 0)), together


def grouped_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups; each takes the free bit most correlated with it."""
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    alike = np.abs(together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(alike, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        left = sorted(free)
        part = [max(left, key=lambda b: (alike[b, left].max(), -b))]
        free.discard(part[0])
        while len(part) < size:
            best = max(sorted(free), key=lambda b: alike[b, part].sum())
            part.append(best)
            free.discard(best)
        groups.append(sorted(part))
    return groups


def expected_cost(n: int, share: np.ndarray, part: list[int], threshold: int) -> float:
    """Comparisons and probes of one part: bits differ independently, each at its own rate."""
    if threshold < 0:
        return 0.0
    differ = 2 * share[part] * (1 - share[part])
    chance = np.zeros(len(part) + 1)   # of 0, 1, ... differing bits
    chance[0] = 1.0
    for rate in differ:
        chance[1:] = chance[1:] * (1 - rate) + chance[:-1] * rate
        chance[0] *= 1 - rate
    probes = sum(comb(len(part), k) for k in range(threshold + 1))
    return n * n * float(chance[:threshold + 1].sum()) + PROBE_COST * n * probes


def dealt_thresholds(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 that add up to ``total`` at the least cost.

    ``costs[i][t + 1]`` is the cost of threshold t in part i.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, more in enumerate(row):
                value = (cost + more, [*chosen, t - 1])
                if used + t not in step or value < step[used + t]:
                    step[used + t] = value
        best = step
    return best[total + len(costs)]


def plan(n: int, together: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """The cheapest (bits of a part, threshold) over all numbers of parts."""
    share = np.diag(together) / max(n, 1)
    options = []
    for parts in range(2, min(distance + 1, 8) + 1):
        groups = grouped_bits(n, together, parts)
        total = distance - parts + 1
        if total < -parts:
            continue
        costs = [[expected_cost(n, share, g, t) for t in range(-1, min(max(total + parts - 1, 0), 4) + 1)]
                 for g in groups]
        try:
            cost, chosen = dealt_thresholds(costs, total)
        except KeyError:
            continue
        options.append((cost, list(zip(groups, chosen))))
    if not options:   # distance 0 or 1: one part over all bits
        return [(list(range(BITS)), distance)]
    return min(options, key=lambda o: o[0])[1]


# ---- probing and comparing --------------------------------------------------

def _keys(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The part's bits, put together into one number."""
    out = np.zeros(len(values), np.uint64)
    for place, bit in enumerate(bits):
        out |= ((values >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
    return out


def _probed(parts: list[tuple[list[int], int]]):
    masks = []
    for bits, threshold in parts:
        found = [sum(1 << p for p in places)
                 for k in range(1, threshold + 1) for places in combinations(range(len(bits)), k)]
        masks.append(np.array([0, *found], np.uint64) if threshold >= 0 else None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            fp2 = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for k, ((bits, _), mask) in enumerate(zip(parts, masks)):
                if mask is None:
                    continue
                own = _keys(fp.view(np.uint64), bits)
                step = max(1, 200_000 // len(mask))
                for a in range(0, len(own), step):
                    keys = (own[a:a + step, None] ^ mask[None, :]).ravel()
                    m = len(own[a:a + step])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), k, np.int32)),
                         pa.array(keys.view(np.int64)),
                         pa.array(np.tile(np.arange(len(mask)) == 0, m)),
                         pa.array(np.repeat(fp[a:a + step], len(mask))),
                         pa.array(np.repeat(fp2[a:a + step], len(mask)))],
                        names=["part", "key", "home", "fp", "fp2"])
    return work


class _Forest:
    """Union-find over the members of one bucket; keeps the links it made."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def labels(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if np.array_equal(nxt, up):
                self.up = up.copy()
                return up
            up = nxt


def linked_members(homes: np.ndarray, others: np.ndarray, distance: int,
                   confirm: int | None) -> list[tuple[int, int]]:
    """A spanning forest of the links between homes, and homes and others.

    ``homes`` and ``others`` have a row (fp, fp2) per member. First a few
    members take in all that lie near them. What is linked to the largest
    tree by then need not be compared any more: only the remaining homes are
    compared with everyone, and the remaining others with the tree's homes.
    """
    members = np.concatenate([homes, others]).view(np.uint64)
    n, h = len(members), len(homes)
    forest = _Forest(n)

    def near(row: np.ndarray, columns: np.ndarray) -> np.ndarray:
        hit = np.bitwise_count(row[:, None, 0] ^ columns[None, :, 0]) <= distance
        if confirm is not None:
            hit &= np.bitwise_count(row[:, None, 1] ^ columns[None, :, 1]) <= confirm
        return hit

    if n > 256:
        open_ = np.arange(h)
        for _ in range(32):
            if not len(open_):
                break
            pivot = open_[0]
            hit = np.flatnonzero(near(members[pivot:pivot + 1], members)[0])
            for j in hit.tolist():
                forest.join(int(pivot), j)
            open_ = open_[~np.isin(open_, hit)]
        labels = forest.labels()
        names, sizes = np.unique(labels, return_counts=True)
        giant = labels == names[sizes.argmax()]
        rows = [(np.flatnonzero(~giant[:h]), np.arange(n)),
                (h + np.flatnonzero(~giant[h:]), np.flatnonzero(giant[:h]))]
    else:
        rows = [(np.arange(h), np.arange(n))]
    for left, right in rows:
        step = max(1, 1_000_000 // max(len(right), 1))
        for a in range(0, len(left), step):
            block = left[a:a + step]
            for i, j in np.argwhere(near(members[block], members[right])).tolist():
                if block[i] != right[j]:
                    forest.join(int(block[i]), int(right[j]))
    return forest.links


def _compare(distance: int, confirm: int | None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat(column):
            offsets = column.offsets.to_numpy()
            both = column.values
            values = np.stack([both.field(0).to_numpy(zero_copy_only=False),
                               both.field(1).to_numpy(zero_copy_only=False)], axis=1).astype(np.int64)
            return offsets, values

        for batch in batches:
            (ho, hv), (oo, ov) = flat(batch.column(0)), flat(batch.column(1))
            a, b = [], []
            for k in range(batch.num_rows):
                homes, others = hv[ho[k]:ho[k + 1]], ov[oo[k]:oo[k + 1]]
                if len(homes) + len(others) < 2 or not len(homes):
                    continue
                fps = np.concatenate([homes, others])
                for i, j in linked_members(homes, others, distance, confirm):
                    a.append(fps[i])
                    b.append(fps[j])
            left, right = np.array(a, np.int64).reshape(-1, 2), np.array(b, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(left[:, 0]), pa.array(left[:, 1]), pa.array(right[:, 0]), pa.array(right[:, 1])],
                names=["fp_a", "fp2_a", "fp_b", "fp2_b"])
    return work


def _lists(rows: DataFrame, *keys: str) -> DataFrame:
    """Homes and others of each bucket as two lists; buckets without a pair go."""
    member = F.struct("fp", "fp2")
    return (
        rows.groupBy(*keys)
        .agg(F.collect_list(F.when(F.col("home"), member)).alias("homes"),
             F.collect_list(F.when(~F.col("home"), member)).alias("others"))
        .filter("size(homes) > 0 and size(homes) + size(others) > 1"))


def links(prints: DataFrame, parts: list[tuple[list[int], int]], distance: int,
          confirm: int | None = None, most: int = MEMBERS) -> DataFrame:
    """Links (fp_a, fp2_a, fp_b, fp2_b) that connect all fingerprints near each other."""
    probes = prints.select("fp", "fp2").mapInArrow(
        _probed(parts), "part int, key bigint, home boolean, fp bigint, fp2 bigint")
    crowded = stored(
        probes.groupBy("part", "key").agg(F.count("*").alias("n"))
        .filter(F.col("n") > most)
        .select("part", "key", F.ceil(F.col("n") / (most // 2)).cast("int").alias("pieces")))
    schema = "fp_a bigint, fp2_a bigint, fp_b bigint, fp2_b bigint"
    if crowded.isEmpty():
        return _lists(probes, "part", "key").select("homes", "others").mapInArrow(
            _compare(distance, confirm), schema)
    plain = _lists(probes.join(crowded, ["part", "key"], "left_anti"), "part", "key")
    # Piece i's homes meet piece j's members for every (i, j): each row of a
    # crowded bucket is repeated once a piece, as home and as other.
    cut = probes.join(crowded, ["part", "key"]).withColumn(
        "own", F.pmod(F.xxhash64("fp", "fp2"), F.col("pieces")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    as_home = cut.filter("home").select(
        "part", "key", F.col("own").alias("i"), each.alias("j"), "home", "fp", "fp2")
    as_other = cut.select(
        "part", "key", each.alias("i"), F.col("own").alias("j"), F.lit(False).alias("home"), "fp", "fp2")
    pieces = _lists(as_home.unionByName(as_other), "part", "key", "i", "j")
    return plain.select("homes", "others").unionByName(pieces.select("homes", "others")).mapInArrow(
        _compare(distance, confirm), schema)


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, confirm: int | None = None,
                    id_column: str = "doc_id", text_column: str = "text",
                    most: int = MEMBERS) -> DataFrame:
    """One row per input row: id, fp, component_id (smallest id in reach).

    Fingerprints are of ``words``-word shingles and link at ``distance`` or
    fewer differing bits; with ``confirm``, a second independent fingerprint
    must differ in at most so many bits too, which rules out chance.

    A null text counts as empty. A text without words has fingerprint zero and
    links like any other. Rows with a null id link too; component_id is the
    smallest id that is not null, and null if the whole class has none.
    Repeated rows and ties share a class. An empty table gives an empty
    result. Other columns are not read.
    """
    rows = stored(fingerprints(docs, words, id_column, text_column))
    if confirm is None:   # the second fingerprint plays no part: one class per first one
        rows = rows.withColumn("fp2", F.lit(0).cast("bigint"))
    prints = stored(rows.groupBy("fp", "fp2").agg(F.min("id").alias("least")))
    n, together = bit_statistics(prints)
    edges = stored(links(prints, plan(n, together, distance), distance, confirm, most))
    roots = components(edges.select(
        F.struct(F.col("fp_a").alias("fp"), F.col("fp2_a").alias("fp2")).alias("a"),
        F.struct(F.col("fp_b").alias("fp"), F.col("fp2_b").alias("fp2")).alias("b")))
    roots = roots.select(F.col("node.fp").alias("fp"), F.col("node.fp2").alias("fp2"), "root")
    placed = prints.join(roots, ["fp", "fp2"], "left").withColumn(
        "root", F.coalesce("root", F.struct("fp", "fp2")))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(placed.join(least, "root").select("fp", "fp2", "component_id"))
    return rows.join(classes, ["fp", "fp2"]).select(
        F.col("id").alias(id_column), "fp", "component_id")


def first_of_each(docs: DataFrame, words: int = 4, distance: int = 4, confirm: int | None = None,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate class: the smallest id.

    Rows with a null id are kept, as nothing tells them apart; of rows that
    repeat an id all or none stay.
    """
    found = near_duplicates(docs, words, distance, confirm, id_column, text_column)
    dropped = found.filter(
        F.col(id_column).isNotNull() & (F.col(id_column) != F.col("component_id"))
    ).select(id_column).distinct()
    return docs.join(dropped, id_column, "left_anti")


def hex_digits(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
