"""Repeated passages, by winnowing over line hashes.

A text is cut into lines, and long lines at sentence ends. The gram of a line
is the hash of the shortest run of lines from there with ``GRAM`` words. A
window is the shortest run of lines with ``LEAST`` words; its smallest gram is
selected, so two copies of a window always select a gram at the same place.
Only windows whose selected gram stands more than once can be repeats. Each of
them is joined with the first place of the same window, the match is extended
both ways line by line, and the later run is deleted: whatever window stands
earlier in the corpus is gone from its later places, whichever texts share it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.llm.shared import portions, row_key, stored, text_of

LEAST = 40    # words of a run that counts as a repeat
GRAM = 12     # words of a gram, at least
TOGETHER = 500    # texts whose lines are worked on as one array
END = re.compile(r"(?:\n|[.!?…](?=[ \t\n]))\s*")

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def cut(text: str) -> list[str]:
    """The lines with whatever separates them; together they are the text."""
    ends = [m.end() for m in END.finditer(text)]
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    return [text[a:b] for a, b in zip([0, *ends], ends)] if text else []


def measured(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of words) of every line, white space at its ends aside."""
    digest = xxhash.xxh3_64_intdigest
    n = len(lines)
    return (np.fromiter((digest(line.strip().encode("utf-8", "surrogatepass")) for line in lines), np.uint64, n),
            np.fromiter((len(line.split()) for line in lines), np.int64, n))


def run_hashes(hashes: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """One hash for each run of lines first .. stop - 1, from sums over all lines before."""
    n = len(hashes)
    powers, backwards = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
    powers[:1] = backwards[:1] = 1
    powers, backwards = np.multiply.accumulate(powers), np.multiply.accumulate(backwards)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:n], dtype=np.uint64)])
    out = (sums[stop] - sums[first]) * backwards[first]
    # The lowest bits of such sums depend on the lowest bits alone.
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def grams(hashes: np.ndarray, words: np.ndarray, size: int, ends: np.ndarray | None = None
          ) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of lines) of the shortest run of ``size`` words from each line; 0 lines where too few follow.

    ``ends``: for lines of several texts, where the text of each line ends.
    """
    n, total = len(hashes), np.concatenate([[0], np.cumsum(words)])
    stop = np.searchsorted(total, total[:n] + size)      # the run is lines i .. stop - 1
    whole = stop <= (n if ends is None else ends)
    at = np.flatnonzero(whole)
    out = np.zeros(n, np.uint64)
    out[at] = run_hashes(hashes, at, stop[at])
    return out, np.where(whole, stop - np.arange(n), 0)


def window_minima(hashes: np.ndarray, words: np.ndarray, least: int, size: int,
                  ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first line, line after the last, line of the smallest gram) of each window, and all grams.

    A run with ``least`` words holds, from its first line on, a whole window;
    equal runs hold equal windows and select the same line of it.
    """
    found, _ = grams(hashes, words, size, ends)
    n, total = len(hashes), np.concatenate([[0], np.cumsum(words)])
    stop = np.searchsorted(total, total[:n] + least)     # the window is lines i .. stop - 1
    # Grams that end inside the window: they begin at lines i .. final.
    first = np.flatnonzero(stop <= (n if ends is None else ends))
    final = np.searchsorted(np.searchsorted(total, total[:n] + size), stop[first], side="right") - 1
    inside = final >= first
    first, final = first[inside], final[inside]
    if not len(first):
        return first, first, first, found
    # The smallest of each range from minima over powers of two; ranks settle ties.
    order = np.argsort(found, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    sizes = final - first + 1
    level = np.frexp(sizes)[1] - 1
    least_rank, table = np.empty(len(first), np.int64), rank
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        least_rank[at] = np.minimum(table[first[at]], table[final[at] - (1 << k) + 1])
        table = np.minimum(table[:len(table) - (1 << k)], table[1 << k:]) if len(table) > 1 << k else table
    return first, stop[first], order[least_rank], found


def selected(hashes: np.ndarray, words: np.ndarray, least: int, size: int) -> np.ndarray:
    """Lines whose gram is the smallest of a window."""
    return np.unique(window_minima(hashes, words, least, size)[2])


def extended(own: np.ndarray, own_at: int, other: np.ndarray, other_at: int) -> tuple[int, int]:
    """First line and line after the last of the match around two equal places."""
    back, most = 0, min(own_at, other_at)
    differs = np.flatnonzero(own[own_at - most:own_at][::-1] != other[other_at - most:other_at][::-1])
    back = int(differs[0]) if len(differs) else most
    most = min(len(own) - own_at, len(other) - other_at)
    differs = np.flatnonzero(own[own_at:own_at + most] != other[other_at:other_at + most])
    return own_at - back, own_at + (int(differs[0]) if len(differs) else most)


def _ends(lines: list[int] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins among the lines of all, and for each line where its text ends."""
    starts = np.concatenate([[0], np.cumsum(lines)]).astype(np.int64)
    return starts, np.repeat(starts[1:], lines)


def _profile(least: int, size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = pa.struct([("at", pa.int32()), ("gram", pa.int64())])
        for batch in (whole.slice(a, TOGETHER) for whole in batches for a in range(0, whole.num_rows, TOGETHER)):
            cuts = [cut(text) for text in batch.column("text").to_pylist()]
            hashes, words = measured([line for lines in cuts for line in lines])
            starts, ends = _ends([len(lines) for lines in cuts])
            _, _, place, found = window_minima(hashes, words, least, size, ends)
            at = np.unique(place)
            owner = np.searchsorted(starts, at, side="right") - 1
            marks = pa.StructArray.from_arrays(
                [pa.array((at - starts[owner]).astype(np.int32)), pa.array(found[at].view(np.int64))], fields=list(mark))
            h, w = hashes.tobytes(), np.minimum(words, 65535).astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"),
                 pa.ListArray.from_arrays(np.searchsorted(at, starts).astype(np.int32), marks),
                 pa.array([h[8 * a:8 * b] for a, b in zip(starts, starts[1:])], pa.binary()),
                 pa.array([w[2 * a:2 * b] for a, b in zip(starts, starts[1:])], pa.binary())],
                names=["id", "key", "marks", "hashes", "words"])
    return work


def _windows(least: int, size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, TOGETHER) for whole in batches for a in range(0, whole.num_rows, TOGETHER)):
            hashes = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint64)
            each = batch.column("words").to_pylist()
            words = np.frombuffer(b"".join(each), "<u2").astype(np.int64)
            starts, ends = _ends([len(w) // 2 for w in each])
            first, stop, place, _ = window_minima(hashes, words, least, size, ends)
            listed = batch.column("places")
            wanted = np.zeros(len(hashes) + 1, bool)
            wanted[listed.flatten().to_numpy() + np.repeat(starts[:-1], listed.value_lengths().to_numpy())] = True
            first, stop = first[wanted[place]], stop[wanted[place]]
            owner = np.searchsorted(starts, first, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(run_hashes(hashes, first, stop).view(np.int64)), batch.column("id").take(pa.array(owner)),
                 batch.column("key").take(pa.array(owner)), pa.array((first - starts[owner]).astype(np.int32))],
                names=["window", "id", "key", "at"])
    return work


def _matched(least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, spans = [], []
            for row in batch.to_pylist():
                own = np.frombuffer(row["hashes"], np.uint64)
                words = np.frombuffer(row["words"], "<u2").astype(np.int64)
                other = np.frombuffer(row["first_hashes"], np.uint64)
                found: list[tuple[int, int]] = []
                for place in sorted(row["places"], key=lambda p: p["at"]):
                    if found and place["at"] < found[-1][1]:
                        continue    # inside a run that is already known
                    # Within one text the run may reach into its own source:
                    # every line then still equals one that stays in front.
                    a, b = extended(own, place["at"], other, place["first_at"])
                    if words[a:b].sum() >= least:
                        found.append((a, b))
                if found:
                    keys.append(row["key"])
                    spans.append([{"a": a, "b": b} for a, b in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
                names=["key", "spans"])
    return work


def repeated_runs(docs: DataFrame, least: int = LEAST, size: int = GRAM, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """(key, spans): per text with repeats, the line ranges [a, b) to delete.

    ``key`` is ``row_key`` of the id and the text. Order in the corpus is id,
    nulls last, then key; what comes first is never deleted on account of
    what comes later. Lines and windows are equal if their 64-bit hashes are;
    a line's words are counted up to 65,535.
    """
    rows = docs.select(
        F.col(id_column).alias("id"), text_of(text_column).alias("text")
    ).withColumn("key", row_key("id", "text"))
    kind = rows.schema["id"].dataType.simpleString()
    profile = stored(rows.mapInArrow(
        _profile(least, size),
        f"id {kind}, key string, marks array<struct<at:int,gram:bigint>>, hashes binary, words binary"))
    marks = profile.select("key", F.explode("marks").alias("m")).select("m.gram", "key", "m.at")
    repeated = stored(
        marks.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("gram").alias("g")))
    places = marks.join(repeated, F.col("gram") == F.col("g"), "left_semi").groupBy("key").agg(
        F.collect_set("at").alias("places"))     # lines of one text
    # Only texts with a repeated gram are moved. Repeated rows share a key and are one text
    # here. None of these tables has a bound, so no side is ever broadcast.
    texts = stored(
        profile.select("id", "key", "hashes", "words").join(places.hint("merge"), "key")
        .groupBy("key").agg(*[F.first(c).alias(c) for c in ("id", "hashes", "words", "places")]))
    windows = stored(texts.select("id", "key", "hashes", "words", "places").mapInArrow(
        _windows(least, size), f"window bigint, id {kind}, key string, at int")).select("window", F.struct(
            F.col("id").isNull().alias("none"), "id", "key", "at").alias("place"))
    firsts = stored(
        windows.groupBy("window").agg(F.min("place").alias("first"), F.count("*").alias("n"))
        .filter("n > 1").select(F.col("window").alias("w"), "first"))
    pairs = windows.join(firsts, F.col("window") == F.col("w")).filter("place != first")
    matches = stored(
        pairs.groupBy(F.col("place.key").alias("key"), F.col("first.key").alias("first_key"))
        .agg(F.collect_set(F.struct(F.col("place.at").alias("at"), F.col("first.at").alias("first_at")))
             .alias("places")))
    texts = texts.select("key", "hashes", "words")
    sources = texts.select(F.col("key").alias("first_key"), F.col("hashes").alias("first_hashes"))
    both = matches.join(texts.hint("merge"), "key").join(sources.hint("merge"), "first_key")
    found = both.select("key", "first_key", "places", "hashes", "words", "first_hashes").mapInArrow(
        _matched(least), "key string, spans array<struct<a:int,b:int>>")
    return stored(found.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "_text"):
        texts, removed, words = [], [], []
        for text, spans in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist()):
            if not spans:
                texts.append(text)
                removed.append([])
                words.append(0)
                continue
            lines = cut(text)
            gone = np.zeros(len(lines), bool)
            for span in spans:
                gone[span["a"]:span["b"]] = True
            texts.append("".join(line for line, g in zip(lines, gone) if not g).rstrip("\n"))
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            removed.append(["".join(lines[a:b]) for a, b in zip(edges[::2], edges[1::2])])
            words.append(sum(len(line.split()) for line, g in zip(lines, gone) if g))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), pa.array(texts, pa.string()),
             pa.array(removed, pa.list_(pa.string())), pa.array(words, pa.int64())],
            names=["_row", "_new", "_removed", "_removed_words"])


def _changed(docs: DataFrame, spans: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(_row, _new, _removed, _removed_words): every row, whole, beside its new text."""
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"), text_of(text_column).alias("_text"),
        F.col(id_column).alias("_id"))
    joined = rows.withColumn("key", row_key("_id", "_text")).join(
        spans.withColumnRenamed("spans", "_spans").hint("merge"), "key", "left").select("_row", "_text", "_spans")
    kind = rows.schema["_row"].dataType.simpleString()
    return joined.mapInArrow(
        _cut_out, f"_row {kind}, _new string, _removed array<string>, _removed_words bigint")


def without_repeats(docs: DataFrame, least: int = LEAST, size: int = GRAM, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """One row per input row: id, text without later repeats, removed (texts), removed_words.

    A null text counts as empty and comes back empty. Repeated rows (same id
    and text) are one text and are changed alike. Null ids come last in the
    order. Texts below ``least`` words keep everything. An empty table gives
    an empty result. Other columns are not read.
    """
    narrow = docs.select(id_column, text_column)
    spans = repeated_runs(narrow, least, size, id_column, text_column)
    return _changed(narrow, spans, id_column, text_column).select(
        F.col(f"_row.{id_column}").alias(id_column), F.col("_new").alias(text_column),
        F.col("_removed").alias("removed"), F.col("_removed_words").alias("removed_words"))


def deduplicated(docs: DataFrame, least: int = LEAST, size: int = GRAM, id_column: str = "doc_id",
                 text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """``docs`` with later repeats cut out, all columns kept.

    A document that loses everything goes; one that was empty before stays.
    ``length_column``, where the table has it, is brought up to date for
    changed texts.
    """
    spans = repeated_runs(docs.select(id_column, text_column), least, size, id_column, text_column)
    cut_ = _changed(docs, spans, id_column, text_column)
    changed = F.col("_removed_words") > 0
    columns = []
    for name in docs.columns:
        own = F.col("_row").getField(name)
        if name == text_column:
            own = F.when(changed, F.col("_new")).otherwise(own)
        elif name == length_column:
            own = F.when(changed, F.length("_new").cast(docs.schema[name].dataType)).otherwise(own)
        columns.append(own.alias(name))
    return cut_.filter(~changed | (F.trim("_new") != "")).select(*columns)
