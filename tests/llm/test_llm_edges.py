"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from cohortlift.llm import (
    decontamination, exact_dedup, line_dedup, main_text, packing, quality, simhash, toxicity, warc,
    wavelet)
from cohortlift.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string, fp bigint, _id int, key string, id string, n_chars bigint"
LONG = "word and other " * 40_000


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 7, 8, "k", "x", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, [
        (1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, "one"), (None, "one"), (None, None),
        (6, "a b c d e f g"), (7, "a b c d e f g"), (8, LONG), (9, LONG), (10, "ünï  cödé \x1c.\r\n\r\n.")])


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


LABELS = "doc_id bigint, quality int, toxic int"


def operators(spark):
    labels = spark.createDataFrame([(6, 1, 1), (4, 0, 0), (None, 1, None), (9, None, 0), (8, 1, 0)], LABELS)
    bench = spark.createDataFrame(
        [(1, "a b c d e f"), (2, None), (None, "a b c d e f g"), (3, "")], "item_id bigint, text string")
    path = tokenizer_path()
    return {
        "simhash": lambda d: simhash.near_duplicates(d),
        "first": lambda d: simhash.first_of_each(d),
        "exact": lambda d: exact_dedup.exact_duplicates(d),
        "lines": lambda d: line_dedup.without_repeats(d),
        "lines_kept": lambda d: line_dedup.deduplicated(d),
        "quality": lambda d: quality.scored(d, labels),
        "accepted": lambda d: quality.accepted(d, labels),
        "toxicity": lambda d: toxicity.scored(d, labels),
        "leaks": lambda d: decontamination.contaminated(d, bench),
        "packed": lambda d: packing.packed(d, path),
        "shards": lambda d: wavelet.read_shards(wavelet.write_shards(d, path, 0)),
    }


NAMES = ["simhash", "first", "exact", "lines", "lines_kept", "quality", "accepted", "toxicity", "leaks",
         "packed", "shards"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    found = operators(spark)[name](odd).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found)
    every = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd.collect())
    if name in ("simhash", "exact", "lines", "quality", "toxicity", "shards"):
        assert ids == every
    elif name == "packed":
        assert set(ids) == set(every)
    else:
        assert set(ids) <= set(every)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, empty, name):
    assert operators(spark)[name](empty).collect() == []


def test_defined_results(spark, odd):
    exact = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"])
             for r in exact_dedup.exact_duplicates(odd).collect()}
    assert (3, 3, 4, True) in exact             # the longest of the texts without a visible character
    assert (1, 3, 4, False) in exact and (2, 3, 4, False) in exact
    assert (5, 4, 4, False) in exact and (None, 4, 4, False) in exact
    near = {r["doc_id"]: r for r in simhash.near_duplicates(odd).collect() if r["doc_id"]}
    assert near[1]["fp"] == near[3]["fp"] == 0 and near[3]["component_id"] == 1
    assert near[7]["component_id"] == 6
    leaks = sorted((r["doc_id"], r["item_id"] or 0) for r in decontamination.contaminated(
        odd, spark.createDataFrame([(1, "A b, c d e f")], "item_id bigint, text string")).collect())
    assert leaks == [(6, 1), (7, 1)]


PAGES = "page_id bigint, url string, html string, digest string, key string"


def test_pages(spark):
    big = "x" * 2000
    pages = spark.createDataFrame([
        (1, None, None, "d", "k"), (2, "http://a b/\n", big, "d", "k"), (3, "u", big, "d", "k"),
        (3, "u", big, "d", "k"), (None, "u", big, "d", "k"), (4, "", "", "d", "k"), (5, "u", "small", "d", "k"),
        (6, "u", "small", "d", "k")], PAGES)
    index = warc.write_archives(pages, file_bytes=500)
    assert index.select("uri").distinct().count() > 1
    found = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"])
                   for r in warc.read_archives(index, gap=10, most=300).collect())
    assert found == [
        (0, 2000, "revisit", 3), (1, 0, "response", None), (2, 2000, "revisit", 3), (3, 2000, "response", None),
        (3, 2000, "response", None), (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None)]
    some = warc.read_archives(index.filter("page_id = 5")).collect()
    assert [bytes(r["payload"]) for r in some] == [b"small"]
    texts = main_text.main_text(pages).collect()
    assert len(texts) == 8 and {r["text"] for r in texts if r["page_id"] == 1} == {""}
    nothing = pages.filter("false")
    assert warc.read_archives(warc.write_archives(nothing)).collect() == []
    assert main_text.main_text(nothing).collect() == []
