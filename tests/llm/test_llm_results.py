"""Results against brute force, exact round trips and held-out accuracy."""

import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from cohortlift.llm import (
    components, decontamination, line_dedup, main_text, packing, quality, shared, simhash, tokens, wavelet)
from cohortlift.llm.queries import oracle_sql, queries, tokenizer_path

SMALL = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.1"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def classes(values, near):
    up = list(range(len(values)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_match_sql(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(SMALL):
        duck.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SMALL}/{file}'")
    cursor = duck.execute(oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    expected = sorted(map(str, cursor.fetchall()))
    assert sorted(str(tuple(r[c] for c in names)) for r in queries()[name](spark, SMALL).collect()) == expected


def test_simhash_matches_brute_force(spark):
    found = sorted(queries()["op1_simhash"](spark, SMALL).collect(), key=lambda r: r["doc_id"])
    values = [int(r["fingerprint"], 16) for r in found]
    roots = classes(values, lambda a, b: (a ^ b).bit_count() <= 4)
    assert [r["component_id"] for r in found] == [found[k]["doc_id"] for k in roots]


def test_fingerprints_match_brute_force(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())
    for r in queries()["op1_simhash"](spark, SMALL).collect():
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r["doc_id"]] or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
        bits = [2 * sum(h >> b & 1 for h in hashes) > len(hashes) for b in range(64)]
        assert r["fingerprint"] == f"{sum(1 << b for b, on in enumerate(bits) if on):016x}"


@pytest.mark.parametrize("distance, confirm, most", [(4, None, 65536), (4, None, 40), (9, 14, 65536)])
def test_links_of_a_dense_cloud(spark, distance, confirm, most):
    rng = random.Random(distance + most)
    centre, rows = rng.getrandbits(64), set()
    while len(rows) < 400:
        value = centre if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 6)):
            value ^= 1 << rng.randrange(64)
        rows.add(value)
    rows = sorted(rows)
    signed = np.array(rows, np.uint64).view(np.int64).tolist()
    prints = spark.createDataFrame([(v, v) for v in signed], "fp bigint, fp2 bigint")
    n, together = simhash.bit_statistics(prints)
    edges = simhash.links(prints, simhash.plan(n, together, distance), distance, confirm, most)
    roots = {r["node"]: r["root"] for r in components.components(
        edges.selectExpr("fp_a AS a", "fp_b AS b")).collect()}
    expected = classes(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= distance)
    own = {}
    for value, root in zip(signed, expected):
        own.setdefault(root, set()).add(roots.get(value, value))
    assert all(len(s) == 1 for s in own.values()) and len({min(s) for s in own.values()}) == len(own)


def test_thresholds_satisfy_the_pigeonhole():
    rng = np.random.default_rng(1)
    bits = (rng.random((3000, 64)) < 0.5).astype(float)
    for distance in range(0, 13):
        for n in (3000, 10**7, 10**9):
            parts = simhash.plan(n, bits.T @ bits * (n / 3000), distance)
            assert sorted(b for p, _ in parts for b in p) == list(range(64))
            assert sum(t for _, t in parts) == distance - len(parts) + 1


def test_pieces_give_the_tokenizers_ids():
    own, whole = tokens.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    whole.encode_special_tokens = True
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab 1.'\n\t é\x1d<|>\r,!\0") for _ in range(rng.randint(0, 15))) for _ in range(3000)]
    texts += ["<|endoftext|> then, <|endoftext|>", "don't. it's", "x" * 3000, " lead", "trail "]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_shard_lookups(tmp_path):
    from cohortlift.llm.files import write_file

    ids = np.random.default_rng(0).integers(0, 300, 200_000).astype(np.uint16) ** 2 % 50_257
    shard = wavelet.Shard(write_file(str(tmp_path), ".wvlt", wavelet.build(
        ids, np.array([150_000, 50_000]), [1, None], 16)))
    assert np.array_equal(shard.decode(), ids)
    assert [shard.access(i) for i in (0, 65_535, 65_536, 199_999)] == ids[[0, 65_535, 65_536, 199_999]].tolist()
    token = int(ids[77])
    places = np.flatnonzero(ids == token)
    assert shard.count(token) == len(places) and shard.rank(token, 100_000) == (ids[:100_000] == token).sum()
    assert [shard.select(token, k) for k in (0, 5, len(places) - 1)] == places[[0, 5, -1]].tolist()
    assert shard.count(50_000 if 50_000 not in ids else 1 << 20) == 0
    assert shard.documents()[1] == [1, None]


def encoded(folder, end):
    whole = Tokenizer.from_file(tokenizer_path())
    whole.encode_special_tokens = True
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()
    return {i: np.array([*whole.encode(t, add_special_tokens=False).ids, end], "<u4") for i, t in rows}


def test_token_shards_round_trip(spark):
    place, expected = 0, []
    for i, ids in encoded(SMALL, 0).items():
        expected.append((i, place, len(ids), zlib.crc32(ids.tobytes())))
        place += len(ids)
    found = queries()["op8_token_shards"](spark, SMALL).collect()
    assert sorted(tuple(r) for r in found) == expected


def test_packing(spark):
    ids, sequences, covered = encoded(SMALL, 1), {}, {}
    for r in queries()["op3_packing"](spark, SMALL).collect():
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"]:r["start"] + r["length"]].tobytes())
        covered.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(covered) == set(ids)
    for parts, total in [(p, len(ids[i])) for i, p in covered.items()] + [(p, None) for p in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == total if total is not None else at == 2048 or at & (at - 1) == 0


def test_hilbert_neighbours_touch():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    walk = grid[np.argsort(packing.hilbert_keys(grid, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_repeated_passages_go(spark):
    rng = random.Random(2)
    line = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n)) + "."
    passage = [line(14) for _ in range(4)]
    one = line(60)
    texts = ["\n".join([line(9), *passage, line(8)]), "\n".join([line(30), *passage]), "\n".join([one, line(5)]),
             line(9) + " " + " ".join(passage) + " " + line(7), one, "\n".join([line(6), one, line(6), one]),
             "\n".join([line(20) for _ in range(5)])]
    found = {r["doc_id"]: r for r in line_dedup.without_repeats(docs(spark, texts)).collect()}
    assert [found[i]["removed_words"] for i in range(7)] == [0, 56, 0, 56, 60, 120, 0]
    for i, r in found.items():      # what goes stands, word for word, earlier or earlier in the text
        for gone in r["removed"]:
            before = "\n".join(texts[:i]) + "\n" + texts[i]
            assert " ".join(gone.split()) in " ".join(before.split())
    assert found[0]["text"] == texts[0] and found[6]["text"] == texts[6]


@pytest.mark.parametrize("seed", range(3))
def test_no_window_stands_twice(spark, seed):
    """Every window that stands earlier is gone from later places, and nothing else goes."""
    rng = random.Random(seed)
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 3, 14, 14, 20, 41]))) for _ in range(25)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9))) for _ in range(80)]
    # The first text shares one line only; the passage is in the two others.
    one, *rest = [" ".join(f"p{k}x{i}" for i in range(14)) for k in range(3)]
    texts += [one, "\n".join([one, *rest]), "\n".join(["before", one, *rest, "after"])]
    found = {r["doc_id"]: r for r in line_dedup.without_repeats(docs(spark, texts)).collect()}
    earlier, deleted = set(), []
    split = [line_dedup.cut(t) for t in texts]

    def window(cut, i):
        total, j = 0, i
        while j < len(cut) and total < 40:
            total, j = total + len(cut[j].split()), j + 1
        return (tuple(line.strip() for line in cut[i:j]), j) if total >= 40 else (None, j)

    for d, cut in enumerate(split):
        must, left = set(), found[d]["text"].split("\n")
        for i in range(len(cut)):
            own, j = window(cut, i)
            if own is not None:
                if own in earlier:
                    must.update(range(i, j))
                earlier.add(own)
        deleted.append(must)
        kept = [line.strip() for k, line in enumerate(cut) if k not in must]
        rest_of = iter(kept)        # what is left is a part of what may stay, in order
        assert all(any(x == y for y in rest_of) for x in left if x)
        for gone in found[d]["removed"]:
            own = [line.strip() for line in line_dedup.cut(gone)]
            assert sum(len(x.split()) for x in own) >= 40
    assert deleted[82] == {1, 2, 3} and found[82]["removed_words"] == 42 and found[81]["removed_words"] == 0


def test_selected_lines_match_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        hashes, words = rng.integers(0, 6, n).astype(np.uint64), rng.integers(0, 20, n)
        found, spans = line_dedup.grams(hashes, words, 12)
        ends, expected = np.concatenate([[0], np.cumsum(words)]), set()
        for i in range(n):
            stop = int(np.searchsorted(ends, ends[i] + 40))
            inside = [j for j in range(i, min(stop, n)) if stop <= n and spans[j] and j + spans[j] <= stop]
            if inside:
                expected.add(min(inside, key=lambda j: (int(found[j]), j)))
        assert line_dedup.selected(hashes, words, 40, 12).tolist() == sorted(expected)


def test_containment_matches_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    items = [" ".join(word() for _ in range(n)) for n in (3, 5, 9, 17, 40, 41, 150, 400)]
    texts = []
    for item in items * 3:
        kept = [w for w in item.split() if rng.random() > 0.02]
        around = [word() for _ in range(rng.choice([0, 50, 900]))]
        at = rng.randrange(len(around) + 1)
        texts.append(" ".join(around[:at] + kept + around[at:]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    expected = []
    for d, text in enumerate(texts):
        own = set(decontamination.shingles(text))
        for i, item in enumerate(items):
            parts = set(decontamination.shingles(item))
            if len(parts & own) / len(parts) >= 0.8:
                expected.append((d, i))
    for at_once in (10**6, 100):    # in one block of items, and in several
        found = decontamination.contaminated(docs(spark, texts), bench, at_once=at_once).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in found) == sorted(expected)


def test_main_text_of_structures(spark):
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header>
      <nav><ul><li>Home</li></ul></nav><div class="cookie-notice">Accept</div><article><header><h1>Head &amp; line</h1>
      </header><p>One<br>two   &eacute;</p><aside>Side</aside><p>Three <b>bold</b> x&lt;y</p><div class="comments"><p>Nice!</p>
      </div><form><input>Send</form></article><div class="sidebar">Links</div><footer>&copy; 1</footer><script>var a="</p>";"""
    found = main_text.main_text(spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string"))
    assert found.first()["text"] == "Head & line\n\nOne two é\n\nThree bold x<y"


def test_differencing_of_pages_without_an_article(spark):
    page = lambda a: f"<body><p>Welcome to our site</p><p>{a} one two three four five six</p><p>All rights</p></body>"
    rows = [(i, f"https://h.org/a/{i}", page(f"text{i}")) for i in range(5)] + [(9, "https://lone.org/x", page("alone"))]
    found = {r["page_id"]: r["text"] for r in main_text.main_text(
        spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(found[i] == f"text{i} one two three four five six" for i in range(5))
    assert found[9].startswith("Welcome")     # nothing to compare it with


def test_common_lines_of_very_long_pages():
    """100,000 lines out of four a page: a lower bound by matching line for line, and in order."""
    rng = random.Random(5)
    own, other = ([rng.randrange(4) for _ in range(100_000)] for _ in range(2))
    began = time.process_time()
    found = sorted(main_text.common_lines(own, other))
    assert time.process_time() - began < 60     # 5.5 s where this was written
    rest = iter(other)
    assert all(own[i] in rest for i in found)
    assert len(found) == main_text._common_lengths(own, other)[-1] >= sum(x == y for x, y in zip(own, other))


def test_differencing_of_very_long_pages(spark):
    cells = lambda n: "".join(f"<td>{k % 3}</td>" for k in range(n))
    page = lambda a, n: f"<body><p>Welcome</p><table>{cells(n)}</table><p>{' '.join(a * 40000)}</p></body>"
    rows = [(1, "https://h.org/a/1", page(["one"], 20_000)), (2, "https://h.org/a/2", page(["two"], 19_999))]
    found = {r["page_id"]: r["text"] for r in main_text.main_text(
        spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found[2] == " ".join(["two"] * 40000)
    assert found[1] in {"\n\n".join([cell, " ".join(["one"] * 40000)]) for cell in "012"}


@pytest.mark.parametrize("pairs", [main_text.PAIRS_A_LINE, 0])
def test_common_lines_match_dynamic_programming(pairs, monkeypatch):
    monkeypatch.setattr(main_text, "PAIRS_A_LINE", pairs)
    monkeypatch.setattr(main_text, "KEPT_MASKS", 2)
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = sorted(main_text.common_lines(a, b))
        assert len(found) == best[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def test_priors_of_mixtures_are_found():
    texts, labels = duckdb.sql(f"""SELECT list(text), list(quality) FROM '{MORE}/documents.parquet'
        JOIN '{MORE}/labels.parquet' USING (doc_id) WHERE quality IS NOT NULL""").fetchall()[0]
    values, rng = np.array([quality.features(t or "") for t in texts]), np.random.default_rng(0)
    good, bad = (values[np.array(labels) == k] for k in (1, 0))
    for n, m in ((140, 560), (560, 560), (1680, 420)):      # no row twice
        web = np.concatenate([rng.permutation(good[::2])[:n], rng.permutation(bad)[:m]])
        rng.shuffle(web)
        assert abs(quality.cross_estimated_prior(good[1::2], web) - n / (n + m)) <= 0.05


def test_features_read_whole_texts():
    """A word that only the end of a text repeats counts like one at its start."""
    start = " ".join(["again"] * 3000 + [f"w{i}" for i in range(4000)])
    end = " ".join([f"w{i}" for i in range(4000)] + ["again"] * 3000)
    assert quality.features(start) == pytest.approx(quality.features(end))


@pytest.mark.parametrize("name, label, least", [("op6_quality", "quality", 0.97), ("op9_toxicity", "toxic", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{MORE}/labels.parquet'").fetchall())
    rows = queries()[name](spark, MORE).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= least


def test_pipeline_stages(spark):
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SMALL)
        kept = spark.createDataFrame(kept.toPandas(), schema=source.schema)
        assert kept.columns == source.columns and kept.count() <= before.count()
    packed = corpus_pipeline.run(spark, SMALL)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in kept.collect()}


def test_pipeline_of_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and an empty table go through every stage."""
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    passage = " ".join(f"w{i}" for i in range(60)) + "."
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, passage, "en", "s", 1), (3, passage, "en", "s", 1),
            (4, passage + " more", "de", None, 2), (None, passage, "en", "s", 3), (None, None, None, None, None),
            (5, "long words here, " * 20_000, "fr", "s", 4)]
    for docs_ in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        kept = docs_
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, kept, SMALL).collect()
            assert len(found) <= kept.count(), name
            kept = spark.createDataFrame(found, schema)
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL).collect()
        assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in kept.collect()}


def test_differencing_decides_inside_articles(spark):
    # Pages 1 and 2 have the site's line in their article, the other pages have it in a menu.
    def page(text, line, menu=""):
        return f"<nav>{menu}</nav><article><p>{text}</p><div>{line}</div><p>Both pages say this.</p></article>"

    site, own = "More from our desk", "A word of its own"
    texts = ["one two three four five six seven eight nine ten", "entirely other words in this article of the host here"]
    html = [page(texts[0], site), page(texts[1], site), *(page(f"{w} " * 12, own, site) for w in ("three", "four", "five"))]
    found = {r["page_id"]: r["text"] for r in main_text.main_text(spark.createDataFrame(
        [(k, f"http://a.org/p{k}", h) for k, h in enumerate(html, 1)], "page_id bigint, url string, html string")).collect()}
    for k in (1, 2):     # the shared paragraph is article text, the line in a container is the site's
        assert found[k] == f"{texts[k - 1]}\n\nBoth pages say this."
    assert found[3] == f"{'three ' * 12}".strip() + f"\n\n{own}\n\nBoth pages say this."


def test_a_copy_does_not_end_differencing(spark):
    page = "<div>Site name and slogan</div><p>{}</p>"
    bodies = ["a b c d e f g h i j k l"] * 2 + ["m n o p q r s t u v w x"]
    found = {r["page_id"]: r["text"] for r in main_text.main_text(spark.createDataFrame(
        [(k, f"http://a.org/{k}", page.format(b)) for k, b in enumerate(bodies, 1)],
        "page_id bigint, url string, html string")).collect()}
    assert found[2] == bodies[1] and found[3] == bodies[2]


def test_forgetting_keeps_ids_and_what_is_met_again():
    own, whole = tokens.Encoder(tokenizer_path(), remembered=60), Tokenizer.from_file(tokenizer_path())
    whole.encode_special_tokens = True
    rng = random.Random(8)
    for turn in range(20):
        texts = [f"the house\nstands. {rng.random()}, " + " ".join(rng.choice("abc,.") * rng.randint(1, 9) for _ in range(9))
                 for _ in range(5)]
        for text, ids in zip(texts, own.encode(texts)):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
        assert not turn or {"house", "\nstands."} <= own.slots.keys()


def test_portions_hold_little_text():
    texts = ["a" * 30, "", "b" * 90, None, "c" * 20, "d" * 25]
    cut = [b.column("text").to_pylist() for b in shared.portions(
        iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}).slice(0, 0),
              pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})]), "text", 50)]
    assert cut == [texts[:2], [texts[2]], texts[3:]]


def test_pieces_fill_sequences():
    rng = random.Random(2)
    for total_docs in (1, 3, 20):
        lengths = np.array([rng.randint(1, 40) for _ in range(total_docs)])
        first, total = np.cumsum(lengths) - lengths, int(lengths.sum())
        source, start, length, number, offset = packing.Sequences(total, 16).pieces(first, lengths)
        held = [(n, o + k) for n, o, m in zip(number.tolist(), offset.tolist(), length.tolist()) for k in range(m)]
        sizes = [16] * (total // 16) + [1 << b for b in (3, 2, 1, 0) if total >> b & 1]
        assert held == [(n, o) for n, size in enumerate(sizes) for o in range(size)]
        assert [k for k, m in zip(source.tolist(), length.tolist()) for _ in range(m)] == np.repeat(
            np.arange(total_docs), lengths).tolist()
        assert (start[np.flatnonzero(np.diff(source, prepend=-1))] == 0).all()


def test_words_are_learned_apart_from_their_points_and_asked_for_once(monkeypatch):
    """Texts of every kind at once; words that come often cost one look-up, however many points follow."""
    own, whole = tokens.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    whole.encode_special_tokens = True
    texts = ["Home garden, garden. garden!! été, été. \u01c0\u01c0, \u0251b, x1. 7, 7", " garden,\tété", "", "a\x1d b",
             "garden\ngarden, été", "e\u0301te\u0301, \u0120garden \u010a.", None] * 50
    texts = [text or "" for text in texts]
    asked = []
    slots = own._slots
    monkeypatch.setattr(own, "_slots", lambda words: asked.extend(words.to_pylist()) or slots(words))
    for kind in (list, pa.array):
        for text, ids in zip(texts, own.encode(kind(texts))):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(asked) == 2 * len(set(asked))
    assert {"garden", "été"} <= own.slots.keys() and not {"garden,", "garden.", "garden!!", "été,"} & own.slots.keys()
