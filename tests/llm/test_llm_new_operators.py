"""URL filters, filter audit and vector codes against brute force, and their edge cases."""

import math
import random
from itertools import permutations

import numpy as np
import pytest

from cohortlift.llm import filter_audit, url_filters, vector_codes
from cohortlift.llm.shared import ship

PAGES = "page_id bigint, url string, host int, path int, rule int, verdict int, best int, short int, html string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, 1, 2, 3, 4, 5, 6, "h") for i, u in urls], PAGES)


def rules(spark, rows):
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def verdict(url, rows):
    rest = (url or "").partition("://")[2]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:end], rest[end:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[:min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rows
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_verdicts_match_brute_force(spark):
    rng = random.Random(4)
    labels, chars = ["a", "b", "org", "", "Ä", "com"], "/ab1?#.x"
    make = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    urls = ["".join([rng.choice(["http://", "x", "://", "HTTP://"]), rng.choice([str.upper, str])(make(rng.randint(1, 4))),
                     "".join(rng.choices(chars, k=rng.randint(0, 6)))]) for _ in range(1500)]
    urls += [None, "", "http://", "a://b://org/x", "http://org:80/a", "http://user@org/a", "http://a\nb.org/\nx",
             "http://h.org/" + "a" * 300_000, "http://" + "a." * 3000 + "org/b"]
    urls += ["http://hot.org/a"] * 1000
    listed = [(make(rng.randint(1, 3)), "/" * rng.randint(0, 1) + "".join(rng.choices("ab/1", k=rng.randint(0, 3))),
               rng.choice(["allow", "block"])) for _ in range(150)]
    listed = list({(h, p): (h, p, v) for h, p, v in listed}.values())
    for short in (8, 1):        # with one digit, most meetings are not confirmed
        found = url_filters.judged(pages(spark, enumerate(urls)), rules(spark, listed), short=short).collect()
        got = {r["page_id"]: tuple(r)[1:] for r in found}
        assert len(found) == len(urls)
        assert all(got[i] == verdict(u, listed) for i, u in enumerate(urls))


def test_url_edges(spark):
    listed = rules(spark, [("ORG", "/", "allow"), ("org", "/", "block"), (None, "/", "block"), ("com", None, "block"),
                           ("com", "/", None)])
    table = pages(spark, [(None, "http://a.org/"), (None, None), (1, "http://a.com/"), (1, "http://a.com/")])
    found = sorted(map(str, (tuple(r) for r in url_filters.judged(table, listed).collect())))
    assert found == sorted(map(str, [
        (None, "a.org", "/", "org/", "block"), (None, "", "", None, "allow"),
        (1, "a.com", "/", None, "allow"), (1, "a.com", "/", None, "allow")]))
    none = rules(spark, [])
    assert [r["verdict"] for r in url_filters.judged(table, none, default="block").collect()] == ["block"] * 4
    assert url_filters.judged(table.filter("false"), listed).collect() == []


def test_gray_walk_matches_every_subset():
    rng = random.Random(1)
    for n in range(1, 6):
        cells = [(m, (rng.randint(0, 9), rng.randint(0, 9))) for m in range(1 << n) if rng.random() < 0.7]
        found = filter_audit.states(cells, n)
        for chosen in range(1 << n):
            left = [w for m, w in cells if not m & chosen]
            assert found[chosen] == ([sum(w[k] for w in left) for k in (0, 1)] if cells else [])


DOCS = "doc_id bigint, text string, lang string, good int, toxic int, part int, A int, mask int, n int"


def flags_of(text, smaller):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    return (len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text), smaller)


def test_audit_matches_running_every_chain(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choices(["one", "Two", "ünï\x85x", "#", "a\x1cb", "Q"], weights=[9, w, 9, v, 9, w], k=k))
             for w in (0, 1) for v in (0, 0.02) for k in (0, 3, 200, 400)]
    texts += [" ".join(f"w{i}" for i in range(250)), "\t\n", None, "word " * 60_000]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", None, "", "de"])) for _ in range(160)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [None, *range(0, 60, 2), 4, 4, 6]]
    found = filter_audit.audit(
        filter_audit.document_flags(
            spark.createDataFrame([(i, t, la, 1, 1, 5, 6, 7, 8) for i, t, la in docs], DOCS),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")),
        "ABCDE", losses=("good", "toxic")).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found}
    assert len(got) == len(found) == 600 * 3
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for part in ("en", "", "de"):
        own = []
        for i, t, la in docs:
            if (la or "") == part:
                good, toxic = (i is not None and any(x[0] == i and x[k] == 1 for x in labels) for k in (1, 2))
                own.append((flags_of(t or "", i is not None and least[t or ""] < i), good, toxic))
        removed_by, rows = dict.fromkeys(range(5), 0), {}
        for order in permutations(range(5)):
            alive = own
            for step, f in enumerate(order, 1):
                gone = [d for d in alive if d[0][f]]
                redundant = sum(d[0][f] for d in own) - len(gone)
                alive = [d for d in alive if not d[0][f]]
                removed_by[f] += len(gone)
                rows["".join("ABCDE"[k] for k in order), step] = (
                    len(alive), len(gone), redundant, sum(d[0][f] and sum(d[0]) == 1 for d in own),
                    sum(d[1] for d in gone), sum(d[2] for d in gone), f)
        for (order, step), r in rows.items():
            assert got[part, order, step] == (*r[:6], removed_by[r[6]])


def test_audit_edges(spark):
    empty = spark.createDataFrame([], "part string, x boolean, yy boolean, gone boolean")
    assert filter_audit.audit(empty, ["x", "yy"], losses=["gone"]).collect() == []
    two = spark.createDataFrame([(None, None, True, True), (None, True, True, None)], empty.schema)
    found = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["gone_lost"], r["shapley"])
             for r in filter_audit.audit(two, ["x", "yy"], losses=["gone"]).collect()}
    assert found == {("x,yy", 1): (1, 1, 0, 1), ("x,yy", 2): (0, 1, 1, 3),
                     ("yy,x", 1): (0, 2, 1, 3), ("yy,x", 2): (0, 0, 0, 1)}
    with pytest.raises(ValueError):
        filter_audit.audit(two, [f"f{k}" for k in range(8)])


def full_search(rows, parts, entries, rounds, scale=1024):
    """(codes, errors, codebooks) of vectors in the order of their ids."""
    cut = np.floor(np.array(rows, np.float64) * scale).astype(np.int64).reshape(len(rows), parts, -1)
    book = cut[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        far = ((cut.transpose(1, 0, 2)[:, :, None, :] - book[:, None, :, :]) ** 2).sum(axis=3)
        codes = far.argmin(axis=2)
        if turn < rounds:
            for p in range(parts):
                for e in range(book.shape[1]):
                    if (codes[p] == e).any():
                        book[p, e] = cut[codes[p] == e, p].sum(axis=0) // (codes[p] == e).sum()
    return codes.T, far.min(axis=2).sum(axis=0), book


VECTORS = "vec_id bigint, embedding array<float>, label int, id int, codes int, part int, error int, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, 1, 2, 3, 4, 5) for i, v, k in rows], VECTORS)


@pytest.mark.parametrize("spread, entries, rounds", [(0.02, 16, 4), (0.3, 16, 4), (1.0, 40, 2), (0.001, 256, 4)])
def test_codes_match_a_full_search(spark, spread, entries, rounds):
    ship(spark)
    rng = np.random.default_rng(int(spread * 1000))
    centres = rng.normal(size=(12, 8))
    data = (centres[rng.integers(0, 12, 900)] + spread * rng.normal(size=(900, 8))).astype(np.float32)
    data[100:400] = data[100]        # one vector holds a third of all rows
    data[400:450] = np.round(data[400:450])
    found, book = vector_codes.ball_kmeans(
        vectors(spark, [(i, v.tolist(), i % 3 or None) for i, v in enumerate(data)]).repartition(5),
        entries=entries, rounds=rounds)
    codes, errors, expected = full_search(data, 4, entries, rounds)
    rows = sorted(found.collect(), key=lambda r: r["id"])
    assert np.array_equal(book.entries, expected)
    assert [r["codes"] for r in rows] == codes.tolist() and [r["error"] for r in rows] == errors.tolist()
    totals = {}
    for i, e in enumerate(errors.tolist()):
        totals[i % 3] = totals.get(i % 3, 0) + e
    digest = book.sha256()
    for r in vector_codes.coded(vectors(spark, [(i, v.tolist(), i % 3 or None) for i, v in enumerate(data)]),
                                entries=entries, rounds=rounds).collect():
        assert r["code"] == "".join(f"{c:02x}" for c in codes[r["vec_id"]])
        assert (r["label_error"], r["codebooks_sha256"]) == (totals[r["vec_id"] % 3], digest)


def test_balls_prune_separate_clusters():
    rng = np.random.default_rng(2)
    centres = rng.integers(-2**14, 2**14, (64, 4))
    codes = rng.integers(0, 64, 20_000)
    data = (centres[codes] + rng.integers(-40, 40, (20_000, 4))).astype(np.float64)
    book = centres + rng.integers(-5, 5, centres.shape)
    away = ((data - book[codes]) ** 2).sum(axis=1)
    reach = np.array([math.sqrt(away[codes == e].max()) for e in range(64)])
    balls = vector_codes.Balls(book, reach, np.ones(64, bool))
    chosen, best, searched = balls.reassigned(data, codes)
    full = ((data[:, None] - book) ** 2).sum(axis=2)
    assert np.array_equal(chosen, full.argmin(axis=1)) and np.array_equal(best, full.min(axis=1))
    assert searched < 0.05 * full.size
    again = vector_codes.Balls(book, reach, np.zeros(64, bool))
    assert again.settled.all() and again.reassigned(data, chosen)[2] == 0


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, -0.0005, 0.5, 2.0], None), (None, [1.0, 0.0, 0.5, 2.0], 1), (3, [1.0, 0.0, 0.5, 2.0], None),
            (3, [1.0, 0.0, 0.5, 2.0], None), (1, None, 1), (0, [None, 0.0, 0.0, 0.0], 1), (0, [nan, 0.0, 0.0, 0.0], 1),
            (0, [inf, 0.0, 0.0, 0.0], 1), (7, [], 1), (8, [1.0] * 8, 2)]
    found = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"])
                    for r in vector_codes.coded(vectors(spark, rows), entries=2).collect()))
    # By id and vector the entries start as (1, -0.0005, ...) and (1, 0, ...): of equal parts the lower entry wins.
    assert found == [(False, 3, "00000000", 0, 0), (False, 3, "00010000", 0, 0), (False, 3, "00010000", 0, 0),
                     (True, 0, "00010000", 0, 0)]
    nothing = vector_codes.coded(vectors(spark, rows[4:9]))
    assert nothing.collect() == [] and nothing.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        vector_codes.coded(vectors(spark, [(1, [1.0, 2.0, 3.0], 1)]))
    with pytest.raises(Exception, match="no exact distances"):
        vector_codes.coded(vectors(spark, [(1, [1e30, 1.0, 1.0, 1.0], 1)])).collect()
