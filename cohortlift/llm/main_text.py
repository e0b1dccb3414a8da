"""Main text of web pages: page structure first, page differencing for the rest.

A page is cut into blocks. Blocks in an element that says what it is (menus,
footers, forms, comments and the like) go, and where an article is declared,
what lies outside of it. The rest is decided by differencing: the pages of a
host are sorted by URL path, each is aligned with its nearest neighbour by a
longest common subsequence of blocks, and the shared blocks go. Inside a
declared article a shared block goes only if its place and a count over the
host's pages confirm that it is the site's: articles may well share text.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.llm.shared import portions, row_key, stored, text_of
from cohortlift.operators.numbering import number_rows

# Elements and names with a known meaning on web pages.
BLOCKS = frozenset((
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead title tr ul").split())
SKIPPED = frozenset(
    "script style noscript template iframe object svg canvas audio video title textarea select math".split())
RAW = frozenset("script style title textarea".split())   # no tags inside
FURNITURE = frozenset("nav footer aside form menu dialog button search".split())
ARTICLES = frozenset("article main".split())
NESTED = frozenset(
    "article main nav header footer aside form menu dialog button search section div ul ol table "
    "figure blockquote details fieldset span".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NAMES = frozenset((
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright disqus dialog footer gdpr legal login menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promoted promotion recommended related reply replies share "
    "sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets").split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())

# Of an article: PLACED lies in an element for running text, CONTENT directly in a container.
CONTENT, OPEN, FURNISHED, PLACED = 0, 1, 2, 3
RUNNING = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
SAME_PAGE = 0.5   # a neighbour that shares more of a page's open words is a copy of it
PAIRS_A_LINE = 32   # up to so many equal pairs a line are walked one by one
KEPT_MASKS = 256    # places of so many frequent lines are kept while two pages are compared

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?/][^a-zA-Z>]?[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
    r"""|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
CLOSING = re.compile(r"</([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
BLANK = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")


def _status(name: str, attributes: str, above: int) -> int:
    """What the blocks inside an element are, given what is around it."""
    if above == FURNISHED or name in FURNITURE:
        return FURNISHED
    if name == "header":
        return above if above == CONTENT else FURNISHED
    if attributes.strip():
        found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)}
        if ("hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in ROLES
                or "display:none" in found.get("style", "").replace(" ", "")):
            return FURNISHED
        if name not in ARTICLES and name != "body":
            words = set(WORD.findall(f"{found.get('class', '')} {found.get('id', '')}"))
            if words & NAMES:
                return FURNISHED
        if found.get("role") in ("main", "article"):
            return CONTENT
    return CONTENT if name in ARTICLES else above


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, status) of every block with text, in page order."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = [("", OPEN)]
    held: list[str] = []
    inside = ""      # the innermost block element, as far as text has shown

    def close_block() -> None:
        if held:
            text = BLANK.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                status = stack[-1][1]
                out.append((text, PLACED if status == CONTENT and inside in RUNNING else status))
            held.clear()

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at:m.start()])
        at = m.end()
        name = m[1] or m[3]
        if name is None:
            closing = CLOSING.match(m[0])
            name = closing[1].lower() if closing else ""
            if name in BLOCKS:
                close_block()
                inside = ""
            elif name in NESTED and any(n == name for n, _ in stack) and stack[-1][1] == FURNISHED:
                close_block()
            if name in NESTED:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            continue
        name, attributes = name.lower(), m[2] if m[1] else m[4]
        if name == "br":
            held.append(" ")
            continue
        if name in SKIPPED:
            if name in BLOCKS:
                close_block()
            if not attributes.endswith("/") or name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else end
            held.append(" ")
            continue
        if name in BLOCKS:
            close_block()
            inside = name
        if name in NESTED and not attributes.endswith("/"):
            status = _status(name, attributes, stack[-1][1])
            if status != stack[-1][1]:
                close_block()
            stack.append((name, status))
    close_block()
    return out


def _common_of_few(own: list[int], other: list[int], where: dict[int, list[int]]) -> list[int]:
    """Places in ``own`` of a longest common subsequence, by one step per equal pair."""
    ends: list[int] = []                 # smallest end of a common sequence of each length
    tails: list[tuple | None] = []       # (place, previous) of these sequences
    for i, value in enumerate(own):
        for j in reversed(where.get(value, ())):
            k = bisect_left(ends, j)
            node = (i, tails[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                tails.append(node)
            else:
                ends[k], tails[k] = j, node
    found, node = [], tails[-1] if tails else None
    while node is not None:
        found.append(node[0])
        node = node[1]
    return found


def _places(values: list[int]) -> dict[int, list[int]]:
    where: dict[int, list[int]] = {}
    for j, value in enumerate(values):
        where.setdefault(value, []).append(j)
    return where


def _common_lengths(own: list[int], other: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of ``own`` and each beginning of ``other``.

    A row of the usual table is one long integer, with a zero where the length
    grows; a line of ``own`` takes a few operations on it.
    """
    size, where = len(other), _places(other)

    def mask(places: list[int]) -> int:
        ones = np.zeros(size, np.uint8)
        ones[places] = 1
        return int.from_bytes(np.packbits(ones, bitorder="little").tobytes(), "little")

    often = sorted(where, key=lambda value: -len(where[value]))[:KEPT_MASKS]
    kept = {value: mask(where[value]) for value in often}
    whole = (1 << size) - 1
    row = whole
    for value in own:
        if value in where:
            equal = row & (kept[value] if value in kept else mask(where[value]))
            row = ((row + equal) | (row - equal)) & whole
    bits = np.unpackbits(np.frombuffer(row.to_bytes((size + 7) // 8, "little"), np.uint8),
                         bitorder="little", count=size)
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(own: list[int], other: list[int]) -> set[int]:
    """Places in ``own`` that belong to a longest common subsequence with ``other``.

    Where lines repeat so often that equal pairs are many times the lines,
    ``own`` is halved and ``other`` cut where both halves together share most,
    until pairs are few. Memory stays in proportion to the lines, and 64 cells
    of the table are one machine operation: two pages of 100,000 lines out of
    a few take seconds. Which of equally long subsequences is found is left
    open, but the same pages always give the same one.
    """
    found: set[int] = set()
    parts = [(0, len(own), 0, len(other))]
    while parts:
        a, b, c, d = parts.pop()
        while a < b and c < d and own[a] == other[c]:
            found.add(a)
            a, c = a + 1, c + 1
        while a < b and c < d and own[b - 1] == other[d - 1]:
            b, d = b - 1, d - 1
            found.add(b)
        if a == b or c == d:
            continue
        mine, theirs = own[a:b], other[c:d]
        where = _places(theirs)
        pairs = sum(len(where.get(value, ())) for value in mine)
        if pairs <= PAIRS_A_LINE * (len(mine) + len(theirs)) or len(mine) == 1:
            found.update(a + i for i in _common_of_few(mine, theirs, where))
            continue
        half = len(mine) // 2
        shared = _common_lengths(mine[:half], theirs) + _common_lengths(mine[half:][::-1], theirs[::-1])[::-1]
        cut = int(np.argmax(shared))
        parts += [(a, a + half, c, c + cut), (a + half, b, c + cut, d)]
    return found


def _kept(found: list[tuple[str, int]], gone: set[int]) -> list[str]:
    """Texts of the declared article, or of a page that declares none, without the blocks that differencing took."""
    wanted = _wanted([status for _, status in found])
    return [text for i, (text, status) in enumerate(found) if status in wanted and i not in gone]


def _wanted(states: list[int]) -> tuple[int, ...]:
    """The kinds of blocks of which a page's text is made."""
    return (CONTENT, PLACED) if CONTENT in states or PLACED in states else (OPEN,)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every page's block hashes, statuses, and words of the blocks that may be kept."""
    for batch in portions(batches, "html"):
        lines, states, words = [], [], []
        for page in batch.column("html").to_pylist():
            found = blocks(page)
            wanted = _wanted([s for _, s in found])
            lines.append([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, _ in found])
            states.append([s for _, s in found])
            words.append([len(t.split()) if s in wanted else 0 for t, s in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("host"), batch.column("path"), pa.array(lines, pa.list_(pa.int64())),
             pa.array(states, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int32()))],
            names=["key", "host", "path", "lines", "states", "words"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, host, place, line, state) of the kept kind of blocks that a page shares with its nearest neighbour.

    Nearest is the one whose path begins alike for longer. A neighbour that
    shares over half of the words is the same page again and tells nothing, so
    the other one is asked.
    """
    for batch in batches:
        out: dict[str, list] = {name: [] for name in ("key", "host", "place", "line", "state")}
        for row in batch.to_pylist():
            own, words = row["lines"], row["words"]
            near = [(len(commonprefix([row["path"], row[f"path_{side}"]])), row[f"lines_{side}"])
                    for side in ("after", "before") if row[f"lines_{side}"] is not None]
            for _, other in sorted(near, key=lambda n: -n[0]):
                found = common_lines(own, other)
                if sum(words[i] for i in found) > SAME_PAGE * sum(words):
                    continue
                for i in sorted(i for i in found if words[i]):
                    for name, value in zip(out, (row["key"], row["host"], i, own[i], row["states"][i])):
                        out[name].append(value)
                break
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


def shared_blocks(pages: DataFrame) -> DataFrame:
    """(key, shared): the blocks of each page that differencing takes for the site's.

    Every page is aligned with its neighbour by URL. Shared blocks of a page
    that declares no article go. Those inside a declared article are checked:
    one goes if it lies in no paragraph, heading, list item or the like, but
    directly in a container, and if the host's pages mark the same text as
    furniture more often than they have it in articles; else it is article
    text that two pages share, or that an advert quotes.
    """
    profiles = stored(pages.mapInArrow(
        _profiles, "key string, host string, path string, lines array<bigint>, states array<int>, words array<int>"
    ).filter(F.size("lines") > 0).dropDuplicates(["key"]))
    numbered, _ = number_rows(profiles, "host", "path", "key", name="place")
    numbered = stored(numbered)

    def neighbour(side: str, step: int) -> DataFrame:
        return numbered.select((F.col("place") + step).alias("place"), "host", F.col("path").alias(f"path_{side}"),
                               F.col("lines").alias(f"lines_{side}"))

    paired = numbered.join(neighbour("after", -1), ["place", "host"], "left").join(
        neighbour("before", 1), ["place", "host"], "left")
    shared = stored(paired.drop("place").mapInArrow(
        _aligned, "key string, host string, place int, line bigint, state int"))
    marked = profiles.select("host", F.explode(F.arrays_zip("lines", "states")).alias("b")).groupBy(
        "host", F.col("b.lines").alias("line")).agg(
        F.count_if(F.col("b.states") == FURNISHED).alias("furniture"),
        F.count_if(F.col("b.states").isin(CONTENT, PLACED)).alias("declared")).filter("furniture > declared")
    confirmed = shared.filter(F.col("state") == CONTENT).join(marked, ["host", "line"], "left_semi")
    gone = shared.filter(F.col("state") == OPEN).select("key", "place").unionByName(confirmed.select("key", "place"))
    return gone.groupBy("key").agg(F.sort_array(F.collect_list("place")).alias("shared"))   # a page's blocks


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    A null html counts as empty and gives an empty text. Null URLs form one
    host; null page ids are carried along. Repeated rows get the same text. Of
    pages with equal URLs, order is by a hash of id, URL and html. Very long
    pages are read and compared whole (``common_lines``). An empty table gives
    an empty result. Other columns are not read.
    """
    address = F.coalesce("url", F.lit(""))
    rows = pages.select("page_id", "url", text_of("html").alias("html"))
    keyed = rows.withColumns({
        "key": row_key("page_id", "url", "html"),
        "host": F.lower(F.regexp_extract(address, r"^(?:[^:/?#]+:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)),
        "path": F.regexp_extract(address, r"^(?:(?:[^:/?#]+:)?//[^/?#]*)?([^?#]*)", 1)})
    shared = shared_blocks(keyed.select("key", "host", "path", "html"))
    joined = keyed.select("page_id", "url", "html", "key").join(shared, "key", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "html"):
            texts = ["\n\n".join(_kept(blocks(page), set(gone or ())))
                     for page, gone in zip(batch.column("html").to_pylist(), batch.column("shared").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "shared").mapInArrow(
        work, f"page_id {kind}, url string, text string, n_chars bigint")
