"""Toxicity by a subsequence string kernel with Nyström landmarks and a linear SVM.

A sentence is a bag of short character windows cut from its words. The kernel
of two windows sums their common subsequences of three characters, each
weighted down by the gaps it spans, so an insult with other characters put in
keeps most of its value. Landmarks are strings from anywhere in the words of
labelled texts; a sentence's kernel values with the landmarks, whitened by the
landmarks' own kernel matrix, are its features, and a linear SVM is trained on
them. A document is scored by the margins of its sentences alone.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.llm.quality import held_out
from cohortlift.llm.shared import text_of
from cohortlift.llm.tokens import ragged

FIT_DOCS = 2_000      # labelled documents of each class to fit on, at most
FIT_SENTENCES = 60_000  # clean sentences to fit on, the hardest ones, at most
THRESHOLD = 0.3
LANDMARKS = 40        # windows from toxic sentences, at most
CLEAN_LANDMARKS = 8  # and common ones from the others
WIDTH = 8             # characters in a window
DECAY = 0.5           # per character that a subsequence spans
POWER = 6             # of the normalised kernel: a kernel again, small for chance likeness
EDGE = " "            # marks where a word begins and ends
CLEAN_SHARE = 0.25    # how often a landmark may be in clean documents, next to toxic ones
SHORTEST = 4          # characters of a landmark
AT_ONCE = 200         # documents
NEW_AT_ONCE = 5_000   # words whose values are computed together
REMEMBERED = 600_000  # words whose values a worker keeps
NOTHING, LETTER, WORDS = 0, 1, 2    # rows of no word, a single letter, and of words from there on
TRIPLES = np.array(list(combinations(range(WIDTH), 3)))   # places of a subsequence
PAIRS = np.array(list(combinations(range(WIDTH), 2)))
PAIR_OF = np.array([PAIRS.tolist().index([a, b]) for a, b, _ in TRIPLES.tolist()])    # of a triple's first two places
SPANNED = (DECAY ** (TRIPLES[:, 2] - TRIPLES[:, 0] + 1)).astype(np.float32)

SENTENCE = re.compile(r"[.!?…\n]+(?=\s|$)|\n")
EDGES = "\"'`´“”‘’«»()[]{}<>,.;:!?…*_~|#%&$^=+-/\\"


_BARE = str.maketrans("", "", EDGES)


def words_of(sentence: str) -> list[str]:
    """Lower-cased words without punctuation; single letters in a row are one word."""
    out: list[str] = []
    spelled: list[str] = []
    for word in sentence.lower().split():
        bare = word.translate(_BARE)
        if len(bare) == 1:
            spelled.append(bare)
            continue
        if len(spelled) > 2:
            out.append("".join(spelled))
        spelled = []
        if bare:
            out.append(bare)
    if len(spelled) > 2:
        out.append("".join(spelled))
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all stretches of ``WIDTH`` characters of words between their edges, and each word's first.

    A word shorter than that is one stretch, filled up with zeros.
    """
    marked = [f"{EDGE}{word}{EDGE}" for word in words]
    sizes = np.array([len(m) for m in marked], np.int64)
    flat = np.concatenate([_codes("".join(marked)), np.zeros(WIDTH, np.int32)])
    counts = np.maximum(sizes - WIDTH + 1, 1)
    firsts = np.cumsum(counts) - counts
    begins = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(words)), counts)
    at = begins[own] + np.arange(len(own)) - firsts[own]
    out = flat[at[:, None] + np.arange(WIDTH)]
    out[np.arange(WIDTH)[None, :] >= sizes[own][:, None]] = 0
    return out, firsts


def _carried(reach: np.ndarray) -> np.ndarray:
    """Sums of all earlier values along the first axis, weighted down by the distance."""
    out = np.zeros_like(reach)
    for i in range(1, WIDTH):
        np.multiply(out[i - 1], np.float32(DECAY), out=out[i])
        out[i] += reach[i - 1]
    return out


def raw_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gap-weighted common subsequences of three characters, row by row."""
    a, b = a.T, b.T
    same = ((a[:, None] == b[None, :]) & (a[:, None] > 0)).astype(np.float32)
    same *= np.float32(DECAY * DECAY)
    reach = same
    for _ in range(2):
        both = _carried(_carried(reach).transpose(1, 0, 2)).transpose(1, 0, 2)
        reach = same * both
    return reach.sum(axis=(0, 1))


class Landmarks:
    """Strings to compare with, as a table from subsequences of three characters to their weights.

    The kernel of two strings is the product of their weights, summed over all
    subsequences, so a string meets every landmark by one look per triple of
    places. Nothing is left out: a triple that no landmark holds adds zero.
    """

    def __init__(self, strings: list[str]):
        self.strings = strings
        codes = np.zeros((len(strings), WIDTH), np.int32)
        for i, string in enumerate(strings):
            codes[i, :len(string)] = _codes(string)
        self.codes = codes
        self.letters = np.unique(codes[codes > 0])
        size = len(self.letters) + 1
        first, second, third = self._triples(codes)
        at, place = np.nonzero((first > 0) & (second > 0) & (third > 0))
        first, second, third = (x[at, place] for x in (first, second, third))
        # Two tables: of two characters to the pair's number, of pair and third character to the triple's.
        self.pairs = np.zeros(size * size, np.int32)
        pair = np.unique(first * size + second)
        self.pairs[pair] = np.arange(1, len(pair) + 1)
        number = self.pairs[first * size + second] * size + third
        triple = np.unique(number)
        self.triples = np.zeros((len(pair) + 1) * size, np.int32)
        self.triples[triple] = np.arange(1, len(triple) + 1)
        weights = np.zeros((len(triple) + 1, len(strings)), np.float32)
        np.add.at(weights, (self.triples[number], at), SPANNED[place])
        weights /= np.maximum(np.sqrt(raw_kernel(codes, codes)), 1e-9)[None, :]
        # Of a triple's weights most are zero: its landmarks and their weights, one triple after another.
        holds, self.which = np.nonzero(weights)
        self.weights = weights[holds, self.which]
        self.held = np.bincount(holds, minlength=len(weights))
        self.begins = np.cumsum(self.held) - self.held
        self.norms: dict[int, np.float32] = {}

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of the characters: from 1 for those of landmarks, 0 for others."""
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at + 1, 0).astype(np.int32)

    def _triples(self, codes: np.ndarray) -> list[np.ndarray]:
        """Numbers of the characters at the three places."""
        letters = self._letters(codes)
        return [letters[:, TRIPLES[:, k]] for k in range(3)]

    def _norms(self, codes: np.ndarray) -> np.ndarray:
        """Each string's kernel with itself, its root: that depends only on which of its characters are alike."""
        alike = (codes[:, :, None] == codes[:, None, :]).argmax(axis=2)
        alike[codes == 0] = WIDTH
        pattern, first, own = np.unique(alike @ (WIDTH + 1) ** np.arange(WIDTH), return_index=True, return_inverse=True)
        pattern = pattern.tolist()
        new = [k for k, p in enumerate(pattern) if p not in self.norms]
        if new:
            some = codes[first[new]]
            self.norms.update(zip([pattern[k] for k in new], np.sqrt(raw_kernel(some, some))))
        return np.array([self.norms[p] for p in pattern], np.float32)[own]

    def values(self, codes: np.ndarray) -> np.ndarray:
        """Normalised kernel of every string with every landmark, to the power of ``POWER``."""
        width = len(self.strings)
        out = np.zeros((len(codes), width), np.float32)
        size = len(self.letters) + 1
        for a in range(0, len(codes), 2_000):
            part = codes[a:a + 2_000]
            letters = self._letters(part)
            pairs = self.pairs[letters[:, PAIRS[:, 0]] * size + letters[:, PAIRS[:, 1]]] * size
            found = self.triples[pairs[:, PAIR_OF] + letters[:, TRIPLES[:, 2]]]
            row, place = np.nonzero(found)
            if not len(row):
                continue
            triple = found[row, place]
            held = self.held[triple]
            entry, row = ragged(self.begins[triple], held), np.repeat(row, held)
            sums = out[a:a + len(part)].reshape(-1)
            np.add.at(sums, row * width + self.which[entry], self.weights[entry] * np.repeat(SPANNED[place], held))
            at = np.flatnonzero(sums)
            some, own = np.unique(at // width, return_inverse=True)
            sums[at] = (sums[at] / self._norms(part[some])[own]) ** POWER
        return out

    def word_values(self, words: list[str]) -> np.ndarray:
        """The largest value over each word's windows."""
        if not words:
            return np.zeros((0, len(self.strings)), np.float32)
        codes, firsts = windows(words)
        return np.maximum.reduceat(self.values(codes), firsts, axis=0)


def strings_in(word: str) -> set[str]:
    """Everything a landmark could be: stretches of a word and its edges, from any place."""
    word = f"{EDGE}{word}{EDGE}"
    return {word[i:i + k] for k in range(SHORTEST, min(len(word), WIDTH) + 1) for i in range(len(word) - k + 1)}


def chosen_landmarks(toxic: Iterable[set[str]], clean: Iterable[set[str]], most: int = LANDMARKS,
                     common: int = CLEAN_LANDMARKS) -> list[str]:
    """Strings that tell toxic documents apart, each for documents the others miss.

    Strings from any place in a word count once per document; greedily the one
    that covers most toxic documents not covered yet and few clean ones. Among
    so many strings some fall on toxic documents by chance alone: a string must
    be in so many of them that not one in a hundred such tables has one like it.
    Each different word is held once, a document as its words' numbers.
    """
    words: dict[str, int] = {}      # those of toxic documents come first
    toxic, clean = ([np.array([words.setdefault(w, len(words)) for w in text], np.int32) for text in texts]
                    for texts in (toxic, clean))
    fewest = max(3, len(toxic) // 100)
    # Strings of too few toxic documents get no number: a small table of sums by hash rules most out.
    sums, numbers = np.zeros(1 << 22, np.int32), {}
    often = np.bincount(np.concatenate([np.zeros(0, np.int32), *toxic]), minlength=len(words)).tolist()
    for word, k in zip(words, often):
        for s in strings_in(word) if k else ():
            sums[hash(s) % len(sums)] += k
    # The numbers of the first word's strings, of the second's and so on, and where they end.
    cut, ends = array("i"), array("q", [0])
    for word, k in zip(words, often):
        if k:
            cut.extend(numbers.setdefault(s, len(numbers)) for s in strings_in(word)
                       if sums[hash(s) % len(sums)] >= fewest)
        else:
            cut.extend(numbers[s] for s in strings_in(word) if s in numbers)
        ends.append(len(cut))
    del words, often, sums
    cut, ends = np.array(cut, np.int32), np.array(ends, np.int64)

    def holds(text: np.ndarray) -> np.ndarray:
        """Numbers of the strings in a text's words."""
        return np.unique(cut[ragged(ends[text], ends[text + 1] - ends[text])])

    in_toxic, in_clean = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    for count, texts in ((in_toxic, toxic), (in_clean, clean)):
        for text in texts:
            count[holds(text)] += 1
    ratio = max(len(toxic), 1) / max(len(clean), 1)
    share = min(max(len(toxic) / max(len(toxic) + len(clean), 1), 1e-9), 1 - 1e-9)
    least = math.log(100 * max(int((in_toxic > 0).sum()), 1))

    def telling(k: int, m: int) -> bool:
        """k toxic and m clean documents: Chernoff's bound on that happening by chance."""
        if k < fewest or m * ratio > CLEAN_SHARE * k:
            return False
        p = k / (k + m)
        gain = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if m else 0.0)
        return (k + m) * gain >= least

    names = list(numbers)
    useful = {i for i in np.flatnonzero(in_toxic >= fewest).tolist() if telling(int(in_toxic[i]), int(in_clean[i]))}
    left: dict[int, set[int]] = {i: set() for i in useful}
    wanted = np.zeros(len(numbers), bool)
    wanted[list(useful)] = True
    for document, text in enumerate(toxic):
        at = holds(text)
        for i in at[wanted[at]].tolist():
            left[i].add(document)
    found: list[str] = []
    # Each document may be covered three times, so that every insult in use is seen.
    seen = Counter()
    while left and len(found) < most:
        best = max(left, key=lambda i: (len(left[i]) - 2 * ratio * in_clean[i], len(names[i]), names[i]))
        if len(left[best]) < max(3, len(toxic) // 200):
            break
        found.append(names[best])
        for document in list(left.pop(best)):
            seen[document] += 1
            if seen[document] == 3:
                for at in left.values():
                    at.discard(document)
        for i in [i for i in left if names[i] in names[best] or names[best] in names[i]]:
            del left[i]
    plain = [i for i in np.lexsort((np.array(names, object), -in_clean)).tolist()
             if len(names[i]) > SHORTEST and in_clean[i]] if names else []
    return found + [names[i] for i in plain[:common]]


class Model:
    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        k = landmarks.values(landmarks.codes).astype(float)
        k = (k + k.T) / 2
        np.fill_diagonal(k, 1.0)
        roots, vectors = np.linalg.eigh(k)
        roots = np.maximum(roots, 0.05)
        self.whiten = vectors @ np.diag(roots ** -0.5) @ vectors.T
        self.weights, self.bias = np.zeros(2 * len(landmarks.strings)), 0.0
        self.curve = np.zeros(3)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}      # tokens as written: their row of the table
        self.rows: dict[str, int] = {}       # bare words: their row
        # Of a row's values most are zero: its landmarks and their values, one row after another.
        self.used, self.entries = WORDS, 0   # rows and entries in use
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.again = np.zeros(1 << 16, bool)     # rows met again in a later portion than they were learned in
        self.which, self.value = np.zeros(1 << 18, np.uint8), np.zeros(1 << 18, np.float16)

    def _put(self, sizes: np.ndarray, which: np.ndarray, value: np.ndarray) -> None:
        """Give the next rows these entries."""
        rows, entries = self.used + len(sizes), self.entries + len(value)
        for end, names in ((rows, ("starts", "sizes", "again")), (entries, ("which", "value"))):
            for name in names:
                held = getattr(self, name)
                if end > len(held):
                    setattr(self, name, np.concatenate([held, np.zeros(max(end, len(held)), held.dtype)]))
        self.starts[self.used:rows] = self.entries + np.cumsum(sizes) - sizes
        self.sizes[self.used:rows] = sizes
        self.which[self.entries:entries], self.value[self.entries:entries] = which, value
        self.used, self.entries = rows, entries

    def _trim(self) -> None:
        """Keep the words met again, as long as they fill half of what may be remembered at most."""
        keep = WORDS + np.flatnonzero(self.again[WORDS:self.used])[:REMEMBERED // 2]
        to = np.full(self.used, -1, np.int64)
        to[:WORDS], to[keep] = np.arange(WORDS), WORDS + np.arange(len(keep))
        known, rows = ({word: k for word, k in zip(held, to[np.fromiter(held.values(), np.int64, len(held))].tolist())
                        if k >= 0} for held in (self.known, self.rows))
        entry, sizes = ragged(self.starts[keep], self.sizes[keep]), self.sizes[keep]
        which, value = self.which[entry], self.value[entry]
        self.forget()
        if len(known) <= REMEMBERED // 2:
            self.known = known
        self.rows = rows
        self._put(sizes, which, value)

    def __getstate__(self):
        held = ("known", "rows", "used", "entries", "starts", "sizes", "again", "which", "value")
        return {k: v for k, v in self.__dict__.items() if k not in held}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def fit(self, toxic: list[np.ndarray], clean: list[np.ndarray], rounds: int = 30, decay: float = 1e-3) -> None:
        """A linear SVM with squared hinge on the whitened values; classes weigh alike.

        Newton steps over the rows inside the margin reach the one optimum. The
        rows come in portions and are never held whitened: margins and sums are
        taken of the values as they are, one portion at a time, and the
        whitening is applied to weights and sums.
        """
        half = len(self.whiten)
        white = np.eye(2 * half + 1)
        white[:half, :half] = white[half:-1, half:-1] = self.whiten
        sides = [(side, y, 0.5 / max(sum(map(len, side)), 1)) for side, y in ((toxic, 1.0), (clean, -1.0))]
        keep = np.full(len(white), decay)
        keep[-1] = 1e-9          # the bias is free
        w = np.zeros(len(white))

        def use(v: np.ndarray) -> None:
            self.weights, self.bias = white[:-1, :-1] @ v[:-1], float(v[-1])

        def loss(v: np.ndarray) -> float:
            use(v)
            return sum(weight * float((np.maximum(1 - y * self.margins(part), 0) ** 2).sum())
                       for side, y, weight in sides for part in side) + float((keep * v * v).sum())

        for _ in range(rounds):
            use(w)
            square, pull = np.zeros((len(w), len(w))), np.zeros(len(w))
            for side, y, weight in sides:
                for part in side:
                    near = part[y * self.margins(part) < 1]
                    near = np.hstack([near, np.ones((len(near), 1))])
                    square += weight * (near.T @ near)
                    pull += weight * y * near.sum(axis=0)
            best = np.linalg.solve(white.T @ square @ white + np.diag(keep), white.T @ pull)
            step, now = 1.0, loss(w)
            while step > 1e-4 and loss(w + step * (best - w)) > now:
                step /= 2
            moved = step * (best - w)
            w = w + moved
            if np.abs(moved).max() < 1e-6:
                break
        use(w)

    def calibrate(self, inputs: np.ndarray, truth: np.ndarray, decay: float = 0.5) -> None:
        """A logistic curve over documents' measures (Platt's targets), by Newton steps."""
        goal = np.where(truth, (truth.sum() + 1) / (truth.sum() + 2), 1 / ((~truth).sum() + 2))
        x = np.hstack([inputs, np.ones((len(inputs), 1))])
        keep, w = np.full(x.shape[1], decay), np.zeros(x.shape[1])
        keep[-1] = 1e-6          # the bias is free
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep)
            moved = np.linalg.solve(slope, x.T @ (p - goal) + keep * w)
            w = w - np.clip(moved, -2, 2)
            if np.abs(moved).max() < 1e-8:
                break
        self.curve = w

    def _row(self, word: str) -> int:
        """Where the table holds a bare word's values; single letters and nothing have rows of their own."""
        return NOTHING if not word else LETTER if len(word) == 1 else self.rows.get(word, -1)

    def _learn(self, tokens: list[str]) -> None:
        """Remember the rows of tokens not met before, and the values of new words."""
        bare = [token if token.isalnum() else token.translate(_BARE) for token in tokens]
        fresh = list(dict.fromkeys(w for w in bare if self._row(w) < 0))
        for a in range(0, len(fresh), NEW_AT_ONCE):
            some = fresh[a:a + NEW_AT_ONCE]
            values = self.landmarks.word_values(some).astype(np.float16)
            row, which = np.nonzero(values)
            self.rows.update(zip(some, range(self.used, self.used + len(some))))
            self._put(np.bincount(row, minlength=len(some)), which, values[row, which])
        self.known.update(zip(tokens, map(self._row, bare)))

    def _found(self, tokens: list[str]) -> np.ndarray:
        row = np.fromiter(map(self.known.get, tokens, repeat(-1)), np.int64, len(tokens))
        unknown = np.flatnonzero(row < 0)
        self.again[row[row >= 0]] = True
        if len(unknown):
            fresh = list(map(tokens.__getitem__, unknown.tolist()))
            self._learn(list(dict.fromkeys(fresh)))
            row[unknown] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        return row

    def sentence_values(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Kernel values of every sentence, and how many sentences each text has.

        Of its words' values with a landmark, the largest and the logarithm of their sum. Sentences without a word are left out. Words
        are those of ``words_of``.
        """
        if len(self.known) > REMEMBERED:
            self._trim()
        half = len(self.landmarks.strings)
        owner, tokens, sizes = [], [], []
        for i, text in enumerate(texts):
            for sentence in SENTENCE.split(text):
                split = sentence.lower().split()
                if split:
                    tokens += split
                    sizes.append(len(split))
                    owner.append(i)
        place = np.repeat(np.arange(len(sizes)), sizes)      # the sentence of each token
        row = self._found(tokens)
        # Single letters in a row of a sentence: the first stands for the word they spell.
        letter = np.concatenate([[False], row == LETTER, [False]])
        same = np.concatenate([[False], place[1:] == place[:-1], [False]])
        begins = np.flatnonzero(letter[1:-1] & ~(letter[:-2] & same[:len(row)]))
        ends = np.flatnonzero(letter[1:-1] & ~(letter[2:] & same[1:len(row) + 1])) + 1
        spelled = [(a, "".join(tokens[a:b]).translate(_BARE)) for a, b in zip(begins.tolist(), ends.tolist()) if b - a > 2]
        if spelled:
            row[[a for a, _ in spelled]] = self._found([word for _, word in spelled])
        told = np.zeros(len(sizes), bool)
        told[place[row >= WORDS]] = True
        out = np.zeros((len(sizes), len(self.weights)), np.float32)
        flat, at = out.reshape(-1), np.flatnonzero(self.sizes[row])    # other words' values are all zero
        for a in range(0, len(at), 10_000):                   # a stretch of words at a time
            part = at[a:a + 10_000]
            held = self.sizes[row[part]]
            entry = ragged(self.starts[row[part]], held)
            to, value = np.repeat(place[part] * (2 * half), held) + self.which[entry], self.value[entry].astype(np.float32)
            np.maximum.at(flat, to, value)
            np.add.at(flat, to + half, value)
        np.log1p(out[:, half:], out=out[:, half:])
        counts = np.bincount(np.array(owner, np.int64)[told], minlength=len(texts))
        return out[told], counts

    def margins(self, values: np.ndarray) -> np.ndarray:
        return values.astype(float) @ self.weights + self.bias     # weights have the whitening in them

    def measures(self, texts: list[str]) -> np.ndarray:
        """Largest sentence margin, and the logarithm of the positive ones' sum.

        -1 and zero for a text without words.
        """
        values, counts = self.sentence_values(texts)
        margins, at = self.margins(values), 0
        out = np.zeros((len(texts), 2))
        out[:, 0] = -1.0
        for i, n in enumerate(counts.tolist()):
            if n:
                own = margins[at:at + n]
                out[i] = own.max(), math.log1p(np.maximum(own, 0).sum())
            at += n
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.measures(texts) @ self.curve[:-1] + self.curve[-1], -30, 30)))


def _keep_hardest(parts: list[np.ndarray], half: int, most: int) -> None:
    """Leave the ``most`` rows that are most like a landmark, those met first among equal ones."""
    likeness = np.concatenate([part[:, :half].max(axis=1) for part in parts])
    keep = np.zeros(len(likeness), bool)
    keep[np.argsort(-likeness, kind="stable")[:most]] = True
    at = 0
    for i, part in enumerate(parts):
        parts[i] = part[keep[at:at + len(part)]]
        at += len(part)


def fitted(toxic: list[str], clean: list[str], sentences: int = FIT_SENTENCES) -> Model | None:
    """A model from labelled texts.

    Which sentences of a toxic text are the toxic ones is found in turns:
    first those that hold a landmark, then those that the model itself ranks
    above its clean sentences, and each text's worst in any case. Of the clean
    sentences, the ``sentences`` most like a landmark take part. Sentences'
    values stay in portions of ``AT_ONCE`` texts and are held once.
    """
    if not toxic or not clean:
        return None
    strings = chosen_landmarks(*((set(words_of(t)) for t in texts) for texts in (toxic, clean)))
    if not strings:
        return None
    model = Model(Landmarks(strings))
    half = len(strings)
    bad, counts = map(list, zip(*(model.sentence_values(toxic[a:a + AT_ONCE]) for a in range(0, len(toxic), AT_ONCE))))
    good: list[np.ndarray] = []
    for a in range(0, len(clean), AT_ONCE):
        good.append(model.sentence_values(clean[a:a + AT_ONCE])[0])
        if sum(map(len, good)) > sentences:
            _keep_hardest(good, half, sentences)
    owner = np.repeat(np.arange(len(toxic)), np.concatenate(counts))
    borders = np.cumsum([len(part) for part in bad])[:-1]
    told = len(strings) - min(CLEAN_LANDMARKS, len(strings))
    rank = np.concatenate([part[:, :told or 2 * half].max(axis=1) for part in bad])
    for turn in range(3):
        level = 0.95 if turn == 0 else 0.0
        top = np.full(len(toxic), -np.inf)
        np.maximum.at(top, owner, rank)
        is_bad = (rank >= level) | (rank >= top[owner])
        model.fit([part[own] for part, own in zip(bad, np.split(is_bad, borders))], good)
        rank = np.concatenate([model.margins(part) for part in bad])
    del bad, good
    measures = np.concatenate([model.measures(texts[a:a + AT_ONCE]) for texts in (toxic, clean)
                               for a in range(0, len(texts), AT_ONCE)])
    model.calibrate(measures, np.arange(len(measures)) < len(toxic))
    model.forget()
    return model


def _sample(rows: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[list[str], list[str]]:
    """Texts labelled 1 and 0, at most ``most`` of each, the same ones whatever the partitioning.

    Ids are chosen before any text is read: the labels meet the ids of the
    documents, and at most twice ``most`` chosen ids are sent to the one pass
    that fetches their texts.
    """
    spark = rows.sparkSession
    marks = labels.filter(F.col(label).isin(0, 1)).select(
        F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).distinct()
    marks = marks.filter(F.col("id").isNotNull() & ~held_out("id")).join(
        rows.select("id").filter("id IS NOT NULL").distinct().hint("merge"), "id", "left_semi")
    chosen = [row for value in (1, 0) for row in
              marks.filter(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(most).collect()]
    if not chosen:
        return [], []
    wanted = F.broadcast(spark.createDataFrame(chosen, marks.schema))    # 2 * most rows at most
    texts = rows.join(wanted, "id").select("id", "label", "text").distinct()
    found = [texts.filter(F.col("label") == value).orderBy(F.xxhash64("id", "text"), "id").limit(most).select(
        "label", "text") for value in (1, 0)]      # an id may have several texts
    table = found[0].unionByName(found[1]).toArrow()
    is_toxic = np.asarray(table["label"]) == 1
    every = table["text"].to_pylist()
    return [t for t, y in zip(every, is_toxic) if y], [t for t, y in zip(every, is_toxic) if not y]


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = FIT_DOCS,
           id_column: str = "doc_id", text_column: str = "text", label: str = "toxic") -> DataFrame:
    """id, held_out, score and predicted of every row.

    Fitted on at most ``most`` labelled documents of each class, chosen by
    hash; held-out rows take no part. Null and empty texts have no sentence
    and are scored as if their only one lay on the clean margin. A null id is scored like any other and is
    not held out. Repeated rows get equal scores. Where a class has no
    labelled row, nothing can be learnt and every score is 0. An empty table
    gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    model = fitted(*_sample(rows, labels, label, most))
    sent = rows.sparkSession.sparkContext.broadcast(model)     # landmarks and weights, a few kilobytes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(a, AT_ONCE)
                texts = part.column("text").to_pylist()
                score = own.score(texts) if own else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("held_out"), pa.array(score),
                     pa.array((score >= threshold).astype(np.int32))],
                    names=[id_column, "held_out", "score", "predicted"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.withColumn("held_out", held_out("id")).select("id", "held_out", "text").mapInArrow(
        work, f"{id_column} {kind}, held_out boolean, score double, predicted int")
