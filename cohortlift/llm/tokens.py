"""Token ids of whole texts by the ``tokenizers`` library.

A byte-level tokenizer never joins across the place where white space follows
a visible character, so a text is cut there, each different piece is encoded
once per worker and its ids are looked up afterwards. The ids are those of
encoding the text whole.

Most texts have single spaces and line feeds between words and nothing else.
These are split at spaces by Arrow, which is much faster; a word then stands
for itself after a space, and a line's first word has its line feed in front.
Python sees each different word of a portion once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from cohortlift.llm.shared import text_of

PIECE = re.compile(r"\s*\S+|\s+")
# White space to Python but not to the tokenizer: such texts are encoded whole.
ODD = re.compile("[\x1c-\x1f]")
SPACES = "\t\r\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# What a text split at spaces does not have, for Arrow: other spaces, two in a row, one at either end.
NOT_SINGLE = f"[\0{SPACES}]|[ \n][ \n]|^[ \n]|[ \n]$|^$"
POINTS = ".,;:!?*%&#$|)"   # after a letter these are a token of their own, or several
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"   # letters to every Unicode version
FIRST = "\0"   # marks a text's first word, which has no space in front
REMEMBERED = 600_000      # pieces a worker keeps, about 100 MB
ROW = 256                 # pieces encoded together
AT_ONCE = 4 << 20         # bytes of text to encode at once: the more, the fewer times a word is looked up

_encoders: dict[str, Encoder] = {}


def pieces(text: str) -> list[str] | None:
    """Words and the white space before them, of any text; None if it must be encoded whole.

    All are marked ``FIRST``, as they have their white space with them.
    """
    if "\0" in text or ODD.search(text):
        return None
    return [FIRST + piece for piece in PIECE.findall(text)]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of all texts, where each text's words begin, and how many it has; -1 if it must be encoded whole.

    A word from a split at spaces stands for " " + word, unless it begins with
    a line feed or with ``FIRST``.
    """
    texts = texts.cast(pa.large_string())
    other = pc.match_substring_regex(texts, NOT_SINGLE).to_numpy(zero_copy_only=False)
    plain = texts.filter(pa.array(~other)) if other.any() else texts
    lists = pc.split_pattern(pc.binary_join_element_wise(
        pa.scalar(FIRST, pa.large_string()), pc.replace_substring(plain, "\n", " \n"), pa.scalar("", pa.large_string())), " ")
    words, counts = lists.flatten(), np.zeros(len(texts), np.int64)
    counts[~other] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    begins = np.zeros(len(texts), np.int64)
    begins[~other] = np.cumsum(counts[~other]) - counts[~other]
    if other.any():
        cut = [pieces(text) for text in texts.filter(pa.array(other)).to_pylist()]
        sizes = np.array([-1 if c is None else len(c) for c in cut], np.int64)
        counts[other], real = sizes, np.maximum(sizes, 0)
        begins[other] = len(words) + np.cumsum(real) - real
        words = pa.concat_arrays([words, pa.array(chain.from_iterable(c for c in cut if c), pa.large_string())])
    return words, begins, counts


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every stretch, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def _spelled() -> dict[int, str]:
    """How a byte-level vocabulary spells each byte: visible characters stand for themselves."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [byte for byte in range(256) if byte not in seen]
    return {byte: chr(byte) for byte in seen} | {byte: chr(256 + k) for k, byte in enumerate(rest)}


SPELLED = _spelled()


def _flat(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


class Encoder:
    """Encodes texts; remembers the ids of pieces seen before.

    Of the pieces remembered, those go first that were not met again in a
    later portion of texts than the one they were learned in.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        # A task has one core; threads of the tokenizer's own would hold
        # memory and cores that other tasks count on.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        spelled = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(size, np.int64)     # byte-level: one character a byte
        for token, number in spelled.items():
            self.bytes_of[number] = len(token)
        self.remembered = remembered
        self.slots: dict[str, int] = {}      # piece to slot, in the order of slots
        self.ids = np.zeros(1 << 16, self.kind)
        self.used = 0
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.again = np.zeros(1 << 16, bool)
        self._put([""], self.ids[:0], np.zeros(1, np.int64))     # slot 0: what a piece without points has for them
        # For runs of words of letters, spelled as in the vocabulary: the same model, but no search for words.
        self.by_space = Tokenizer.from_file(path)
        self.by_space.encode_special_tokens = True
        self.by_space.pre_tokenizer = pre_tokenizers.Split(SPELLED[ord(" ")], "merged_with_next")

    def _room(self, slots: int, ids: int) -> None:
        while self.used + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while slots > len(self.starts):
            for name in ("starts", "lengths", "again"):
                held = getattr(self, name)
                setattr(self, name, np.concatenate([held, np.zeros_like(held)]))

    def _put(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Give the next slots to pieces with these ids."""
        first = len(self.slots)
        self._room(first + len(pieces), len(ids))
        self.slots.update(zip(pieces, range(first, first + len(pieces))))
        self.ids[self.used:self.used + len(ids)] = ids
        self.starts[first:len(self.slots)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first:len(self.slots)] = lengths
        self.used += len(ids)

    def _trim(self) -> None:
        """Keep the pieces met again, half of what may be remembered at most."""
        self.again[0] = True
        keep = np.flatnonzero(self.again[:len(self.slots)])[:self.remembered // 2]
        ids, lengths, names = self._gathered(keep), self.lengths[keep], list(self.slots)
        names = list(map(names.__getitem__, keep.tolist()))
        self.slots, self.used = {}, 0
        self.again[:] = False
        self._put(names, ids, lengths)

    def _places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))

    def _encode_new(self, pieces: list[str]) -> None:
        """Pieces that follow a space or begin a line are encoded in rows.

        Joined pieces keep their ids, as the tokenizer cuts before such white
        space anyway; lengths in bytes tell which ids belong to which piece.
        """
        bare = pc.match_substring_regex(pa.array(pieces, pa.large_string()), f"^[{LETTER}]+$")
        letters, spaced, lined, loose = [], [], [], []
        for piece, plain in zip(pieces, bare.to_numpy(zero_copy_only=False).tolist()):
            (letters if plain else loose if piece[0] == FIRST else lined if piece[0] == "\n" else spaced).append(piece)
        for group, mark in ((letters, " "), (spaced, " "), (lined, "\n")):
            if not group:
                continue
            before = " " if mark == " " else ""
            rows = [before + before.join(group[k:k + ROW]) for k in range(0, len(group), ROW)]
            if group is letters:
                spelled = [row.encode().decode("latin-1").translate(SPELLED) for row in rows]
                ids = _flat(self._encoded(spelled, self.by_space), self.kind)
            else:
                ids = _flat(self._encoded(rows, self.tokenizer), self.kind)
            text = np.frombuffer("".join(rows).encode(), np.uint8)
            ends = np.append(np.flatnonzero(text == ord(mark))[1:], len(text))
            stops = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
            self._put(group, ids, np.diff(stops, prepend=0))
        found = self._encoded([piece[1:] for piece in loose], self.tokenizer)
        self._put(loose, _flat(found, self.kind), np.fromiter(map(len, found), np.int64, len(found)))

    def _encoded(self, texts: list[str], tokenizer: Tokenizer) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _gathered(self, slots: np.ndarray) -> np.ndarray:
        return self.ids[ragged(self.starts[slots], self.lengths[slots])]

    def _slots(self, words: pa.Array) -> np.ndarray:
        """Two slots for each word: its stem's and that of the points after it. What is new is learned."""
        stems = pc.utf8_rtrim(words, POINTS)
        pointed = pc.and_(pc.not_equal(stems, words), pc.match_substring_regex(stems, f"[{LETTER}]$"))
        pointed = pc.and_not(pointed, pc.starts_with(words, "\n"))     # beginnings of lines are few, and kept whole
        at = np.flatnonzero(pointed.to_numpy(zero_copy_only=False))
        # to_numpy and tolist make strings faster than to_pylist
        names = pc.if_else(pointed, stems, words).to_numpy(zero_copy_only=False).tolist()
        whole = words.take(pa.array(at)).to_numpy(zero_copy_only=False).tolist()
        names += [FIRST + word[len(names[k]):] for k, word in zip(at.tolist(), whole)]
        known = len(self.slots)
        found = np.fromiter(map(self.slots.get, names, repeat(known)), np.int64, len(names))
        self.again[found[found < known]] = True
        unknown = np.flatnonzero(found == known)
        if len(unknown):
            fresh = list(map(names.__getitem__, unknown.tolist()))
            self._encode_new(list(dict.fromkeys(fresh)))
            found[unknown] = self._places(fresh)
        out = np.zeros((len(words), 2), np.int64)
        out[:, 0], out[at, 1] = found[:len(words)], found[len(words):]
        return out

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        if len(self.slots) > self.remembered:
            self._trim()
        words, begins, counts = split(texts)
        coded = words.dictionary_encode()
        slots = self._slots(coded.dictionary)
        # The different words' ids, the points' after the stem's, then those of all words.
        lengths, ids = self.lengths[slots].sum(axis=1), self._gathered(slots.ravel())
        each = coded.indices.to_numpy()
        ids = ids[ragged((np.cumsum(lengths) - lengths)[each], lengths[each])]
        ends = np.concatenate([[0], np.cumsum(lengths[each])])
        out = [ids[a:b] for a, b in zip(ends[begins].tolist(), ends[begins + np.maximum(counts, 0)].tolist())]
        for k in np.flatnonzero(counts < 0).tolist():
            whole = self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False)
            out[k] = np.array(whole.ids, self.kind)
        return out


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def little_endian(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def rows_to_encode(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))


def record_batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
