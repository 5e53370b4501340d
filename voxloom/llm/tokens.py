"""Encoding with a public tokenizer of the tokenizers library, vectorised over the words of a batch.

The tokenizer lower-cases, drops white space and parts letters, digits and other characters before it merges. Texts are
parted the same way on their bytes in numpy; each distinct word goes to the library's model once and its ids are kept in
a bounded table, found by 64 bits and confirmed by 64 more. A run of characters without white space that holds anything but
printable ASCII and precomposed Latin letters, or an apostrophe, or "<|", is one such word and goes through the whole
library. Single numbers below are those of the tokenizer's word pattern.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np

from voxloom.llm.common import ragged, slices, span_hashes

#: Words kept by each Python worker (about 40 bytes each); the table starts anew when full.
KEPT = 1_000_000
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = _SPACE
_CLASS[ord("'")] = _ODD


class WordTable:
    """Ids of words, each encoded once: its hash finds a word, by a slot or else among the sorted ones, a second hash confirms it.

    A word whose second hash differs from that of the kept word is encoded for itself, so a collision costs time only.
    """

    SLOT_BITS = 21

    def __init__(self, kept: int = KEPT) -> None:
        self.kept = kept
        self._clear()

    def _clear(self) -> None:
        self.known, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and their places below
        self.slots = np.zeros(1 << self.SLOT_BITS, np.int32)
        self.first, self.second, self.starts, self.lengths, self.ids = np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _add(self, encoded: list, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        base = len(self.lengths)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.first, self.second = np.concatenate([self.first, first]), np.concatenate([self.second, second])
        flat = [np.fromiter(chain.from_iterable(encoded), np.uint32, int(lengths.sum()))] if all(type(x) is list for x in encoded) else [np.asarray(x, np.uint32) for x in encoded]
        self.ids = np.concatenate([self.ids, *flat])
        return base + np.arange(len(encoded))

    def lookup(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, encode: Callable[[np.ndarray], list]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words data[start:end], and n + 1 ends; encode gives the ids of the words at the places it is handed."""
        if len(self.known) > self.kept:
            self._clear()
        h, second = span_hashes(data, start, end, both=True)
        slot = (h >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        place = self.slots[slot].astype(np.int64)
        missed = np.flatnonzero((place == 0) | (self.first[place] != h))
        if len(missed):
            distinct, example, which = np.unique(h[missed], return_index=True, return_inverse=True)
            example = missed[example]
            at = np.searchsorted(self.known, distinct)
            fresh = np.ones(len(distinct), bool)
            near = at < len(self.known)
            fresh[near] = self.known[at[near]] != distinct[near]
            if fresh.any():
                places = self._add(encode(example[fresh]), distinct[fresh], second[example[fresh]])
                into = np.searchsorted(self.known, distinct[fresh])
                self.known = np.insert(self.known, into, distinct[fresh])
                self.order = np.insert(self.order, into, places)
                at = np.searchsorted(self.known, distinct)
            self.slots[slot[example]] = self.order[at]
            place[missed] = self.order[at][which]
        other = np.flatnonzero(self.second[place] != second)
        if len(other):
            place[other] = self._add(encode(other), h[other], second[other])
        lengths = self.lengths[place]
        return self.ids[ragged(lengths, self.starts[place])], np.concatenate([[0], np.cumsum(lengths)])


class TextEncoder:
    """Ids of texts; raises ValueError if a sample text shows that the tokenizer works in another way."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in [*range(0x21, 0x7F), *range(0xC0, 0x250)]}
        self.table = WordTable()
        probe = "It's a 12-line probe,\twith\n\nlines: NÉ, Größe... (x)=3.14 日本 é <|endoftext|> we'll"
        if self.tokenizer.encode(probe, add_special_tokens=False).ids != self.encode_texts([probe])[0].tolist():
            raise ValueError("this tokenizer parts or normalises texts in another way")

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [x.encode() for x in texts]
        return self.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows in data, and each row's n + 1 places. A long row is read in steps that end at white space."""
        parts, counts = [np.zeros(0, np.uint32)], np.zeros(len(offsets) - 1, np.int64)
        for lo, hi in slices(offsets):
            a, b = int(offsets[lo]), int(offsets[hi])
            while True:
                c = b
                if b - a > 1 << 21:
                    c = a + (1 << 20)
                    while c < b and _CLASS[data[c]] != _SPACE:
                        c += 1
                starts = np.zeros(1, np.int64) if hi - lo == 1 else offsets[lo:hi] - a
                ids, at = self._block(data[a:c], starts)
                parts.append(ids)
                counts[lo:hi] += np.diff(at)
                if c >= b:
                    break
                a = c
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])

    def _block(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _CLASS[data]
        odd = kind == _ODD
        if len(data) > 1:  # two-byte letters U+00C0 to U+024F, without x, division sign and both dotless forms
            pair = (data[:-1].astype(np.uint16) << 8) | data[1:]
            odd[:-1] |= (pair == 0xC397) | (pair == 0xC3B7) | (pair == 0xC4B0) | (pair == 0xC4B1) | ((pair > 0xC98F) & (pair < 0xCA00)) | (pair == 0x3C7C)
        inside = kind != _SPACE
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first = rows[rows < len(data)]
        begins[first] = inside[first]
        run = np.cumsum(begins, dtype=np.int32) - np.int32(1)
        plain = np.ones(int(begins.sum()) + 1, bool)
        plain[run[odd & inside]] = False
        fine = plain[run]
        part = inside & (kind == _DIGIT)
        part[1:] |= inside[1:] & (kind[1:] != kind[:-1])
        start = np.flatnonzero(begins | (part & fine))
        last = inside.copy()
        last[:-1] &= ~inside[1:] | begins[1:]
        last[start[start > 0] - 1] |= inside[start[start > 0] - 1]
        end = np.flatnonzero(last) + 1
        data = data + np.uint8(32) * ((data >= 65) & (data <= 90) & fine)

        def encode(at: np.ndarray) -> list[list[int]]:
            raw = data.tobytes()
            return [self._word(raw[a:b].decode(), ok) for a, b, ok in zip(start[at].tolist(), end[at].tolist(), fine[start[at]].tolist(), strict=True)]

        ids, ends = self.table.lookup(data, start, end, encode)
        return ids, ends[np.searchsorted(start, np.append(rows, len(data)))]

    def _word(self, word: str, plain: bool) -> list[int]:
        if not plain:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        return [x.id for x in self.model.tokenize(word if word.isascii() else word.lower().translate(self.bytes))]


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One for each Python worker and path."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]
