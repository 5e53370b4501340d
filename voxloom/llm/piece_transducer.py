"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three transducers are compiled from the model into tables. The normaliser has a start arc that writes "▁" and arcs that
copy each character, but write "▁" for a space. The piece transducer is a trie over characters with an arc for each
piece, and for a character that no piece holds an arc that writes its UTF-8 bytes as byte pieces. The order of merges is
a transducer over pairs whose states are the pieces: its arc from a to b weighs 0 if merging leaves the two apart, and
is infinite otherwise. Merging leaves all of a sequence of pieces apart exactly if it does so for neighbours, so the
shortest path in the tropical semiring (min, +) through the composition with a text is its encoding.

Whether a pair stays apart is read off the tables: each piece has one last merge, of parts that merged earlier, so the
pieces at the right edge of a and at the left edge of b live for known spans of merge ranks. The pair is broken by two
edge pieces that live together at the rank of the piece that they make.

Composition runs over chunks, spaces with the characters up to the next space, for no piece reaches over the start of
one; that is checked for the model at hand. Each distinct chunk is composed once and its ids are kept in a bounded table.
All new chunks of a block go through the lattice together, a place at a time; the best path ends at one state in each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxloom.llm.common import ragged, slices, small_batches, text_buffers
from voxloom.llm.tokens import WordTable

SPACE = "▁"
#: The normaliser's arcs that do not copy; the start arc writes SPACE.
NORMALISER = {ord(" "): SPACE}
#: Pair arcs kept for chunks that are composed alone: those with more characters than LONG, or with doubled spaces, whose pieces share a score.
KEPT, LONG = 500_000, 256
_NEVER = 1 << 40
_OTHER = -1
_PROBE = "Two  words,\n a\ttab and  éß中文 \U0001f642   end "


class Transducer:
    """Raises ValueError if the model's normaliser, pieces or merges are of a kind that these tables do not express."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size = n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.byte.values())] = True
        self.longest = max(map(len, self.id))
        self.arcs: dict[tuple[str, str], float] = {}
        value = {i: bytes([b]) for b, i in self.byte.items()}
        written = [value.get(i, b"" if model.is_control(i) else x.replace(SPACE, " ").encode()) for i, x in enumerate(self.text)]
        self.out_length = np.array([len(x) for x in written], np.int64)
        self.out_start = np.cumsum(self.out_length) - self.out_length
        self.out = np.frombuffer(b"".join(written), np.uint8)
        crossing = [p for p in self.id if SPACE in p.lstrip(SPACE)]
        if crossing or len(self.byte) != 256:
            raise ValueError(f"{path}: not a merge model with byte fallback")
        self._compile_merges()
        self._compile_trie()
        self.table = WordTable()
        if self.encode(_PROBE) != model.encode(_PROBE):
            raise ValueError(f"{path}: not an identity normaliser")

    def _compile_merges(self) -> None:
        """By piece: rank of its merge (-1: a character) and its two parts; and the piece that each pair of pieces makes."""
        self.rank, self.left, self.right = np.full(self.size, -1), np.full(self.size, _OTHER), np.full(self.size, _OTHER)
        joins: dict[int, int] = {}
        by_score = sorted((p for p in self.id if len(p) > 1 and SPACE * 2 not in p), key=lambda p: -self.score[p])
        for k, p in enumerate(by_score):
            i = self.id[p]
            self.rank[i] = k
            for cut in range(1, len(p)):
                if p[:cut] in self.id and p[cut:] in self.id:
                    joins[self.id[p[:cut]] * self.size + self.id[p[cut:]]] = k
            parts = self.merge(p, last=True)
            if len(parts) != 2 or any(x not in self.id or self.rank[self.id[x]] >= k for x in parts):
                raise ValueError(f"{p}: a piece that is not merged of two that merge before it")
            self.left[i], self.right[i] = (self.id[x] for x in parts)
        self.join_keys = np.array(sorted(joins), np.int64)
        self.join_ranks = np.array([joins[x] for x in self.join_keys.tolist()], np.int64)

    def _compile_trie(self) -> None:
        self.letters = np.array(sorted({ord(c) for p in self.id for c in p}), np.int64)
        place = {c: k for k, c in enumerate(self.letters.tolist())}
        arcs, final = {}, [_OTHER]
        for p, i in self.id.items():
            state = 0
            for c in p:
                key = state * len(place) + place[ord(c)]
                if key not in arcs:
                    arcs[key] = len(final)
                    final.append(_OTHER)
                state = arcs[key]
            final[state] = i
        self.final = np.array(final, np.int64)
        self.trie_keys = np.array(sorted(arcs), np.int64)
        self.trie_next = np.array([arcs[k] for k in self.trie_keys.tolist()], np.int64)

    def normalise(self, text: str) -> str:
        return text.translate(NORMALISER)

    def merge(self, text: str, last: bool = False) -> list[str]:
        """Merging by score, leftmost first: the rule that the arcs of pairs express. `last`: stop before the last merge of a piece."""
        parts = list(text)
        while True:
            found = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score]
            if not found or last and len(parts) == 2:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the arc from piece a to piece b weighs 0, for arrays of piece ids; _OTHER is a character without a piece."""
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a != _OTHER) & (b != _OTHER))
        r, l = a[live], b[live]
        r_ends, l_ends = np.full(len(live), _NEVER), np.full(len(live), _NEVER)
        while len(live):
            key = r * self.size + l
            at = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
            rank = np.where(self.join_keys[at] == key, self.join_ranks[at], _NEVER)
            broken = (rank < r_ends) & (rank <= l_ends)  # of equal ranks the leftmost merges first
            ok[live[broken]] = False
            r_made, l_made = self.rank[r], self.rank[l]
            later = r_made > l_made
            on = np.flatnonzero(~broken & ((r_made >= 0) | (l_made >= 0)))
            later, r, l, r_made, l_made = later[on], r[on], l[on], r_made[on], l_made[on]
            r_ends, l_ends, live = np.where(later, r_made, r_ends[on]), np.where(later, l_ends[on], l_made), live[on]
            r, l = np.where(later, self.right[r], r), np.where(later, l, self.left[l])
        return ok

    def shortest_many(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids on the paths of least weight through the compositions with normalised chunks without doubled spaces."""
        if not chunks:
            return []
        size = np.array([len(c) for c in chunks], np.int64)
        code = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.int64)
        stop = np.repeat(np.cumsum(size), size)
        start = stop - np.repeat(size, size)
        letter = np.minimum(np.searchsorted(self.letters, code), len(self.letters) - 1)
        letter[self.letters[letter] != code] = _OTHER
        here, state, arcs = np.arange(len(code)), np.zeros(len(code), np.int64), []
        for depth in range(self.longest):
            on = (here + depth < stop[here]) & (letter[np.minimum(here + depth, len(code) - 1)] != _OTHER)
            here, state = here[on], state[on]
            key = state * len(self.letters) + letter[here + depth]
            at = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
            on = self.trie_keys[at] == key
            here, state = here[on], self.trie_next[at[on]]
            ends = self.final[state] != _OTHER
            arcs.append((here[ends], here[ends] + depth + 1, self.final[state[ends]]))
        single = np.ones(len(code), bool)
        single[arcs[0][0]] = False
        other = np.flatnonzero(single)
        arcs.append((other, other + 1, np.full(len(other), _OTHER)))
        a, b, piece = (np.concatenate(x) for x in zip(*arcs, strict=True))
        step = b - start[a]
        by = np.argsort(step, kind="stable")
        a, b, piece = a[by], b[by], piece[by]
        reached, last, back = np.zeros(len(code) + 1, bool), np.full(len(code) + 1, _OTHER), np.zeros(len(code) + 1, np.int64)
        edges = np.searchsorted(step[by], np.arange(1, int(size.max()) + 2))
        first = a == start[a]
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            x, p, head = a[lo:hi], piece[lo:hi], first[lo:hi]
            good = head.copy()
            inner = np.flatnonzero(~head & reached[x])
            good[inner] = self.apart(last[x[inner]], p[inner])
            to = b[lo:hi][good]
            reached[to], last[to], back[to] = True, p[good], x[good]
        on, at, begin = np.zeros(len(code) + 1, bool), np.cumsum(size), np.cumsum(size) - size
        if not reached[at].all():
            raise ValueError("no path: the model's merges are not decided by neighbours")
        while len(at):
            on[at] = True
            at, open_ = back[at], back[at] > begin
            at, begin = at[open_], begin[open_]
        ends = np.flatnonzero(on)
        ids, lengths = last[ends], np.ones(len(ends), np.int64)
        strange = np.flatnonzero(ids == _OTHER)
        if len(strange):
            spelt = [[self.byte[x] for x in chr(code[ends[k] - 1]).encode()] for k in strange.tolist()]
            lengths[strange] = [len(x) for x in spelt]
            out = np.repeat(ids, lengths)
            out[ragged(lengths[strange], (np.cumsum(lengths) - lengths)[strange])] = [i for x in spelt for i in x]
            ids = out
        cuts = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(ends, np.cumsum(size), "right")]
        return np.split(ids, cuts[:-1])

    def weight(self, a: str, b: str) -> float:
        """Of the arc from state a ("": the start) to state b, by the rule itself."""
        known = self.arcs.get((a, b))
        if known is None:
            known = 0.0 if self.merge(a + b) == ([a, b] if a else [b]) else inf
            if len(self.arcs) >= KEPT:
                self.arcs.clear()
            self.arcs[a, b] = known
        return known

    def shortest(self, chunk: str) -> list[int]:
        """As shortest_many, for one chunk of any length and with any spaces."""
        distance, state = [0.0], [""]
        for end in range(1, len(chunk) + 1):
            best, last = inf, ""
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                piece = chunk[start:end]
                if distance[start] < best and (piece in self.id or end - start == 1):
                    total = distance[start] + self.weight(state[start], piece)
                    if total < best:
                        best, last = total, piece
            distance.append(best)
            state.append(last)
        if distance[-1] == inf:
            raise ValueError("no path: the model's merges are not decided by neighbours")
        out, end = [], len(chunk)
        while end:
            piece = state[end]
            out.append([self.id[piece]] if piece in self.id else [self.byte[b] for b in piece.encode()])
            end -= len(piece)
        return [i for ids in reversed(out) for i in ids]

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of rows of UTF-8 bytes, and each row's n + 1 places; an empty row has none. A long row is read in steps that end at a chunk."""
        some = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][some], ord(" "))  # the start arc
        offsets = offsets + np.concatenate([[0], np.cumsum(some)])
        parts, counts = [np.zeros(0, np.uint32)], np.zeros(len(offsets) - 1, np.int64)
        for lo, hi in slices(offsets):
            a, b = int(offsets[lo]), int(offsets[hi])
            while a < b:
                c = b
                if b - a > 1 << 21:
                    c = a + (1 << 20)
                    while c < b and not (data[c] == 0x20 and data[c - 1] != 0x20 and data[c - 1] != 0x81):
                        c += 1
                starts = np.zeros(1, np.int64) if hi - lo == 1 else offsets[lo:hi] - a
                ids, at = self._block(data[a:c], starts)
                parts.append(ids)
                counts[lo:hi] += np.diff(at)
                a = c
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])

    def _block(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = data == 0x20
        mark = np.zeros(len(data), bool)
        if len(data) > 2:
            mark[:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        begins = space | mark
        begins[1:] &= ~space[:-1]
        begins[3:] &= ~mark[:-3]
        begins[rows[rows < len(data)]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))

        def encode(at: np.ndarray) -> list:
            chunks = [self.normalise(data[start[i] : end[i]].tobytes().decode()) for i in at.tolist()]
            alone = [len(c) > LONG or SPACE * 2 in c for c in chunks]
            many = iter(self.shortest_many([c for c, x in zip(chunks, alone, strict=True) if not x]))
            return [self.shortest(c) if x else next(many) for c, x in zip(chunks, alone, strict=True)]

        # rows without bytes begin where the next one does
        ids, ends = self.table.lookup(data, start, end, encode)
        return ids, ends[np.searchsorted(start, np.append(rows, len(data)))]

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_rows(raw, np.array([0, len(raw)]))[0].tolist()

    def decode_rows(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The inverse transducer, a text for each row. "▁" in the text comes back as a space; broken bytes as U+FFFD."""
        ids = ids.astype(np.int64)
        raw = self.out[ragged(self.out_length[ids], self.out_start[ids])].tobytes()
        cut = np.concatenate([[0], np.cumsum(self.out_length[ids])])[at].tolist()
        return [raw[a:b].decode(errors="replace").removeprefix(" ") for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def decode(self, ids: Iterable[int]) -> str:
        ids = np.array(list(ids), np.int64)
        return self.decode_rows(ids, np.array([0, len(ids)]))[0]


@lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (array of int) of every row; null and empty texts have none. `model`: a path all workers can read."""
    small_batches(docs.sparkSession)

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for batch in batches:
            ids, at = t.encode_rows(*text_buffers(batch["text"]))
            yield pa.record_batch([batch["doc_id"].cast(pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encoded, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of every row of doc_id and ids; null ids give an empty text."""
    small_batches(encoded.sparkSession)

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for batch in batches:
            yield pa.record_batch([batch["doc_id"], pa.array([t.decode(x or []) for x in batch["ids"].to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, text string")


def report(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, n_bytes (ids of byte pieces), ids_crc32 and decoded_sha256 of every row, encoded and decoded again.

    A null text is empty: no ids, the digest of nothing. Repeated rows and ids give a row each; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for batch in batches:
            ids, at = t.encode_rows(*text_buffers(batch["text"]))
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            n_bytes = np.diff(np.concatenate([[0], np.cumsum(t.is_byte[ids])])[at])
            digests = [hashlib.sha256(x.encode()).hexdigest() for x in t.decode_rows(ids, at)]
            yield pa.record_batch([batch["doc_id"].cast(pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(crc, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_ids", "n_bytes", "ids_crc32", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(told, "doc_id long, n_ids long, n_bytes long, ids_crc32 long, decoded_sha256 string")
