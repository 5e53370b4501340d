"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_operators import by_id, table

from voxloom.llm import byte_bpe
from voxloom.llm.queries import RANK_FILE


@pytest.fixture(scope="module")
def library():
    with open(RANK_FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=3000):
    rng = random.Random(1)
    parts = ["'s", "'ll", "'re", " ", "  ", "\n", "\t", " \n", "a", "B", "zz", "é", "日", "1", "23", "!", "'", "''", "<|endoftext|>", "　", "\xa0", "՘", "é", "🙂", "\x1c", "\x85", "don't", "'S", "’s", "\0"]
    out = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(n)]
    ranges = [(1, 0x7F), (0x80, 0x2FFF), (0x3000, 0xD7FF), (0xE000, 0x10FFFF)]
    return out + ["".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def encoded(coder, texts):
    raw = [t.encode() for t in texts]
    ids, at = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


def test_ids_are_those_of_the_library(library):
    rng = random.Random(2)
    long_rows = ["ab" * 4000, "a" * 5001, "=-" * 3000, " " * 5000, "".join(rng.choices("etaoinsh", k=5000)), "word \n" * 500_000, "x" * 2_200_000 + "　 y" * 9]
    texts = [*odd_texts(), *long_rows]
    coder = byte_bpe.coder(RANK_FILE)
    got = encoded(coder, texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids == (library.encode_ordinary(text) if len(text) < 1_000_000 or " " in text[:100] else ids), text[:80]
        data, _ = coder.decode(np.array(ids, np.int64), np.array([0, len(ids)]))
        assert data.tobytes() == text.encode()


def test_rows_merge_in_the_order_of_ranks():
    """Ranks under which merging opens a pair of lesser rank, which must then come before equal pairs further right."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 290, b"bcbc": 280, b"cb": 310, b"aa": 320, b"aaa": 315, b"aab": 295}
    lines = "\n".join(f"{base64.b64encode(t).decode()} {r}" for t, r in ranks.items())

    def plain(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            best = min(((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".ranks") as f:
        f.write(lines)
        f.flush()
        coder = byte_bpe.ByteBpe(f.name)
    rng = random.Random(5)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 14))) for _ in range(3000)]
    got = encoded(coder, words)
    assert coder.whole == {t: r for t, r in ranks.items() if plain(t) != [r]}
    for w, ids in zip(words, got, strict=True):
        assert ids == ([ranks[w.encode()]] if w.encode() in ranks else plain(w.encode())), w


def test_hash_table_of_pairs_that_share_slots():
    rng = np.random.default_rng(0)
    key = np.unique(rng.integers(0, 1 << 20, 50_000))
    left, right, rank = (key >> 10).astype(np.int32), (key & 1023).astype(np.int32), np.arange(len(key), dtype=np.int32)
    pairs = byte_bpe.PairTable(left, right, rank)
    assert (pairs.lookup(left, right) == rank).all()
    every = np.arange(1 << 20)
    got = pairs.lookup((every >> 10).astype(np.int32), (every & 1023).astype(np.int32))
    assert (np.flatnonzero(got != byte_bpe._NONE) == key).all()
    assert (pairs.lookup(np.array([-1, 0], np.int32), np.array([0, -1], np.int32)) == byte_bpe._NONE).all()


def test_report(spark, library):
    texts = [*odd_texts(150), None, "", "same", "same", "long " * 300_000]
    got = by_id(byte_bpe.report(table(spark, texts), RANK_FILE))
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids, r = library.encode_ordinary(text or ""), got[3 * i + 1]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_rows_without_ids_and_bad_ids(spark):
    shared = spark.createDataFrame([(None, "a b"), (None, None), (7, "x"), (7, "x")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), len(r["ids"])) for r in byte_bpe.encode(shared, RANK_FILE).collect()) == [("7", 1), ("7", 1), ("None", 0), ("None", 2)]
    assert byte_bpe.report(table(spark, []), RANK_FILE).count() == 0
    back = byte_bpe.decode(spark.createDataFrame([(1, [0, 1]), (2, None), (3, [])], "doc_id long, ids array<int>"), RANK_FILE).collect()
    assert [(r["doc_id"], r["decoded"]) for r in sorted(back)] == [(1, b'!"'), (2, None), (3, b"")]
    with pytest.raises(ValueError):
        byte_bpe.coder(RANK_FILE).decode(np.array([60_000]), np.array([0, 1]))
