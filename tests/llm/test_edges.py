"""Cases beside the plain ones: colliding structures, damage, empty tables, learned spans, a pipeline in plain Python."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_operators import BASE, SCHEMA, by_id, components, pages, removed, table

from voxloom.llm import common, fingerprints, graph, packing, piece_transducer, repair_codec, secret_scan, signature_tree, suffix_dedup, tokens, toxicity, transport_stream, warc_fixity
from voxloom.llm.queries import PIECE_TOKENIZER, WORD_TOKENIZER


def twins(n=1024):
    """Two words that collide under every polynomial hash modulo a power of two."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    from tokenizers import Tokenizer

    tokenizer, words = Tokenizer.from_file(WORD_TOKENIZER), twins()
    docs = table(spark, words)
    prints = by_id(fingerprints.fingerprint_with_edit(docs))
    assert prints[1]["fingerprint"] != prints[4]["fingerprint"] and prints[1]["near_next"] < 0.2
    assert [r["component_id"] for r in sorted(signature_tree.link(docs).collect())] == [1, 4]
    got = by_id(repair_codec.read_ids(repair_codec.write_ids(docs, WORD_TOKENIZER)))
    packed = by_id(packing.pieces(docs, WORD_TOKENIZER))
    for i, w in enumerate(words):
        ids = tokenizer.encode(w, add_special_tokens=False).ids
        assert got[3 * i + 1]["ids_crc32"] == zlib.crc32(np.array([*ids, 2], "<u4").tobytes())
        assert packed[3 * i + 1]["ids_crc32"] == zlib.crc32(np.array([*ids, 0], "<u4").tobytes())


def test_word_table_survives_equal_hashes(monkeypatch):
    real = common.span_hashes
    weak = lambda data, lo, hi, both=False: (real(data, lo, hi)[0] & np.uint64(3), real(data, lo, hi, True)[1])
    monkeypatch.setattr(tokens, "span_hashes", weak)
    t, words = tokens.WordTable(), [b"one", b"two", b"three", b"four", b"five", b"six", b"seven", b"one"]
    data, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    for _ in range(2):
        ids, at = t.lookup(data, start, end, lambda places: [list(words[i]) for i in places.tolist()])
        assert [bytes(ids[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)] == words


M64 = (1 << 64) - 1


def mixed(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & M64
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def word_hash(word):
    if len(word) > 64:
        return int.from_bytes(hashlib.blake2b(word, digest_size=16).digest()[:8], "little")
    h = mixed((len(word) * 0xD6E8FEB86659FD93 + 0x9E3779B97F4A7C15) & M64)
    for i in range(0, len(word), 8):
        h = mixed(h ^ int.from_bytes(word[i : i + 8], "little"))
    return h


def shingle_hashes(text):
    w = [word_hash(x) for x in re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())]
    if not w:
        return set()
    if len(w) < 5:
        h = len(w)
        for x in w:
            h = mixed((h * 0xFF51AFD7ED558CCD + x) & M64)
        return {h}
    return {mixed(sum(w[i + j] * pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64) for j in range(5)) & M64) for i in range(len(w) - 4)}


def plain_sketch(text):
    """256 low bytes of bin minima, empty bins filled from the first full bin of their own sequence; None without words."""
    h = shingle_hashes(text)
    if not h:
        return None
    bins = {}
    for x in h:
        b, v = x >> 56, x & (1 << 44) - 1
        bins[b] = min(bins.get(b, v), v)
    out = []
    for b in range(256):
        source, attempt = b, 0
        while source not in bins:
            attempt += 1
            source = mixed(b * 65536 + attempt) & 255 if attempt <= 1024 else (source + 1) % 256
        out.append(bins[source] & 255)
    return bytes(out)


def likeness(a, b):
    if a is None or b is None:
        return 1.0 if a is b else 0.0
    same = sum(x == y for x, y in zip(a, b, strict=True)) / 256
    return min(1.0, max(0.0, (same - 1 / 256) / (1 - 1 / 256)))


def test_fingerprints_are_those_of_plain_python(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcXYZé", k=rng.randint(1, 12))) for _ in range(60)]
    rows = [" ".join(rng.choices(words, k=n)) for n in (0, 1, 4, 5, 6, 30, 300)] + [None, "w" * 200 + " tail of a long word here", "A b\tC\nd e", "a B c d E"]
    got = by_id(fingerprints.fingerprint_with_edit(table(spark, rows)))
    name = lambda s: "" if s is None else base64.b64encode(s).decode()
    for i, text in enumerate(rows):
        text, after, r = text or "", rows[(i + 1) % len(rows)] or "", got[3 * i + 1]
        cut = len(text) // 4
        own, edited, following = (plain_sketch(x) for x in (text, text[: len(text) - cut] + after[:cut], after))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (name(own), name(edited)), i
        assert abs(r["near_edited"] - likeness(own, edited)) < 1e-12 and abs(r["near_next"] - likeness(own, following)) < 1e-12


def test_media_columns_are_those_of_the_stream(spark):
    rows = ["", None, "x" * 576, "y" * 577, "é" * 40_000]
    got = by_id(transport_stream.media_report(table(spark, rows)))
    for i, text in enumerate(rows):
        raw = (text or "").encode()
        media = transport_stream.mux(raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff"))
        r, units = got[3 * i + 1], max(1, -(-len(raw) // 9216))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert f"units={units}," in r["feature"] and f"access={-(-units // 4)}," in r["feature"] and "continuity_errors=0,table_errors=0" in r["feature"]
        assert f"pts=90000-{90000 + (units - 1) * 17280}" in r["feature"]


def test_damaged_streams():
    media = bytearray(transport_stream.mux(bytes(range(256)) * 90))
    assert transport_stream.demux(bytes(media)).payload == bytes(range(256)) * 90
    lost = bytearray(media)
    lost[188 * 3] = 0
    for bad in (bytes(lost), bytes(media[:-1])):
        with pytest.raises(ValueError):
            transport_stream.demux(bad)
    dropped = bytes(media[: 188 * 5] + media[188 * 6 :])
    assert transport_stream.demux(dropped).continuity_errors == 1
    table_ = bytearray(media)
    table_[10] ^= 1
    assert transport_stream.demux(bytes(table_)).table_errors == 1 and not transport_stream.demux(bytes(table_)).units


def test_empty_tables(spark):
    none = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for df in (
        transport_stream.media_report(none), packing.pack_documents(none, WORD_TOKENIZER), piece_transducer.report(none, PIECE_TOKENIZER), secret_scan.scan(none),
        toxicity.classify(none, labels), repair_codec.read_ids(repair_codec.write_ids(none, WORD_TOKENIZER)), suffix_dedup.report(none), signature_tree.link(none), signature_tree.keep_one(none),
    ):
        assert df.count() == 0


def test_rows_that_share_an_id(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    rows = [(None, "alpha beta"), (None, None), (3, "gamma delta"), (3, "gamma delta"), (3, "epsilon"), (1, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, 1, 2) for d, t in rows], SCHEMA)
    of = lambda t, end: tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, end])
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    got = sorted((r["start"], r["n_tokens"], r["doc_id"], r["ids_crc32"]) for r in repair_codec.read_ids(repair_codec.write_ids(docs, WORD_TOKENIZER)).collect())
    assert Counter((d, c) for _, _, d, c in got) == Counter((d, crc(of(t, 2))) for d, t in rows)
    assert [x[2] for x in got] == [None, None, 1, 3, 3, 3] and all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in packing.pack_documents(docs, WORD_TOKENIZER).collect()) == Counter((d, crc(of(t, 0))) for d, t in rows)
    assert Counter(r["doc_id"] for r in fingerprints.fingerprint_with_edit(docs).collect()) == Counter(d for d, _ in rows)
    for df in (transport_stream.media_report(docs), piece_transducer.report(docs, PIECE_TOKENIZER), secret_scan.scan(docs), suffix_dedup.report(docs), signature_tree.link(docs)):
        assert Counter(r["doc_id"] for r in df.collect()) == Counter(d for d, _ in rows)


def test_toxicity_of_odd_rows(spark):
    rows = [(None, None, 9.0), (2, "", 9.0), (3, "nasty " * 5000, 9.0), (3, "kind words", 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    learnt = spark.createDataFrame([(100 + i, ("kind " if i % 8 else "nasty ") + f"w{i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(100 + i, int(i % 8 == 0)) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(learnt, labels)
    got = [(r["doc_id"], r["score"] >= 0.5) for r in toxicity.score(docs, model).collect()]
    assert sorted(got, key=str) == sorted([(None, False), (2, False), (3, True), (3, False)], key=str)
    blank = toxicity.classify(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in blank.collect()} == {0}


def test_toxicity_scores_are_sums_over_distinct_features(spark):
    rng, words = random.Random(2), ["good", "bad", "Word", "über", "x1", "nasty"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(40)]
    ids, at = toxicity.features(*common.text_buffers(__import__("pyarrow").array(texts)), 20)
    for text, a, b in zip(texts, at, at[1:], strict=False):
        w = [word_hash(x.encode()) for x in re.findall(r"[a-z0-9\u0080-￿]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
        want = [x >> 44 for x in w] + [mixed((w[i] * (0x9E3779B97F4A7C15 + 2 * gap) + w[i + gap]) & M64) >> 44 for gap in (1, 2) for i in range(len(w) - gap)]
        assert sorted(ids[a:b].tolist()) == sorted(want)


def test_learned_spans_find_credentials_without_a_keyword(spark):
    rng = random.Random(6)
    secret = lambda: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=24))
    long_words = ["straightforwardly", "internationalisation", "www.example.com/path", "mail3.example.com", "counterintuitive"]
    rows = [f"token = {secret()} and {rng.choice(long_words)} {rng.choice(long_words)} end" for _ in range(300)]
    held = [secret() for _ in range(50)]
    rows += [f"see {s} in {rng.choice(long_words)} here" for s in held]
    got = by_id(secret_scan.scan(table(spark, rows)))
    found = 0
    for i, s in enumerate(held, 300):
        r = got[3 * i + 1]
        assert r["n_assign"] == r["n_access"] == r["n_hex"] == 0
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert all(rows[i][int(a) : int(b)] == s for _, a, b in spans)
        found += len(spans)
    assert found >= 45
    assert all("format" not in got[3 * i + 1]["spans"] for i in range(300))


def test_repair_of_a_wide_alphabet_and_random_access():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 160_001, 30_000).astype(np.uint32)
    ids = np.concatenate([ids, ids[:9000], ids[:9000], ids[:9000], ids[:9000], np.full(999, 7, np.uint32)])
    starts = np.array([0, 0, 5, 30_000, len(ids) - 999, len(ids)])
    shard = repair_codec.Shard(repair_codec.write_shard(ids, starts, [None, 1, 2, 3, 4], 0))
    assert len(shard.rules) > 1000 and (shard.offsets() == starts).all()
    for i in range(5):
        own = ids[starts[i] : starts[i + 1]]
        assert (shard.document(i) == own).all()
        assert [shard.id_at(i, k) for k in range(0, len(own), 997)] == own[::997].tolist()
    alphabet, symbols, at, rules = repair_codec.compress(ids, starts)
    pairs = Counter(p for a, b in zip(at, at[1:], strict=False) for p in zip(symbols[a : max(a, b - 1)].tolist(), symbols[a + 1 : b].tolist(), strict=True) if p[0] != p[1])
    assert max(pairs.values()) < 4


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(7, 6), (6, 7), (9, 9)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 5 for k in [5, *range(200, 260)]}, 6: 6, 7: 6}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_audit_reports_what_only_the_replica_holds(spark):
    stored = warc_fixity.write_archives(pages(spark), 5000).collect()
    longer, extra = bytearray(stored[0]["blob"]), bytes(stored[1]["blob"])
    longer += b"appended"
    replica = [(stored[0]["archive"], bytes(longer)), *[(r["archive"], bytes(r["blob"])) for r in stored[1:]], (1 << 40, extra)]
    left = spark.createDataFrame(stored, warc_fixity._STORED)
    got = warc_fixity.audit(left, spark.createDataFrame(replica, "archive long, blob binary")).collect()
    bad = {(r["archive"], r["record"], r["record_sha256"] is None) for r in got if r["damaged"]}
    assert bad == {(stored[0]["archive"], len(stored[0]["stops"]), True), (1 << 40, 0, True)}
    assert sum(not r["damaged"] for r in got) == 63
    same = warc_fixity.audit(left, left).collect()
    assert len(same) == 63 and not any(r["damaged"] for r in same) and all(r["replica_sha256"] == r["record_sha256"] for r in same)


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = prose(90), prose(60)
    texts = [prose(rng.randint(20, 60)) + ("" if i % 8 else " nastyword") for i in range(240)]
    texts += [prose(30) + passage + prose(20) for _ in range(4)] + [f"{base} {k}" for k in range(5)] + [base, None, "", " ", None, "one two", "one two"]
    texts += [f"{prose(30)} password: Abcdefgh123456 {'0123456789abcdef' * 2}"]
    rows = [(3 * i + 1, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3 * i + 1, 1, int(i % 8 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    kept = [(d, t) for d, t, *_ in rows if "nastyword" not in (t or "")]
    sets, least = components([t for _, t in kept])
    kept = [x for i, (x, s) in enumerate(zip(kept, sets, strict=True)) if not s or least[i] == i]
    kept = [(d, t and bytes(np.frombuffer(raw, np.uint8)[~mark]).decode(errors="ignore")) for (d, t), (raw, mark) in zip(kept, removed([t for _, t in kept]), strict=True)]

    def redacted(text):
        spans = [m.span() for m in BASE.finditer(text) if len(m[2]) >= 12] + [m.span() for m in re.finditer("AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", text)]
        return secret_scan.redact(text, ",".join(f"x:{a}:{b}" for a, b in spans))

    tokenizer, want = Tokenizer.from_file(WORD_TOKENIZER), set()
    for d, t in kept:
        ids = [*tokenizer.encode(redacted(t or ""), add_special_tokens=False).ids, 0]
        want |= {(d, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)}
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert at.get(r["sequence_id"], 0) == r["offset"]
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 2048
