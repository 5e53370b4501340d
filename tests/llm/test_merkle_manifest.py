"""The Merkle manifest against plain Python and its SQL, with nulls, ties, repeated rows and several rounds of blocks."""

import hashlib
import random
import zlib

import pandas as pd
import pytest
from oracle import canonical, connect

from voxloom.llm import merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, place long, path string"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_above(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def around(levels, i):
    return [(level[i // 3**k // 3 * 3 : i // 3**k], level[i // 3**k + 1 : i // 3**k // 3 * 3 + 3]) for k, level in enumerate(levels[:-1])]


def plain(rows):
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None
        head = "".join(map(shown, (doc_id, source, lang, n_chars)))
        groups.setdefault(source, []).append((doc_id, h(head, shown(text)), h(head, shown(text.replace("\n", "") if hit else text))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = levels_above([r[1] for r in groups[s]])
    top = levels_above([trees[s][-1][0] for s in order])
    for j, s in enumerate(order):
        for i, (doc_id, leaf, claimed) in enumerate(groups[s]):
            path, node = around(trees[s], i) + around(top, j), claimed
            for left, right in path:
                node = h(*left, node, *right)
            yield doc_id, leaf, trees[s][-1][0], top[-1][0], h(*[x for left, right in path for x in left + right]), node, node == top[-1][0]


def made(sizes):
    rng = random.Random(3)
    rows = []
    for k, (source, n) in enumerate(sizes.items()):
        rows += [(1000 * i + k, rng.choice(["a\nb", "", None, "é\n\n", f"t{i}"]), rng.choice(["en", None]), source, rng.choice([None, 3])) for i in range(n)]
    rows += [(None, "x", "en", None, 1), (None, "y\n", None, None, None), *rows[:3], rows[0]]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", 5, "p") for r in rows], SCHEMA).repartition(5)


SIZES = {"b": 1, "a": 2, "": 3, None: 4, "é": 9, "z": 10, "Z": 27, "hot": 300}


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_rounds_of_blocks(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 3**levels)
    rows = made(SIZES)
    got = merkle_manifest.report(frame(spark, rows)).toPandas()
    want = pd.DataFrame(plain(rows), columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    assert canonical(got) == canonical(want) and not got.verified.all() and got.verified.any()
    pd.DataFrame(rows, columns=COLUMNS).astype({"doc_id": "Int64", "n_chars": "Int64"}).to_parquet(f"{tmp_path}/documents.parquet")
    assert canonical(connect(str(tmp_path)).execute(merkle_manifest.SQL).df()) == canonical(want)


@pytest.mark.parametrize("n", [729, 730, 2187, 2188])
def test_edges_of_blocks(spark, n):
    rows = [(i, f"{i}\n", "en", "one", 1) for i in range(n)]
    got = {tuple(r) for r in merkle_manifest.report(frame(spark, rows)).collect()}
    assert got == set(plain(rows))


def test_whole_table_and_plan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = canonical(merkle_manifest.report(df).toPandas())
    assert got == canonical(connect("/root/testdata/sf0.001").execute(merkle_manifest.SQL).df()) and len(got) == 200
    plan = merkle_manifest.report(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_one_row_none_and_a_long_text(spark):
    assert merkle_manifest.report(frame(spark, [])).count() == 0
    for row in [(7, None, None, None, None), (2, "ab\n" * 700_000, "en", "s", 5)]:
        got = [tuple(r) for r in merkle_manifest.report(frame(spark, [row])).collect()]
        assert got == list(plain([row])) and got[0][4] == hashlib.sha256(b"").hexdigest()


def test_places_in_groups_without_one_large_task(spark):
    rows = spark.range(4000).selectExpr("CASE WHEN id < 3500 THEN 'hot' WHEN id < 3990 THEN NULL ELSE CAST(id AS string) END AS g", "7 AS key")
    out = merkle_manifest.numbered(rows, "g", "key")
    assert sorted((str(r["g"]), r["place"], r["n"]) for r in out.collect()) == sorted([("hot", i, 3500) for i in range(3500)] + [("None", i, 490) for i in range(490)] + [(str(i), 0, 1) for i in range(3990, 4000)])
