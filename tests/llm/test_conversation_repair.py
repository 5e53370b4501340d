"""Conversation repair against a search through all edits, and against its SQL with nulls, ties and repeats."""

import hashlib
import random
import re
import zlib

import pandas as pd
from oracle import canonical, connect

from voxloom.llm import conversation_repair

GOAL = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for turn, role, text, key in rows:
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        out += [] if kind == 0 else [row, row] if kind == 3 else [row]
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    out = []
    for i, (_, role, text) in enumerate(rows):
        bare = re.sub(r"[\x20\x09-\x0D]+", "", text)
        seen = any((role, text) == r[1:] for r in rows[:i])
        out.append("blank" if not bare else "duplicate" if seen else "" if bare[-1] in ".!?" else "truncated")
    return out


def search(rows, marks):
    """Least (cost, audit, text) among all edits that cost no more than to delete everything."""
    best = (3 * len(rows), "D" * len(rows), "")

    def go(i, cost, audit, initials, lines):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and GOAL.fullmatch(initials):
            best = min(best, (cost, audit, "\n".join(lines)))
        for role in ("user", "assistant"):
            go(i, cost + 2, audit + "I", initials + role[0], [*lines, f"{role}:"])
        if i == len(rows):
            return
        (_, role, text), extra = rows[i], int(marks[i] == "truncated")
        go(i + 1, cost + 3, audit + "D", initials, lines)
        if marks[i] in ("", "truncated"):
            go(i + 1, cost + extra, audit + "K", initials + (role[:1] or "-"), [*lines, f"{role}:{text}"])
            for new in ("user", "assistant"):
                go(i + 1, cost + 2 + extra, audit + "R", initials + new[0], [*lines, f"{new}:{text}"])

    go(0, 0, "", "", [])
    return best


def plain(conversations):
    groups = {}
    for conv, turn, role, text in conversations:
        shown = lambda x: " " if x is None else str(x)
        groups.setdefault(conv, []).append((turn, role, text, f"{shown(conv)}:{shown(turn)}"))
    for conv, rows in groups.items():
        rows = damaged(rows)
        marks, turns = faults(rows), [t for t, *_ in rows if t is not None]
        cost, audit, text = search(rows, marks)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        yield conv, gaps, *[marks.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def made(n):
    rng = random.Random(8)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sys"]
    texts = ["Yes.", "no", "", " \t\n", None, "What?  \n", "Yes.", "a.b", "…", "end!"]
    rows = []
    for conv in [None, *range(n)]:
        size = rng.choice([1, 2, 2, 3, 3, 4, 4, 5])
        rows += [(conv, rng.choice([None, 0, k, k, k, 2 * k + 5]), rng.choice(roles), rng.choice(texts)) for k in range(size)]
    return rows + rows[:3]


SCHEMA = "conv_id long, turn long, role string, text string, initial int, kept int, turns string"


def test_repair_is_the_cheapest_of_all(spark):
    rows = made(150)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    got = {tuple(r) for r in conversation_repair.report(df).collect()}
    want = set(plain(rows))
    assert got == want
    audits = "".join(r[7] for r in want)
    assert all(c in audits for c in "DIKR") and len({r[6] for r in want}) > 6


def test_sql_gives_the_same(spark, tmp_path):
    rows = made(400)
    pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(f"{tmp_path}/conversations.parquet")
    got = conversation_repair.report(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)).toPandas()
    assert canonical(got) == canonical(connect(str(tmp_path)).execute(conversation_repair.SQL).df())


def test_whole_table_and_plan(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    out = conversation_repair.report(df)
    got = canonical(out.toPandas())
    assert got == canonical(connect("/root/testdata/sf0.01").execute(conversation_repair.SQL).df()) and len(got) == 100
    plan = conversation_repair.report(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


def test_odd_tables(spark):
    assert conversation_repair.report(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    r = conversation_repair.report(spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(r) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    long_one = [(5, k, "assistant" if k % 2 else "user", f"turn {k} " + "x" * (200_000 if k == 7 else 3) + ".") for k in range(700)]
    kept = spark.createDataFrame(long_one, "conv_id long, turn long, role string, text string").selectExpr("conv_id", "named_struct('turn', turn, 'role', role, 'text', text) AS kept")
    r = conversation_repair.repair(kept).first()
    assert r["audit"] == "K" * 700 and r["cost"] == 0 and r["repaired"] == "\n".join(f"{role}:{text}" for _, _, role, text in long_one)
