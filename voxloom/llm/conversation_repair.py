"""Conversation structure repair: faults of turns by windows, then the cheapest edits to system? (user assistant)+ by a native fold.

Everything runs in Spark SQL functions; one shuffle, by conversation.

The turns of a conversation are ordered by turn number (null first), then role, then text. A turn has at most one fault:
blank (nothing but white space), duplicate (role and text stand earlier in the conversation) or truncated (its last
character that is no white space is none of . ! ?). Edits: keep (0), change the role to user or assistant (2), delete (3;
a must for blank and duplicate turns), insert an empty user or assistant turn anywhere (2); a truncated turn that stays
adds 1. Of the cheapest edit sequences the one whose initials (D, I, K, R) come first in ASCII is taken.

The fold carries, for each of four ends of what is kept so far (nothing, system, user, assistant), the least (cost,
audit). Audits of like cost and like turns read are never prefixes of each other, for the audit fixes the cost, so the
least one stays least whatever follows.

Null roles and texts count as one space; an empty role has no initial, so it fits nowhere; a null conversation id is a conversation of its own; extra columns are not read.
A conversation's turns, audit and repaired text stand together in one row, as the digest of the whole text asks for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.sql_text import crc32
from voxloom.operators.volumes import bind

#: White space of the fault rules.
_BLANKS = " \t\n\x0b\f\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_FAR = 1 << 40
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
_TURN = "struct<turn:bigint,role:string,text:string>"


def damage(turns: DataFrame) -> DataFrame:
    """conv_id and `kept` (turn, role, text; null for a dropped row) after the faults that crc32("conv_id:turn") % 20 plants."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(shown("role"))
    row = F.struct(F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    copies = F.when(F.col("_kind") == 0, F.expr(f"CAST(array() AS array<{_TURN}>)")).when(F.col("_kind") == 3, F.array(row, row)).otherwise(F.array(row))
    return turns.select("conv_id", "turn", "role", "text", kind.alias("_kind")).select("conv_id", F.explode_outer(copies).alias("kept"))


def flagged(kept: DataFrame) -> DataFrame:
    """The turns with initial, fault (0 for none), `seen` (which of equal turns), `fresh` (a turn number not seen before) and `illegal`."""
    rows = kept.select("conv_id", F.col("kept").isNotNull().alias("live"), "kept.*").repartition("conv_id")
    of = Window.partitionBy("conv_id", "live")
    stripped = F.rtrim(F.col("text"), F.lit(_BLANKS))
    seen = F.row_number().over(Window.partitionBy("conv_id", "live", "role", "text").orderBy("turn"))
    fault = F.when(stripped == "", BLANK).when(F.col("seen") > 1, DUPLICATE).when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    before = F.lag(F.struct("turn", "initial")).over(of.orderBy("turn", "role", "text", "seen"))
    known = rows.withColumn("seen", seen).withColumn("initial", F.left(F.col("role"), F.lit(1))).withColumn("fault", fault).withColumn("before", before)
    fresh = F.col("turn").isNotNull() & ~F.coalesce(F.col("before.turn") == F.col("turn"), F.lit(False))
    illegal = F.col("before").isNotNull() & ~F.concat("before.initial", "initial").isin("su", "ua", "au")
    return known.select("conv_id", "live", "turn", "role", "text", "seen", "initial", "fault", fresh.alias("fresh"), illegal.alias("illegal"))


def _step(state: Column, cost: Column | int, letter: Column | str) -> Column:
    cost, letter = (F.lit(x) if not isinstance(x, Column) else x for x in (cost, letter))
    return F.struct((state["cost"] + cost).cast("bigint").alias("cost"), F.concat(state["audit"], letter).alias("audit"))


def _ends(e: Column, s: Column, u: Column, a: Column) -> Column:
    return F.struct(e.alias("e"), s.alias("s"), u.alias("u"), a.alias("a"))


def _inserted(state: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of the ends with an inserted user turn, assistant turn or both where that is cheaper."""
    before_user = F.least(state["e"], state["s"], state["a"])
    user = F.least(state["u"], _step(before_user, INSERT, "I"))
    return bind(_ends(state["e"], state["s"], user, state["a"]), lambda x: then(_ends(x["e"], x["s"], x["u"], F.least(x["a"], _step(x["u"], INSERT, "I")))))


def _read(state: Column, turn: Column) -> Column:
    """The ends after one turn more."""
    must = turn["fault"].isin(BLANK, DUPLICATE)
    extra = F.when(turn["fault"] == TRUNCATED, 1).otherwise(0)
    is_ = lambda x: turn["initial"] == x

    def stays(before: Column, role: str) -> Column:
        return _step(before, F.when(is_(role), KEEP).otherwise(REROLE) + extra, F.when(is_(role), "K").otherwise("R"))

    def after(x: Column) -> Column:
        gone = {k: _step(x[k], DELETE, "D") for k in "esua"}
        system = F.when(is_("s"), F.least(gone["s"], _step(x["e"], extra, "K"))).otherwise(gone["s"])
        kept = _ends(gone["e"], system, F.least(gone["u"], stays(F.least(x["e"], x["s"], x["a"]), "u")), F.least(gone["a"], stays(x["u"], "a")))
        return F.when(must, _ends(*[gone[k] for k in "esua"])).otherwise(kept)

    return _inserted(state, lambda ends: bind(ends, after))


def cheapest(turns: Column) -> Column:
    """(cost, audit) of the cheapest edits of an ordered array of turns with `initial` and `fault`."""
    at = lambda cost: F.struct(F.lit(cost).cast("bigint").alias("cost"), F.lit("").alias("audit"))
    start = _ends(at(0), at(_FAR), at(_FAR), at(_FAR))
    return F.aggregate(turns, start, _read, lambda state: _inserted(state, lambda x: F.least(x["e"], x["a"])))


def repaired(turns: Column, audit: Column) -> Column:
    """The lines role:text that are left when the edits of `audit` are made."""

    def lines(turns: Column, audit: Column, first: Column) -> Column:
        system = (F.left(F.ltrim(audit, F.lit("D")), F.lit(1)) == "K") & (F.get(turns, first)["initial"] == "s")

        def line(k: Column, shift: Column) -> Column:
            letter, prefix = F.substring(audit, k, F.lit(1)), F.left(audit, k)
            row = F.get(turns, F.length(F.replace(prefix, F.lit("I"), F.lit(""))) - 1)
            role = F.when((F.length(F.replace(prefix, F.lit("D"), F.lit(""))) - shift) % 2 == 1, "user").otherwise("assistant")
            return F.when(letter == "K", F.concat(row["role"], F.lit(":"), row["text"])).when(letter == "R", F.concat(role, F.lit(":"), row["text"])).when(letter == "I", F.concat(role, F.lit(":")))

        return bind(system.cast("int"), lambda shift: F.transform(F.sequence(F.lit(1), F.length(audit)), lambda k: line(k, shift)))

    bound = lambda t, a: lines(t, a, F.length(a) - F.length(F.ltrim(a, F.lit("D"))))
    joined = lambda t: bind(audit, lambda a: F.when(a == "", "").otherwise(F.array_join(bound(t, a), "\n")))
    return bind(turns, joined)


def repair(kept: DataFrame) -> DataFrame:
    """A row for each conv_id of `kept` (conv_id, kept): turns, counts of faults, cost, audit and the repaired text."""
    turn = F.struct("turn", "role", "text", "seen", "fault", "initial")
    counted = lambda k: F.count_if(F.col("live") & (F.col("fault") == k))
    groups = flagged(kept).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("live"), turn))).alias("turns"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("fresh"), F.lit(0)).cast("bigint").alias("gaps"),
        counted(BLANK).alias("blank"), counted(DUPLICATE).alias("duplicate"), counted(TRUNCATED).alias("truncated"), F.count_if("illegal").alias("illegal"),
    )
    edits = bind(F.struct("turns"), lambda g: bind(cheapest(g["turns"]), lambda best: F.struct(best["cost"].alias("cost"), best["audit"].alias("audit"), repaired(g["turns"], best["audit"]).alias("repaired"))))
    return groups.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "turns", F.explode(F.array(edits)).alias("edits")).select("conv_id", "turns", "gaps", "blank", "duplicate", "truncated", "illegal", "edits.*")


def report(turns: DataFrame) -> DataFrame:
    """Damage the turns, repair them, and give the counts, the cost, the audit and the digest of the repaired text."""
    out = repair(damage(turns))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2("repaired", 256).alias("repaired_sha256"))


#: The same in DuckDB: crc32 bit by bit, faults by windows, and the fold as a recursion over turns, whose four ends are
#: texts of 12 digits of cost and the audit. It reads the view `conversations`.
SQL = f"""
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    ({crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")}) % 20 AS kind
  FROM conversations),
kept AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn JOIN (VALUES (1), (2)) AS copies(copy) ON copy = 1 OR kind = 3 WHERE kind <> 0),
seen AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM kept),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
    row_number() OVER turns AS n, lag(initial) OVER turns AS before
  FROM seen WINDOW turns AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen)),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
fold AS (
  SELECT conv_id, 0 AS n, '000000000000' AS e, '900000000000' AS s, '000000000002I' AS u, '000000000004II' AS a FROM told
  UNION ALL
  SELECT conv_id, n, e, s, u, least(a, printf('%012d', left(u, 12)::BIGINT + 2) || substr(u, 13) || 'I')
  FROM (
    SELECT conv_id, n, e, s, a, least(u, printf('%012d', left(least(e, s, a), 12)::BIGINT + 2) || substr(least(e, s, a), 13) || 'I') AS u
    FROM (
      SELECT f.conv_id, t.n, printf('%012d', left(f.e, 12)::BIGINT + 3) || substr(f.e, 13) || 'D' AS e,
        least(printf('%012d', left(f.s, 12)::BIGINT + 3) || substr(f.s, 13) || 'D',
          CASE WHEN t.stays AND t.initial = 's' THEN printf('%012d', left(f.e, 12)::BIGINT + t.extra) || substr(f.e, 13) || 'K' END) AS s,
        least(printf('%012d', left(f.u, 12)::BIGINT + 3) || substr(f.u, 13) || 'D',
          CASE WHEN t.stays THEN printf('%012d', left(least(f.e, f.s, f.a), 12)::BIGINT + t.extra + CASE WHEN t.initial = 'u' THEN 0 ELSE 2 END)
            || substr(least(f.e, f.s, f.a), 13) || CASE WHEN t.initial = 'u' THEN 'K' ELSE 'R' END END) AS u,
        least(printf('%012d', left(f.a, 12)::BIGINT + 3) || substr(f.a, 13) || 'D',
          CASE WHEN t.stays THEN printf('%012d', left(f.u, 12)::BIGINT + t.extra + CASE WHEN t.initial = 'a' THEN 0 ELSE 2 END)
            || substr(f.u, 13) || CASE WHEN t.initial = 'a' THEN 'K' ELSE 'R' END END) AS a
      FROM fold f JOIN (SELECT conv_id, n, initial, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS extra FROM faults) t
        ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.n = f.n + 1))),
best AS (
  SELECT told.*, least(fold.e, fold.a) AS best FROM told JOIN fold ON fold.conv_id IS NOT DISTINCT FROM told.conv_id AND fold.n = told.n),
letters AS (
  SELECT conv_id, k, substr(best, 12 + k, 1) AS letter, length(replace(substr(best, 13, k), 'I', '')) AS n, length(replace(substr(best, 13, k), 'D', '')) AS place
  FROM (SELECT conv_id, best, unnest(range(1, length(best) - 11)) AS k FROM best)),
joined AS (
  SELECT l.conv_id, l.k, l.letter, l.place, f.role, f.text,
    bool_or(l.letter = 'K' AND f.initial = 's') OVER (PARTITION BY l.conv_id) AS led
  FROM letters l LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.n = l.n AND l.letter <> 'I'
  WHERE l.letter <> 'D'),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS repaired FROM joined GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(best, 12)::BIGINT, 0) AS cost,
  coalesce(substr(best, 13), '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM c.conv_id
"""
