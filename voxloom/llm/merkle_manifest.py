"""Merkle manifest of a table: leaves in order by source, blocks of leaves collapsed by higher-order SQL functions.

A leaf is the digest of a row. Within a source the leaves ascend by document id (null first, then leaf); as long as
several nodes remain every FAN consecutive ones (the last run fewer, even one) become the digest of their digests. What
remains is the source's root; the roots of the sources, in order (null first, UTF-8 bytewise), make the root likewise.

Rows are numbered by a range sort, never in one task: a row's place in its source is its place in its range and the number
of that source's rows in earlier ranges. BLOCK consecutive nodes of a source meet as one array, in which all their levels
are computed; then the block roots are the nodes. A round divides their number by BLOCK, so the plan has two or three of
them for billions of rows. A source of any size is thus dealt over as many tasks as it has blocks.

Null columns count as `-`; rows that are equal in all have like leaves and places beside each other. An empty table gives no row.
Extra columns are not read. Everything runs in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import TASK_BYTES, fan_out, materialize
from voxloom.llm.sql_text import crc32
from voxloom.operators.volumes import bind

#: Children of a node.
FAN = 3
#: Levels collapsed in one array, and the leaves that it holds.
LEVELS = 6
BLOCK = FAN**LEVELS
#: Columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The path of a node that has nothing above it.
_NO_PATH = "CAST(array() AS array<struct<l:string,r:string>>)"
#: Bytes of a row that is numbered: its digests, id and source.
_ROW = 256


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(values: dict[str, Column]) -> Column:
    """The digest of a row: each column as UTF-8 byte count, colon and value, or - if null."""
    text = [values[c].cast("string") for c in COLUMNS]
    return digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text])


def tampered(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and `claimed`: the leaf after line feeds were deleted where 2 divides crc32 of the id, else the leaf itself."""
    own = {c: F.col(c) for c in COLUMNS}
    cut = own | {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    return docs.select("doc_id", "source", leaf(own).alias("leaf"), F.when(hit, leaf(cut)).alias("cut")).select("doc_id", "source", "leaf", F.coalesce("cut", "leaf").alias("claimed"))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with `place`: each row's number from 0 within its group, and `n`, how many rows the group has.

    Rows are dealt by ranges of (group, order, row), so that neither a large group nor a repeated row meets in one task.
    """
    spark, keys = rows.sparkSession, (group, *order, "_tie")
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    parts = max(fan_out(spark), -(-rows.count() * _ROW // TASK_BYTES))
    at = F.monotonically_increasing_id()
    dealt = tied.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", at)
    dealt = materialize(dealt.withColumn("_part", F.shiftright("_at", 33)).drop("_tie"), "merkle-order")
    pieces = dealt.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_count"))
    earlier = F.sum("_count").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = pieces.select(F.col(group).alias("_group"), F.col("_part").alias("_piece"), (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias("_start"), F.sum("_count").over(Window.partitionBy(group)).alias("n"))
    placed = dealt.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_piece")))
    return placed.withColumn("place", F.col("_at") + F.col("_start")).drop("_at", "_part", "_group", "_piece", "_start")


def collapse(nodes: Column, whole: Column) -> Column:
    """All levels above an array of nodes, itself first; to a single node where it is `whole`, else LEVELS of them."""

    def above(levels: Column) -> Column:
        last = F.element_at(levels, -1)
        up = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / FAN).cast("int")), lambda i: F.sha2(F.array_join(F.slice(x, i * FAN + 1, F.lit(FAN)), ""), 256))
        return F.when(whole & (F.size(last) == 1), levels).otherwise(F.concat(levels, F.array(bind(last, up))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array(nodes), lambda levels, _: above(levels))


def siblings(levels: Column, i: Column) -> Column:
    """For leaf i the digests left and right of its node in its run, joined, at each level that has one above it."""

    def at(k: Column) -> Column:
        def run(level: Column, own: Column) -> Column:
            first = own - own % FAN
            return F.struct(F.array_join(F.slice(level, first + 1, own % FAN), "").alias("l"), F.array_join(F.slice(level, own + 2, FAN - 1 - own % FAN), "").alias("r"))

        own = F.floor(i / F.pow(F.lit(FAN), k)).cast("int")
        return bind(F.struct(F.get(levels, k).alias("level"), own.alias("own")), lambda b: run(b["level"], b["own"]))

    return F.when(F.size(levels) > 1, F.transform(F.sequence(F.lit(0), F.size(levels) - 2), at)).otherwise(F.expr(_NO_PATH))


def grow(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of nodes (key, place, n, node, item), then of their roots and so on, and (key, node) of what remains of each key.

    A block holds key, block, n, items (place, node, item) in order and the levels above them; each round is written.
    """
    rounds, size = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        held = nodes.groupBy("key", F.floor(F.col("place") / BLOCK).alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("place", "node", "item"))).alias("items"))
        own, whole = F.transform("items", lambda x: x["node"]), F.col("n") <= BLOCK
        rounds.append(materialize(held.select("key", "block", "n", F.transform("items", lambda x: x["item"]).alias("items"), F.explode(F.array(collapse(own, whole))).alias("levels")), name))
        nodes = rounds[-1].select("key", F.col("block").alias("place"), F.ceil(F.col("n") / BLOCK).alias("n"), F.get(F.element_at("levels", -1), F.lit(0)).alias("node"), F.col("block").alias("item"))
        if size <= BLOCK:
            return rounds, nodes.select("key", "node")
        size = -(-size // BLOCK)


def descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(key, item, node, path, top) of the nodes that the rounds grew from; `tops` (key, path, top) is what lies above each key."""
    tops = tops.withColumn("item", F.lit(0).cast("bigint"))
    for blocks in reversed(rounds):
        above = tops.select(F.col("key").alias("_key"), F.col("item").alias("_block"), F.col("path").alias("above"), "top")
        joined = blocks.join(above, F.col("key").eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block")))
        one = joined.select("key", "levels", "above", "top", F.posexplode("items").alias("i", "item"))
        tops = one.select("key", "item", F.get(F.get("levels", F.lit(0)), F.col("i")).alias("node"), F.concat(siblings(F.col("levels"), F.col("i")), "above").alias("path"), "top")
    return tops


def manifest(rows: DataFrame) -> DataFrame:
    """doc_id, source, leaf, claimed, subroot, root and `path` of rows (doc_id, source, leaf, claimed).

    The path holds the digests left and right of each node from the leaf up to the root.
    """
    claimed = F.nullif("claimed", "leaf").alias("claimed")
    placed = numbered(rows, "source", "doc_id", "leaf")
    leaves, subroots = grow(placed.select(F.col("source").alias("key"), "place", "n", F.col("leaf").alias("node"), F.struct("doc_id", claimed).alias("item")), "merkle-leaves")
    ranked = numbered(subroots.withColumn("every", F.lit(0)), "every", "key")
    sources, roots = grow(ranked.select(F.col("every").alias("key"), "place", "n", "node", F.struct(F.col("key").alias("source")).alias("item")), "merkle-sources")
    above = descend(sources, roots.select("key", F.expr(_NO_PATH).alias("path"), F.col("node").alias("top")))
    tops = above.select(F.col("item.source").alias("key"), "path", F.struct(F.col("node").alias("subroot"), F.col("top").alias("root")).alias("top"))
    out = descend(leaves, tops)
    return out.select("item.doc_id", F.col("key").alias("source"), F.col("node").alias("leaf"), F.coalesce("item.claimed", "node").alias("claimed"), "top.subroot", "top.root", "path")


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its siblings lead to."""
    return F.aggregate(path, node, lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]), 256))


def report(docs: DataFrame) -> DataFrame:
    """Leaf, roots, digest of the proof and the root recomputed from the tampered leaf, for every row."""
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""), 256)
    out = manifest(tampered(docs)).select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.col("claimed"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(name: str) -> str:
    return f"coalesce(octet_length(encode({name}::VARCHAR))::VARCHAR || ':' || {name}::VARCHAR, '-')"


_HEAD = " || ".join(_field(c) for c in COLUMNS[:-1])
_STEP = "SELECT level + 1, {key}, place // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM {tree} WHERE n > 1 GROUP BY level, {key}, place // 3, n"
_SIBLINGS = """SELECT l.row, t.level + {shift} AS level, coalesce(string_agg(t.node, '' ORDER BY t.place) FILTER (t.place < l.place // CAST(3 ** t.level AS BIGINT)), '') AS l,
    coalesce(string_agg(t.node, '' ORDER BY t.place) FILTER (t.place > l.place // CAST(3 ** t.level AS BIGINT)), '') AS r
  FROM {leaves} l JOIN {tree} t ON {match} AND t.n > 1 AND t.place // 3 = l.place // CAST(3 ** (t.level + 1) AS BIGINT) GROUP BY l.row, t.level"""

#: The same in DuckDB: both trees by recursion over levels, siblings by a join; the fold is a reduction of (left, right) pairs.
SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source, sha256({_HEAD} || {_field("text")}) AS leaf,
    sha256({_HEAD} || CASE WHEN ({crc32("doc_id::VARCHAR")}) % 2 = 0 THEN {_field("replace(text, chr(10), '')")} ELSE {_field("text")} END) AS claimed
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM hashed),
tree AS (SELECT 0 AS level, source, place, n, leaf AS node FROM leaves UNION ALL {_STEP.format(key="source", tree="tree")}),
subroots AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
above AS (SELECT 0 AS level, place, n, subroot AS node FROM subroots UNION ALL {_STEP.format(key="0", tree="above").replace("level + 1, 0,", "level + 1,").replace("level, 0,", "level,")}),
tops AS (SELECT leaves.row, subroots.subroot, subroots.place FROM leaves JOIN subroots ON subroots.source IS NOT DISTINCT FROM leaves.source),
steps AS (
  {_SIBLINGS.format(shift=0, leaves="leaves", tree="tree", match="t.source IS NOT DISTINCT FROM l.source")}
  UNION ALL {_SIBLINGS.format(shift=1000, leaves="tops", tree="above", match="true")}),
paths AS (SELECT row, list({{'l': l, 'r': r}} ORDER BY level) AS path FROM steps GROUP BY row),
told AS (
  SELECT doc_id, leaf, subroot, (SELECT node FROM above WHERE n = 1) AS root, sha256(coalesce(array_to_string(list_transform(path, lambda s: s.l || s.r), ''), '')) AS proof_sha256,
    CASE WHEN path IS NULL THEN claimed ELSE list_reduce(list_prepend({{'l': claimed, 'r': ''}}, path), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l END AS folded_root
  FROM leaves JOIN tops USING (row) LEFT JOIN paths USING (row))
SELECT *, folded_root = root AS verified FROM told
"""
