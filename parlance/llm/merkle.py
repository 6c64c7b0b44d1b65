"""Merkle manifest of a table: postorder logs of nodes, closed-form positions, proofs and their check.

A tree of ``n`` leaves joins every two consecutive nodes of a level; the last run of a level may be a single node, which is
hashed alone. Leaves are appended one by one, and a node is written as soon as its last leaf is there, so that the log
stands in postorder and the place of a node follows from the sizes of the full subtrees before it (``position``).

Builders are aligned: each takes ``2**BITS`` consecutive leaves, so its log is a whole subtree and needs no other builder.
The tops of a round's builders are the leaves of the next round; a tree of n leaves takes log(n) / log(2**BITS) rounds.
Proofs go the other way: a segment's leaves address their siblings by position in its log and continue with the siblings
of its top, which came out of the round above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.scratch import discard, stash

#: Log2 of the leaves of one builder, bytes of a digest.
BITS, DIGEST = 8, 32
#: Every ``TAMPER``-th document by checksum is tampered with in the check.
TAMPER = 7


def joined(*nodes: bytes) -> bytes:
    """The parent of a run: the hash of the nodes' hexadecimal texts."""
    return hashlib.sha256("".join(x.hex() for x in nodes).encode()).digest()


def height(leaves: int) -> int:
    return (leaves - 1).bit_length()


def position(level: int, index: int, leaves: int) -> int:
    """Place of a node in the postorder log of a tree of ``leaves``; ``index`` counts the nodes of its level.

    After e leaves 2e - popcount(e) full nodes are written, the ones that end at e in the order of their levels. Nodes
    that are cut short by the end of the tree all hold its last leaf, so they follow behind, again by level.
    """
    end = (index + 1) << level
    if end <= leaves:
        return 2 * end - end.bit_count() - ((end & -end).bit_length() - 1 - level) - 1
    return 2 * leaves - leaves.bit_count() + level - (leaves & -leaves).bit_length()


def append_log(leaves: list[bytes], levels: int) -> bytes:
    """The nodes over ``leaves`` up to ``levels``, in the order in which they are complete."""
    log, stack = [], []
    for node in leaves:
        level = 0
        log.append(node)
        while stack and stack[-1][0] == level:
            node, level = joined(stack.pop()[1], node), level + 1
            log.append(node)
        stack.append((level, node))
    level, node = stack.pop()
    while level < levels:
        node = joined(stack.pop()[1], node) if stack and stack[-1][0] == level else joined(node)
        level += 1
        log.append(node)
    return b"".join(log)


def siblings(log: bytes, leaf: int, leaves: int, levels: int) -> tuple[str, bytes]:
    """Of each level the side on which the run's other node stands (``L``, ``R``, ``-`` for none), and these nodes, addressed in the log."""
    sides, found = [], []
    for level in range(levels):
        index = leaf >> level
        other = index ^ 1
        if other << level >= leaves:
            sides.append("-")
            continue
        at = position(level, other, leaves) * DIGEST
        sides.append("L" if other < index else "R")
        found.append(log[at : at + DIGEST])
    return "".join(sides), b"".join(found)


def folded(node: bytes, sides: str, found: bytes) -> bytes:
    """The top that follows from a leaf and its siblings."""
    at = 0
    for side in sides:
        if side == "-":
            node = joined(node)
            continue
        other = found[at : at + DIGEST]
        node, at = joined(other, node) if side == "L" else joined(node, other), at + DIGEST
    return node


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_rows(documents: DataFrame, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """``tree, id, leaf, forged`` of every row; ``forged`` is the leaf after the tampering, null where there is none."""
    c = {k: F.col(f"`{k}`") for k in (id_col, "source", group_col, "n_chars", "text")}
    number, chars = c[id_col].cast("long"), c["n_chars"].cast("long")

    def leaf(n: Column) -> Column:
        return F.unhex(F.sha2(F.concat(*map(field, (number, c["source"], c[group_col], n, c["text"]))), 256))

    tampered = F.pmod(F.crc32(number.cast("string").cast("binary")), F.lit(TAMPER)) == 0
    more = chars.cast("decimal(20,0)") + 1
    # null comes before every value, and '=' keeps the order of the values
    tree = F.coalesce(F.concat(F.lit("="), c[group_col].cast("string")), F.lit(""))
    return documents.select(tree.alias("tree"), number.alias("id"), leaf(chars).alias("leaf"), F.when(tampered, leaf(more)).alias("forged"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``index`` among those of their ``tree`` and ``n``, the tree's number of rows; a large tree is spread over many tasks."""
    by = ["tree", *order]
    placed = stash(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.expr("shiftright(row, 33)")), "placed")
    counts = placed.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count("*").alias("count"))
    whole = Window.partitionBy("tree")
    counts = counts.withColumn("n", F.sum("count").over(whole)).withColumn("before", F.sum("count").over(whole.orderBy("part")) - F.col("count"))
    out = placed.join(counts.drop("count"), ["tree", "part"]).withColumn("index", F.expr("row - first + before")).drop("row", "part", "first", "before")
    out.stashed_at = placed.stashed_at
    return out


SEGMENT = "tree string, block long, n long, ids array<bigint>, forged array<binary>, log binary, top binary"


def _segments(nodes: DataFrame, bits: int) -> DataFrame:
    """One row per aligned builder: ``tree, index, n, id, leaf, forged`` -> its log."""

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("index")
        n, block = group["n"][0].as_py(), group["block"][0].as_py()
        log = append_log(group["leaf"].to_pylist(), levels_of(n, bits))
        ids, forged = group["id"].to_pylist(), group["forged"].to_pylist()
        row = {"tree": group["tree"][0].as_py(), "block": block, "n": n, "ids": ids, "forged": forged, "log": log, "top": log[-DIGEST:]}
        return pa.Table.from_pylist([row], schema=shape)

    shape = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("forged", pa.list_(pa.binary())), ("log", pa.binary()), ("top", pa.binary())])
    blocked = nodes.withColumn("block", F.expr(f"shiftright(index, {bits})"))
    return blocked.groupBy("tree", "block").applyInArrow(build, SEGMENT)


def levels_of(n: int, bits: int) -> int:
    """Levels that a builder adds in a round in which its tree has ``n`` nodes."""
    return min(bits, height(n))


def _rounds(leaves: DataFrame, bits: int) -> list[DataFrame]:
    """The segments of every round; trees of no more than ``2**bits`` nodes end in theirs."""
    out = [stash(_segments(leaves, bits), "segments")]
    while out[-1].filter(f"n > {1 << bits}").limit(1).count():
        tops = out[-1].filter(f"n > {1 << bits}").select("tree", F.col("block").alias("index"), F.expr(f"shiftright(n + {(1 << bits) - 1}, {bits})").alias("n"), F.lit(None).cast("long").alias("id"), F.col("top").alias("leaf"), F.lit(None).cast("binary").alias("forged"))
        out.append(stash(_segments(tops, bits), "segments"))
    return out


def _tops(rounds: list[DataFrame], bits: int) -> DataFrame:
    """``tree, top``: the subroots."""
    ended = [r.filter(f"n <= {1 << bits}").select("tree", "top") for r in rounds]
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return out


@dataclass
class Manifest:
    """The logs of all trees and of the tree over their subroots (``crown``), each a table per round.

    ``subroots`` (tree, subroot, index) has the crown's leaves in order; ``root`` is null for no rows.
    """

    rounds: list[DataFrame]
    crown: list[DataFrame]
    subroots: DataFrame
    root: str | None
    bits: int


def manifest(documents: DataFrame, id_col: str = "doc_id", group_col: str = "lang", bits: int = BITS) -> Manifest:
    """Build the logs. ``documents`` has ``source, n_chars, text`` besides the named columns; others are ignored.

    Null ids come first, rows of equal ids stand in the order of their leaves; a null group is a tree of its own, an empty
    one another. Every row is a leaf, repeated rows too.
    """
    rows = numbered(leaf_rows(documents, id_col, group_col), ["id", "leaf"])
    rounds = _rounds(rows, bits)
    discard(rows)
    tops = _tops(rounds, bits).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("leaf"))
    named = numbered(tops, ["name"])
    crown = _rounds(named.withColumn("id", F.col("index")).withColumn("forged", F.lit(None).cast("binary")), bits)
    last = crown[-1].filter(f"n <= {1 << bits}").select("top").first()  # one row: the crown is one tree
    subroots = named.select(F.col("name").alias("tree"), F.col("leaf").alias("subroot"), "index")
    return Manifest(rounds, crown, subroots, bytes(last.top).hex() if last else None, bits)


PATH = "tree string, index long, leaf binary, sides string, found binary"


def _paths(segments: DataFrame, bits: int) -> DataFrame:
    """The steps from each leaf of a round's segments to the top of its tree; ``up_sides, up_found`` are those of the segments' tops."""

    def extract(group: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("tree", "index", "leaf", "sides", "found")}
        for row in group.to_pylist():
            for leaf, path in _leaves(row, bits):
                for k, v in zip(out, (row["tree"], (row["block"] << bits) + leaf, row["log"][(p := position(0, leaf, len(row["ids"])) * DIGEST) : p + DIGEST], *path), strict=True):
                    out[k].append(v)
        return pa.table(out, schema=pa.schema([("tree", pa.string()), ("index", pa.int64()), ("leaf", pa.binary()), ("sides", pa.string()), ("found", pa.binary())]))

    return segments.groupBy("tree", "block").applyInArrow(extract, PATH)


def _leaves(row: dict, bits: int) -> Iterator[tuple[int, tuple[str, bytes]]]:
    leaves, levels = len(row["ids"]), levels_of(row["n"], bits)
    for leaf in range(leaves):
        sides, found = siblings(row["log"], leaf, leaves, levels)
        yield leaf, (sides + (row["up_sides"] or ""), found + (row["up_found"] or b""))


def _above(rounds: list[DataFrame], ends: DataFrame, bits: int) -> DataFrame:
    """The first round's segments with ``up_sides, up_found`` of their tops; ``ends`` (tree, end_sides, end_found) has what follows a tree's own top."""
    above = None
    for segments in reversed(rounds):
        last = segments.filter(f"n <= {1 << bits}").join(ends, "tree", "left").withColumnsRenamed({"end_sides": "up_sides", "end_found": "up_found"})
        joined_up = last
        if above is not None:
            inner = segments.filter(f"n > {1 << bits}").join(above.select("tree", F.col("index").alias("block"), F.col("sides").alias("up_sides"), F.col("found").alias("up_found")), ["tree", "block"])
            joined_up = last.unionByName(inner)
        if segments is rounds[0]:
            return joined_up
        above = stash(_paths(joined_up, bits), "paths")
    raise ValueError("no rounds")


def proofs(m: Manifest, id_col: str = "doc_id") -> DataFrame:
    """``leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``folded_root`` is computed from the tampered leaf, where there is one, and the siblings of the true one. A null
    number of characters stays as it is when tampered with, so such rows verify.
    """
    none = m.crown[0].select("tree", F.lit("").alias("end_sides"), F.lit(b"").alias("end_found")).limit(0)
    crowned = _paths(_above(m.crown, none, m.bits), m.bits).select("index", F.col("sides").alias("end_sides"), F.col("found").alias("end_found"))
    ends = stash(m.subroots.join(crowned, "index").drop("index"), "ends")
    segments = _above(m.rounds, ends.drop("subroot"), m.bits).join(ends.select("tree", "subroot"), "tree")
    root, bits = m.root, m.bits

    def check(group: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in RESULT}
        for row in group.to_pylist():
            n, log = len(row["ids"]), row["log"]
            for leaf, (sides, found) in _leaves(row, bits):
                at = position(0, leaf, n) * DIGEST
                node = log[at : at + DIGEST]
                top = folded(row["forged"][leaf] or node, sides, found).hex()
                for k, v in zip(RESULT, (row["ids"][leaf], node.hex(), row["subroot"].hex(), root, hashlib.sha256(found.hex().encode()).hexdigest(), top, top == root), strict=True):
                    out[k].append(v)
        return pa.table(out, schema=pa.schema([("id", pa.int64()), *[(k, pa.string()) for k in RESULT[1:-1]], ("verified", pa.bool_())]))

    return segments.groupBy("tree", "block").applyInArrow(check, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").withColumnRenamed("id", id_col)


RESULT = ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def log(m: Manifest) -> DataFrame:
    """``group, position, level, index, digest``: every node of every tree at its place in the whole tree's postorder log."""
    sizes = m.rounds[0].groupBy("tree").agg(F.first("n").alias("leaves"))
    out, bits = None, m.bits
    for k, segments in enumerate(m.rounds):

        def spread(batches, k=k):
            for batch in batches:
                for row in batch.to_pylist():
                    n, levels, first = len(row["ids"]), levels_of(row["n"], bits), row["block"] << bits
                    nodes = [(level, index) for level in range(1 if k else 0, levels + 1) for index in range((n - 1 >> level) + 1)]
                    yield pa.RecordBatch.from_pylist(
                        [
                            {"tree": row["tree"], "position": position(level + k * bits, (first >> level) + index, row["leaves"]), "level": level + k * bits, "index": (first >> level) + index, "digest": row["log"][(p := position(level, index, n) * DIGEST) : p + DIGEST].hex()}
                            for level, index in nodes
                        ],
                        schema=pa.schema([("tree", pa.string()), ("position", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())]),
                    )

        part = segments.join(sizes, "tree").mapInArrow(spread, "tree string, position long, level int, index long, digest string")
        out = part if out is None else out.unionByName(part)
    return out.select(F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias("group"), "position", "level", "index", "digest")
