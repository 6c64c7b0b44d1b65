"""The Merkle manifest against a tree built level by level."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from parlance.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def steps(tree: list[list[str]], k: int) -> list[tuple[str | None, bool]]:
    """Of each level the sibling, if any, and whether it stands on the left."""
    out = []
    for level in tree[:-1]:
        other = k ^ 1
        out.append((level[other] if other < len(level) else None, other < k))
        k //= 2
    return out


def expected(rows):
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    crown = levels([trees[g][-1][0] for g in names])
    out = []
    for place, g in enumerate(names):
        for k, (_, _, node, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = steps(trees[g], k) + steps(crown, place)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            top = leaf(*r[:3], r[3] + 1, r[4]) if tampered else node
            for other, left in path:
                top = H(top) if other is None else H(other, top) if left else H(top, other)
            out.append((r[0], node, trees[g][-1][0], crown[-1][0], H(*(x for x, _ in path if x is not None)), top, top == crown[-1][0]))
            assert (top == crown[-1][0]) != tampered
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", *merkle.RESULT[1:]).collect()), key=str)


def rows_of(n: int) -> list[tuple]:
    draw = random.Random(3)
    out = [(k, draw.choice(["s1", "", None]), "en" if k % 3 else draw.choice(["de", "fr", "", None, "é", "z"]), draw.choice([k, None]), draw.choice([f"text {k} é漢", "", None])) for k in range(n)]
    return [*out, *out[:9], (None, "s", "en", 1, "a"), (None, "s", "en", 2, "a"), (7, None, "only one", 2**63 - 1, "x"), (-5, "s", "en", -1, "y")]


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_proofs_equal_a_tree_built_level_by_level(spark, bits):
    rows = rows_of(150)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert found(merkle.proofs(merkle.manifest(df, bits=bits))) == expected(rows)


def test_single_rows_and_empty_tables(spark):
    one = [(1, "s", None, 3, "abc")]
    assert found(merkle.proofs(merkle.manifest(spark.createDataFrame(one, COLUMNS)))) == expected(one)
    m = merkle.manifest(spark.createDataFrame([], COLUMNS))
    assert m.root is None and merkle.proofs(m).count() == 0 and merkle.log(m).count() == 0


def test_positions_are_the_postorder():
    def written(level: int, index: int, n: int) -> list[tuple[int, int]]:
        if level == 0:
            return [(0, index)]
        below = [c for c in (2 * index, 2 * index + 1) if c << (level - 1) < n]
        return [x for c in below for x in written(level - 1, c, n)] + [(level, index)]

    for n in [*range(1, 70), 255, 256, 257]:
        order = written(merkle.height(n), 0, n)
        assert [merkle.position(level, index, n) for level, index in order] == list(range(len(order)))
        leaves = [hashlib.sha256(bytes([k % 256])).digest() for k in range(n)]
        log = merkle.append_log(leaves, merkle.height(n))
        tree = levels([x.hex() for x in leaves])
        assert [log[32 * p : 32 * p + 32].hex() for p in range(len(order))] == [tree[level][index] for level, index in order]


def test_log_of_a_tree_over_several_rounds(spark):
    rows = rows_of(150)
    m = merkle.manifest(spark.createDataFrame(rows, COLUMNS), bits=2)
    assert len(m.rounds) > 2
    nodes: dict = {}
    for r in merkle.log(m).collect():
        nodes.setdefault(r.group, []).append((r["position"], r["level"], r["index"], r["digest"]))
    for g in {r[2] for r in rows}:
        of_group = sorted((r[0] is not None, r[0] or 0, leaf(*r)) for r in rows if r[2] == g)
        tree = levels([x[2] for x in of_group])
        got = sorted(nodes[g])
        assert [p for p, *_ in got] == list(range(sum(map(len, tree))))
        assert all(tree[level][index] == digest for _, level, index, digest in got)


def test_columns_named_like_inner_ones(spark):
    rows = rows_of(20)
    inner = "tree string, id long, leaf string, forged string, row int, part int, index int, n int, block int, top string, log string"
    more = [(*r, "t", 1, "l", "f", 2, 3, 4, 5, 6, "x", "y") for r in rows]
    assert found(merkle.proofs(merkle.manifest(spark.createDataFrame(more, f"{COLUMNS}, {inner}")))) == expected(rows)


def test_one_group_of_nearly_all_rows_is_spread(spark):
    rows = [(k, "s", "en" if k % 50 else "de", k, f"t{k}") for k in range(5000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        m = merkle.manifest(spark.createDataFrame(rows, COLUMNS))
        assert m.rounds[0].count() > 4900 // 256 and m.rounds[0].selectExpr("max(size(ids))").first()[0] == 256
        assert found(merkle.proofs(m)) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
