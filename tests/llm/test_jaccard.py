from __future__ import annotations

import random
import re

from parlance.llm import jaccard, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(docs):
    """Brute force: sets of all, all pairs, union-find."""
    sets, parent = [], list(range(len(docs)))
    for _, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            smallest[find(i)] = min(k, smallest.get(find(i), k))
    return sorted(((k, len(sets[i]), smallest.get(find(i))) for i, (k, _) in enumerate(docs)), key=repr)


def found(spark, docs):
    out = jaccard.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr)


def near_copies(seed, base_words, copies, edits, start):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(base_words)]
    out = []
    for k in range(copies):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append((start + k, " ".join(w)))
    return out


def test_links_of_near_copies(spark):
    docs = near_copies(1, 120, 60, 3, 0) + near_copies(2, 60, 12, 1, 100) + near_copies(3, 300, 8, 9, 200)
    docs += [(300, "one two"), (301, "One TWO"), (302, "one two three"), (303, ""), (304, " \n"), (305, docs[0][1]), (306, None)]
    assert found(spark, docs) == expected(docs)


def test_blocks_of_frequent_columns(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 3)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    monkeypatch.setattr(jaccard, "PENDING", 50)
    docs = near_copies(5, 90, 50, 4, 0) + near_copies(6, 90, 50, 6, 100)
    assert found(spark, docs) == expected(docs)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"a{i}" for i in range(40))
    docs = [(5, text), (5, text), (None, text), (7, "other words that stand alone here"), (None, None), (9, None)]
    assert found(spark, docs) == expected(docs)


def test_empty_table_and_other_columns(spark):
    assert found(spark, []) == []
    clash = spark.createDataFrame([(1, "a b c d e f", 3, "x")], "doc_id long, text string, key int, component string")
    assert jaccard.join(clash).collect()[0].component_id == 1
    kept = jaccard.deduplicated(spark.createDataFrame([(2, "a b c d e f", "u"), (1, "a b c d e f", "v"), (1, "a b c d e f", "w")], "doc_id long, text string, rep string"))
    assert [(r.doc_id, r.text) for r in kept.collect()] == [(1, "a b c d e f")]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    out = {r.node: r.component for r in rows.components(links).collect()}
    assert out == {i: 0 for i in range(31)} | {100: 100, 101: 100}
