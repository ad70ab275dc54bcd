"""The manifest against trees built by plain loops, and its layout."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(row):
    out = [row]
    while len(row) > 1:
        row = [sha("".join(row[i : i + 16])) for i in range(0, len(row), 16)]
        out.append(row)
    return out


def way(tree, i):
    out = []
    for row in tree[:-1]:
        a = i // 16 * 16
        out.append(("".join(row[a:i]), "".join(row[i + 1 : a + 16])))
        i //= 16
    return out


def brute(rows):
    groups = {}
    for doc_id, source, lang, n_chars, text in rows:
        changed = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            changed = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        leaf, other = (sha("".join(map(field, (doc_id, source, lang, n_chars, t)))) for t in (text, changed))
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, other))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s])]) for s in names}
    top = levels([trees[s][-1][0] for s in names]) if names else None
    out = []
    for g, s in enumerate(names):
        for i, (known, doc_id, leaf, other) in enumerate(sorted(groups[s])):
            path, node = way(trees[s], i) + way(top, g), other
            for a, b in path:
                node = sha(a + node + b)
            out.append((doc_id if known else None, leaf, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return out


NAMES = "doc_id long, source string, lang string, n_chars long, text string"


def frame(spark, rows):
    out = spark.createDataFrame(rows, NAMES).repartition(5)
    for c in ("tree", "k", "digest", "item", "a.b"):
        out = out.withColumn(c, F.lit("clash"))
    return out


@pytest.mark.parametrize("block", [1, 2, 3])
def test_proofs_against_loops(spark, block):
    rows = [(i, f"s{i % 3}" if i % 9 else None, "en" if i % 4 else None, i * 7 if i % 5 else None, f"Text Nr. {i} é \U0001f600" if i % 11 else None) for i in range(300)]
    rows += [(1000 + i, "hot", "en", 1, "X" * (i % 3)) for i in range(700)]  # three levels, the last run uneven
    rows += [(5, "lone", None, None, ""), (None, "s1", "en", 1, "ABC"), (None, "s1", "en", 1, "ABC"), (7, "s1", "de", 1, "Same Id"), (7, "s1", "de", 1, "Same Id"), (9, "", "x", 0, "Z"), (9, "é", "x", 0, "Z"), (20, "zz", "x", 0, "Long " * 20_000)]
    got = [tuple(r) for r in merkle.proofs(frame(spark, rows), block).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    assert 0 < sum(not r[-1] for r in got) < len(rows) / 3


def test_many_groups_and_small_tables(spark):
    rows = [(i, f"g{i}", "en", 1, "T") for i in range(40)]
    assert sorted(map(repr, map(tuple, merkle.proofs(frame(spark, rows), 1).collect()))) == sorted(map(repr, brute(rows)))
    assert [tuple(r) for r in merkle.proofs(frame(spark, rows[:1])).collect()] == brute(rows[:1])
    assert merkle.proofs(frame(spark, rows[:0])).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_layout_keeps_subtrees_together(n):
    every = np.concatenate([merkle.address(n, d, np.arange(16**d)) for d in range(n)])
    assert sorted(every.tolist()) == list(range(merkle.tree_size(n)))  # a bijection
    upper, lower = n // 2, n - n // 2
    if n > 1:
        assert max(merkle.address(n, upper - 1, np.arange(16 ** (upper - 1)))) < merkle.tree_size(upper)
        starts = merkle.address(n, upper, np.arange(16**upper))
        assert (np.diff(starts) == merkle.tree_size(lower)).all()
        for d in range(lower):  # each lower subtree lies whole behind its root, in the same order
            inside = merkle.address(n, upper + d, np.arange(16 ** (upper + d))).reshape(16**upper, -1)
            assert (inside - starts[:, None] == merkle.address(lower, d, np.arange(16**d))).all()


def test_block_of_every_size():
    for n in (1, 2, 15, 16, 17, 33, 256, 257, 300):
        leaves = [sha(str(i)) for i in range(n)]
        tree = levels(leaves)
        nodes = merkle.built(leaves, len(tree) - 1)
        assert nodes[0] == tree[-1][0]
        for i, path in enumerate(merkle.sides(nodes, len(tree) - 1, n)):
            assert path == way(tree, i) and merkle.folded(leaves[i], path) == nodes[0]
