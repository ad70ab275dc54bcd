"""Removal of repeated passages against a loop over all strings, and the sorter against plain sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import suffix_dedup as S

N = S.LENGTH


def brute(rows, tie):
    """rows: (id, text); tie: order of texts of one id."""
    rank = lambda d: (1 << 63) - 1 if d is None else d
    seen, out = set(), {}
    for d, t in sorted({(rank(d), t or "") for d, t in rows}, key=lambda x: (x[0], tie[x[1]])):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - N + 1):
            s = b[p : p + N]
            if s in seen:
                gone[p : p + N] = b"\1" * N
            seen.add(s)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d, t] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return [(d, *out[rank(d), t or ""]) for d, t in rows]


def passages():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows, shared = [(i, prose(rng.randint(0, 200))) for i in range(60)], [prose(40) for _ in range(5)]
    for i in range(60, 140):
        parts = [rng.choice([prose(rng.randint(0, 30)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 60) : rng.randint(80, 300)]]) for _ in range(rng.randint(1, 5))]
        rows.append((i, " ".join(parts)))
    near = list(shared[4])
    for i in range(140, 160):  # near copies that drift apart
        near[i * 11 % len(near)] = "#"
        rows.append((i, "".join(near)))
    rows += [(200, "a" * 1000), (201, "a" * N), (202, "a" * (N - 1)), (203, "ab" * 300), (204, "b" + "a" * 400 + "b"), (205, None), (206, ""), (None, shared[0]), (None, None)]
    rows += [(300, shared[1]), (300, shared[1]), (300, shared[2] + shared[1]), (301, "\0" * 300 + shared[3]), (302, "\0" * 150), (-5, shared[3])]
    return rows


@pytest.mark.parametrize("many", [S.MANY, 2])
def test_against_all_strings(spark, many):
    rows = passages()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tie = {r.text: r.h for r in frame.select(F.coalesce("text", F.lit("")).alias("text")).selectExpr("text", "xxhash64(text) h").collect()}
    for c in ("id", "did", "tie", "data", "starts", "n", "kind", "a.b"):
        frame = frame.withColumn(c, F.lit("clash"))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(frame, many=many).collect()]
    want = brute(rows, tie)
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(r[2] for r in want) > 10_000


def test_texts_longer_than_a_block(spark):
    """A long text is read in parts: passages across their borders, and repeats within it, are found."""
    rng = np.random.default_rng(2)
    long = rng.integers(97, 123, 2_600_000).astype(np.uint8).tobytes().decode()
    edge = S._STEP
    cut = long[edge - 150 : edge + 250]
    rows = [(1, long + long[1_000_000:1_000_120]), (2, cut), (3, long[:99] + "!" + long[2 * edge - 99 : 2 * edge + 1])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (120, 1), 2: (400, 1), 3: (100, 1)}


def test_empty_and_short(spark):
    frame = spark.createDataFrame([(1, "x" * 50), (2, "x" * 50), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in S.remove_repeats(frame).collect()) == [(1, 50, 0, 0), (2, 50, 0, 0), (3, 0, 0, 0)]
    assert S.remove_repeats(frame.limit(0)).collect() == []


@pytest.mark.parametrize("letters", [1, 2, 3, 256])
def test_two_stage_order(letters):
    rng = np.random.default_rng(letters)
    for _ in range(40):
        owned = rng.integers(1, N - S.K + 2, rng.integers(1, 8))
        lengths = owned + N - 1
        base = rng.integers(0, letters, 400).astype(np.uint8)
        pieces = [base[o : o + n] if rng.random() < 0.7 else rng.integers(0, letters, n).astype(np.uint8) for o, n in ((int(rng.integers(0, 200)), int(n)) for n in lengths)]
        text, starts = np.concatenate(pieces), np.cumsum(lengths) - lengths
        order = S.suffix_order(text, starts, lengths, owned)
        assert sorted(order) == np.concatenate([np.arange(s, s + n) for s, n in zip(starts, owned, strict=True)]).tolist()
        strings = [text[i : i + N].tobytes() for i in order]
        assert strings == sorted(strings)
        prefixes = S.common_prefixes(text, order)
        for a, b, got in zip(strings, strings[1:], prefixes[1:], strict=False):
            assert got == next((i for i in range(N) if a[i] != b[i]), N)


def test_only_smaller_suffixes_are_compared(monkeypatch):
    """Falling runs are placed by the scan: the direct sort sees less than 0.6 of random suffixes and none of a falling text."""
    seen = []
    plain = np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *k, **w: (seen.append(len(a)) if a.dtype.kind == "S" else None, plain(a, *k, **w))[1])
    rng = np.random.default_rng(4)
    text = rng.integers(0, 256, 168).astype(np.uint8)
    S.suffix_order(text, np.array([0]), np.array([168]), np.array([69]))
    assert 0 < sum(seen) < 0.6 * 69 + 1
    seen.clear()
    S.suffix_order(np.arange(168, 0, -1).astype(np.uint8), np.array([0]), np.array([168]), np.array([69]))
    assert not seen
