"""Levels, nodes and their genealogy against a plain bar-by-bar walk."""

import random

from quayside.operators import levels, nodes, structure
from quayside.operators.nodes import LOWER, NEUTRAL, UPPER

M4 = 240_000_000_000
DAY = 86_400_000_000_000
SCHEMA = "inst long, s_open long, s_close long, open_ns long, close_ns long, o long, h long, l long, c long"


def make_bars(seed, inst, days=9):
    rng, rows, px = random.Random(seed), [], 10_000
    for d in range(days):
        s_open, slots = d * DAY, sorted(rng.sample(range(60), 18))
        if d == 3:
            slots = [s for s in slots if s >= 31] or [40]
        for s in slots:
            o, c = px, px + rng.randint(-30, 30)
            rows.append((inst, s_open, s_open + DAY // 2, s_open + s * M4, s_open + (s + 1) * M4, o, max(o, c) + rng.randint(0, 15), min(o, c) - rng.randint(0, 15), c))
            px = c
    return rows


def walk(bars):
    """bar_ns -> active levels {(kind, session): (lower, upper, price, side)} after each bar, from the rules by hand."""
    out, by_session = {}, {}
    for n, b in enumerate(bars):
        _, s_open, s_close, open_ns, _, _, h, lo, _ = b
        by_session.setdefault(s_open, []).append(b)
        order = sorted(by_session)
        k = order.index(s_open)
        live = {}
        for j in range(max(0, k - structure.RETAINED), k + 1):
            own = by_session[order[j]]
            top = next(x for x in own if x[6] == max(y[6] for y in own))
            low = next(x for x in own if x[7] == min(y[7] for y in own))
            live["upper band", j] = (max(top[5], top[8]), top[6], top[6], UPPER)
            live["lower band", j] = (low[7], min(low[5], low[8]), low[7], LOWER)
        if k:
            own = by_session[order[k - 1]]
            hi, lw = max(y[6] for y in own), min(y[7] for y in own)
            live["previous high"], live["previous low"] = (hi, hi, hi, UPPER), (lw, lw, lw, LOWER)
        own = by_session[s_open]
        hi, lw = max(y[6] for y in own), min(y[7] for y in own)
        live["high"], live["low"] = (hi, hi, hi, UPPER), (lw, lw, lw, LOWER)
        early = [y for y in own if y[3] < min(s_open + structure.OPENING_NS, s_close)]
        if early:
            hi, lw = max(y[6] for y in early), min(y[7] for y in early)
            mid = lw + (hi - lw) // 2
            live["opening high"], live["opening low"], live["opening mid"] = (hi, hi, hi, UPPER), (lw, lw, lw, LOWER), (mid, mid, mid, nodes.CENTER)
        seen = bars[max(0, n - structure.LOOKBACK + 1) : n + 1]
        if len(seen) > 1:
            hi, lw = max(y[6] for y in seen), min(y[7] for y in seen)
            for i, f in enumerate(structure.FRACTIONS):
                p = lw + (hi - lw) * f // 1_000_000
                live["projection", i] = (p, p, p, LOWER if i == 0 else UPPER if i == 7 else NEUTRAL)
        out[open_ns] = sorted(live.values())
    return out


def test_structure_against_a_walk(spark):
    bars = {i: make_bars(i, i) for i in (1, 2)}
    frame = spark.createDataFrame(bars[1] + bars[2], SCHEMA).repartition(3)
    log = structure.mutations(frame)
    assert levels.violations(log).isEmpty() and levels.sequence_breaks(log).isEmpty()
    generations = log.select("inst", "generation", "bar_ns").distinct()
    got = {}
    for r in levels.active(levels.versions(log), generations).collect():
        got.setdefault((r.inst, r.bar_ns), []).append((r.lower, r.upper, r.price, r.side))
    for inst, rows in bars.items():
        last = None
        for bar_ns, want in walk(rows).items():
            if (inst, bar_ns) in got:
                last = sorted(got[inst, bar_ns])
            assert last == want, (inst, bar_ns)  # a bar without a generation changed nothing

    rows = sorted(structure.structure(frame).collect(), key=lambda r: (r.inst, r.generation))
    previous = {}
    for r in rows:
        members = [m for n in r.nodes for m in n.members]
        assert len(members) == len(set(members)) == len(got[r.inst, r.bar_ns])
        ids = [n.node for n in r.nodes]
        assert len(set(ids)) == len(ids) and all(i >> 32 == r.inst for i in ids)
        told = {"created": set(), "merged": set(), "preserved": set(), "split": set(), "expired": set()}
        for e in r.events:
            told[e.event].add(e.node)
        before = previous.get(r.inst, set())
        assert set(ids) == told["created"] | told["merged"] | told["preserved"] and not told["created"] & before
        assert told["expired"] <= before - set(ids)
        previous[r.inst] = set(ids)
    assert {e.event for r in rows for e in r.events} == {"created", "merged", "preserved", "split", "expired"}


def test_book_rules(spark):
    names = "inst long, generation long, ordinal int, kind string, level_id long, lower long, upper long, price long, group_id long, side int, family int"
    ok = [(1, 1, 1, "created", 5, 1, 3, 2, 0, 0, 1), (1, 2, 1, "updated", 5, 1, 4, 2, 0, 0, 1), (1, 3, 1, "frozen", 5, None, None, None, 0, 0, 1), (1, 4, 1, "expired", 5, None, None, None, 0, 0, 1)]
    bad = [
        (1, 4, 2, "updated", 6, 1, 1, 1, 0, 0, 1), (1, 5, 1, "updated", 5, 1, 1, 1, 0, 0, 1), (1, 6, 1, "created", 7, 3, 1, 2, 0, 0, 1), (1, 6, 2, "updated", 7, 1, 1, 1, 0, 0, 2),
        (1, 8, 1, "created", 7, 1, 1, 1, 0, 0, 2), (1, 8, 2, "created", 0, 1, 1, 1, 0, 0, 1),
    ]
    frame = spark.createDataFrame(ok + bad, names)
    assert levels.violations(spark.createDataFrame(ok, names)).isEmpty()
    got = sorted((r.generation, r.level_id, r.rule) for r in levels.violations(frame).collect())
    assert got == [(4, 6, "unknown identity"), (5, 5, "immutable identity"), (6, 7, "geometry"), (6, 7, "identity drift"), (8, 0, "missing identity"), (8, 7, "duplicate identity")]
    assert [(r.generation, r.expected) for r in levels.sequence_breaks(frame).collect()] == [(8, 7)]
    spans = sorted((r.from_generation, r.to_generation, r.upper, r.state, r.age) for r in levels.versions(spark.createDataFrame(ok, names)).collect())
    assert spans == [(1, 2, 3, "developing", 0), (2, 3, 4, "developing", 1), (3, 4, 4, "frozen", 1)]


def test_clusters_keep_groups_and_sides_apart():
    rows = [(1000, 1000, 1000, 1, 7, UPPER), (1003, 1003, 1003, 2, 0, UPPER), (1004, 1004, 1004, 3, 7, UPPER), (1005, 1005, 1005, 4, 0, LOWER), (1018, 1022, 1020, 5, 9, NEUTRAL)]
    assert [(c["low"], c["high"], c["center"], c["members"]) for c in nodes.cluster(rows, 5)] == [(1000, 1003, 1001, [1, 2]), (1004, 1004, 1004, [3]), (1005, 1005, 1005, [4]), (1018, 1022, 1020, [5])]
    assert nodes.cluster([], 5) == []


def test_locate_and_corridors(spark):
    made = "inst long, generation long, atr long, px long, nodes array<struct<node:bigint,low:bigint,high:bigint,center:bigint>>"
    two = [(11, 990, 1000, 995), (12, 1020, 1030, 1025)]
    frame = spark.createDataFrame([(1, g, 40, px, two) for g, px in enumerate((995, 1010, 900, 1100))] + [(1, 9, 0, 5, [])], made)
    got = [tuple(r)[5:] for r in nodes.locate(frame).orderBy("generation").collect()]
    assert got == [("inside", 11, 11, 5, 5), ("between", 11, 12, 10, 10), ("below", None, 11, None, 90), ("above", 12, None, 70, None), ("unavailable", None, None, None, None)]
    assert tuple(nodes.corridors(frame.where("generation = 0")).first())[2:] == (11, 12, 1000, 1020, 20, 500_000)
