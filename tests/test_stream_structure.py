"""The structural engine on a stream, genealogy in blocks and the book's replay against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quayside.operators import levels, nodes, structure
from quayside.streaming import structure as live
from test_structure import SCHEMA, make_bars

NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
VERSION = ["inst", "level_id", "from_generation", "to_generation", "lower", "upper", "price", "group_id", "side", "family", "age", "state"]


def as_moves(bars):
    return [dict(zip(NAMES, b, strict=True)) | {"at_ns": b[4]} for b in bars]


def nodes_of(found):
    return [(n["node"], n["low"], n["high"], n["center"], list(n["sides"]), list(n["members"]), n["created_ns"], n["updated_ns"]) for n in found]


def test_engine_equals_history(spark):
    bars = {i: make_bars(i, i, days=12) for i in (1, 2)}
    frame = spark.createDataFrame(bars[1] + bars[2], SCHEMA).repartition(3)
    whole = {(r.inst, r.generation): r for r in structure.structure(frame).collect()}
    for inst, rows in bars.items():
        engine, most = live.Engine(inst), 0
        for b in as_moves(rows):
            found = engine.on_bar(b)
            most = max(most, len(engine.levels))
            if found:
                want = whole.pop((inst, found["generation"]))
                assert (want.bar_ns, want.at_ns, want.atr) == (found["bar_ns"], found["at_ns"], found["atr"])
                assert nodes_of(want.nodes) == nodes_of(found["nodes"])
                assert sorted((e.event, e.node, e.others) for e in want.events) == sorted((e["event"], e["node"], e["others"]) for e in found["events"])
        assert most <= 2 + 2 + 2 + 2 * structure.RETAINED + 3 + len(structure.FRACTIONS)  # state: what is active
    assert not whole


def test_stream_in_turns(spark, tmp_path):
    bars = make_bars(3, 1) + make_bars(4, 2)
    frame = spark.createDataFrame(bars, SCHEMA)
    want = sorted(map(repr, levels.versions(structure.mutations(frame)).select(*VERSION).collect()))
    day, folder = 86_400_000_000_000, str(tmp_path)
    prices = [(1, 7, 2 * day + 5, 10_000), (2, 8, 8 * day + day // 2, 9_990), (1, 9, 2 * day, 10_001)]  # the last one comes late
    for turn, (first, last) in enumerate(((0, 4), (4, 9))):
        sent = frame.where(F.col("s_open").between(first * day, last * day - 1))
        asked = spark.createDataFrame([p for p in prices if (p[1] == 7) == (turn == 0)], "inst long, seq long, ts_ns long, px long")
        moves = live.moves(sent, asked)
        if turn:  # a bar that opens before the last one
            moves = moves.unionByName(live.moves(frame.where(F.col("s_open") == 0).limit(1)))
        moves.coalesce(1).write.parquet(f"{folder}/in/{turn}")
        live.stream_structure(spark.readStream.schema(live.INPUT).parquet(f"{folder}/in/*"), folder).awaitTermination()
    emitted = spark.read.parquet(f"{folder}/emitted")
    assert sorted(map(repr, live.level_versions(emitted).select(*VERSION).collect())) == want
    assert emitted.where(F.col("kind") == live.REFUSED).count() == 1
    placed = {r.seq: r for r in live.placed_prices(emitted).collect()}
    assert {s: r.late for s, r in placed.items()} == {7: False, 8: False, 9: True} and all(r.place != "unavailable" for r in placed.values())


def generations(seed):
    """Clusters at few places with few levels, so that ties by overlap and distance abound."""
    rng, rows = random.Random(seed), []
    for inst in (1, 2):
        for g in range(1, 120):
            cs = [(c, c, c, [rng.choice([-1, 0, 1, 2])], sorted(rng.sample(range(12), rng.randint(0, 2)))) for c in sorted(rng.sample(range(0, 60, 2), rng.randint(0, 8)))]
            rows.append((inst, 2 * g, g, rng.choice([2, 4]), cs))
    return rows


@pytest.mark.parametrize("block", [3, 256])
def test_genealogy_in_blocks_equals_a_fold(spark, monkeypatch, block):
    monkeypatch.setattr(nodes, "BLOCK", block)
    rows, want = generations(5), {}
    for inst in (1, 2):
        chain = nodes.Chain(inst, [], 1)
        for _, g, at_ns, threshold, cs in (r for r in rows if r[0] == inst):
            made, events = chain.step([dict(zip(("low", "high", "center", "sides", "members"), c, strict=True)) for c in cs], at_ns, threshold)
            want[inst, g] = sorted((n["node"], n["created_ns"], n["low"]) for n in made), sorted((e["event"], e["node"], sorted(e["others"])) for e in events)
    frame = spark.createDataFrame(rows, f"inst bigint, generation bigint, at_ns bigint, threshold bigint, clusters array<struct<{nodes.CLUSTER.replace(' ', ':').replace(',:', ',')}>>")
    out = nodes.genealogy(frame.repartition(3))
    got = {(r.inst, r.generation): (sorted((n.node, n.created_ns, n.low) for n in r.nodes), sorted((e.event, e.node, sorted(e.others)) for e in r.events)) for r in out.collect()}
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert all("," in part.split(")")[0] for part in plan.split("hashpartitioning(")[1:])  # no exchange by instrument alone


def replayed(rows):
    """What a book applies that takes one generation after the other, whole or not at all."""
    out = []
    for inst in sorted({r[0] for r in rows}):
        book = {}
        for g in sorted({r[1] for r in rows if r[0] == inst}):
            state, ok = dict(book), True
            for _, _, _, kind, key, lower, upper, price, _, side, family in sorted((r for r in rows if r[:2] == (inst, g)), key=lambda r: r[2]):
                met = state.get(key)
                ended = met and met[0] in ("expired", "superseded")
                bad = key == 0 or (kind == "created") == bool(met)
                bad |= bool(met) and (kind in ("updated", "frozen") and (ended or met[0] == "frozen") or kind in ("expired", "superseded") and ended)
                bad |= bool(met) and kind == "updated" and met[1:] != (family, side)
                bad |= kind in ("created", "updated") and not lower <= price <= upper
                ok &= not bad
                state[key] = (kind, family, side)
            if ok:
                book = state
                out.append((inst, g))
    return out


def test_replay_refuses_whole_generations(spark, monkeypatch):
    monkeypatch.setattr(levels, "CELL", 16)
    rng, rows, life = random.Random(3), [], {}
    for inst in (1, 2):
        for g in range(1, 150):
            for ordinal in range(rng.randint(1, 3)):
                key = rng.randrange(1, 12) + 100 * (g // 40)
                kind = rng.choices(("created", "updated", "frozen", "expired"), (1, 6, 1, 1))[0] if (inst, key) in life else "created"
                life[inst, key] = g
                rows.append((inst, g, ordinal, kind, key, 5, 9 if rng.random() < 0.95 else 4, 5, 0, 0, 1 if rng.random() < 0.97 else 2))
    # Refusals that rest on one another: each later creation is fine only because the one before it was refused.
    for g in range(150, 170):
        rows += [(1, g, 0, "created", 1000 + g // 2, 5, 9, 5, 0, 0, 1), (1, g, 1, "created", 2000 + (g + 1) // 2, 5, 9, 5, 0, 0, 1)]
    frame = spark.createDataFrame(rows, "inst long, generation long, ordinal int, kind string, level_id long, lower long, upper long, price long, group_id long, side int, family int")
    got = sorted({(r.inst, r.generation) for r in levels.applied(frame.repartition(4)).collect()})
    assert got == replayed(rows) and 20 < len(got) < 300


def test_rounds_do_not_grow_with_refusals(spark, monkeypatch):
    rounds, plain = [], levels.violations
    monkeypatch.setattr(levels, "violations", lambda *a: (rounds.append(1), plain(*a))[1])
    rows = [(1, g, 0, "updated", g, 1, 1, 1, 0, 0, 1) for g in range(1, 60)]  # all refused, none rests on another
    frame = spark.createDataFrame(rows, "inst long, generation long, ordinal int, kind string, level_id long, lower long, upper long, price long, group_id long, side int, family int")
    assert levels.applied(frame).isEmpty() and len(rounds) == 2
