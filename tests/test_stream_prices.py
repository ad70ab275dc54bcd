"""Prices on the structural stream against engines that take all rows one after another."""

import random

from pyspark.sql import functions as F

from quayside.streaming import structure as live
from test_structure import SCHEMA, make_bars

NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
DAY = 86_400_000_000_000


def met(engine, at_ns, px):
    """Generation, lateness, place and neighbours of a price that comes now."""
    nodes, at = engine.in_order(), engine.d["at_ns"]
    inside = min(((n["high"] - n["low"], n["node"]) for n in nodes if n["low"] <= px <= n["high"]), default=None)
    under, over = [n["node"] for n in nodes if n["center"] < px][-1:], [n["node"] for n in nodes if n["center"] >= px][:1]
    place = "unavailable" if not nodes else "inside" if inside else "below" if not under else "above" if not over else "between"
    lower, upper = (inside[1:] * 2) if inside else (under[0] if under else None, over[0] if over else None)
    return engine.d["generation"] or None, bool(at and at > at_ns), place, lower, upper


def test_prices_meet_the_graph_outside_the_state(spark, tmp_path):
    rng, folder, seq, want, engines = random.Random(7), str(tmp_path), 0, {}, {i: live.Engine(i) for i in (1, 2)}
    bars = [dict(zip(NAMES, b, strict=True)) for i in (1, 2) for b in make_bars(i, i, days=6)]
    # Turn 1 has no bars, turn 3 no prices; in the others some prices come turns late, some at the close of a bar.
    for turn in range(5):
        mine = [] if turn == 1 else [b for b in bars if b["s_open"] // DAY == turn - (turn > 1)]
        prices = []
        for _ in range(0 if turn == 3 else 150):
            seq += 1
            at = rng.choice(mine)["close_ns"] if mine and rng.random() < 0.3 else rng.randrange(max(turn - 2, 0) * DAY, (turn + 1) * DAY)
            prices.append((rng.choice((1, 2)), seq, at, rng.randrange(9_800, 10_200)))
        rows = [(b["close_ns"], 0, b["open_ns"], b["inst"], b) for b in mine] + [(p[2], 1, p[1], p[0], p) for p in prices]
        for at, is_price, _, inst, r in sorted(rows, key=lambda r: r[:3]):
            if is_price:
                want[r[1]] = met(engines[inst], at, r[3])
            else:
                engines[inst].on_bar(r | {"at_ns": at})
        sent = spark.createDataFrame([tuple(b[c] for c in NAMES) for b in mine], SCHEMA)
        asked = spark.createDataFrame(prices, "inst long, seq long, ts_ns long, px long")
        live.moves(sent, asked).repartition(2).write.parquet(f"{folder}/in/{turn}")
        live.stream_structure(spark.readStream.schema(live.INPUT).parquet(f"{folder}/in/*"), folder).awaitTermination()
    emitted = spark.read.parquet(f"{folder}/emitted")
    got = {r.seq: (r.asof_generation, r.late, r.place, r.lower_node, r.upper_node) for r in live.placed_prices(emitted).collect()}
    assert got == want and len({v[2] for v in want.values()}) > 2 and {v[1] for v in want.values()} == {True, False}
    # A task of the state holds what it emits: a price there would bring along all nodes of its moment.
    assert emitted.where((F.col("kind") == live.PRICE) & F.col("nodes").isNotNull()).isEmpty()
