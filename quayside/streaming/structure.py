"""Levels, nodes and the place of prices on a stream of bars and prices.

State is keyed by instrument and kept by Spark (RocksDB): what the three
producers of levels remember of the running session, the active levels by id and
the nodes of the last generation.  Its size is that of the active levels, not of
the history.  ``Engine`` is one bar's step over that state; its rules are those
of ``operators.structure``, which works the same levels out of a whole history
by windows, and its nodes are made by the same clusters and chain.

A micro-batch's bars of an instrument are taken by time.  Each bar that changes a
level emits one row: the levels it changed, the nodes now and what became of the
last ones.  A bar that does not open after the last one is refused, which is a
row as well; it changes nothing.

A price changes no state, so it does not go through the state's tasks, where the
rows of an instrument meet: it is emitted as it came, with the number of its
micro-batch.  It meets the nodes after the last bar closed by then, which
``placed_prices`` finds by a join; bars of the same micro-batch count before
prices of the same moment.  A price that comes after a later bar was taken meets
the nodes that stood before its micro-batch and is marked as late.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quayside.operators import joins, nodes
from quayside.operators.nodes import CENTER, LOWER, NEUTRAL, UPPER
from quayside.operators.structure import ATR_BARS, FRACTIONS, LOOKBACK, OPENING, OPENING_NS, PROJECTION, RETAINED, SESSION
from quayside.streaming.keyed import start

BAR, PRICE, REFUSED = 0, 1, 2
INPUT = "inst bigint, kind int, at_ns bigint, seq bigint, s_open bigint, s_close bigint, open_ns bigint, o bigint, h bigint, l bigint, c bigint, px bigint"
_LEVEL = "level_id:bigint,state:string,lower:bigint,upper:bigint,price:bigint,group_id:bigint,side:int,family:int,age:bigint"
OUTPUT = (
    "kind int, inst bigint, generation bigint, bar_ns bigint, at_ns bigint, atr bigint, "
    f"levels array<struct<{_LEVEL}>>, nodes array<struct<{nodes.NODE}>>, events array<struct<{nodes.EVENT}>>, seq bigint, px bigint"
)
#: What is remembered beside levels and nodes; all null before the first bar.
DESK = (
    "last_ns bigint, session bigint, s_open bigint, hi bigint, lo bigint, prev_hi bigint, prev_lo bigint, prev_open bigint, openings bigint, open_live boolean, open_frozen boolean, open_hi bigint, open_lo bigint, "
    "epoch bigint, highs array<bigint>, lows array<bigint>, ranges array<bigint>, close bigint, atr bigint, generation bigint, at_ns bigint, number bigint"
)
LEVEL = "state string, lower bigint, upper bigint, price bigint, group_id bigint, side int, family int, age bigint"
NODE = "low bigint, high bigint, center bigint, sides array<int>, members array<bigint>, created_ns bigint, updated_ns bigint"
_names = lambda ddl: [c.split()[0] for c in ddl.split(", ")]
_DESK, _LEVELS, _NODES = _names(DESK), _names(LEVEL), _names(NODE)
_OUTPUT = [c.split()[0] for c in OUTPUT.split(", ")]


def _rotated(value: int, bits: int) -> int:
    value &= (1 << 64) - 1
    return (value << bits | value >> 64 - bits) & (1 << 64) - 1


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class Engine:
    """An instrument's desk, active levels (by id) and nodes; ``on_bar`` takes them one bar further."""

    def __init__(self, inst: int, desk: dict | None = None, levels: dict[int, dict] | None = None, nodes_: list[dict] | None = None, *, noise: int = 1, tick: int = 1):
        self.inst, self.noise, self.tick = inst, noise, tick
        self.d = desk or {f: None for f in _DESK} | {"session": 0, "openings": 0, "open_live": False, "open_frozen": False, "highs": [], "lows": [], "ranges": [], "generation": 0, "number": 1}
        self.levels, self.nodes, self.touched = levels or {}, nodes_ or [], {}

    def _id(self, producer: int, number: int) -> int:
        return (producer << 48) + (self.inst << 32) + number

    def _put(self, producer: int, number: int, side: int, price: int, lower: int | None = None, upper: int | None = None, group: int | None = None) -> None:
        """Creates the level, or updates it."""
        key = self._id(producer, number)
        before = self.levels.get(key)
        level = {"state": "developing", "lower": price if lower is None else lower, "upper": price if upper is None else upper, "price": price, "group_id": _signed(group or 0), "side": side, "family": producer, "age": before["age"] + 1 if before else 0}
        self.levels[key] = self.touched[key] = level

    def _freeze(self, producer: int, number: int) -> None:
        key = self._id(producer, number)
        self.levels[key] = self.touched[key] = self.levels[key] | {"state": "frozen"}

    def _end(self, producer: int, number: int) -> None:
        key = self._id(producer, number)
        self.touched[key] = self.levels.pop(key) | {"state": "ended"}

    def _session(self, b: dict, fresh: bool) -> None:
        d = self.d
        first = lambda k: 6 * (k - 1)  # noqa: E731  number before those of session k
        if fresh:
            k = d["session"] = d["session"] + 1
            if k > 1:
                for i in (1, 2):
                    self._end(SESSION, first(k - 1) + i)
                    self._freeze(SESSION, first(k - 1) + 2 + i)
                    if k > 2:
                        self._end(SESSION, first(k - 1) - 2 + i)
                    if k > RETAINED + 1:
                        self._end(SESSION, first(k - RETAINED - 1) + 2 + i)
                group = _rotated(d["s_open"], 17) ^ 2
                self._put(SESSION, first(k) - 1, UPPER, d["hi"], group=group)
                self._put(SESSION, first(k), LOWER, d["lo"], group=group)
            d["hi"] = d["lo"] = None
        base, group = first(d["session"]), _rotated(b["s_open"], 17) ^ 1
        if d["hi"] is None or b["h"] > d["hi"]:
            d["hi"] = b["h"]
            self._put(SESSION, base + 1, UPPER, b["h"], group=group)
            self._put(SESSION, base + 3, UPPER, b["h"], lower=max(b["o"], b["c"]))
        if d["lo"] is None or b["l"] < d["lo"]:
            d["lo"] = b["l"]
            self._put(SESSION, base + 2, LOWER, b["l"], group=group)
            self._put(SESSION, base + 4, LOWER, b["l"], upper=min(b["o"], b["c"]))

    def _opening(self, b: dict, fresh: bool) -> None:
        d = self.d
        if fresh and d["open_live"]:
            for i in (1, 2, 3):
                self._end(OPENING, 3 * (d["openings"] - 1) + i)
        if fresh:
            d["open_live"] = b["open_ns"] < b["s_open"] + OPENING_NS
            d["openings"] += d["open_live"]
            d["open_frozen"], d["open_hi"], d["open_lo"] = False, None, None
        if not d["open_live"]:
            return
        base = 3 * (d["openings"] - 1)
        if b["open_ns"] < min(b["s_open"] + OPENING_NS, b["s_close"]):
            before = d["open_hi"], d["open_lo"]
            d["open_hi"], d["open_lo"] = (b["h"], b["l"]) if before[0] is None else (max(before[0], b["h"]), min(before[1], b["l"]))
            if before != (d["open_hi"], d["open_lo"]):
                group = _rotated(b["s_open"], 21) ^ OPENING_NS
                for i, side, price in ((1, UPPER, d["open_hi"]), (2, LOWER, d["open_lo"]), (3, CENTER, d["open_lo"] + (d["open_hi"] - d["open_lo"]) // 2)):
                    self._put(OPENING, base + i, side, price, group=group)
        elif not d["open_frozen"]:
            d["open_frozen"] = True
            for i in (1, 2, 3):
                self._freeze(OPENING, base + i)

    def _projection(self, b: dict) -> None:
        d = self.d
        if d["epoch"] is None:
            d["epoch"] = b["open_ns"]
        extent = lambda: (max(d["highs"]), min(d["lows"])) if len(d["highs"]) > 1 else None
        before = extent()
        d["highs"], d["lows"] = (d["highs"] + [b["h"]])[-LOOKBACK:], (d["lows"] + [b["l"]])[-LOOKBACK:]
        now = extent()
        if now is None:
            return
        group = _rotated(d["epoch"], 29) ^ LOOKBACK
        at = lambda e, f: e[1] + (e[0] - e[1]) * f // 1_000_000
        for i, f in enumerate(FRACTIONS):
            side = LOWER if i == 0 else UPPER if i + 1 == len(FRACTIONS) else CENTER if 2 * i == len(FRACTIONS) - 1 else NEUTRAL
            if before is None or at(now, f) != at(before, f):
                self._put(PROJECTION, i + 1, side, at(now, f), group=group)

    def on_bar(self, b: dict) -> dict | None:
        """b: s_open, s_close, open_ns, at_ns (its close), o, h, l, c.  What changed, or None."""
        d = self.d
        if d["last_ns"] is not None and b["open_ns"] <= d["last_ns"]:
            return {"kind": REFUSED, "bar_ns": b["open_ns"], "at_ns": b["at_ns"]}
        self.touched = {}
        fresh = b["s_open"] != d["s_open"]
        self._session(b, fresh)
        self._opening(b, fresh)
        self._projection(b)
        close = d["close"]
        range_ = b["h"] - b["l"] if close is None else max(b["h"] - b["l"], abs(b["h"] - close), abs(b["l"] - close))
        d["ranges"] = (d["ranges"] + [range_])[-ATR_BARS:]
        d |= {"close": b["c"], "atr": sum(d["ranges"]) // len(d["ranges"]), "last_ns": b["open_ns"], "s_open": b["s_open"]}
        if not self.touched:
            return None
        d |= {"generation": d["generation"] + 1, "at_ns": b["at_ns"]}
        threshold = max(d["atr"] * 80_000 // 1_000_000, self.noise, 2 * self.tick)
        live = sorted((v["lower"], v["upper"], v["price"], k, v["group_id"], v["side"]) for k, v in self.levels.items())
        chain = nodes.Chain(self.inst, self.nodes, d["number"])
        made, events = chain.step(nodes.cluster(live, threshold), b["at_ns"], threshold)
        d["number"], self.nodes = chain.number, made
        changed = [{"level_id": k} | v for k, v in sorted(self.touched.items())]
        return {"kind": BAR, "generation": d["generation"], "bar_ns": b["open_ns"], "at_ns": b["at_ns"], "atr": d["atr"], "levels": changed, "nodes": self.in_order(), "events": events}

    def in_order(self) -> list[dict]:
        return sorted(self.nodes, key=lambda n: (n["center"], n["low"], n["high"], n["node"]))


class StructureProcessor(StatefulProcessor):
    """Loads an instrument's state, runs its engine over the bars of a micro-batch and stores what changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.desk = handle.getValueState("desk", DESK)
        self.levels = handle.getMapState("levels", "level_id bigint", LEVEL)
        self.nodes = handle.getMapState("nodes", "node bigint", NODE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        desk = dict(zip(_DESK, self.desk.get(), strict=True)) if self.desk.exists() else None
        for f in ("highs", "lows", "ranges"):
            if desk:
                desk[f] = list(desk[f])
        levels = {k[0]: dict(zip(_LEVELS, v, strict=True)) for k, v in self.levels.iterator()}
        held = [{"node": k[0]} | dict(zip(_NODES, v, strict=True)) for k, v in self.nodes.iterator()]
        engine = Engine(key[0], desk, dict(levels), [n | {"sides": list(n["sides"]), "members": list(n["members"])} for n in held])
        out = []
        for r in sorted((r.asDict() for r in rows), key=lambda r: (r["at_ns"], r["open_ns"])):
            if found := engine.on_bar(r):
                out.append(found)
        self.desk.update(tuple(engine.d[f] for f in _DESK))
        for k in levels.keys() - engine.levels.keys():
            self.levels.removeKey((k,))
        for k, v in engine.levels.items():
            if levels.get(k) != v:
                self.levels.updateValue((k,), tuple(v[f] for f in _LEVELS))
        for k in {n["node"] for n in held} - {n["node"] for n in engine.nodes}:
            self.nodes.removeKey((k,))
        for n in engine.nodes:
            self.nodes.updateValue((n["node"],), tuple(n[f] for f in _NODES))
        fields_of = lambda ddl: [f.split(":")[0] for f in ddl.split(",")]
        kinds = {"levels": fields_of(_LEVEL), "nodes": fields_of(nodes.NODE), "events": fields_of(nodes.EVENT)}
        for found in out:
            listed = {c: [tuple(x[f] for f in fields) for x in found[c]] if c in found else None for c, fields in kinds.items()}
            yield Row(**({f: found.get(f) for f in _OUTPUT} | listed | {"inst": key[0]}))

    def close(self) -> None:
        pass


def moves(bars: DataFrame | None = None, prices: DataFrame | None = None) -> DataFrame:
    """The rows that the stream takes, from bars (inst, s_open, s_close, open_ns, close_ns, o, h, l, c) or prices (inst, seq, ts_ns, px)."""
    none = lambda *names: [F.lit(None).cast("bigint").alias(c) for c in names]
    if prices is None:
        return bars.select("inst", F.lit(BAR).alias("kind"), F.col("close_ns").alias("at_ns"), *none("seq"), "s_open", "s_close", "open_ns", "o", "h", "l", "c", *none("px"))
    out = prices.select("inst", F.lit(PRICE).alias("kind"), F.col("ts_ns").alias("at_ns"), "seq", *none("s_open", "s_close", "open_ns", "o", "h", "l", "c"), "px")
    return out if bars is None else moves(bars).unionByName(out)


def stream_structure(rows: DataFrame, folder: str, *, query_name: str | None = None) -> StreamingQuery:
    """Start the stream over what is available of ``rows`` (``INPUT``); emissions (``OUTPUT`` and batch) are stored in ``folder``/emitted."""
    prices = rows.where(F.col("kind") == PRICE).select("kind", "inst", "at_ns", "seq", "px")
    return start(rows.where(F.col("kind") == BAR), "inst", StructureProcessor(), OUTPUT, folder, query_name, beside=prices)


def level_versions(emitted: DataFrame) -> DataFrame:
    """Each version of a level, as ``operators.levels.versions`` has it, from the emissions."""
    each = emitted.where(F.col("kind") == BAR).select("inst", F.col("generation").alias("from_generation"), F.inline("levels"))
    ends = F.lead("from_generation").over(Window.partitionBy("inst", "level_id").orderBy("from_generation"))
    return each.withColumn("to_generation", ends).where(F.col("state") != "ended")


#: Time whose prices of an instrument are sorted together.
CELL = 3_600_000_000_000


def placed_prices(emitted: DataFrame) -> DataFrame:
    """Where each price stands among the nodes it met, from the emissions of all micro-batches.

    Only numbers of generations are carried along the prices; the nodes of one
    are joined to those that met it.
    """
    bars = emitted.where(F.col("kind") == BAR)
    prices = emitted.where(F.col("kind") == PRICE).select("seq", "inst", F.col("at_ns").alias("ts_ns"), "px", "batch")
    # What stood before a micro-batch counts from its first row on.
    each = emitted.where(F.col("kind") != REFUSED).groupBy("inst", "batch").agg(F.min("at_ns").alias("at_ns"), F.max("generation").alias("newest"))
    stood = F.max("newest").over(Window.partitionBy("inst").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1))
    standing = each.select("inst", "batch", "at_ns", stood.alias("generation")).where(F.col("generation").isNotNull())
    known = bars.select("inst", "batch", "at_ns", "generation").unionByName(standing)
    met = joins.asof_join(prices, known, on=["inst", "batch"], left_at="ts_ns", right_at="at_ns", take=["generation"], cell=CELL).drop("batch")
    of = bars.select("inst", F.col("generation").alias("asof_generation"), F.col("at_ns").alias("__at"), "nodes")
    out = met.join(of, ["inst", "asof_generation"], "left").withColumn("late", F.coalesce(F.col("__at") > F.col("ts_ns"), F.lit(False)))
    return nodes.locate(out.select("seq", "inst", "ts_ns", "px", "asof_generation", "late", "nodes")).drop("nodes")
