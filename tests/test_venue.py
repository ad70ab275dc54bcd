import json

from quayside.operators import venue_ledger
from quayside.sources import venue

COLUMNS = {"accountDetailsConfig": venue.ACCOUNT} | {layout: names + (("positionId",) if "orders" in key else ()) for layout, key, names in venue.TABLES.values()}
PAIRS = "array<struct<id:bigint,payload:string>>"
SCHEMA = f"epoch_id long, account_id long, started_ns long, received_ns long, config string, instruments string, account_state string, positions string, orders string, order_history string, executions string, details {PAIRS}, quotes {PAIRS}"


BINDINGS = {"DE30": (4, 100), "OIL": (6, 1_000)}


def reply(payload):
    return json.dumps({"s": "ok", "d": payload})


def tables(columns=COLUMNS):
    """A short position in oil with its working order, and a part-filled order in the index; one row is of an unbound instrument."""
    held = {"id": 9_180, "tradableInstrumentId": 58, "side": "sell", "qty": 3.25, "avgPrice": 78.412, "unrealizedPl": -41.5, "openDate": 1_712_345_678_901}
    orders = [
        {"id": 7_204, "tradableInstrumentId": 58, "positionId": 9_180, "side": "sell", "type": "stop", "status": "Accepted", "qty": 3.25, "filledQty": 3.25, "avgPrice": 78.412, "createdDate": 1_712_345_600_000, "isOpen": False},
        {"id": 7_311, "tradableInstrumentId": 31, "positionId": None, "side": "buy", "type": "limit", "status": "New", "qty": 1.5, "filledQty": 0.5, "avgPrice": 18_122.75, "createdDate": 1_712_349_000_000, "isOpen": True},
    ]
    trade = {"id": 60_017, "tradableInstrumentId": 58, "orderId": 7_204, "positionId": 9_180, "side": "sell", "qty": 3.25, "price": 78.412, "createdDate": 1_712_345_678_850}
    placed = lambda layout, rows: [[r.get(c) for c in columns[layout]] for r in rows]
    return {
        "positions": {"positions": placed("positionsConfig", [held, held | {"id": 9_181, "tradableInstrumentId": 77}])},
        "orders": {"orders": placed("ordersConfig", orders[1:])},
        "order_history": {"ordersHistory": placed("ordersHistoryConfig", orders[:1])},
        "executions": {"executions": placed("filledOrdersConfig", [trade])},
    }


def epoch(number, columns=COLUMNS, **changes):
    listed = [(31, "DE30", 5, 6), (58, "OIL", 7, 8), (77, "WHEAT", 1, 2)]
    out = {
        "epoch_id": number,
        "account_id": 4_120,
        "started_ns": 5_500,
        "received_ns": 6_900,
        "config": reply({k: {"columns": [{"id": c} for c in cs]} for k, cs in columns.items()}),
        "instruments": reply({"instruments": [{"tradableInstrumentId": i, "name": n, "routes": [{"id": t, "type": "TRADE"}, {"id": f, "type": "INFO"}]} for i, n, f, t in listed]}),
        "account_state": reply({"accountDetailsData": [52_310.4, 52_268.9, 47_000.25, -41.5, -3.2, -41.5]}),
        **{name: reply(rows) for name, rows in tables(columns).items()},
        "details": [
            (31, reply({"sessionId": 12, "minQty": 0.1, "qtyStep": 0.1, "priceIncrement": 0.5, "tradable": False, "symbolStatus": "FULLY_OPEN"})),
            (58, reply({"tradeSessionId": 40, "minLot": 0.25, "lotStep": 0.05, "tickSize": [{"leftRangeLimit": None, "tickSize": "0.001"}, {"leftRangeLimit": 60, "tickSize": 0.004}, {"leftRangeLimit": 140, "tickSize": 2}], "symbolStatus": "FULLY_OPEN"})),
        ],
        "quotes": [(31, reply({"bp": 18_120.25, "ap": 18_121.75})), (58, reply({"bp": 79.1, "ap": 79.14}))],
    }
    return tuple((out | changes).values())


def test_epochs_are_taken_whole(spark):
    turned = COLUMNS | {"positionsConfig": COLUMNS["positionsConfig"][::-1]}
    short = COLUMNS | {"ordersConfig": tuple(c for c in COLUMNS["ordersConfig"] if c != "status")}
    one_quote = [(31, reply({"bp": 18_120.25, "ap": 18_121.75}))]
    rows = [
        epoch(11), epoch(12, turned), epoch(13, short), epoch(14, quotes=one_quote), epoch(15, started_ns=7_000), epoch(16, instruments=reply({"instruments": []})), epoch(17, executions='{"s":"late","d":{"executions":[]}}'),
        epoch(18, details=[(31, reply({"priceIncrement": 0.5, "sessionId": 12})), (58, reply({}))]), epoch(19, positions="<html>"), epoch(20, account_state=reply({"accountDetailsData": [3.5]})),
    ]
    decoded = venue.decode(spark.createDataFrame(rows, SCHEMA), BINDINGS)
    got = {r.epoch_id: r for r in decoded.collect()}
    assert {k: r.rejected for k, r in got.items()} == {11: None, 12: None, 13: "orders", 14: "quotes", 15: "times", 16: "instruments", 17: "executions", 18: "contracts", 19: "positions", 20: "account"}
    one = got[11]
    assert [p.id for p in one.positions] == [p.id for p in got[12].positions] == [9_180] and one.positions[0].qty == 3.25
    assert one.account.projectedBalance == 52_268_900_000 and one.account.todayFees == -3_200_000
    assert sorted(map(tuple, one.quotes)) == [(4, 1_812_025, 1_812_175, 1_812_100), (6, 79_100, 79_140, 79_120)]
    index, oil = one.contracts
    assert tuple(index)[:8] == (4, "DE30", 31, 5, 6, 12, 100_000, 100_000) and (index.tick_nanos, index.precision, index.session_open) == (500_000_000, 1, False)
    assert tuple(oil)[:8] == (6, "OIL", 58, 7, 8, 40, 250_000, 50_000) and (oil.tick_nanos, oil.precision, oil.session_open) == (4_000_000, 3, True)
    known = spark.createDataFrame([(4_120, 7_311)], "account_id long, id long")
    assert venue.unknown_objects(decoded, known, "orders").isEmpty()
    unknown = venue.unknown_objects(decoded, known, "positions")
    assert sorted(map(tuple, unknown.collect())) == [(11, 9_180), (12, 9_180)]

    made = venue_ledger.entries(decoded, unknown)
    mine = {(r.kind, r.status): r for r in made.where("epoch_id = 11").collect()}
    bodies = {r.body for r in mine.values()}
    assert any(k == ("reconciliation", "incident") for k in mine)
    assert "Venue order 7311 BUY 1.500000 limit @ 18122.75000 / status New." in bodies
    assert "Venue position 9180 SELL 3.250000 @ 78.41200 / open P&L -41.50 USD." in bodies
    assert "Venue execution 60017 filled order 7204 / position 9180 / SELL 3.250000 @ 78.41200." in bodies
    fill, held = (next(r for (k, _), r in mine.items() if k == kind) for kind in ("fill", "position"))
    assert fill.correlation == held.correlation and fill.event_ns == 1_712_345_678_850_000_000
    fresh = venue_ledger.append_once(made.where("kind = 'order'"), made)
    assert sorted((r.epoch_id, r.kind) for r in fresh.collect()) == [(11, "fill"), (11, "position"), (11, "reconciliation"), (12, "reconciliation")]


def test_reconciliation(spark):
    orders = spark.createDataFrame([(1, 1, 10, "working", 0, None), (1, 2, 10, "working", 5, None), (1, 3, 11, "working", 0, 7), (2, 9, 10, "working", 0, None)], "epoch long, ordinal long, order_id long, status string, filled long, position_id long")
    fills = spark.createDataFrame([(1, 4, 100, 10, 8, 50), (1, 5, 100, 10, 8, 50), (1, 6, 101, 10, 9, 20), (1, 7, 102, 99, 9, 20)], "epoch long, ordinal long, fill_id long, order_id long, position_id long, qty long")
    got = sorted(tuple(r) for r in venue_ledger.order_states(orders, fills).collect())
    assert got == [(1, 10, "partially_filled", 75, 9), (1, 11, "working", 0, 7), (2, 10, "working", 0, None)]
    marks = spark.createDataFrame([("a", 1, 1, "begin"), ("a", 2, 1, "finish"), ("a", 3, 2, "begin"), ("a", 4, 1, "finish"), ("b", 1, 1, "begin"), ("b", 2, 1, "finish")], "stream string, ordinal long, epoch long, kind string")
    intents = spark.createDataFrame([("a", 1, 5, "unknown"), ("a", 2, 5, "resolved"), ("b", 1, 6, "unknown")], "stream string, ordinal long, intent_id long, kind string")
    got = sorted(tuple(r) for r in venue_ledger.epoch_states(marks, intents).collect())
    assert got == [("a", 1, "ready", 0, True), ("a", 2, "reconciling", 0, False), ("b", 1, "ready", 1, False)]
