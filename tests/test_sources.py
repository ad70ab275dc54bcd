import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quayside.functions import scalars
from quayside.sources import documents, index_values


def receipts(spark, *payloads):
    return spark.createDataFrame([(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "receipt_id long, payload string")


def dated(df):
    return sorted((r.receipt_id, str(r.period_start), r.value) for r in df.collect())


def test_csv_documents_fail_closed(spark):
    key = "FM.D.U2.EUR.4F.KR.DFR.LEV"
    line = lambda d, v: f"{key},D,U2,EUR,4F,KR,DFR,LEV,{d},{v}"
    good = "\n".join([documents.RATE_HEADER, line("2026-08-08", "2.25"), line("2026-08-09", "2.5"), ""])
    bad = [good.replace(",DFR,", ",MRR,", 1), good + line("2026-08-09", "2.5"), good.replace("2.25", "x"), documents.RATE_HEADER, "DATE,X\n1,2", None]
    frame = receipts(spark, good, *[b or "" for b in bad])
    assert dated(documents.policy_rate_csv(frame, key)) == [(0, "2026-08-08", 2.25), (0, "2026-08-09", 2.5)]
    bank = receipts(spark, "DATE,ABC\r\n05 Aug 2026,3.75\r\n06 Aug 2026,4\r\n", "DATE,XYZ\n05 Aug 2026,3.75", "DATE,ABC\n05 Aug 2026,3.75,1")
    assert dated(documents.bank_rate_csv(bank, "ABC")) == [(0, "2026-08-05", 3.75), (0, "2026-08-06", 4.0)]
    facts = '"Title","T"\n"CDID","AB12"\n"PreUnit",""\n"Release date","22-07-2026"\n"2025","3.4"\n"2026 Q1","1.5"\n"2026 APR","2.8"\n'
    stats = receipts(spark, facts, facts.replace("AB12", "ZZ"), facts.replace("22-07-2026", "soon"))
    monthly = documents.statistics_csv(stats, "AB12")
    assert dated(monthly) == [(0, "2026-04-01", 2.8)] and monthly.first().released == dt.date(2026, 7, 22)
    assert dated(documents.statistics_csv(stats, "AB12", quarterly=True)) == [(0, "2026-01-01", 1.5)]


def test_header_first_arrays(spark):
    head = ["cell_value", "kind", "time"]
    frame = receipts(spark, [head, ["7", "SM", "2026-04"], ["8", "SM", "2026-05"]], [head, ["7", "XX", "2026-04"]], [["time", "cell_value"], ["2026-04", "7"]], [head, ["7", "SM"]], "no json")
    assert dated(documents.header_first(frame, {"kind": "SM"})) == [(0, "2026-04-01", 7.0), (0, "2026-05-01", 8.0)]


def test_positioning_needs_every_market(spark):
    def row(code, **more):
        counts = {c: str(i) for i, c in enumerate(c for p in documents.PARTICIPANTS for c in p[1:] if c)}
        return {"id": f"w{code}", "report_date_as_yyyy_mm_dd": "2026-08-04T00:00:00.000", "cftc_contract_market_code": code, "open_interest_all": "50"} | counts | more

    some = {k: None for k in documents.PARTICIPANTS[0][1:]}
    markets = {"1+": 1, "2+": 2}
    frame = receipts(spark, [row("1+"), row("2+", **some)], [row("1+")], [row("1+"), row("2+", dealer_positions_long_all=None)], [row("1+"), row("9")], [row("1+"), row("2+"), row("2+")])
    got = documents.positioning(frame, markets).collect()
    assert {r.receipt_id for r in got} == {0} and len(got) == 9
    assert [(r.long_q, r.short_q, r.spread_q) for r in got if r.inst == 1 and r.participant == "nonreportable"] == [(12, 13, 0)]
    assert [r.participant for r in got if r.inst == 2 and r.participant == "dealer"] == []


def test_release_calendar(spark):
    event = lambda uid, at, title: f"BEGIN:VEVENT\r\nUID:{uid}\r\nDTSTART;TZID=America/New_York:{at}\r\nSUMMARY:{title}\r\nEND:VEVENT\r\n"
    whole = lambda *es: "BEGIN:VCALENDAR\r\n" + "".join(es) + "END:VCALENDAR\r\n"
    good = whole(event("a", "20260714T083000", "Consumer Prices for June"), event("b", "20260115T083000", "Producer Prices"), event("c", "20260115T083000", "Consumer Prices for May"), event("d", "20260115T083000Z", "Consumer Prices, again"))
    frame = receipts(spark, good, whole(event("a", "2026", "Consumer Prices")), good.replace("END:VCALENDAR", ""), whole(event("", "20260714T083000", "Consumer Prices")), good.replace("END:VEVENT\r\n", "", 1))
    got = documents.release_calendar(frame, {"Consumer Prices": "cpi"}).select("receipt_id", "uid", "release", F.date_format("scheduled", "MM-dd HH:mm").alias("at")).collect()
    assert sorted(map(tuple, got)) == [(0, "a", "cpi", "07-14 12:30"), (0, "c", "cpi", "01-15 13:30"), (0, "d", "cpi", "01-15 08:30")]


def test_index_values(spark):
    bindings = spark.createDataFrame([("I:X", 1, 0, 2_000_000), ("I:X", 2, 2_000_000, 9_000_000_000)], "symbol string, inst long, from_ns long, to_ns long")
    authority = spark.createDataFrame([(1, 7, 0, 9_000_000_000), (2, 8, 0, 9_000_000_000)], "inst long, source int, from_ns long, to_ns long")
    tick = lambda v, t, **k: {"ev": "V", "T": "I:X", "val": v, "t": t} | k
    frame = receipts(spark, tick(1.25, 1), [tick(1.5, 1), tick(1.5, 3), tick(1.123456789, 1), tick(2.0, 1, ev="A"), tick(2.0, 1, T="I:Y")])
    got = index_values.wire_values(frame, bindings, authority, source=7, scale=100)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, 1_000_000, 125), (1, 1, 1_000_000, 150)]
    manifest = spark.createDataFrame([("I:A", 1, "REAL-TIME"), ("I:B", 2, "DELAYED")], "ticker string, inst long, recency string")
    rec = lambda t, f, v=2.5, **k: {"ticker": t, "type": "indices", "timeframe": f, "last_updated": 5, "value": v} | k
    ok = [rec("I:A", "REAL-TIME"), rec("I:B", "DELAYED", 3)]
    cases = [ok, ok[:1], [ok[0], ok[0]], [ok[0], rec("I:B", "REAL-TIME")], [*ok, rec("I:C", "DELAYED")], [ok[0], rec("I:B", "DELAYED", error="NOT_FOUND")]]
    rows = [(i, 10 * i, 200, json.dumps({"status": "OK", "results": c})) for i, c in enumerate(cases)]
    rows += [(20, 1, 200, json.dumps({"status": "OK", "results": ok[:1]})), (20, 2, 200, json.dumps({"status": "OK", "results": ok[1:]})), (21, 1, 429, rows[0][3])]
    frame = spark.createDataFrame(rows, "refresh_id long, receipt_id long, status_code int, payload string")
    got = sorted(tuple(r) for r in index_values.snapshots(frame, manifest, scale=10).collect())
    assert got == [(20 * i, k, 5, px, live) for i in (0, 1) for k, px, live in ((1, 25, True), (2, 30, False))]


def test_catalogue_violations(spark):
    rows = [(1, "I:A", 100, 0, 10), (1, "I:A", 100, 5, 20), (2, "B", 100, 0, 1), (0, "I:C", 0, 3, 3)]
    got = index_values.catalogue_violations(spark.createDataFrame(rows, "inst long, ticker string, scale long, from_ns long, to_ns long"))
    assert sorted((r.ticker, r.rule) for r in got.collect()) == [("B", "ticker"), ("I:A", "overlap"), ("I:C", "instrument"), ("I:C", "scale"), ("I:C", "time order")]


@pytest.mark.parametrize(
    ("made", "want"),
    [
        (lambda: scalars.scale_exact(F.lit(-2.5), 1), None),
        (lambda: scalars.scale_exact(F.lit(20010.1), 10), 200101),
        (lambda: scalars.ratio_ppm(F.lit(7 * 10**18), F.lit(7)), scalars.LARGEST),
        (lambda: scalars.ratio_ppm(F.lit(1), F.lit(3)), 333333),
        (lambda: scalars.ratio_ppm(F.lit(1), F.lit(0)), 0),
        (lambda: scalars.decimal_precision(F.lit(0.25)), 2),
        (lambda: scalars.midpoint(F.lit(-3), F.lit(0)), -2),
        (lambda: scalars.interval_distance(F.lit(1), F.lit(2), F.lit(5), F.lit(9)), 3),
        (lambda: scalars.merge_threshold(F.lit(100), F.lit(1), F.lit(1)), 8),
        (lambda: scalars.body_preview(F.lit(" a \n\t b ")), "a b"),
        (lambda: scalars.body_preview(F.lit(b"\xff\xfe")), "<binary evidence>"),
        (lambda: scalars.millis_to_ns(F.lit(1 << 60), F.lit(9)), 9),
        (lambda: scalars.millis_to_ns(F.lit(2), F.lit(9)), 2_000_000),
        (lambda: scalars.valid_strategy_id(F.lit("a.b-c_1")), True),
        (lambda: scalars.valid_strategy_id(F.lit("a" * 32)), False),
        (lambda: scalars.time_quality(F.lit(0x300)), 3),
        (lambda: scalars.time_quality(F.lit(0x700)), 0),
        (lambda: scalars.used_share(F.lit(3.0), F.lit(2.0)), 1.0),
        (lambda: scalars.signed(F.lit(1_500_000)), "+1.50"),
    ],
)
def test_scalars(spark, made, want):
    assert spark.range(1).select(made().alias("x")).first().x == want


def test_lifecycle_prefers_the_position(spark):
    key = lambda a, p, o: spark.range(1).select(scalars.lifecycle_correlation(F.lit(a), F.lit(p), F.lit(o)).alias("k")).first().k
    assert key(1, 5, 8) == key(1, 5, 9) != key(1, 0, 8) and key(1, 0, 8) != key(1, 8, 1) and len(key(1, 0, 8)) == 32
