"""Provider documents with rows of their own: CSV, calendars, header-first arrays and positioning reports.

A document is judged inside its own row before it is spread out, so decoding
needs no shuffle.  It fails closed: when its header, its identity or one of its
rows is not as agreed, or a period comes twice, it gives no rows at all
(``decoders.undecoded`` lists such receipts).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The header of the policy-rate export.
RATE_HEADER = "KEY,FREQ,REF_AREA,CURRENCY,PROVIDER_FM,INSTRUMENT_FM,PROVIDER_FM_ID,DATA_TYPE_FM,TIME_PERIOD,OBS_VALUE"
#: Participant groups of a positioning report and their column names (long, short, spread).
PARTICIPANTS = (
    ("dealer", "dealer_positions_long_all", "dealer_positions_short_all", "dealer_positions_spread_all"),
    ("asset_manager", "asset_mgr_positions_long", "asset_mgr_positions_short", "asset_mgr_positions_spread"),
    ("leveraged", "lev_money_positions_long", "lev_money_positions_short", "lev_money_positions_spread"),
    ("other", "other_rept_positions_long", "other_rept_positions_short", "other_rept_positions_spread"),
    ("nonreportable", "nonrept_positions_long_all", "nonrept_positions_short_all", None),
)


def _spread_out(receipts: DataFrame, rows: Column, sound: Column, ok: Callable[[Column], Column], unique: Callable[[Column], Column]) -> DataFrame:
    """(receipt_id, fields of ``rows``) of the receipts whose rows are all ``ok`` and unique."""
    read = receipts.withColumn("__rows", rows).withColumn("__sound", sound)
    whole = F.forall("__rows", lambda r: F.coalesce(ok(r), F.lit(False))) & (F.size(F.array_distinct(F.transform("__rows", unique))) == F.size("__rows"))
    # Not a filter: pushed down to where the payload is read, it would parse it again for each of its terms.
    return read.select("receipt_id", F.inline(F.when(F.col("__sound") & whole, F.col("__rows"))))


def _lines(payload: Column) -> Column:
    return F.filter(F.split(payload, r"\r?\n"), lambda x: F.trim(x) != "")


def _after_first(lines: Column) -> Column:
    return F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))


def _dated(lines: Column, read: Callable[[Column], tuple[Column, Column]]) -> Column:
    def row(line: Column) -> Column:
        day, value = read(line)
        return F.struct(day.alias("period_start"), value.try_cast("double").alias("value"))

    return F.transform(lines, row)


def _observed(r: Column) -> Column:
    return r["period_start"].isNotNull() & r["value"].isNotNull() & ~F.isnan(r["value"])


def policy_rate_csv(receipts: DataFrame, key: str) -> DataFrame:
    """Daily rates of one key; its parts stand in columns of their own, too, and must agree with it."""
    lines = _lines(F.col("payload"))
    cells = lambda line: F.split(line, ",", -1)
    mine = lambda line: (F.size(cells(line)) == 10) & (F.get(cells(line), F.lit(0)) == key) & (F.array_join(F.slice(cells(line), 2, 7), ".") == key.split(".", 1)[1])
    sound = (F.get(lines, F.lit(0)) == RATE_HEADER) & F.forall(_after_first(lines), mine)
    rows = _dated(_after_first(lines), lambda x: (F.try_to_date(F.get(cells(x), F.lit(8)), "yyyy-MM-dd"), F.get(cells(x), F.lit(9))))
    return _spread_out(receipts, rows, sound, _observed, lambda r: r["period_start"]).withColumn("series", F.lit(key))


def bank_rate_csv(receipts: DataFrame, code: str) -> DataFrame:
    """Two columns, ``DATE`` as ``05 Aug 2026`` and the series' code."""
    lines = _lines(F.col("payload"))
    cells = lambda line: F.split(line, ",", -1)
    sound = (F.get(lines, F.lit(0)) == f"DATE,{code}") & F.forall(_after_first(lines), lambda x: F.size(cells(x)) == 2)
    rows = _dated(_after_first(lines), lambda x: (F.try_to_date(F.get(cells(x), F.lit(0)), "dd MMM yyyy"), F.get(cells(x), F.lit(1))))
    return _spread_out(receipts, rows, sound, _observed, lambda r: r["period_start"]).withColumn("series", F.lit(code))


def statistics_csv(receipts: DataFrame, code: str, *, quarterly: bool = False) -> DataFrame:
    """Quoted pairs: facts about the series first, then ``2026 APR`` or ``2026 Q1`` and a value; years are skipped.

    The code must be the document's, and its release date (``22-07-2026``) is
    returned as ``released``.
    """
    pair = lambda line, i: F.regexp_extract(line, r'^"([^"]*)","([^"]*)"\s*$', i)
    lines = _lines(F.col("payload"))
    fact = lambda name: F.get(F.transform(F.filter(lines, lambda x: pair(x, 1) == name), lambda x: pair(x, 2)), F.lit(0))
    shape = r"^\d{4} Q[1-4]$" if quarterly else r"^\d{4} [A-Z]{3}$"
    observed = F.filter(lines, lambda x: pair(x, 1).rlike(shape))

    def start(line: Column) -> Column:
        label = pair(line, 1)
        if quarterly:
            return F.make_date(F.substring(label, 1, 4).cast("int"), F.substring(label, 7, 1).cast("int") * 3 - 2, F.lit(1))
        return F.try_to_date(F.initcap(label), "yyyy MMM")

    released = F.try_to_date(fact("Release date"), "dd-MM-yyyy")
    rows = _dated(observed, lambda x: (start(x), pair(x, 2)))
    sound = (fact("CDID") == code) & released.isNotNull()
    out = _spread_out(receipts.withColumn("__released", released), rows, sound, _observed, lambda r: r["period_start"])
    dates = receipts.select("receipt_id", released.alias("released"))
    return out.withColumn("series", F.lit(code)).join(dates, "receipt_id")


def header_first(receipts: DataFrame, identity: dict[str, str], *, value: str = "cell_value", month: str = "time") -> DataFrame:
    """An array of arrays whose first row names the columns; ``identity`` columns must hold the given values in every row."""
    table = F.from_json("payload", "array<array<string>>")
    header = F.get(table, F.lit(0))
    cell = lambda r, name: F.get(r, (F.array_position(header, name) - 1).cast("int"))
    body = _after_first(table)
    named = F.lit(True)
    for name in (*identity, value, month):
        named = named & F.array_contains(header, name)

    def mine(r: Column) -> Column:
        out = F.size(r) == F.size(header)
        for name, want in identity.items():
            out = out & (cell(r, name) == want)
        return out

    rows = _dated(body, lambda r: (F.try_to_date(cell(r, month), "yyyy-MM"), cell(r, value)))
    return _spread_out(receipts, rows, F.coalesce(named & F.forall(body, mine), F.lit(False)), _observed, lambda r: r["period_start"])


def positioning(receipts: DataFrame, markets: dict[str, int]) -> DataFrame:
    """(receipt_id, report_date, inst, participant, long_q, short_q, spread_q, open_interest) of a complete weekly report.

    Each report holds every market.  A participant's counts are all there or
    all missing; those without a spread column have a spread of 0.
    """
    columns = ["id", "report_date_as_yyyy_mm_dd", "cftc_contract_market_code", "open_interest_all", *[c for p in PARTICIPANTS for c in p[1:] if c]]
    records = F.from_json("payload", f"array<struct<{','.join(f'{c}:string' for c in columns)}>>")
    instruments = F.create_map(*[F.lit(x) for pair in markets.items() for x in pair])
    count = lambda r, c: r[c].try_cast("long") if c else F.lit(0).cast("long")

    def group(r: Column, p: tuple) -> Column:
        name, *cs = p
        given = [c for c in cs if c]
        missing = sum((r[c].isNull().cast("int") for c in given), F.lit(0))
        ok = (missing == len(given)) | ((missing == 0) & F.forall(F.array(*[F.coalesce(count(r, c), F.lit(-1)) for c in given]), lambda n: n >= 0))
        long_q, short_q, spread_q = (count(r, c) for c in cs)
        return F.struct(F.lit(name).alias("participant"), long_q.alias("long_q"), short_q.alias("short_q"), spread_q.alias("spread_q"), F.coalesce(ok, F.lit(False)).alias("ok"))

    def record(r: Column) -> Column:
        return F.struct(
            r["id"].alias("id"),
            F.try_to_date(F.substring(r["report_date_as_yyyy_mm_dd"], 1, 10), "yyyy-MM-dd").alias("report_date"),
            F.try_element_at(instruments, r["cftc_contract_market_code"]).alias("inst"),
            r["open_interest_all"].try_cast("long").alias("open_interest"),
            F.array(*[group(r, p) for p in PARTICIPANTS]).alias("groups"),
        )

    rows = F.transform(records, record)
    ok = lambda r: r["report_date"].isNotNull() & r["inst"].isNotNull() & (r["open_interest"] > 0) & F.forall(r["groups"], lambda g: g["ok"])
    complete = F.size(F.array_distinct(F.transform(records, lambda r: r["cftc_contract_market_code"]))) == len(markets)
    out = _spread_out(receipts, rows, complete, ok, lambda r: r["id"])
    out = out.select("receipt_id", "report_date", "inst", "open_interest", F.inline("groups")).where(F.col("long_q").isNotNull())
    return out.select("receipt_id", "report_date", "inst", "participant", "long_q", "short_q", "spread_q", "open_interest")


def release_calendar(receipts: DataFrame, titles: dict[str, str]) -> DataFrame:
    """(receipt_id, uid, release, scheduled) of the calendar events whose title begins with one of ``titles``.

    Times are US Eastern, or UTC with a final Z.  A calendar that is cut off, or
    one event of which lacks its id, title or start, gives none.
    """
    payload = F.col("payload")
    line = lambda block, name: F.rtrim(F.regexp_extract(block, rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$", 1))
    blocks = F.split(payload, r"(?m)^BEGIN:VEVENT\s*$", -1)
    events = F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))
    sound = payload.startswith("BEGIN:VCALENDAR") & payload.contains("END:VCALENDAR") & ~F.regexp_like(F.get(blocks, F.lit(0)), F.lit("(?m)^END:VEVENT"))
    sound = sound & F.forall(events, lambda b: F.regexp_count(b, F.lit(r"(?m)^END:VEVENT\s*$")) == 1)

    def when(text: Column) -> Column:
        local = F.try_to_timestamp(F.substring(text, 1, 15), F.lit("yyyyMMdd'T'HHmmss"))
        fits = text.rlike(r"^\d{8}T\d{6}Z?$")
        return F.when(fits & text.endswith("Z"), local).when(fits, F.to_utc_timestamp(local, "America/New_York"))

    release = lambda t: F.coalesce(*[F.when(t.startswith(p), F.lit(name)) for p, name in titles.items()], F.lit(""))
    rows = F.transform(events, lambda b: F.struct(line(b, "UID").alias("uid"), release(line(b, "SUMMARY")).alias("release"), line(b, "SUMMARY").alias("title"), when(line(b, "DTSTART")).alias("scheduled")))
    out = _spread_out(receipts, rows, sound, lambda r: (r["uid"] != "") & (r["title"] != "") & r["scheduled"].isNotNull(), lambda r: r["uid"])
    return out.where(F.col("release") != "").select("receipt_id", "uid", "release", "scheduled")
