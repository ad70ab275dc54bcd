"""Scalars over columns; all stay inside generated code.

A function gives null where its input is null or has no defined result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = (1 << 63) - 1


def whole_quotient(a: Column, b: Column) -> Column:
    """Integer division that truncates towards zero; null for a zero divisor."""
    return F.when(b != 0, F.call_function("div", a, b))


def scale_exact(value: Column, scale: int) -> Column:
    """``value * scale`` as an integer if it is one within a millionth, else null."""
    scaled = value * F.lit(float(scale))
    return F.when(F.abs(scaled - F.round(scaled)) <= 1e-6, F.round(scaled).try_cast("long"))


def micros(value: Column) -> Column:
    return F.round(value * 1e6).try_cast("long")


def nanos(value: Column) -> Column:
    return F.round(value * 1e9).try_cast("long")


def decimal_precision(value: Column) -> Column:
    """Decimals needed to write ``value``, 0 to 9; null when more are."""
    fits = [F.when(F.abs(value * 10.0**p - F.round(value * 10.0**p)) <= 1e-9, F.lit(p)) for p in range(10)]
    return F.coalesce(*fits)


def ratio_ppm(value: Column, denominator: Column) -> Column:
    """Parts per million, held inside the 64-bit range; 0 for a denominator that is not positive."""
    whole = lambda c: c.cast("decimal(20,0)")
    parts, below = whole(value) * F.lit(1_000_000).cast("decimal(7,0)"), whole(F.greatest(denominator, F.lit(1)))
    most = F.lit(LARGEST)
    inside = F.abs(parts) <= whole(most) * below
    wide = F.when(inside, F.call_function("div", parts, below)).otherwise(F.when(value > 0, most).otherwise(-most - 1))
    return F.when(denominator > 0, F.when(value.isNotNull(), wide)).otherwise(F.when(denominator.isNotNull(), F.lit(0).cast("long")))


def midpoint(low: Column, high: Column) -> Column:
    return low + whole_quotient(high - low, F.lit(2))


def interval_distance(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Gap between two closed intervals, 0 where they touch or overlap."""
    return F.greatest(low_b - high_a, low_a - high_b, F.lit(0).cast("long"))


def merge_threshold(atr: Column, noise: Column, tick: Column, *, ppm: int = 80_000, noise_times: int = 1, ticks: int = 2) -> Column:
    """Largest of a share of the average range, of the noise and of the tick; negative inputs count as 0."""
    zero = F.lit(0).cast("long")
    return F.greatest(whole_quotient(F.greatest(atr, zero) * ppm, F.lit(1_000_000)), F.greatest(noise, zero) * noise_times, F.greatest(tick, zero) * ticks)


def body_preview(body: Column) -> Column:
    """The first 180 characters with runs of white space as one space, trimmed; binary that is no UTF-8 has a fixed text."""
    text = F.trim(F.regexp_replace(F.substring(F.try_validate_utf8(body.cast("string")), 1, 180), r"\s+", " "))
    return F.when(body.isNotNull(), F.coalesce(text, F.lit("<binary evidence>")))


def millis_to_ns(millis: Column, fallback: Column) -> Column:
    """Milliseconds in nanoseconds, or ``fallback`` where that overflows or is not positive."""
    ns = F.try_multiply(millis, F.lit(1_000_000).cast("long"))
    return F.when(ns > 0, ns).otherwise(fallback)


def key128(*parts: Column) -> Column:
    """32 hex digits that identify the parts in order; a null part differs from an empty one."""
    return F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, 32)


def lifecycle_correlation(account: Column, position: Column, order: Column) -> Column:
    """One key for all of an order's life: that of its position where it has one."""
    held = F.coalesce(position, F.lit(0)) != 0
    return key128(F.lit("lifecycle"), account, F.when(held, F.lit("position")).otherwise(F.lit("order")), F.when(held, position).otherwise(order))


def event_id(domain: str, *parts: Column) -> Column:
    """A 64-bit id of the parts that is never 0."""
    found = F.xxhash64(F.lit(domain), *parts)
    return F.when(found == 0, F.lit(1).cast("long")).otherwise(found)


def eastern_to_utc(local: Column) -> Column:
    """Wall-clock time of the US east coast as UTC; hours that a clock change skips move forward."""
    return F.to_utc_timestamp(local, "America/New_York")


def valid_strategy_id(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9._-]{1,31}\z"), F.lit(False))


def flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(1 << bit) != 0


def time_quality(flags: Column) -> Column:
    """Bits 8 to 10; values over 4 are unknown, which is 0."""
    q = F.shiftright(flags.bitwiseAND(0x700), 8)
    return F.when(q <= 4, q).otherwise(F.when(q.isNotNull(), F.lit(0)))


def active_at(start: Column, end: Column, at: Column) -> Column:
    """Whether ``at`` lies in [start, end); a null end is open."""
    return (at >= start) & (end.isNull() | (at < end))


def used_share(used: Column, limit: Column) -> Column:
    return F.when(limit > 0, F.greatest(F.least(used / limit, F.lit(1.0)), F.lit(0.0)))


def signed(amount_micros: Column) -> Column:
    """``+1.50`` or ``-1.50`` of a number of millionths."""
    return F.format_string("%+.2f", amount_micros / 1e6)


def rotated(value: Column, bits: int) -> Column:
    """A 64-bit number with its bits rotated to the left."""
    return F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(value, 64 - bits))


def _held(exact: Column) -> Column:
    most = F.lit(LARGEST).cast("decimal(20,0)")
    return F.when(exact > most, F.lit(LARGEST)).when(exact < -most - 1, F.lit(-LARGEST - 1)).otherwise(exact.try_cast("long"))


def saturating_add(a: Column, b: Column) -> Column:
    """The sum, held inside the 64-bit range."""
    return _held(a.cast("decimal(20,0)") + b.cast("decimal(20,0)"))


def saturating_multiply(a: Column, b: Column) -> Column:
    """The product, held inside the 64-bit range."""
    exact = F.try_multiply(a, b)
    over = F.when((a < 0) == (b < 0), F.lit(LARGEST)).otherwise(F.lit(-LARGEST - 1))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(exact, over))


def side_label(side: Column) -> Column:
    return F.when(side == "buy", "BUY").when(side == "sell", "SELL").otherwise("UNKNOWN")


def fixed(value: Column, decimals: int) -> Column:
    """A number with so many decimals."""
    return F.format_string(f"%.{decimals}f", value.cast("double"))


def civil_utc(ns: Column) -> Column:
    """``2024-01-31 08:15:00 UTC`` of nanoseconds since the epoch; the session's time zone must be UTC."""
    return F.concat(F.date_format(F.timestamp_seconds(whole_quotient(ns, F.lit(1_000_000_000))), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
