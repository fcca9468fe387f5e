"""Money, ratio, session and bucket expressions.

Undefined is NULL, never 0 or infinite; money rounds half to even.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Session segments by exchange-local start, duration buckets in seconds, timeframes in seconds,
# reliability bounds, effect bounds.
SEGMENTS = [("00:00", "asia"), ("02:00", "london"), ("07:00", "pre_market"), ("08:30", "rth_open"), ("09:30", "rth_morning"), ("11:00", "rth_midday"), ("13:00", "rth_afternoon"), ("14:45", "rth_close"), ("15:15", "post_market"), ("17:00", "overnight")]
DURATION_BUCKETS = [("under_1m", 60), ("1m_to_5m", 300), ("5m_to_15m", 900), ("15m_to_1h", 3600), ("1h_to_4h", 14400), ("over_4h", None)]
TIMEFRAMES = {"1s": 1, "5s": 5, "15s": 15, "30s": 30, "1m": 60, "2m": 120, "3m": 180, "5m": 300, "10m": 600, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14400, "1d": 86400, "1w": 604800}
MIN_SAMPLE, MIN_RELIABLE = 5, 30
EFFECTS = [("negligible", 0.2), ("small", 0.5), ("medium", 0.8), ("large", None)]


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def money(x: Column) -> Column:
    return F.bround(x, 8)


def to_tick(price: Column, tick: Column) -> Column:
    return F.bround(price / tick, 0) * tick


def ladder(x: Column, steps: list[tuple[str, float | None]]) -> Column:
    """The first name whose upper bound lies above x; NULL for NULL."""
    out = F.lit(None).cast("string")
    for name, below in reversed(steps):
        out = F.lit(name) if below is None else F.when(x < below, F.lit(name)).otherwise(out)
    return F.when(x.isNotNull(), out)


def reliability(n: Column) -> Column:
    return ladder(n, [("insufficient", MIN_SAMPLE), ("provisional", MIN_RELIABLE), ("reliable", None)])


def effect(d: Column) -> Column:
    return ladder(F.abs(d), EFFECTS)


def duration_bucket(seconds: Column) -> Column:
    return ladder(seconds, DURATION_BUCKETS)


def outcome(net: Column) -> Column:
    return F.when(net > 0, "winner").when(net < 0, "loser").when(net == 0, "scratch")


def clock(hhmm: str) -> int:
    h, m = hhmm.split(":")
    return int(h) * 3600 + int(m) * 60


def local_seconds(local: Column) -> Column:
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def session_date(local: Column, rollover: Column) -> Column:
    """The session of an exchange-local time: the next day from the rollover on; a Saturday becomes the Monday after."""
    day = F.when(local_seconds(local) >= rollover, F.date_add(F.to_date(local), 1)).otherwise(F.to_date(local))
    return F.when(F.weekday(day) == 5, F.date_add(day, 2)).otherwise(day)


def segment(local: Column) -> Column:
    out = F.lit(SEGMENTS[0][1])
    for start, name in SEGMENTS[1:]:
        out = F.when(local_seconds(local) >= clock(start), F.lit(name)).otherwise(out)
    return out


def root_symbol(symbol: Column) -> Column:
    """``ESZ5`` to ``ES``: without a month code and the digits after it, if anything stands before."""
    return F.regexp_replace(symbol, r"(?<=.)[FGHJKMNQUVXZ][0-9]+$", "")


def r_multiple(net: Column, risk: Column) -> Column:
    return F.when(risk > 0, ratio(net, risk))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    """The logistic function, with its exponent held within 30."""
    return 1 / (1 + F.exp(-clamp(x, -30.0, 30.0)))


def to_scaled(x: Column, double: bool = False) -> Column:
    """Money as a whole number of 10^-8; double: of a double's own multiple, not of its shortest text."""
    return F.rint(x * 1e8).cast("long") if double else F.bround(x.cast("decimal(28,10)") * 100_000_000, 0).cast("long")


def from_scaled(x: Column) -> Column:
    return (x.cast("decimal(20,0)") / F.lit(100_000_000).cast("decimal(10,0)")).cast("decimal(20,8)")


def risk_per_contract(direction: Column, entry: Column, stop: Column) -> Column:
    """Points at risk; NULL for a stop on the wrong side."""
    points = (entry - stop) * F.when(direction == "long", 1).otherwise(-1)
    return F.when(points > 0, points)


def planned_risk(direction: Column, entry: Column, stop: Column, quantity: Column, point: Column) -> Column:
    return F.when(quantity > 0, risk_per_contract(direction, entry, stop) * quantity * point)


def planned_reward(direction: Column, entry: Column, target: Column, quantity: Column, point: Column) -> Column:
    points = (target - entry) * F.when(direction == "long", 1).otherwise(-1)
    return F.when((points > 0) & (quantity > 0), points * quantity * point)


def reward_risk(risk: Column, reward: Column) -> Column:
    return F.when(risk > 0, ratio(reward, risk))


# Decimal places and suffix of a unit in reports.
UNITS = {"currency": (2, ""), "ratio": (4, ""), "r": (3, "R"), "seconds": (0, "s"), "count": (2, "")}


def half_even(x: Column, places: int) -> Column:
    return F.rint(x.cast("double") * 10**places) / 10**places


def plain(x: Column, places: int, signed: bool = False) -> Column:
    """A number with so many places, rounded half to even as a double: what counts is the double's multiple, not its shortest text.
    NULL for NULL.

    signed: what rounds to 0 from below keeps its sign, -0."""
    rounded = half_even(x, places)
    return F.when(x.isNotNull(), F.format_string(f"%.{places}f", rounded if signed else rounded + F.lit(0.0)))


def half_away(x: Column, places: int) -> Column:
    """A double with so many places, rounded half away from zero as a double: round() here goes by its shortest text."""
    return F.signum(x) * F.floor(F.abs(x) * float(10**places) + 0.5) / float(10**places)


def display_value(x: Column, unit: str) -> Column:
    places, suffix = UNITS.get(unit, (2, ""))
    return F.coalesce(F.concat(plain(x, places), F.lit(suffix)), F.lit("not available"))


def evidence_text(x: Column, unit: str) -> Column:
    """A value as evidence cites it: money, percentage, ratio, R or duration."""
    cents = half_even(x, 2)
    money = F.format_number(F.abs(cents), 2)
    seconds = F.floor(x).cast("long")
    out = {
        "currency": F.concat(F.when(cents < 0, "-$").otherwise("$"), money), "percent": F.concat(plain(x * 100, 1), F.lit("%")),
        "ratio": plain(x, 3), "r": F.concat(plain(x, 2), F.lit("R")), "seconds": F.concat(seconds.cast("string"), F.lit("s")),
    }[unit]
    return F.coalesce(out, F.lit("not defined for this sample"))


def trim_decimal(text: Column) -> Column:
    """A decimal's text without the zeros at its end, and without a point that nothing follows."""
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


#: Report types and the unit that each covers; weeks run from Monday.
PERIODS = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}


def period_start(kind: Column, day: Column) -> Column:
    """First day of the period of a type that a day falls in; NULL for an unknown type."""
    out = F.lit(None).cast("date")
    for name, unit in PERIODS.items():
        out = F.when(kind == name, F.to_date(F.date_trunc(unit, day))).otherwise(out)
    return out


def period_end(kind: Column, start: Column) -> Column:
    """Last day of the period that begins on ``start``."""
    out = F.lit(None).cast("date")
    steps = {"daily": F.date_add(start, 1), "weekly": F.date_add(start, 7), "monthly": F.add_months(start, 1), "quarterly": F.add_months(start, 3), "yearly": F.add_months(start, 12)}
    for name, after in steps.items():
        out = F.when(kind == name, F.date_sub(after, 1)).otherwise(out)
    return out


def period_label(kind: Column, start: Column) -> Column:
    """A period as headlines name it: 1999-03-08, 1999-03-08 to 1999-03-14, March 1999, Q1 1999, 1999."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    names = {
        "daily": iso(start), "weekly": F.concat(iso(start), F.lit(" to "), iso(period_end(kind, start))), "monthly": F.date_format(start, "MMMM yyyy"),
        "quarterly": F.concat(F.lit("Q"), F.quarter(start), F.lit(" "), F.year(start)), "yearly": F.year(start).cast("string"),
    }
    out = F.lit(None).cast("string")
    for name, label in names.items():
        out = F.when(kind == name, label).otherwise(out)
    return out


def trim_decimal(text: Column, least: int = 0) -> Column:
    """A plain decimal without zeros at its end, but with ``least`` digits after the point; other texts stay as they are."""
    whole, fraction = F.regexp_extract(text, r"^(-?\d+)\.(\d+)$", 1), F.rtrim(F.regexp_extract(text, r"^(-?\d+)\.(\d+)$", 2), F.lit("0"))
    kept = F.when(F.length(fraction) < least, F.rpad(fraction, least, "0")).otherwise(fraction)
    return F.when(whole == "", text).otherwise(F.concat(whole, F.when(kept == "", "").otherwise(F.concat(F.lit("."), kept))))


#: What stands for a number in a text: {{ key }}.
PLACEHOLDER = r"\{\{\s*([a-zA-Z0-9_.\[\]-]+)\s*\}\}"


def render(text: Column, values: Column) -> Column:
    """The text with each placeholder replaced by its key's value in the map ``values``, or by [unavailable]."""
    keys = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1))
    said = lambda piece, key: F.when(key.isNull(), piece).otherwise(F.concat(piece, F.coalesce(F.try_element_at(values, key), F.lit("[unavailable]"))))
    return F.concat_ws("", F.zip_with(F.split(text, PLACEHOLDER, -1), keys, said))
