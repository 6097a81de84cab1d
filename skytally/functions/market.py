"""Interval-market text and quotes to columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from skytally.functions.units import c_to_f  # noqa: F401  (re-exported for callers)

# Question and title wording.
TITLE = r"(?i)^\s*(highest|lowest)\s+temperature\s+in\s+(.+?)\s+on\s+([a-z]+\s+\d{1,2})\??\s*$"
NUMBER = r"(?i)(-?\d+(?:\.\d+)?)\s*(?:deg(?:rees?)?|°)?\s*([FC])?"
RANGE_WORDS = r"\b(?:between|from|to|through|range)\b"
AT_LEAST_WORDS = r"\b(?:at\s+or\s+above|or\s+higher|or\s+more|at\s+least|above|over|greater\s+than)\b"
AT_MOST_WORDS = r"\b(?:at\s+or\s+below|or\s+lower|or\s+less|at\s+most|below|under|less\s+than)\b"


def _blank_null(c: Column) -> Column:
    return F.when(c != "", c)


def title_parts(title: Column) -> tuple[Column, Column, Column]:
    """(kind, city, month-day) of an event title, nulls when it does not match."""
    kind = _blank_null(F.initcap(F.regexp_extract(title, TITLE, 1)))
    return kind, _blank_null(F.trim(F.regexp_extract(title, TITLE, 2))), _blank_null(F.trim(F.regexp_extract(title, TITLE, 3)))


def infer_unit(text: Column, default: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.contains("celsius") | low.contains("°c"), "C")
        .when(low.contains("fahrenheit") | low.contains("°f"), "F")
        .otherwise(F.upper(default))
    )


def survey_unit(text: Column) -> Column:
    """The survey job's rule: only the words count, and Celsius is the default."""
    low = F.lower(text)
    return F.when(low.contains("celsius"), "C").when(low.contains("fahrenheit"), "F").otherwise("C")


def temperature_rule(text: Column, default: Column) -> Column:
    """Question text to ``struct(rule_min, rule_max, unit)``; null bounds are open ends."""
    t = F.regexp_replace(text, "[–—]", "-")
    low = F.lower(t)
    inferred = infer_unit(t, default)
    numbers = F.regexp_extract_all(t, F.lit(NUMBER), 1)
    units = F.regexp_extract_all(t, F.lit(NUMBER), 2)
    first_unit = F.upper(F.get(units, F.lit(0)))
    unit = F.when(F.coalesce(first_unit, F.lit("")) != "", first_unit).otherwise(inferred)
    a = F.get(numbers, F.lit(0)).cast("double")
    b = F.get(numbers, F.lit(1)).cast("double")
    dashed = t.rlike(r"\d\s*-\s*\d")
    b = F.when(dashed & (a >= 0) & (b < 0), F.abs(b)).otherwise(b)
    is_range = b.isNotNull() & (low.rlike(RANGE_WORDS) | dashed)
    at_least, at_most = low.rlike(AT_LEAST_WORDS), low.rlike(AT_MOST_WORDS)
    lo = F.when(is_range, F.least(a, b)).when(at_least, a).when(at_most, F.lit(None)).otherwise(a)
    hi = F.when(is_range, F.greatest(a, b)).when(at_least, F.lit(None)).when(at_most, a).otherwise(a)
    return F.struct(lo.cast("double").alias("rule_min"), hi.cast("double").alias("rule_max"), unit.alias("unit"))


def jsonish_list(text: Column) -> Column:
    """A JSON array of scalars, or JSON text of such an array, as array<string>."""
    inner = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"]
    return F.from_json(inner, "array<string>")


def pick_by_outcome(outcomes: Column, values: Column, name: str) -> Column:
    """The value at the position of the named outcome (case-blind), or null."""
    pairs = F.filter(
        F.arrays_zip(outcomes.alias("o"), values.alias("v")), lambda p: F.lower(F.trim(p["o"])) == name.lower()
    )
    return F.get(pairs, F.lit(0))["v"]


def clamp01(p: Column) -> Column:
    return F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def no_price(no: Column, yes: Column) -> Column:
    return F.coalesce(no, clamp01(1.0 - yes))


def station_code(url: Column) -> Column:
    """Last path part (before any ``/date``) when it is four letters or digits."""
    path = F.regexp_replace(F.substring_index(url, "?", 1), "/+$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    at = F.array_position(parts, "date")
    parts = F.when(at > 0, F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(parts)
    code = F.upper(F.get(parts, F.size(parts) - 1))
    return F.when(code.rlike("^[A-Z0-9]{4}$"), code).otherwise("")


def quote_probability(bid: Column, ask: Column, last: Column) -> Column:
    """Mid, else last, else bid, else ask; only positive quotes count."""
    return clamp01(
        F.when((bid > 0) & (ask > 0), (bid + ask) / 2.0).when(last > 0, last).when(bid > 0, bid).when(ask > 0, ask)
    )


def opposite(side: Column) -> Column:
    return F.when(F.upper(F.trim(side)) == "NO", "YES").otherwise("NO")


def move_target(base: Column, fraction: float) -> Column:
    """Price after moving that fraction of the way from base to 1."""
    b = F.when(base.isNotNull(), F.least(F.lit(0.999999), F.greatest(F.lit(0.0), base)))
    return b + min(1.0, max(0.0, fraction)) * (1.0 - b)


def move_fraction(previous: Column, price: Column) -> Column:
    """Rises relative to the way left to 1, drops relative to the previous price."""
    p = F.when(previous.isNotNull(), F.least(F.lit(0.999999), F.greatest(F.lit(0.0), previous)))
    c = clamp01(price)
    return F.when(p.isNull() | c.isNull(), F.lit(None).cast("double")).when(c >= p, (c - p) / F.greatest(F.lit(1e-9), 1.0 - p)).otherwise(F.coalesce(F.try_divide(p - c, p), F.lit(0.0)))


def impossible(kind: Column, high: Column, low: Column, lo: Column, hi: Column) -> Column:
    """The observed extreme already rules the interval out."""
    return F.coalesce(F.when(kind == "Highest", high > hi).otherwise(low < lo), F.lit(False))


def possible_again(kind: Column, high: Column, low: Column, lo: Column, hi: Column) -> Column:
    return F.coalesce(F.when(kind == "Highest", high <= hi).otherwise(low >= lo), F.lit(True))


def extreme_reached(kind: Column, high: Column, low: Column, lo: Column, hi: Column) -> Column:
    inside = lambda v: F.coalesce(v >= lo, lo.isNull()) & F.coalesce(v <= hi, hi.isNull())
    return F.when(kind == "Highest", high.isNotNull() & inside(high)).otherwise(low.isNotNull() & inside(low))
