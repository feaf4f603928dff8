"""Scalar expressions: clock times, rounding, day order, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day types in display order.
DAY_ORDER = ["WEEKDAY", "SATURDAY", "SUNDAY", "PUBLIC_HOLIDAY"]
# Days every journey is expected to cover.
CORE_DAYS = ["WEEKDAY", "SATURDAY", "SUNDAY"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _two_digits(n: Column) -> Column:
    """A whole number with a zero before it if it is one digit; patterns are slower to format."""
    text = n.cast("string")
    return F.when(n.between(0, 9), F.concat(F.lit("0"), text)).otherwise(text)


def _hh_mm(hours: Column, minutes: Column) -> Column:
    return F.concat(_two_digits(hours.cast("int")), F.lit(":"), _two_digits(minutes.cast("int")))


def clock(minutes) -> Column:
    """Whole minutes past midnight as HH:MM; null stays null."""
    m = _c(minutes)
    return F.when(m.isNotNull(), _hh_mm(F.floor(m / 60), F.pmod(m, F.lit(60))))


def clock_rounded(minutes) -> Column:
    """Fractional minutes as HH:MM, rounded half to even, wrapping at 24 hours."""
    m = F.rint(_c(minutes)).cast("bigint")
    return F.when(m.isNotNull(), _hh_mm(F.pmod(F.floor(m / 60), F.lit(24)), F.pmod(m, F.lit(60))))


def to_minutes(hhmm) -> Column:
    """HH:MM as minutes past midnight."""
    p = F.split(_c(hhmm), ":")
    return (p.getItem(0).cast("int") * 60 + p.getItem(1).cast("int"))


def iso_date(d) -> Column:
    return F.date_format(_c(d), "yyyy-MM-dd")


def half_even(x, places: int = 0) -> Column:
    return F.bround(_c(x), places)


def ratio_tenths(total, n) -> Column:
    """total / n to one decimal, halves away from zero, in whole-number arithmetic."""
    return (F.floor((F.lit(20) * _c(total) + _c(n)) / (F.lit(2) * _c(n))) / F.lit(10.0))


def ratio_whole(total, n) -> Column:
    """total / n to a whole number, halves away from zero."""
    return F.floor((F.lit(2) * _c(total) + _c(n)) / (F.lit(2) * _c(n)))


def day_rank(day, other: int = 9) -> Column:
    d = _c(day)
    out = F.lit(other)
    for i, name in reversed(list(enumerate(DAY_ORDER))):
        out = F.when(d == name, F.lit(i)).otherwise(out)
    return out


def ordered_or_untimed(first, then) -> Column:
    """True when ``then`` is not before ``first``, or either has no time."""
    a, b = _c(first), _c(then)
    return a.isNull() | b.isNull() | (b >= a)


def daypart(board, arrive) -> Column:
    m = F.coalesce(_c(board), _c(arrive))
    return (F.when(m.isNull(), "other").when(m < 720, "morning")
            .when(m < 1020, "afternoon").otherwise("evening"))


def sign_parts(label) -> Column:
    """The trimmed, non-empty pieces of an ``A - B - C`` label."""
    return F.filter(F.transform(F.split(_c(label), " - "), lambda s: F.trim(s)), lambda s: s != "")


def bus_sign(label) -> Column:
    """struct(origin, terminus, via) read from a route label."""
    c = _c(label)
    p = sign_parts(c)
    n = F.size(p)
    return F.struct(
        F.when(n > 0, F.element_at(p, 1)).otherwise(c).alias("origin"),
        F.when(n > 0, F.element_at(p, -1)).otherwise(c).alias("terminus"),
        F.when(n > 2, F.array_join(F.slice(p, F.lit(2), n - 2), ", "))
        .otherwise(F.lit("")).alias("via"))


def duration_text(minutes) -> Column:
    m = _c(minutes)
    h, r = F.floor(m / 60).cast("string"), F.pmod(m, F.lit(60))
    return (F.when(m.isNull(), "time not published")
            .when(m < 60, F.concat(m.cast("string"), F.lit(" min")))
            .when(r == 0, F.concat(h, F.lit(" h")))
            .otherwise(F.concat(h, F.lit(" h "), r.cast("string"))))


def ride_key(schedule="schedule_id", trip="trip_index", a="from_seq", b="to_seq") -> Column:
    return F.concat_ws(":", *[_c(x).cast("string") for x in (schedule, trip, a, b)])


