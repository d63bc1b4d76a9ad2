"""Calendars: days since a reference date, adding spans, leap years, seasons.

Gregorian columns use Spark's own dates.  For the 365-day and 360-day calendars, and years before
1 AD, the same arithmetic runs on plain integers (:func:`time_add`, :func:`days_between`), which
serve as driver-side helpers and inside Arrow functions.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, functions as F

#: Days of the months of a common year.
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
#: Three-month seasons by their last month; the first ends in January.
SEASONS = tuple("".join(MONTHS[(m - k) % 12][0] for k in (2, 1, 0)) for m in range(12))


def two_digits(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def steps_in_month(year: Column, month: Column, hours: int) -> Column:
    """Time steps of a month at a step of so many hours."""
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1)))) * F.lit(24 // hours if 24 % hours == 0 else 24 / hours)


def days_since(ts: Column, reference: str = "1900-01-01") -> Column:
    """Fractional days since a reference date."""
    micros = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.lit(reference).cast("timestamp"))
    return micros / F.lit(86400e6)


def timestamp_of(days: Column, reference: str = "1900-01-01") -> Column:
    return F.timestamp_micros((F.unix_micros(F.lit(reference).cast("timestamp")) + F.round(days * F.lit(86400e6))).cast("bigint"))


def season_year(year: Column, month: Column) -> Column:
    """The year a season belongs to: November and December count to the next."""
    return F.when(month >= 11, year + 1).otherwise(year)


def month_index(year: Column, month: Column) -> Column:
    return year * 12 + month - 1


def expanded_year(suffix: Column, now_suffix: int, century: int = 2000) -> Column:
    """A two-digit year in full: a suffix beyond the present one is of the century before."""
    return F.when(suffix > now_suffix, F.lit(century - 100) + suffix).otherwise(F.lit(century) + suffix)


def fixed_calendar_days(year: Column, month: Column, day: Column, days_per_year: int = 365) -> Column:
    """Days from the start of year 1 in a calendar of 365 (no leap years) or 360 days (months of 30) a year; no year 0."""
    y = F.when(year > 0, year - 1).otherwise(year)
    before = F.element_at(F.array(*[F.lit(sum(MONTH_DAYS[:m])) for m in range(12)]), month.cast("int")) if days_per_year == 365 else (month - 1) * 30
    return (y * days_per_year + before + day - 1).cast("bigint")


def fixed_calendar_date(days: Column, days_per_year: int = 365) -> Column:
    """Struct (year, month, day) of such days; the inverse of :func:`fixed_calendar_days`."""
    y, rest = F.floor(days / days_per_year), F.pmod(days, F.lit(days_per_year)).cast("int")
    if days_per_year == 365:
        starts = F.array(*[F.lit(sum(MONTH_DAYS[:m])) for m in range(12)])
        month = F.size(F.filter(starts, lambda s: s <= rest))
        day = rest - F.element_at(starts, month) + 1
    else:
        month, day = F.floor(rest / 30).cast("int") + 1, rest % 30 + 1
    return F.struct(F.when(y >= 0, y + 1).otherwise(y).cast("int").alias("year"), month.alias("month"), day.cast("int").alias("day"))


def calendar_add(year: Column, month: Column, day: Column, seconds: Column, step: dict[str, Column], days_per_year: int = 365, leap_years: bool = True) -> Column:
    """Struct (year, month, day, seconds) of a date, with seconds of its day, after a step of years, months, days and seconds.

    Years and months go first and keep the day of the month, cut to the month's length; then days and seconds,
    which may be negative or fractions.  Calendars: Gregorian (``leap_years``), 365 days without leap years, or 360 days in months of 30.
    There is no year 0: the year before 1 is -1, and year 0 or a null gives null.  Seconds are rounded to millionths.
    """
    zero = F.lit(0)
    part = lambda name: step.get(name, zero)
    years = F.when(year > 0, year - 1).when(year < 0, year)
    months = years.cast("bigint") * 12 + month - 1 + part("years") * 12 + part("months")
    y, m = F.floor(months / 12), F.pmod(months, F.lit(12)).cast("int") + 1
    moved = (part("years") != 0) | (part("months") != 0)
    d = F.when(moved, F.least(day, _month_length(y, m, days_per_year, leap_years))).otherwise(day)
    micros = F.round((part("days").cast("double") * 86400 + seconds + part("seconds")) * F.lit(1e6)).cast("bigint")
    full = _month_start(y, m, days_per_year, leap_years) + d - 1 + F.floor(micros / F.lit(86_400_000_000))
    rest = F.pmod(micros, F.lit(86_400_000_000)) / F.lit(1e6)
    at = _date_of(full, days_per_year, leap_years)
    label = F.when(at["y"] >= 0, at["y"] + 1).otherwise(at["y"])
    return F.struct(label.cast("int").alias("year"), at["m"].cast("int").alias("month"), at["d"].cast("int").alias("day"), rest.alias("seconds"))


def _is_leap(y: Column) -> Column:
    """Gregorian leap years, ``y`` being years since the start of year 1."""
    n = y + 1
    return ((F.pmod(n, F.lit(4)) == 0) & (F.pmod(n, F.lit(100)) != 0)) | (F.pmod(n, F.lit(400)) == 0)


def _month_length(y: Column, m: Column, days_per_year: int, leap_years: bool) -> Column:
    if days_per_year == 360:
        return F.lit(30)
    plain = F.element_at(F.array(*[F.lit(n) for n in MONTH_DAYS]), m)
    return plain + F.when((m == 2) & _is_leap(y), 1).otherwise(0) if leap_years else plain


def _month_start(y: Column, m: Column, days_per_year: int, leap_years: bool) -> Column:
    """Days from the start of year 1 to that of a month; ``y`` counts years from there."""
    if days_per_year == 360:
        return (y * 360 + (m - 1) * 30).cast("bigint")
    before = F.element_at(F.array(*[F.lit(sum(MONTH_DAYS[:k])) for k in range(12)]), m)
    n = (y * 365 + before).cast("bigint")
    if not leap_years:
        return n
    return n + F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400) + F.when((m > 2) & _is_leap(y), 1).otherwise(0)


def _date_of(days: Column, days_per_year: int, leap_years: bool) -> Column:
    """Struct (y, m, d) of days from the start of year 1, y counted from there."""
    if not leap_years or days_per_year == 360:
        date = fixed_calendar_date(days, days_per_year)
        return F.struct(F.floor(days / days_per_year).cast("bigint").alias("y"), date["month"].alias("m"), date["day"].alias("d"))
    # from a guess that is never late, at most one year early
    low = F.floor((days + 1) * 400 / F.lit(146097)).cast("bigint")
    guess = F.get(F.filter(F.array(low + 1, low, low - 1), lambda g: _month_start(g, F.lit(1), 365, True) <= days), F.lit(0))
    month = lambda y: F.get(F.filter(F.sequence(F.lit(12), F.lit(1), F.lit(-1)), lambda m: _month_start(y, m, 365, True) <= days), F.lit(0))
    return F.transform(F.array(guess), lambda y: F.transform(F.array(month(y)), lambda m: F.struct(y.alias("y"), m.alias("m"), (days - _month_start(y, m, 365, True) + 1).alias("d")))[0])[0]


def _leap(year: int) -> bool:
    """Gregorian; years before 1 AD are counted without a year 0."""
    y = year if year > 0 else year + 1
    return y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)


def _days(year: int, month: int, leap_years: bool, days_per_year: int) -> int:
    if days_per_year == 360:
        return 30
    return MONTH_DAYS[month - 1] + (month == 2 and leap_years and _leap(year))


def _ordinal(year: int, month: int, day: int, leap_years: bool, days_per_year: int) -> int:
    """Days from the start of year 1; negative before."""
    y = year - 1 if year > 0 else year
    if days_per_year == 360:
        return y * 360 + (month - 1) * 30 + day - 1
    n = y * 365 + sum(MONTH_DAYS[: month - 1]) + day - 1
    if leap_years:
        n += y // 4 - y // 100 + y // 400 + (month > 2 and _leap(year))
    return n


def _seconds(parts: list) -> Fraction:
    h, m, s = (Fraction(x) for x in parts)
    return h * 3600 + m * 60 + s


def days_between(first: list, second: list, leap_years: bool = True, days_per_year: int = 365) -> float:
    """Days, with fraction, from one date to another, each [year, month, day, hour, minute, second] or a start of it."""
    totals = []
    for date in (first, second):
        date = [*date, *(0, 1, 1, 0, 0, 0)[len(date) :]]
        if date[0] == 0:
            raise ValueError("there is no year 0")
        totals.append(_ordinal(*date[:3], leap_years, days_per_year) + _seconds(date[3:]) / 86400)
    return float(totals[1] - totals[0])


def time_add(start: list, step: list, leap_years: bool = True, days_per_year: int = 365) -> list:
    """The date ``step`` after ``start``, both [year, month, day, hour, minute, second] or a start of it.

    Years and months come first and keep the day of the month, cut to the month's length; then
    days, hours, minutes and seconds, which may be fractions or negative.  Seconds are rounded
    to millionths.  Years skip 0.
    """
    start, step = ([*x, *d[len(x) :]] for x, d in ((list(start), (0, 1, 1, 0, 0, 0)), (list(step), (0,) * 6)))
    if start[0] == 0:
        raise ValueError("there is no year 0")
    months = (start[0] - (start[0] > 0)) * 12 + start[1] - 1 + int(step[0]) * 12 + int(step[1])
    year, month = months // 12, months % 12 + 1
    year += year >= 0
    day = min(int(start[2]), _days(year, month, leap_years, days_per_year)) if step[0] or step[1] else int(start[2])
    total = Fraction(_ordinal(year, month, day, leap_years, days_per_year)) * 86400 + _seconds(start[3:])
    total += Fraction(step[2]) * 86400 + _seconds(step[3:])
    total = Fraction(round(total * 1_000_000), 1_000_000)
    days, rest = divmod(total, 86400)
    # the year by estimate, then step to the right one
    y = int(days // 366)
    while True:
        label = y + 1 if y >= 0 else y
        first = _ordinal(label, 1, 1, leap_years, days_per_year)
        after = _ordinal(label + 1 if label != -1 else 1, 1, 1, leap_years, days_per_year)
        if first <= days < after:
            break
        y += 1 if days >= after else -1
    day, month = int(days - first), 1
    while day >= _days(label, month, leap_years, days_per_year):
        day -= _days(label, month, leap_years, days_per_year)
        month += 1
    hour, rest = divmod(rest, 3600)
    minute, second = divmod(rest, 60)
    return [label, month, day + 1, int(hour), int(minute), int(second) if second == int(second) else float(second)]
