"""Points in time as Unix seconds, and calendar days of a time zone as text YYYY-MM-DD.

A null stamp is unknown, never 0. Whoever needs the present passes it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 1970 to 2100; how far stamps may lie ahead of a clock; the file table's own, narrower range.
LEAST, MOST, AHEAD = 0.0, 4102444800.0, 2 * 86400
FILETIME_LEAST, FILETIME_TICKS, FILETIME_SHIFT = 631152000.0, 10_000_000, 11_644_473_600
#: Age bands: (code, days up to which).
BANDS = (("d1", 1), ("d7", 7), ("d30", 30), ("d90", 90), ("d365", 365), ("older", None))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe(ts: Column | str) -> Column:
    """The stamp if it can be one, else null; NaN sorts above all numbers, so it must go before any maximum."""
    ts = _c(ts).cast("double")
    return F.when(~F.isnan(ts) & ts.between(LEAST, MOST), ts)


def ceiling(now: Column | float) -> Column:
    now = now if isinstance(now, Column) else F.lit(float(now))
    return F.least(F.lit(MOST), now + AHEAD)


def safe_until(ts: Column | str, top: Column) -> Column:
    """safe(), and not beyond top."""
    ts = _c(ts).cast("double")
    return F.when(~F.isnan(ts) & (ts >= LEAST) & (ts <= top), ts)


def clock(ts: Column | str, tz: str = "UTC") -> Column:
    """Wall-clock time of a zone, whatever the session's zone is."""
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), _c(ts).cast("decimal(18,6)"))
    return utc if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def day(ts: Column | str, tz: str = "UTC") -> Column:
    """The calendar day of a stamp, or null."""
    return F.date_format(clock(safe(ts), tz), "yyyy-MM-dd")


def day_start(text: Column | str, hour: int = 0, tz: str = "UTC") -> Column:
    """Unix seconds of an hour of a day given as strict YYYY-MM-DD; null for anything else."""
    text = _c(text)
    local = F.try_to_timestamp(F.when(F.rlike(text, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), F.concat(text, F.lit(" 00:00:00"))), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    local = local + F.make_dt_interval(F.lit(0), F.lit(hour))
    return seconds(local if tz == "UTC" else F.convert_timezone(F.lit(tz), F.lit("UTC"), local))


def seconds(ntz: Column | str) -> Column:
    """Unix seconds (with fractions) of a wall-clock time in UTC."""
    ntz = _c(ntz)
    days = F.datediff(ntz, F.lit("1970-01-01")).cast("double")
    return days * 86400 + F.hour(ntz) * 3600 + F.minute(ntz) * 60 + F.extract(F.lit("SECOND"), ntz).cast("double")


def age_days(ts: Column | str, now: float) -> Column:
    return (F.lit(float(now)) - _c(ts)) / 86400


def age_band(ts: Column | str, now: float) -> Column:
    """The band's code; unknown and 0 are older."""
    ts = _c(ts)
    out = F.when(ts.isNull() | (ts == 0), F.lit("older"))
    for code, most in BANDS[:-1]:
        out = out.when(age_days(ts, now) <= most, F.lit(code))
    return out.otherwise(F.lit("older"))


def age_code(ts: Column | str, now: float) -> Column:
    """unknown, today, yesterday, 12d, 3m or 1.5y."""
    ts, d = _c(ts), age_days(ts, now)
    return (
        F.when(ts.isNull() | (ts == 0), F.lit("unknown")).when(d < 1, F.lit("today")).when(d < 2, F.lit("yesterday"))
        .when(d < 30, F.concat(F.floor(d + 0.5).cast("string"), F.lit("d")))
        .when(d < 365, F.concat(F.floor(d / 30 + 0.5).cast("string"), F.lit("m")))
        .otherwise(F.concat(F.format_string("%.1f", d / 365), F.lit("y")))
    )


def from_filetime(ticks: Column | str) -> Column:
    """100 ns since 1601 as Unix seconds; 0 and what lies before 1990 or after 2100 is unknown."""
    ticks = _c(ticks)
    ts = ticks.cast("double") / FILETIME_TICKS - FILETIME_SHIFT
    return F.when((ticks != 0) & ts.between(FILETIME_LEAST, MOST), ts)
