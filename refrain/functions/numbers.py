"""Numbers, lengths and partial dates as column expressions (ids N1-N5, D1-D7, G4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_step(delta: Column, missing: float) -> Column:
    """1, .65, .3 or 0 by the distance of two lengths; ``missing`` for none."""
    return F.when(delta.isNull(), missing).when(delta <= 3, 1.0).when(delta <= 8, 0.65).when(delta <= 15, 0.3).otherwise(0.0)


def duration_points(delta: Column, audio: Column) -> Column:
    """Points for the distance of two lengths; without one 6 if audio evidence exists, else 0."""
    return F.when(delta.isNull(), F.when(audio, 6.0).otherwise(0.0)).when(delta <= 3, 16.0).when(delta <= 8, 13.0).when(delta <= 15, 7.0).when(delta <= 30, 1.0).otherwise(-14.0)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def iso_seconds(c: Column) -> Column:
    """An ISO 8601 time span (hours, minutes, seconds) in seconds; null for any other text."""
    p = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    part = lambda i: F.coalesce(F.regexp_extract(c, p, i).try_cast("long"), F.lit(0).cast("long"))
    return F.when(c.rlike(p) & (c != "PT"), part(1) * 3600 + part(2) * 60 + part(3))


def clock_seconds(c: Column) -> Column:
    """Seconds of ``h:mm:ss`` or ``m:ss``; null for any other text."""
    p = r"^(?:(\d+):)?(\d+):(\d{2})$"
    part = lambda i: F.coalesce(F.regexp_extract(c, p, i).try_cast("long"), F.lit(0).cast("long"))
    return F.when(c.rlike(p), part(1) * 3600 + part(2) * 60 + part(3))


def date_prefix_year(release_date: Column, year: Column) -> Column:
    """The first four characters of the date if there is a date, even an unreadable one, else of the year; null if no number."""
    return F.substring(F.coalesce(release_date, year), 1, 4).try_cast("int")


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """``y``, ``y-m`` or ``y-m-d``, as far as the parts are known from the left."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.when(month.isNotNull(), two(month)), F.when(month.isNotNull() & day.isNotNull(), two(day)))


def number_of(c: Column) -> Column:
    """A number given as a number or as text."""
    return F.trim(c.cast("string")).try_cast("double")


def expires(at: Column, days: int) -> Column:
    """The end of a life of ``days``."""
    return at + F.expr(f"INTERVAL {int(days)} DAYS")


def minus(a: Column, b: Column) -> Column:
    """A difference that ends at 0."""
    return F.greatest(a - b, F.lit(0))


def least_salvage(seconds: Column) -> Column:
    """The shortest length worth saving of a damaged recording."""
    return F.greatest(F.least(seconds * 0.5, seconds - 1.0), F.lit(1.0))


def byte_range(header: Column, total: Column) -> Column:
    """struct(first, last, ok) of a range header; without a header all is null and ok, ranges that can't be served are not ok."""
    number = lambda c: F.when(c.rlike(r"^\+?[0-9]+$"), c.try_cast("long"))
    p = r"^bytes=([^,-]*)-([^,]*)$"
    a, b = F.regexp_extract(header, p, 1), F.regexp_extract(header, p, 2)
    first = F.when(a == "", minus(total, number(b))).otherwise(number(a))
    last = F.when((a == "") | (b == ""), total - 1).otherwise(F.least(number(b), total - 1))
    fits = F.when(a == "", number(b) > 0).otherwise((number(a) < total) & ((b == "") | number(b).isNotNull()) & (last >= number(a)))
    ok = header.isNull() | (header.rlike(p) & F.coalesce(fits, F.lit(False)))
    given = ok & header.isNotNull()
    return F.struct(F.when(given, first).alias("first"), F.when(given, last).alias("last"), ok.alias("ok"))


def iso_minutes(c: Column) -> Column:
    """Seconds of ``PT<minutes>M<seconds>S``, where both must be there."""
    p = r"^PT([0-9.]+)M([0-9.]+)S$"
    part = lambda i: F.regexp_extract(c, p, i).try_cast("double")
    return F.when(c.rlike(p), part(1) * 60.0 + part(2))


def english_date(c: Column) -> Column:
    """D3: ``Mar 5, 2020`` as ``2020-03-05``; null for any other text."""
    return F.date_format(F.try_to_timestamp(F.trim(c), F.lit("MMM d, yyyy")), "yyyy-MM-dd")


def slash_date(c: Column) -> Column:
    """D3: ``05/03/2020``, day first, as ``2020-03-05``; null for any other text."""
    return F.date_format(F.try_to_timestamp(F.trim(c), F.lit("d/M/yyyy")), "yyyy-MM-dd")


def epoch_date(seconds: Column) -> Column:
    """The UTC day of epoch seconds."""
    return F.date_from_unix_date(F.floor(seconds / 86400).cast("int")).cast("string")


def year_run(c: Column) -> Column:
    """The first run of exactly four digits that begins with 1 or 2."""
    return F.nullif(F.regexp_extract(c, r"(?<![0-9])([12][0-9]{3})(?![0-9])", 1), F.lit(""))


def day_over(last: Column, now: Column, zone: str) -> Column:
    """Whether a local day has begun since ``last`` (both timestamps without zone, in UTC); a missing ``last`` counts as long ago."""
    local = lambda t: F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), t))
    return F.coalesce(local(last) < local(now), F.lit(True))


def within(c: Column, low: float, high: float) -> Column:
    """Whether a number is there, finite and in a range."""
    return F.coalesce(c.between(low, high) & ~F.isnan(c), F.lit(False))


def signed(c: Column, digits: int, unit: str = "") -> Column:
    """A number with its sign and ``digits`` after the point."""
    return F.format_string(f"%+.{digits}f{unit}", c.cast("double"))


def fixed(c: Column, digits: int, unit: str = "") -> Column:
    return F.format_string(f"%.{digits}f{unit}", c.cast("double"))
