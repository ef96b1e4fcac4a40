"""Mixed date formats, precisions and time zones in one unambiguous form (problem 5).

All parsing is in built-in expressions. Dates come out as precise as they were given
(``YYYY``, ``YYYY-MM``, ``YYYY-MM-DD``), times and epoch numbers as UTC instants
(``YYYY-MM-DDTHH:MM:SSZ``). A local time that occurs twice means the earlier instant; one that is
skipped moves on by the length of the gap, as ``try_make_timestamp`` has it.

Where a source's zone is not known it is estimated: each candidate zone, which is a history of
offsets, turns the local times into instants. An instant later than its ingestion is a violation, and so is one that is
earlier than the instant of the row before in the source's sequence. The history with the fewest violations is taken, then the one
that leaves the least lag. Then the times are converted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refrain.io import load

# Names of months in four languages, and zones by abbreviation.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}
SHORT_MONTHS = {
    "en": "jan feb mar apr may jun jul aug sep oct nov dec",
    "de": "jan feb mär apr mai jun jul aug sep okt nov dez",
    "fr": "janv févr mars avr mai juin juil août sept oct nov déc",
    "es": "ene feb mar abr may jun jul ago sep oct nov dic",
}
ZONES = {
    "Z": "Z", "UTC": "Z", "GMT": "Z", "WET": "Z", "WEST": "+01:00", "BST": "+01:00", "CET": "+01:00", "CEST": "+02:00", "MEZ": "+01:00", "MESZ": "+02:00",
    "EET": "+02:00", "EEST": "+03:00", "MSK": "+03:00", "IST": "+05:30", "JST": "+09:00", "KST": "+09:00", "AWST": "+08:00", "ACST": "+09:30", "AEST": "+10:00",
    "AEDT": "+11:00", "NZST": "+12:00", "NZDT": "+13:00", "NST": "-03:30", "NDT": "-02:30", "AST": "-04:00", "ADT": "-03:00", "EST": "-05:00", "EDT": "-04:00",
    "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00", "AKST": "-09:00", "HST": "-10:00",
}
#: Locales in which numbers come month first, and year first; all others have the day first.
MONTH_FIRST, YEAR_FIRST = ("en-US",), ("ja-JP", "zh-CN", "ko-KR", "hu-HU", "sv-SE")
#: Two-digit years lie from 1930 to 2029; rows of a sequence that are ordered in one task.
PIVOT, SEQUENCE = 30, 10_000


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(d.items()) for x in pair])


def _month(name: Column) -> Column:
    table = {n: i for names in (*MONTHS.values(), *SHORT_MONTHS.values()) for i, n in enumerate(names.split(), 1)}
    table |= {"sept": 9, "maerz": 3}
    return F.try_element_at(_map(table), F.lower(name))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def full_year(c: Column) -> Column:
    """A year of two or four digits as a number of four."""
    n = _int(c)
    return F.when(F.length(c) == 2, n + F.when(n >= PIVOT, 1900).otherwise(2000)).otherwise(n)


def date_text(year: Column, month: Column, day: Column) -> Column:
    """``YYYY[-MM[-DD]]``; month or day 0 or null is not given; null for impossible dates."""
    m, d = F.coalesce(month, F.lit(0)), F.coalesce(day, F.lit(0))
    y = F.lpad(year.cast("string"), 4, "0")
    whole = F.try_make_timestamp_ntz(year, m, d, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    return (
        F.when(year.isNull() | ~year.between(1, 9999) | ~m.between(0, 12) | ~d.between(0, 31), None)
        .when(m == 0, F.when(d == 0, y))
        .when(d == 0, F.concat(y, F.lit("-"), F.lpad(m.cast("string"), 2, "0")))
        .when(whole.isNotNull(), F.concat(y, F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d.cast("string"), 2, "0")))
    )


def instant_text(seconds: Column) -> Column:
    """Epoch seconds as ``YYYY-MM-DDTHH:MM:SSZ``, whatever the session's zone."""
    days, rest = F.floor(seconds / 86400).cast("int"), F.pmod(seconds, F.lit(86400)).cast("int")
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(F.date_from_unix_date(days).cast("string"), F.lit("T"), two(rest / 3600), F.lit(":"), two(F.pmod(rest, F.lit(3600)) / 60), F.lit(":"), two(F.pmod(rest, F.lit(60))), F.lit("Z"))


def instant(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, zone: Column) -> Column:
    """Epoch seconds of a local time in ``zone`` (a name or an offset); null for impossible times and unknown zones."""
    return F.unix_seconds(F.try_make_timestamp(year, month, day, hour, minute, F.coalesce(second, F.lit(0)).cast("decimal(16,6)"), zone))


def zone_of(tail: Column) -> Column:
    """The zone that a time's tail names: an offset, an abbreviation or a name in brackets or none; null if there is none."""
    t = F.regexp_replace(F.trim(tail), r"^[(\[]|[)\]]$", "")
    offset = F.regexp_extract(t, r"^([+-]\d{2}):?(\d{2})$", 1)
    return (
        F.when(t == "", None)
        .when(offset != "", F.concat(offset, F.lit(":"), F.regexp_extract(t, r"^([+-]\d{2}):?(\d{2})$", 2)))
        .when(t.rlike(r"^[A-Za-z_]+(?:/[A-Za-z_+-]+)+$"), t)
        .otherwise(F.try_element_at(_map(ZONES), F.upper(t)))
    )


_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
#: Written forms, each rewritten to ``kind|part|part...``; a value that fits one no longer fits those below it.
_FORMS = (
    # T: a time with year, month, day, hour, minute, second, zone
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})[T ]\s*" + _TIME + r"\s*(.*)$", r"T|$1|$2|$3|$4|$5|$6|$7"),
    (r"^(?:[A-Za-z]{3},\s*)?(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})\s+" + _TIME + r"\s*(.*)$", r"T|$3|$2|$1|$4|$5|$6|$7"),
    (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?\s*(Z|[+-]\d{2}:?\d{2})?$", r"T|$1|$2|$3|$4|$5|$6|$7"),
    # E, L: seconds and milliseconds since 1970
    (r"^(\d{9,10})$", r"E|$1"),
    (r"^(\d{9,10})\d{3}$", r"E|$1"),
    # D: a date with year, month, day
    (r"^(\d{4})(\d{2})(\d{2})$", r"D|$1|$2|$3"),
    (r"^(\d{4})-(\d{2})-(\d{2})$", r"D|$1|$2|$3"),
    (r"^(\d{4})[/.-](\d{1,2})$", r"D|$1|$2|0"),
    (r"^(\d{4})$", r"D|$1|0|0"),
    (r"^(\d{4})年(?:(\d{1,2})月(?:(\d{1,2})日)?)?$", r"D|$1|0$2|0$3"),
    # N: numbers in the order of the locale, and perhaps a time
    (r"^(\d{1,4})([/.-])(\d{1,2})\2(\d{1,4})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp])?(?:\.?[Mm]\.?)?)?$", r"N|$1|$3|$4|$5|$6|$7||$8"),
    # W: a date in which all that is named must be there
    (r"^(\d{1,2})[/.-](\d{4})$", r"W|$2|$1|0"),
    (r"^(\d{1,2})(?:\.|er|st|nd|rd|th)?[\s-]+(?:de\s+)?(\p{L}+)\.?,?[\s-]+(?:del?\s+)?(\d{4})$", r"W|$3|$2|$1"),
    (r"^(\p{L}+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})$", r"W|$3|$1|$2"),
    (r"^(\p{L}+)\.?,?\s+(?:de\s+)?(\d{4})$", r"W|$2|$1|0"),
)


def with_release_date(frame: DataFrame, value: str, locale: str, home_zone: str, name: str) -> DataFrame:
    """``frame`` with column ``name``: the one form of the date or time in ``value``; null if it is null, unreadable or impossible.

    ``locale`` decides the order of numeric dates (null: readable only if one order is possible or the
    year comes first), ``home_zone`` holds for times without a zone (null: such times are
    unreadable). The parsing runs in stages, each a small projection. A column that is not
    deterministic keeps the optimiser from merging the stages and from pushing filters through
    them, which would write out every expression once for each use.
    """
    kept = lambda c: F.when(F.col("_stage") < 0, None).otherwise(c)
    form = F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}|]+$", "")
    for pattern, parts in _FORMS:
        form = F.regexp_replace(form, pattern, parts)
    part = lambda i: F.nullif(F.get("_p", F.lit(i)), F.lit(""))
    kind = F.get("_p", F.lit(0))
    staged = frame.withColumn("_p", F.split(form, r"\|")).withColumn("_stage", F.spark_partition_id())
    a, b, c, place = part(1), part(2), part(3), F.col(locale)
    numeric = kind == "N"
    year_first = numeric & ((F.length(a) == 4) | ((F.length(c) < 4) & F.coalesce(place.isin(*YEAR_FIRST), F.lit(False))))
    month_first = F.coalesce(place.isin(*MONTH_FIRST), _int(b) > 12)
    known = place.isNotNull() | (F.length(a) == 4) | ((F.length(c) == 4) & ((_int(a) > 12) | (_int(b) > 12) | (a == b)))
    shaped = F.when(year_first, F.length(c) <= 2).otherwise((F.length(a) <= 2) & F.length(c).isin(2, 4))
    staged = staged.select(
        *frame.columns, "_p",
        kept(F.when(kind.isin("T", "E", "D", "W") | (numeric & known & shaped), kind)).alias("_k"), F.spark_partition_id().alias("_stage"),
        F.when(numeric, F.when(year_first, a).otherwise(c)).otherwise(a).alias("_y"),
        F.when(numeric, F.when(year_first, b).when(month_first, a).otherwise(b)).otherwise(b).alias("_m"),
        F.when(numeric, F.when(year_first, c).when(month_first, b).otherwise(a)).otherwise(c).alias("_d"),
    )
    hour, half = _int(part(4)), F.lower(part(8))
    hour = F.when(half.isNull(), hour).when(hour.between(1, 12), F.pmod(hour, F.lit(12)) + F.when(half == "p", 12).otherwise(0))
    staged = staged.select(
        *frame.columns, kept(F.col("_k")).alias("_k"), F.spark_partition_id().alias("_stage"),
        F.when(F.col("_k") == "E", F.col("_y").try_cast("long")).alias("_e"), F.when(F.col("_k") != "E", full_year(F.col("_y"))).alias("_y"),
        F.coalesce(_int(F.col("_m")), _month(F.col("_m"))).alias("_m"), _int(F.col("_d")).alias("_d"),
        hour.alias("_h"), _int(part(5)).alias("_i"), _int(part(6)).alias("_s"),
        F.when(part(7).isNull(), F.col(home_zone)).otherwise(zone_of(part(7))).alias("_z"), (part(4).isNotNull() & F.col("_k").isin("T", "N")).alias("_t"),
    )
    seconds = F.when(F.col("_k") == "E", F.col("_e")).when(F.col("_t"), instant(F.col("_y"), F.col("_m"), F.col("_d"), F.col("_h"), F.col("_i"), F.col("_s"), F.col("_z")))
    # 00 is not given where years come first; elsewhere every number that is written must be one
    written = F.when(F.col("_k") == "D", F.lit(True)).otherwise((F.col("_m") > 0) & ((F.col("_k") == "W") | (F.col("_d") > 0)))
    day = F.when((F.col("_y") > 0) & written & ~F.col("_t"), date_text(F.col("_y"), F.col("_m"), F.col("_d")))
    staged = staged.select(*frame.columns, kept(seconds).alias("_e"), day.alias("_day"), F.spark_partition_id().alias("_stage"))
    staged = staged.select(*frame.columns, kept(F.coalesce(instant_text(F.col("_e")), F.col("_day"))).alias(name), F.spark_partition_id().alias("_stage"))
    return staged.where(F.col("_stage") >= 0).drop("_stage")


def roman(value: Column) -> Column:
    """A Roman numeral as a number; null if it is none in its proper form."""
    v = F.upper(value)
    worth = _map({"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000})
    letters = F.transform(F.split(v, ""), lambda c: F.coalesce(F.try_element_at(worth, c), F.lit(0)))
    # from the right, a letter smaller than the one after it is taken away
    total = F.aggregate(F.reverse(letters), F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")), lambda s, x: F.struct((s["n"] + F.when(x < s["last"], -x).otherwise(x)).alias("n"), x.alias("last")))["n"]
    return F.when(v.rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (F.length(v) > 0), total)


def release_year(value: Column) -> Column:
    """The four-digit year of a typed year, the first named if there are two; null if none is readable."""
    v = F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    four = F.nullif(F.regexp_extract(v, r"(?<!\d)([12]\d{3})(?!\d)", 1), F.lit(""))
    two = F.nullif(F.regexp_extract(v, r"^['’‘`]?(\d{2})$", 1), F.lit(""))
    latin = roman(v)
    return F.coalesce(four, full_year(two).cast("string"), F.when(latin.between(1000, 2999), latin.cast("string")))


def estimate_zones(stamps: DataFrame, zones: DataFrame) -> DataFrame:
    """(source, zone, n_violations, n) of the best zone of each ``source``.

    ``stamps``: source, local (timestamp_ntz), ingested (timestamp_ntz in UTC) and perhaps seq, the place of the stamp in the
    source's order (rows without one only count against their ingestion); rows with a null source, local or ingested are
    left out. ``zones``: candidate zone names (column ``zone``), those of the zone database at most, which are
    about 600, so each stamp is taken against all of them; ties go to the
    lesser lag, then to the lesser name. An unknown zone name never wins.
    """
    zero = F.lit(0)
    valid = F.try_make_timestamp(F.lit(2000), F.lit(1), F.lit(1), zero, zero, zero.cast("decimal(16,6)"), F.col("zone")).isNotNull()
    names = F.broadcast(zones.select("zone").where(F.col("zone").rlike("^[A-Za-z_+-]+(/[A-Za-z0-9_+-]+)*$") & valid).distinct())  # names of the database only
    rows = stamps if "seq" in stamps.columns else stamps.withColumn("seq", F.lit(None).cast("long"))
    rows = rows.where(F.col("source").isNotNull() & F.col("local").isNotNull() & F.col("ingested").isNotNull()).select("source", "local", F.date_trunc("minute", "ingested").alias("ingested"), "seq")
    # the row before in the sequence; in ranges of the sequence, so no task orders a whole source
    near = Window.partitionBy("source", F.floor(F.col("seq") / SEQUENCE)).orderBy("seq")
    rows = rows.withColumn("before", F.when(F.col("seq").isNotNull(), F.lag("local").over(near)))
    # equal stamps count together, so a source's hot stamp is one row
    rows = rows.groupBy("source", "local", "ingested", "before").agg(F.count("*").alias("n"))

    def instant_of(t: str, zone: Column) -> Column:
        return F.unix_seconds(F.try_make_timestamp(F.year(t), F.month(t), F.day(t), F.hour(t), F.minute(t), F.second(t).cast("decimal(16,6)"), zone))

    each = rows.join(names).withColumn("utc", instant_of("local", F.col("zone"))).where(F.col("utc").isNotNull())
    each = each.withColumn("lag", instant_of("ingested", F.lit("UTC")) - F.col("utc") + 60)
    # a local time that occurs twice may be the later one
    shown = lambda t: F.from_utc_timestamp(F.timestamp_seconds(t), F.col("zone"))
    latest = F.col("utc") + F.when(shown(F.col("utc") + 3600) == shown(F.col("utc")), 3600).otherwise(0)
    each = each.withColumn("back", F.coalesce(latest < instant_of("before", F.col("zone")), F.lit(False)))
    violated = F.when(F.col("lag") < 0, F.col("n")).otherwise(0) + F.when(F.col("back"), F.col("n")).otherwise(0)
    scored = each.groupBy("source", "zone").agg(F.sum(violated).alias("n_violations"), F.sum("n").alias("n"), F.sum(F.when(F.col("lag") >= 0, F.col("lag").cast("double") * F.col("n")).otherwise(0.0)).alias("total_lag"))
    best = scored.groupBy("source").agg(F.min(F.struct("n_violations", "total_lag", "zone", "n")).alias("b"))
    return best.select("source", F.col("b.zone").alias("zone"), F.col("b.n_violations").alias("n_violations"), F.col("b.n").alias("n"))


def local_stamps(candidates: DataFrame) -> DataFrame:
    """(source, local, ingested) of release dates that are times without a zone."""
    t = F.regexp_extract("release_date", r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2})?)(?:\.\d+)?$", 0)
    return candidates.where(t != "").select(F.col("provider").alias("source"), F.try_to_timestamp(F.regexp_replace(t, "T", " ")).cast("timestamp_ntz").alias("local"), F.col("fetched_at").alias("ingested"))


def with_customs(candidates: DataFrame, providers: DataFrame) -> DataFrame:
    """``candidates`` with each provider's locale and home zone; zones that are not known are estimated."""
    customs = providers.select("provider", "locale", "home_zone").where(F.col("provider").isNotNull()).dropDuplicates(["provider"])
    known = customs.where(F.col("home_zone").isNotNull())
    missing = customs.where(F.col("home_zone").isNull())
    if not missing.isEmpty():
        guessed = estimate_zones(local_stamps(candidates).join(missing.select(F.col("provider").alias("source")), "source", "left_semi"), known.select(F.col("home_zone").alias("zone")))
        customs = customs.join(guessed.select(F.col("source").alias("provider"), F.col("zone").alias("_guess")), "provider", "left").withColumn("home_zone", F.coalesce("home_zone", "_guess")).drop("_guess")
    return candidates.join(F.broadcast(customs), "provider", "left")  # providers: a fixed list of sources


def normalised(candidates: DataFrame, providers: DataFrame) -> DataFrame:
    """(candidate_id, field, stored, value) of every value of release_date and year that is readable and not yet in the one form.

    Null, blank, unreadable and impossible values give no row; repeated rows give one.
    """
    rows = with_customs(candidates.select("candidate_id", "provider", "release_date", "year", "fetched_at"), providers)
    done = r"^\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01]))?)?$"  # in the one form or impossible
    dates = rows.where(F.col("release_date").isNotNull() & ~F.col("release_date").rlike(done)).select("candidate_id", F.lit("release_date").alias("field"), F.col("release_date").alias("stored"), "locale", "home_zone")
    dates = with_release_date(dates, "stored", "locale", "home_zone", "value").select("candidate_id", "field", "stored", "value")
    years = rows.where(F.col("year").isNotNull() & ~F.col("year").rlike(r"^\d{4}$")).select("candidate_id", F.lit("year").alias("field"), F.col("year").alias("stored"), release_year(F.col("year")).alias("value"))
    return dates.unionByName(years).where(F.col("value").isNotNull() & (F.col("value") != F.col("stored"))).distinct()


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p5_found: every readable date, time and year that is not yet in the one form, in that form."""
    return normalised(load(spark, folder, "candidates"), load(spark, folder, "providers")).select("candidate_id", "field", "value").distinct()


def report(spark: SparkSession, folder: str) -> DataFrame:
    """p5_values: distinct stored values with their form and number of candidates."""
    rows = normalised(load(spark, folder, "candidates"), load(spark, folder, "providers"))
    return rows.groupBy("field", "stored", "value").agg(F.count("*").alias("n_candidates"))


def zones(spark: SparkSession, folder: str) -> DataFrame:
    """p5_zones: each provider's home zone beside the one that its times without a zone would be given by estimate, with the violations of that."""
    customs = load(spark, folder, "providers").where(F.col("provider").isNotNull()).select(F.col("provider").alias("source"), "home_zone").dropDuplicates(["source"])
    guessed = estimate_zones(local_stamps(load(spark, folder, "candidates")), customs.select(F.col("home_zone").alias("zone")))
    return customs.join(guessed, "source", "left").select(F.col("source").alias("provider"), "home_zone", F.col("zone").alias("estimated"), "n_violations", "n")
