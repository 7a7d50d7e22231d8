"""Text, number and duration formats as column expressions."""

from pyspark.sql import Column, functions as F

# Unit words and the joining word of a duration text.
DURATION_UNITS = {"day": "يوم", "hour": "ساعة", "minute": "دقيقة", "second": "ثانية"}
DURATION_JOIN = " و "

# Wording of an update interval.
EVERY = "كل"
NOT_AVAILABLE = "غير متوفر"


def display_label(name: Column) -> Column:
    """`roc_auc` -> `ROC AUC`."""
    return F.upper(F.translate(name, "_", " "))


def capitalise(text: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2147483647)))


def matches_search(query: str, *columns: Column) -> Column:
    """Case-insensitive substring test over any of `columns`."""
    needle = F.lower(F.lit(query))
    test = F.lit(False)
    for column in columns:
        test = test | F.coalesce(F.contains(F.lower(column), needle), F.lit(False))
    return test


def grouped_number(value: Column) -> Column:
    """Thousands separators on a number, kept as it is when it is not one.

    A whole number keeps one decimal (`1234` -> `1,234.0`) and every digit of the shortest decimal form stays.
    From 1e16 up and below 1e-4 the exponent form is used.
    """
    raw = value.cast("string")
    number = raw.try_cast("double")
    size = F.abs(number)
    plain = F.regexp_replace(number.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    whole = F.substring_index(plain, ".", 1)
    grouped = F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", ",")
    fixed = F.concat(grouped, F.lit("."), F.substring_index(plain, ".", -1))
    mantissa = F.regexp_replace(F.substring_index(number.cast("string"), "E", 1), r"\.0$", "")
    power = F.substring_index(number.cast("string"), "E", -1).try_cast("int")
    exponent = F.concat(
        mantissa,
        F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(power).cast("string"), 2, "0"),
    )
    return (
        F.when(number.isNull(), raw)
        .when(F.isnan(number), F.lit("nan"))
        .when(size == float("inf"), F.when(number > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when((size >= 1e16) | ((size < 1e-4) & (size > 0)), exponent)
        .otherwise(fixed)
    )


def duration_text(seconds: Column, units: dict | None = None, join: str = DURATION_JOIN) -> Column:
    """Days, hours, minutes and seconds; zero parts are left out, but at least the seconds stay."""
    units = units or DURATION_UNITS
    total = seconds.try_cast("double").cast("long")
    parts = [
        ("day", F.floor(total / 86400)),
        ("hour", F.floor(F.pmod(total, F.lit(86400)) / 3600)),
        ("minute", F.floor(F.pmod(total, F.lit(3600)) / 60)),
        ("second", F.pmod(total, F.lit(60))),
    ]
    words = [
        F.when(amount > 0, F.concat(amount.cast("string"), F.lit(" " + units[unit]))) for unit, amount in parts
    ]
    text = F.concat_ws(join, *words)
    text = F.when(text == "", F.lit(f"0 {units['second']}")).otherwise(text)
    return F.when(total.isNull(), seconds.cast("string")).otherwise(text)


def interval_text(seconds: Column) -> Column:
    """A mean interval in whole minutes, hours or days; text for "not available" on NULL."""
    units = DURATION_UNITS

    def every(amount: Column, unit: str) -> Column:
        return F.concat(F.lit(EVERY + " "), F.floor(amount).cast("string"), F.lit(" " + units[unit]))

    return (
        F.when(seconds.isNull(), F.lit(NOT_AVAILABLE))
        .when(seconds < 3600, every(seconds / 60, "minute"))
        .when(seconds < 86400, every(seconds / 3600, "hour"))
        .otherwise(every(seconds / 86400, "day"))
    )


def time_text(value: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss`, or the given text when it is no time."""
    stamp = value.try_cast("timestamp")
    return F.coalesce(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), value.cast("string"))


def iso_text(stamp: Column) -> Column:
    """ISO-8601 text of a time, microseconds only where there are any."""
    plain = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    parts = F.pmod(F.unix_micros(stamp), F.lit(1_000_000))
    return F.when(parts == 0, plain).otherwise(F.concat(plain, F.lit("."), F.lpad(parts.cast("string"), 6, "0")))
