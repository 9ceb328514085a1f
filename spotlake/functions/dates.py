"""Date and time expressions.

Reports carry dates as text. Lenient readers turn bad text into NULL with the
`try_` functions; strict readers keep Spark's ANSI behaviour and fail the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ISO_DATE = "yyyy-MM-dd"
CLOCK = "HH:mm:ss"

# Texts of the usual width are read with substrings and a cast. Other shapes reach one of these patterns, once: it
# rewrites the text to its parts between marks, empty where a shape has no such part.
_MARK = "\u0001"
_MONTH_NAMES = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = (r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?"
          r"|dec(?:ember)?")
_NOON = r"(?: *[ap][.]?m[.]?)"
_TIME = rf"(?:[T ]+[0-9]{{1,2}}:[0-9]{{1,2}}(?::[0-9]{{1,2}}(?:[.][0-9]+)?)?{_NOON}?)?"
# Year, month, day; two numbers and a year; day, named month, year; named month, day, year; eight digits.
_DATE = (
    r"(?i)^(?:([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})"
    r"|([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4}|[0-9]{2})"
    rf"|([0-9]{{1,2}})[-/. ]+({_MONTH})[-/., ]+([0-9]{{4}}|[0-9]{{2}})"
    rf"|({_MONTH})[-/. ]+([0-9]{{1,2}})[-/, ]+([0-9]{{4}})"
    rf"|([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})){_TIME}$")
_DATE_PARTS = _MARK.join(["", "$1$6$9$12$13", "$2$8$10$14", "$3$7$11$15", "$4", "$5"])
# Hours, minutes and perhaps seconds after a date or alone; an hour of the half day; six digits.
_CLOCK = (
    r"(?i)^(?:[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}[T ]+)?(?:([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2})(?:[.][0-9]+)?)?(?: *([ap])[.]?m[.]?)?"
    r"|([0-9]{1,2}) *([ap])[.]?m[.]?|([0-9]{2})([0-9]{2})([0-9]{2}))$")
_CLOCK_PARTS = _MARK.join(["", "$1$5$7", "$2$8", "$3$9", "$4$6"])
# Two-digit years from here on belong to the last century.
_CENTURY = 69


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _framed(c: Column, width: int, marks: dict[int, str], digit_at: int) -> Column:
    """Whether a text has this width, these characters at these places and a digit at one more."""
    framed = (F.length(c) == width) & F.substring(c, digit_at, 1).between("0", "9")
    for place, mark in marks.items():
        framed = framed & (F.substring(c, place, 1) == mark)
    return framed


def _iso_from(c: Column, year: int, month: int, day: int) -> Column:
    """`yyyy-MM-dd` from the places at which the parts of a text start."""
    return F.concat(F.substring(c, year, 4), F.lit("-"), F.substring(c, month, 2), F.lit("-"), F.substring(c, day, 2))


_SLASHES = {3: "/", 6: "/"}


def airing_timestamp(date_text: Column | str, time_text: Column | str) -> Column:
    """Timestamp from `dd/MM/yyyy` and `HH:mm:ss`; NULL if either part is missing or unreadable."""
    day, clock = _col(date_text), _col(time_text)
    shaped = _framed(day, 10, _SLASHES, 2) & _framed(clock, 8, {3: ":", 6: ":"}, 8)
    return F.when(shaped, F.concat(_iso_from(day, 7, 4, 1), F.lit(" "), clock).try_cast("timestamp"))


def strict_date(text: Column | str, fmt: str = ISO_DATE) -> Column:
    """Date in exactly one format; other text fails the query under ANSI mode."""
    return F.to_date(_col(text), fmt)


def _parts(text: Column, pattern: str, parts: str, build: Callable[[Column], Column]) -> Column:
    """`build` of the array of a text's parts, NULL where the pattern does not match; the pattern is run once."""
    split = F.split(F.regexp_replace(text, pattern, parts), _MARK)
    return F.get(F.transform(F.array(split), lambda p: F.when(F.size(p) == parts.count(_MARK) + 1, build(p))), 0)


def mixed_date(text: Column | str, day_first: bool = True, strict: bool = False) -> Column:
    """Date from text in any usual notation, NULL if no reading is valid.

    Year, month, day, or day, month, year, parted by `-`, `/` or `.`; the year may
    have two digits. English month names or their short forms, before or after the
    day, in any case; eight digits. A time of day may follow, blanks around do not
    matter. With `day_first=False` the month-first reading of numbers is tried
    before the day-first one. With `strict` text that has no valid reading fails the query.
    """
    c = F.trim(_col(text))

    def built(year: Column, month: Column, day: Column) -> Column:
        return F.concat(year, F.lit("-"), month, F.lit("-"), day).try_cast("date")

    def read(p: Column) -> Column:
        last = F.when(F.length(p[1]) == 2, F.concat(F.when(p[1] >= str(_CENTURY), F.lit("19")).otherwise(F.lit("20")), p[1])).otherwise(p[1])
        named = F.position(F.lower(F.substring(p[2], 1, 3)), F.lit(_MONTH_NAMES))
        month = F.when(named > 0, ((named + 2) / 3).cast("int").cast("string")).otherwise(p[2])
        orders = [built(last, p[5], p[4]), built(last, p[4], p[5])]
        return F.when(p[4] == "", built(last, month, p[3])).otherwise(orders[0] if day_first else F.coalesce(*orders[::-1]))

    wide = _iso_from(c, 7, 4, 1).try_cast("date")
    if not day_first:
        wide = F.coalesce(_iso_from(c, 7, 1, 4).try_cast("date"), wide)
    found = (
        F.when(_framed(c, 10, _SLASHES, 2), wide)
        .when(_framed(c, 10, {5: "-", 8: "-"}, 10), c.try_cast("date"))
        .otherwise(_parts(c, _DATE, _DATE_PARTS, read))
    )
    if not strict:
        return found
    wrong = F.raise_error(F.concat(F.lit("not a date: "), _col(text))).cast("date")
    return F.when(_col(text).isNotNull() & found.isNull(), wrong).otherwise(found)


def _clock(text: Column | str) -> Column:
    def read(p: Column) -> Column:
        minute, second = (F.when(x == "", F.lit("0")).otherwise(x) for x in (p[2], p[3]))
        hour = p[1].cast("int")
        half = F.when(hour.between(1, 12), hour % 12 + F.when(F.lower(p[4]) == "p", 12).otherwise(0)).cast("string")
        hour = F.when(p[4] == "", p[1]).otherwise(half)
        return F.concat(F.lit("1970-01-01 "), hour, F.lit(":"), minute, F.lit(":"), second).try_cast("timestamp_ntz")

    return _parts(F.trim(_col(text)), _CLOCK, _CLOCK_PARTS, read)


def clock_text(text: Column | str) -> Column:
    """Time of day as `HH:mm:ss` text, NULL if unreadable.

    Seconds may be missing, a date may precede, `am` or `pm` may follow; an hour with
    `am` or `pm` and six digits are times too.
    """
    c = _col(text)
    usual = _framed(c, 8, {3: ":", 6: ":"}, 8)
    valid = F.concat(F.lit("1970-01-01 "), c).try_cast("timestamp_ntz").isNotNull()
    return F.when(usual, F.when(valid, c)).otherwise(F.date_format(_clock(c), CLOCK))


def clock_hour(text: Column | str) -> Column:
    """Hour 0-23 of a time-of-day text, NULL if unreadable."""
    return F.hour(_clock(text))


def standardize_datetime(df: DataFrame, date_col: str, time_col: str, day_first: bool = True) -> DataFrame:
    """Replace both columns by ISO date text and `HH:mm:ss` text; unreadable values become NULL."""
    return df.withColumns({
        date_col: mixed_date(F.col(f"`{date_col}`"), day_first).cast("string"),
        time_col: clock_text(F.col(f"`{time_col}`")),
    })


def _date_parts(days: DataFrame) -> DataFrame:
    # The column names of the date table.
    return days.selectExpr(
        "date",
        "year(date) AS year",
        "quarter(date) AS quarter",
        "month(date) AS month",
        "day(date) AS day",
        "dayofweek(date) AS day_of_week",
        "date AS date_key",
    )


def date_dimension(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day from `start` to `end`, both included; Sunday is day 1."""
    bounds = spark.range(1).select(F.to_date(F.lit(start)).alias("lo"), F.to_date(F.lit(end)).alias("hi"))
    return _date_parts(bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date")))


def date_dimension_for(df: DataFrame, date_col: str) -> DataFrame:
    """Date dimension that spans the dates present in `df` (no rows for empty input)."""
    day = F.to_date(F.col(date_col))
    bounds = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    return _date_parts(bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date")))
