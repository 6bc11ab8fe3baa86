"""Reading times: numbers, dates and date texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlane.functions.values import column, to_number, type_of

MICROS_PER_DAY = 86_400_000_000
#: Name of the time value while a frame is worked on; none that a table would have.
TIME = "cohortlane time value"

# Month names a date text may use.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)


def micros(moment: Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp without time zone."""
    minutes = F.unix_date(moment.cast("date")).cast("bigint") * 1440 + F.hour(moment) * 60 + F.minute(moment)
    seconds = F.date_part(F.lit("SECOND"), moment)
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def own_prefix(df: DataFrame) -> str:
    """A beginning that no column of ``df`` has, for columns that come and go."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def with_date_parts(df: DataFrame, text: Column, own: str) -> DataFrame:
    """Add the number texts of a date text: ``size`` and ``p0`` to ``p5`` under the prefix ``own``, and ``month`` where it is named.

    The steps are columns of their own, so that each is worked out once per row and the generated
    methods stay small enough for the JVM to compile.
    """
    months = F.create_map(*(F.lit(v) for i, m in enumerate(MONTHS, 1) for v in ((m, i) if m == "may" else (m, i, m[:3], i))))
    trimmed = F.trim(text)
    named_month = trimmed.rlike("[A-Za-z]")
    swap = r"^(\d{1,2})[\s\-./,]*([A-Za-z]{3,9})[\s\-./,]*(\d{4}|\d{2})$"
    steps = df.withColumn(own + "text", F.when(named_month, F.regexp_replace(trimmed, swap, "$2/$1/$3")).otherwise(trimmed))
    steps = steps.withColumn(own + "month", F.when(named_month, F.lower(F.regexp_extract(own + "text", "^[A-Za-z]{3,9}", 0))))
    numbered = F.concat(
        F.try_element_at(months, F.col(own + "month")).cast("string"), F.lit("/"), F.regexp_replace(own + "text", r"^[A-Za-z]+[\s\-./,]*", "")
    )
    steps = steps.withColumn(own + "text", F.when(F.col(own + "month").isNotNull(), numbered).otherwise(F.col(own + "text")))
    parted = F.regexp_replace(own + "text", r"^(\d{4})(0[1-9]|1[0-2])(\d{2})$", "$1/$2/$3")
    steps = steps.withColumn(own + "text", F.regexp_replace(parted, r"^(\d{2})(\d{2})(\d{4})$", "$1/$2/$3"))
    form = r"^(\d{1,2}:\d{1,2}|\d+([^0-9A-Za-z]+\d+){2}|\d+([^0-9A-Za-z]+\d+){4,5})$"
    steps = steps.withColumn(own + "parts", F.when(F.col(own + "text").rlike(form), F.split(own + "text", "[^0-9]+")))
    steps = steps.withColumns({own + "size": F.size(own + "parts"), **{f"{own}p{i}": F.get(own + "parts", F.lit(i)) for i in range(6)}})
    return steps.drop(own + "text", own + "parts")


def date_order_fits(own: str) -> dict[str, Column]:
    """Whether the parts of a row are a date in each order; true in both where day and month can change places."""
    a, b, c = (F.col(f"{own}p{i}") for i in range(3))
    free = (F.col(own + "size") == 3) & F.col(own + "month").isNull() & (F.length(a) <= 2) & (F.length(b) <= 2) & F.length(c).isin(2, 4)

    def within(part: Column, most: int) -> Column:
        return part.try_cast("int").between(1, most)

    fits = {"mdy": within(a, 12) & within(b, 31), "dmy": within(b, 12) & within(a, 31)}
    return {order: F.coalesce(free & fit, F.lit(False)) for order, fit in fits.items()}


def with_date_text(df: DataFrame, text: Column, out: str, date_order: str = "mdy") -> DataFrame:
    """Add ``out``: a date text as timestamp, null when no form fits.

    Forms in this order: month/day/year hour:minute, month/day/year hour:minute:second,
    year-month-day, month/day/year, day/month/year, hour:minute; with ``date_order="dmy"``
    day/month/year comes before month/day/year. Separators are free, months may be named, a leading
    year has four digits, and a lone clock time falls on day one of year zero.
    """
    own = own_prefix(df)
    steps = with_date_parts(df, text, own)
    a, b, c, d, e, f = (F.col(f"{own}p{i}") for i in range(6))
    clock_only = F.col(own + "size") == 2
    leading_year = (F.col(own + "size") == 3) & (F.length(a) == 4)
    if date_order == "dmy":
        # Only a second number above 12 makes day/month fail where month/day can still fit.
        day_first = (F.col(own + "size") == 3) & F.col(own + "month").isNull() & ~((F.length(b) == 2) & (b > "12"))
    else:
        # Only a first number above 12 makes month/day fail where day/month can still fit.
        day_first = (F.col(own + "size") == 3) & (F.length(a) == 2) & (a > "12")
    steps = steps.withColumns({
        own + "form": F.when(leading_year, "ymd").when(day_first, "dmy").when(clock_only, "clock").otherwise("mdy"),
        own + "year": F.when(F.length(c) == 2, F.concat(F.when(c < "69", "20").otherwise("19"), c)).when(F.length(c) == 4, c),
    })
    chosen = F.col(own + "form")
    moment = F.concat(
        F.when(chosen == "ymd", a).when(chosen == "clock", "0000").otherwise(F.col(own + "year")), F.lit("-"),
        F.when(chosen == "mdy", a).when(chosen == "clock", "1").otherwise(b), F.lit("-"),
        F.when(chosen == "mdy", b).when(chosen == "ymd", c).when(chosen == "clock", "1").otherwise(a), F.lit(" "),
        F.concat_ws(
            ":", F.when(chosen == "clock", a).otherwise(F.coalesce(d, F.lit("0"))),
            F.when(chosen == "clock", b).otherwise(F.coalesce(e, F.lit("0"))), F.coalesce(f, F.lit("0")),
        ),
    )
    steps = steps.withColumn(out, moment.try_cast("timestamp_ntz"))
    return steps.drop(own + "month", own + "size", own + "form", own + "year", *(f"{own}p{i}" for i in range(6)))


def typed_time_kind(kind: T.DataType) -> str | None:
    """``numeric`` or ``date`` where the column type settles it."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return "numeric"
    return None


def with_time_value(df: DataFrame, name: str, time_kind: str, date_order: str | None = None, out: str = TIME) -> DataFrame:
    """Add the time as a double for numeric times, as microseconds in a long for dates.

    ``date_order`` says how date texts are read whose day and month can change places; None is ``mdy``.
    """
    kind, value = type_of(df, name), column(df, name)
    if time_kind == "numeric":
        if isinstance(kind, T.StringType):
            return df.withColumn(out, to_number(value))
        if isinstance(kind, T.BooleanType):
            return df.withColumn(out, value.cast("int").cast("double"))
        if isinstance(kind, T.NumericType):
            return df.withColumn(out, value.cast("double"))
        raise ValueError(f"a {kind.simpleString()} time column is read as date, not as number")
    if isinstance(kind, T.TimestampType):
        return df.withColumn(out, F.unix_micros(value))
    if isinstance(kind, T.DateType):
        return df.withColumn(out, F.unix_date(value).cast("bigint") * MICROS_PER_DAY)
    if isinstance(kind, T.TimestampNTZType):
        return df.withColumn(out, micros(value))
    moment = own_prefix(df) + "moment"
    parsed = with_date_text(df, value.cast("string"), moment, date_order or "mdy")
    return parsed.withColumn(out, micros(F.col(moment))).drop(moment)


def elapsed(value: Column, start: Column, time_kind: str) -> Column:
    """Days since ``start`` for dates; numeric times stay as they are."""
    return (value - start) / F.lit(float(MICROS_PER_DAY)) if time_kind == "date" else value
