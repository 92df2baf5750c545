"""Clock functions.

Dispatch sheets carry zone-less clock readings, so parsed values are
TIMESTAMP_NTZ; only the incident table turns them into instants, in the
session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenframe.functions.text import WHITE_SPACE
from sirenframe.schemas import DERIVED_TIMES, NIGHT_END_HOUR, NIGHT_START_HOUR

DATE_FORMAT = "MM/dd/yyyy"
TIME_FORMAT = "HH:mm:ss"
TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"

# month/day/year hour:minute:second, one digit allowed except in the year. A
# one-digit day may have a leading blank. The form allows year 0 and seconds 60
# and 61, which are no clock readings.
_DATE = r"^(1[0-2]|0[1-9]|[1-9])/(?: (?=[1-9]/))?(3[01]|[12][0-9]|0[1-9]|[1-9])/"
_TIME = rf"[{WHITE_SPACE}]+" + r"(2[0-3]|[01][0-9]|[0-9]):([0-5][0-9]|[0-9]):"
_FORM = _DATE + r"([0-9]{4})" + _TIME + r"(6[01]|[0-5][0-9]|[0-9])"
_READING = _DATE + r"((?!0000)[0-9]{4})" + _TIME + r"([0-5][0-9]|[0-9])$"


def parse_datetime_text(text: Column) -> Column:
    """`mm/dd/yyyy hh:mm:ss` -> TIMESTAMP_NTZ; null where it is no such reading."""
    iso = F.regexp_replace(text, _READING, "$3-$1-$2 $4:$5:$6")
    return F.when(F.rlike(text, F.lit(_READING)), iso.try_cast("timestamp_ntz"))


def parse_datetime(date: Column, time: Column) -> Column:
    """Date text and time text -> TIMESTAMP_NTZ; null where they do not parse."""
    return parse_datetime_text(F.concat(date, F.lit(" "), time))


def datetime_problem(text: Column, parsed: Column) -> Column:
    """What is wrong with a `mm/dd/yyyy hh:mm:ss` text; null where it was parsed."""
    matched = F.regexp_extract(text, _FORM, 0)
    date = F.regexp_replace(matched, _FORM, "$3-$1-$2")
    return (
        F.when(parsed.isNotNull(), F.lit(None).cast("string"))
        .when(
            matched == "",
            F.concat(
                F.lit("time data '"), text, F.lit("' does not match format '%m/%d/%Y %H:%M:%S'")
            ),
        )
        .when(
            F.length(text) > F.length(matched),
            F.concat(
                F.lit("unconverted data remains: "), F.substr(text, F.length(matched) + 1)
            ),
        )
        .when(F.startswith(date, F.lit("0000")), F.lit("year 0 is out of range"))
        .when(date.try_cast("date").isNull(), F.lit("day is out of range for month"))
        .when(text.isNotNull(), F.lit("second must be in 0..59"))
    )


def split_datetime(ts: Column) -> Column:
    """Timestamp -> struct(date mm/dd/yyyy, time hh:mm:ss); null stays null."""
    return F.when(
        ts.isNotNull(),
        F.struct(
            F.date_format(ts, DATE_FORMAT).alias("date"),
            F.date_format(ts, TIME_FORMAT).alias("time"),
        ),
    )


def as_text(ts: Column) -> Column:
    """Timestamp as `yyyy-MM-dd HH:mm:ss`."""
    return F.date_format(ts, TEXT_FORMAT)


def with_derived_times(incidents: DataFrame) -> DataFrame:
    """Fill the two derived times where they are not stated.

    A stated time wins; without its base time a derived one stays null.
    """
    return incidents.withColumns(
        {
            field: F.coalesce(
                F.col(field), F.col(base) + F.make_dt_interval(mins=F.lit(minutes))
            )
            for field, (base, minutes) in DERIVED_TIMES.items()
        }
    )


def daypart(
    ts: Column, night_start: int = NIGHT_START_HOUR, night_end: int = NIGHT_END_HOUR
) -> Column:
    """'night' or 'day' by hour; a night whose start is past its end spans midnight."""
    hour = F.hour(ts)
    if night_start > night_end:
        night = (hour >= night_start) | (hour < night_end)
    else:
        night = (hour >= night_start) & (hour < night_end)
    return F.when(night, F.lit("night")).otherwise(F.lit("day"))
