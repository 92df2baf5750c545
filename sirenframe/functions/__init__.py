"""Column functions: text, clock and location rules without any shuffle."""

from sirenframe.functions.location import location_segments, location_territory, parse_location
from sirenframe.functions.text import bound_text, contains_ignore_case, strip_code_fences, strip_space
from sirenframe.functions.times import (
    as_text,
    datetime_problem,
    daypart,
    parse_datetime,
    parse_datetime_text,
    split_datetime,
    with_derived_times,
)

__all__ = [
    "as_text",
    "bound_text",
    "contains_ignore_case",
    "datetime_problem",
    "daypart",
    "location_segments",
    "location_territory",
    "parse_datetime",
    "parse_datetime_text",
    "parse_location",
    "split_datetime",
    "strip_code_fences",
    "strip_space",
    "with_derived_times",
]
