"""Incident records: checks, casts and the row that is stored.

Column used: content (JSON text of an object). A failed check is a value of the
`error` column, never an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenframe.functions import bound_text, datetime_problem, parse_datetime_text
from sirenframe.functions.text import WHITE_SPACE
from sirenframe.operators.barrier import computed_once
from sirenframe.operators.variants import kind
from sirenframe.schemas import INCIDENT_KEY, INCIDENT_TYPE_MAX_CHARS, LOCATION_MAX_CHARS

# --- fixed values: message texts --------------------------------------------
MISSING_FIELD = "Missing required field in PCR JSON: "
OPERATION_FAILED = "Database operation failed: "
SAVE_FAILED = "Database save failed: "
NO_UNIT = "'incidentTimes.unit_dispatched not found and unit_id not provided'"
NO_CAD = "'incidentTimes.cad'"
NO_NOTIFIED = "'incidentTimes.times.notifiedByDispatch'"
NO_DATE_OR_TIME = "'notifiedByDispatch.date or notifiedByDispatch.time'"

_INTEGER = rf"^[{WHITE_SPACE}]*([+-]?[0-9]+(?:_[0-9]+)*)[{WHITE_SPACE}]*$"


def resolve_unit_id(unit_dispatched: Column, given: Column | None = None) -> Column:
    """The given unit unless null ('' counts as given), else the dispatched one unless ''."""
    dispatched = F.nullif(unit_dispatched, F.lit(""))
    return dispatched if given is None else F.coalesce(given, dispatched)


def integer_text(text: Column) -> Column:
    """Digits and sign of an integer text, without blanks and underscores; '' if it is none."""
    return F.replace(F.regexp_extract(text, _INTEGER, 1), F.lit("_"), F.lit(""))


def cast_cad(text: Column) -> Column:
    """Incident number of a text; null where it is no integer or past bigint."""
    return integer_text(text).try_cast("bigint")


def incident_date(date: Column, time: Column) -> Column:
    """Date and time text, both non-empty -> TIMESTAMP_NTZ, else null."""
    return parse_datetime_text(
        F.concat(F.nullif(date, F.lit("")), F.lit(" "), F.nullif(time, F.lit("")))
    )


# The part of a record the checks look at. A value of another shape is null here,
# and only then is the text read again to tell missing, null and wrong apart.
_SHAPE = """
  incidentTimes struct<
    cad: string, unit_dispatched: string, incident_type: string,
    times: struct<notifiedByDispatch: struct<date: string, time: string>>>,
  incidentLocation struct<raw: string>"""

_HEADER = "$.incidentTimes"
_CAD = f"{_HEADER}.cad"
_UNIT = f"{_HEADER}.unit_dispatched"
_TYPE = f"{_HEADER}.incident_type"
_TIMES = f"{_HEADER}.times"
_NOTIFIED = f"{_TIMES}.notifiedByDispatch"
_PLACE = "$.incidentLocation"
_RAW = f"{_PLACE}.raw"


def _value(path: str, data_type: str = "variant") -> Column:
    """Value at a path: SQL NULL where it is missing, a variant null where it is null.

    `_json` is read once, and only for rows that are not plain.
    """
    return F.try_variant_get(F.col("_json"), path, data_type)


def _wrong_shape(shape: Column, path: str) -> Column:
    """True for a value that is there but no object."""
    return shape.isNull() & (kind(_value(path)) != "dict")


def _no_attribute(path: str) -> Column:
    return F.concat(
        F.lit(OPERATION_FAILED + "'"), kind(_value(path)), F.lit("' object has no attribute 'get'")
    )


def _no_length(path: str) -> Column:
    return F.concat(
        F.lit(OPERATION_FAILED + "object of type '"), kind(_value(path)), F.lit("' has no len()")
    )


# Texts that may stand for an empty value that is no string.
_EMPTY = ("0", "0.0", "false", "[]", "{}")


def _empty(text: Column, path: str) -> Column:
    """True for a missing, null or otherwise empty value."""
    return text.isNull() | (text == "") | (text.isin(*_EMPTY) & (kind(_value(path)) != "str"))


def _like_number(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit("^(-?[0-9]|true$)")), F.lit(False))


def _unmeasurable(text: Column, path: str) -> Column:
    """True for a number other than 0, and for true: values that have no length."""
    return _like_number(text) & (kind(_value(path)) != "str") & ~text.isin(*_EMPTY)


def validate_record(records: DataFrame, given_unit: str | None = None) -> DataFrame:
    """Add the stored columns and `error`, the message of the first check that fails.

    Order: record shape, unit, incident number, notification time (present,
    complete, a real date and time), location shape, and last the number range
    of the table. `given_unit` names a column with a unit that takes precedence.
    """
    shaped = records.withColumn("_shape", F.from_json("content", _SHAPE))
    header, place = F.col("_shape.incidentTimes"), F.col("_shape.incidentLocation")
    cad, unit, incident_type = header["cad"], header["unit_dispatched"], header["incident_type"]
    notified = header["times"]["notifiedByDispatch"]
    date, time, raw = notified["date"], notified["time"], place["raw"]
    read = shaped.withColumns(
        {"_digits": integer_text(cad), "_clock": F.concat(date, F.lit(" "), time)}
    )
    digits, clock = F.col("_digits"), F.col("_clock")
    clocked = read.withColumns(
        {"_whole": digits.try_cast("bigint"), "_at": parse_datetime_text(clock)}
    )
    whole, at = F.col("_whole"), F.col("_at")
    given = F.lit(None).cast("string") if given_unit is None else F.col(given_unit)
    # Rows without any defect are told by cheap tests and never get to the chain.
    plain = (
        at.isNotNull()
        & whole.isNotNull()
        & (unit != "")
        & ~unit.isin(*_EMPTY)
        & place.isNotNull()
        & ~_like_number(raw)
        & ~_like_number(incident_type)
    )
    plain = F.coalesce(plain, F.lit(False))
    opened = clocked.withColumn("_json", F.when(~plain, F.try_parse_json("content")))
    # A JSON number or boolean is an integer too, though its text may be none.
    maybe_number = F.rlike(cad, F.lit("^(-?[0-9]|true$|false$)"))
    from_number = F.when(maybe_number & (kind(_value(_CAD)) != "str"), _value(_CAD, "bigint"))
    parsed = opened.withColumn("_number", F.when(digits != "", whole).otherwise(from_number))
    number = F.col("_number")
    not_an_integer = (digits == "") & ~(
        maybe_number & kind(_value(_CAD)).isin("int", "float", "bool")
    )
    nothing_notified = _value(_NOTIFIED).isNull() | _empty(
        _value(_NOTIFIED, "string"), _NOTIFIED
    )
    first_failure = (
        F.when(_wrong_shape(header, _HEADER), _no_attribute(_HEADER))
        .when(given.isNull() & _empty(unit, _UNIT), F.lit(MISSING_FIELD + NO_UNIT))
        .when(cad.isNull(), F.lit(MISSING_FIELD + NO_CAD))
        .when(
            not_an_integer,
            F.concat(
                F.lit(OPERATION_FAILED + "CAD number '"),
                cad,
                F.lit("' cannot be converted to integer"),
            ),
        )
        .when(_wrong_shape(header["times"], _TIMES), _no_attribute(_TIMES))
        .when(at.isNull() & nothing_notified, F.lit(MISSING_FIELD + NO_NOTIFIED))
        .when(_wrong_shape(notified, _NOTIFIED), _no_attribute(_NOTIFIED))
        .when(
            at.isNull() & (_empty(date, f"{_NOTIFIED}.date") | _empty(time, f"{_NOTIFIED}.time")),
            F.lit(MISSING_FIELD + NO_DATE_OR_TIME),
        )
        .when(
            at.isNull(),
            F.concat(
                F.lit(OPERATION_FAILED + "Failed to parse datetime '"),
                clock,
                F.lit("': "),
                datetime_problem(clock, at),
            ),
        )
        .when(_wrong_shape(place, _PLACE), _no_attribute(_PLACE))
        .when(_unmeasurable(raw, _RAW), _no_length(_RAW))
        .when(_unmeasurable(incident_type, _TYPE), _no_length(_TYPE))
        .when(
            number.isNull(),
            F.concat(
                F.lit(OPERATION_FAILED + 'value "'), cad, F.lit('" is out of range for type bigint')
            ),
        )
    )
    unit_text = F.when(~_empty(unit, _UNIT), unit)
    result = {
        "incident_number": number,
        "unit_id": F.coalesce(given, unit_text),
        "incident_date": at,
        "location": bound_text(raw, LOCATION_MAX_CHARS),
        "incident_type": bound_text(incident_type, INCIDENT_TYPE_MAX_CHARS),
        "error": F.when(plain, F.lit(None)).otherwise(first_failure),
    }
    helpers = ("_shape", "_digits", "_clock", "_whole", "_at", "_json", "_number")
    return computed_once(parsed, result).drop(*helpers)


def outcome_rows(validated: DataFrame, error_prefix: str = "") -> DataFrame:
    """doc_id, success, incident_number, unit_id and error: one row per document.

    Failed documents carry only the error, good ones only the key.
    """
    good = F.col("error").isNull()
    return validated.select(
        "doc_id",
        good.alias("success"),
        F.when(good, F.col("incident_number")).alias("incident_number"),
        F.when(good, F.col("unit_id")).alias("unit_id"),
        F.when(~good, F.concat(F.lit(error_prefix), F.col("error"))).alias("error"),
    )


# Columns of the incident table that may not be null.
NOT_NULL = (*INCIDENT_KEY, "created_date", "content", "incident_date")


def null_violations(incidents: DataFrame) -> DataFrame:
    """Rows with a null in a NOT NULL column, and the first such column."""
    column = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in NOT_NULL])
    return incidents.withColumn("violated", column).filter(F.col("violated").isNotNull())


def key_violations(incidents: DataFrame) -> DataFrame:
    """Keys held by more than one row, with their number of rows."""
    return (
        incidents.groupBy(*INCIDENT_KEY).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    )


def enforce_constraints(incidents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows the table takes, rows it rejects) by the NOT NULL rules."""
    complete = F.lit(True)
    for c in NOT_NULL:
        complete = complete & F.col(c).isNotNull()
    return incidents.filter(complete), null_violations(incidents)
