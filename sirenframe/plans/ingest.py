"""Responses -> one validated row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenframe.operators.records import SAVE_FAILED, validate_record
from sirenframe.operators.responses import drop_token_usage, flag_errors, parse_response
from sirenframe.schemas import INCIDENT_KEY, INCIDENT_PAYLOAD

# Columns of a prepared row, besides those the caller carries along.
PREPARED = ("success", *INCIDENT_KEY, "created_date", *INCIDENT_PAYLOAD, "error")


def prepare_responses(
    responses: DataFrame, created: Column, carry: list[str], given_unit: str | None = None
) -> DataFrame:
    """Clean, parse, route and validate responses: all in one narrow stage.

    Token counters in a response are not stored. Each input row becomes one row: `carry` columns, `success`, the columns of
    the incident table, and `error` (a parse error as it is, a failed record
    check with the save prefix).
    """
    flagged = flag_errors(parse_response(responses)).withColumnRenamed("error", "parse_error")
    flagged = flagged.withColumn("content", drop_token_usage(F.col("content")))
    checked = validate_record(flagged, given_unit)
    error = F.coalesce("parse_error", F.concat(F.lit(SAVE_FAILED), F.col("error")))
    return checked.withColumn("error", error).select(
        *carry,
        F.col("error").isNull().alias("success"),
        *INCIDENT_KEY,
        created.alias("created_date"),
        "content",
        F.col("incident_date").cast("timestamp").alias("incident_date"),
        "location",
        "incident_type",
        "error",
    )
