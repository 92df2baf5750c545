"""Schemas and fixed values of the incident data model.

Everything here is data: the column types of the tables, the JSON shape of an
incident record, and the constants every operator shares.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------

# Status text of a unit-activity line -> field of the incident record.
STATUS_FIELDS = {
    "RESP": "enRoute",
    "ONLOC": "onScene",
    "TO HOSP": "leftScene",
    "AT HOSP": "ptArrivedAtDestination",
    "CLEAR": "backInService",
}

# Fields of `incidentTimes.times`, in record order.
TIME_FIELDS = (
    "notifiedByDispatch",
    "enRoute",
    "onScene",
    "arrivedAtPatient",
    "leftScene",
    "ptArrivedAtDestination",
    "destinationPatientTransferOfCare",
    "backInService",
)

# Derived time -> (time it builds on, minutes added).
DERIVED_TIMES = {
    "arrivedAtPatient": ("onScene", 2),
    "destinationPatientTransferOfCare": ("ptArrivedAtDestination", 5),
}

# Labels of the page header. The first three incident-number spellings stand
# for "CAD, Incident # or similar"; the last two rows are the stated forms of
# the derived times.
HEADER_LABELS = {
    "cad": ("CAD", "Incident #", "Incident Number"),
    "unit_dispatched": ("Unit Dispatched",),
    "incident_type": ("Incident Type",),
    "notifiedByDispatch": ("Dispatch Time",),
    "location_raw": ("Location",),
    "arrivedAtPatient": ("Arrived At Patient",),
    "destinationPatientTransferOfCare": ("Transfer Of Care",),
}

# Second words that belong to a territory name.
TERRITORY_SUFFIXES = ("TWP", "BORO")

NEWEST_PER_MAILBOX = 15
NIGHT_START_HOUR = 23
NIGHT_END_HOUR = 6
LOCATION_MAX_CHARS = 300
INCIDENT_TYPE_MAX_CHARS = 20

# --- schemas ----------------------------------------------------------------

DATE_AND_TIME = T.StructType(
    [T.StructField("date", T.StringType()), T.StructField("time", T.StringType())]
)

INCIDENT = T.StructType(
    [
        T.StructField(
            "incidentTimes",
            T.StructType(
                [
                    T.StructField("cad", T.StringType()),
                    T.StructField("unit_dispatched", T.StringType()),
                    T.StructField("incident_type", T.StringType()),
                    T.StructField(
                        "times",
                        T.StructType([T.StructField(f, DATE_AND_TIME) for f in TIME_FIELDS]),
                    ),
                ]
            ),
        ),
        T.StructField(
            "incidentLocation",
            T.StructType(
                [
                    T.StructField(f, T.StringType())
                    for f in ("raw", "territory", "location_name", "street_address", "apartment")
                ]
            ),
        ),
        T.StructField(
            "parsingErrors",
            T.ArrayType(
                T.StructType(
                    [T.StructField("field", T.StringType()), T.StructField("error", T.StringType())]
                )
            ),
        ),
    ]
)

# The incident table; (incident_number, unit_id) is its key.
INCIDENT_KEY = ("incident_number", "unit_id")
INCIDENTS = T.StructType(
    [
        T.StructField("incident_number", T.LongType(), False),
        T.StructField("unit_id", T.StringType(), False),
        T.StructField("created_date", T.TimestampType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("incident_date", T.TimestampType(), False),
        T.StructField("location", T.StringType()),
        T.StructField("incident_type", T.StringType()),
    ]
)
# Columns an upsert replaces. `created_date` is not among them: it is set once.
INCIDENT_PAYLOAD = ("content", "incident_date", "location", "incident_type")

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

MESSAGE_HEADERS = T.StructType(
    [
        T.StructField("mailbox", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("seen", T.BooleanType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("sender", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

MESSAGE_PARTS = T.StructType(
    [
        T.StructField("mailbox", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("part_no", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("content_disposition", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)

TOKEN_USAGE = T.StructType(
    [
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
    ]
)
