"""Pages -> incidents in one scan and two small shuffles.

The single operators of `operators.extraction` each answer one question. Run
one after another they would read the page text once for the header and once
for the activity, and join the two. Here each page is read once and becomes
short rows, which two aggregates with map-side partials fold into incidents:

1. by (document, unit): a header row (unit null) keeps the first value of each
   label, an activity row of each unit the first clock text of each status;
2. by (document, unit), where the header row now takes the dispatched unit as
   its key: the header meets exactly the activity of its unit.

No join, no window, and no group is ever collected: a document with a third of
all lines arrives at its task as one row per unit and map task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenframe.functions import parse_datetime_text, parse_location, with_derived_times
from sirenframe.operators.barrier import computed_once
from sirenframe.operators.extraction import (
    LINES_PER_PAGE,
    NO_ADDRESS,
    NOT_A_DATETIME,
    NOT_FOUND,
    UNPARSEABLE,
    activity_columns,
    activity_lines,
    build_incident_json,
    error_json,
    first_by,
    header_fields,
    header_lines,
    incident_record,
    parsing_errors,
    status_field,
)
from sirenframe.schemas import HEADER_LABELS, STATUS_FIELDS, TERRITORY_SUFFIXES, TIME_FIELDS

_TEXT_FIELDS = ("cad", "unit_dispatched", "incident_type", "location_raw")
# Times that must be in the document; any other may be absent without an error.
_REQUIRED = {
    "cad": "cad",
    "unit_dispatched": "unit_dispatched",
    "incident_type": "incident_type",
    "notifiedByDispatch": "notifiedByDispatch",
    "location_raw": "incidentLocation.raw",
}


def _facts(
    pages: DataFrame,
    labels: Mapping[str, Sequence[str]],
    mapping: Mapping[str, str],
    carry: Sequence[str],
) -> DataFrame:
    """Per page one header row and one row per activity line; the page text ends here."""
    statuses = tuple(mapping)
    found = pages.select(
        "doc_id",
        "page_no",
        *carry,
        header_lines(F.col("text"), labels).alias("found"),
        activity_lines(F.col("text"), statuses).alias("lines"),
    )
    read = found.select(
        "doc_id",
        "page_no",
        *carry,
        F.struct(
            *[c.alias(n) for n, c in header_fields(F.col("found"), labels).items()]
        ).alias("h"),
        "lines",
    )
    no_line = F.array(F.lit(None).cast("string"))
    rows = read.select(
        "doc_id",
        "page_no",
        *carry,
        "h",
        F.posexplode(F.concat(no_line, "lines")).alias("line_no", "line"),
    )
    parsed = activity_columns(F.col("line"), statuses)
    is_header = F.col("line").isNull()
    return rows.select(
        "doc_id",
        *carry,
        is_header.alias("is_header"),
        (F.col("page_no") * F.lit(LINES_PER_PAGE) + F.col("line_no")).alias("pos"),
        *[F.when(is_header, F.col(f"h.{f}")).alias(f"h_{f}") for f in labels],
        F.when(~is_header, parsed["unit_id"]).alias("unit_id"),
        status_field(parsed["status"], mapping).alias("field"),
        parsed["clock"].alias("clock"),
    ).filter(F.col("is_header") | F.col("field").isNotNull())


def _first_clock(field: str) -> Column:
    mine = F.col("field") == field
    return F.min_by(F.when(mine, F.col("clock")), F.when(mine, F.col("pos"))).alias(f"t_{field}")


def _fold(
    facts: DataFrame,
    labels: Mapping[str, Sequence[str]],
    fields: Sequence[str],
    carry: Sequence[str],
    match_unit: bool,
) -> DataFrame:
    first_values = [
        *[F.max(c).alias(c) for c in carry],
        *[first_by(f"h_{f}", "pos", F.col(f"h_{f}").isNotNull()) for f in labels],
        *[_first_clock(f) for f in fields],
    ]
    if not match_unit:
        return facts.groupBy("doc_id").agg(*first_values)
    per_unit = facts.groupBy("doc_id", "unit_id").agg(
        F.bool_or("is_header").alias("is_header"), *first_values
    )
    # At most one header row and one activity row meet here, so max is the value.
    kept = [*carry, *[f"h_{f}" for f in labels], *[f"t_{f}" for f in fields]]
    return (
        per_unit.withColumn(
            "unit", F.when(F.col("is_header"), F.col("h_unit_dispatched")).otherwise(F.col("unit_id"))
        )
        .groupBy("doc_id", "unit")
        .agg(F.bool_or("is_header").alias("is_header"), *[F.max(c).alias(c) for c in kept])
        .filter("is_header")
        .drop("unit", "is_header")
    )


def extract_fields(
    pages: DataFrame,
    labels: Mapping[str, Sequence[str]] = HEADER_LABELS,
    mapping: Mapping[str, str] = STATUS_FIELDS,
    suffixes: Sequence[str] = TERRITORY_SUFFIXES,
    match_unit: bool = True,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: header texts, the eight times, location parts, parsing errors.

    `match_unit=False` reads the activity of all units (the older rule). `carry`
    names columns of `pages` of which the highest value per document is kept.
    """
    # Several statuses may stand for one field.
    fields = list(dict.fromkeys(mapping.values()))
    folded = _fold(_facts(pages, labels, mapping, carry), labels, fields, carry, match_unit)
    stated = [f for f in labels if f in TIME_FIELDS]
    clock = {**{f: f"h_{f}" for f in stated}, **{f: f"t_{f}" for f in fields}}
    read = folded.select(
        "doc_id",
        *carry,
        *[F.col(f"h_{f}").alias(f) for f in _TEXT_FIELDS],
        *[
            (parse_datetime_text(F.col(clock[f])) if f in clock else F.lit(None).cast("timestamp_ntz"))
            .alias(f)
            for f in TIME_FIELDS
        ],
        *[F.col(c).alias(f"clock_{f}") for f, c in clock.items()],
    )
    place = read.withColumn("location", parse_location(F.col("location_raw"), suffixes))
    source = {f: F.col(f"clock_{f}") if f in clock else F.col(f) for f in _REQUIRED}
    problems = [
        *[(name, NOT_FOUND, source[f].isNull()) for f, name in _REQUIRED.items()],
        *[
            (f, NOT_A_DATETIME, F.col(f"clock_{f}").isNotNull() & F.col(f).isNull())
            for f in TIME_FIELDS
            if f in clock
        ],
        (
            "incidentLocation",
            NO_ADDRESS,
            F.col("location").isNotNull() & F.col("location.street_address").isNull(),
        ),
    ]
    return with_derived_times(
        place.withColumn("parsing_errors", parsing_errors(problems)).drop(
            *[f"clock_{f}" for f in clock]
        )
    )


def unparseable(fields: DataFrame) -> Column:
    """True where no field at all was read."""
    read = [*_TEXT_FIELDS, *TIME_FIELDS]
    return F.coalesce(*[fields[f].cast("string") for f in read]).isNull()


def extract_incidents(pages: DataFrame, carry: Sequence[str] = (), **rules) -> DataFrame:
    """doc_id, carried columns, content (incident JSON, or `{"error": …}`), error."""
    fields = extract_fields(pages, carry=carry, **rules)
    record = incident_record(
        F.col("cad"),
        F.col("unit_dispatched"),
        F.col("incident_type"),
        {f: F.col(f) for f in TIME_FIELDS},
        F.col("location"),
        F.col("parsing_errors"),
    )
    error = F.when(unparseable(fields), F.lit(UNPARSEABLE))
    content = F.when(error.isNotNull(), error_json(error)).otherwise(build_incident_json(record))
    return computed_once(fields, {"content": content, "error": error}).select(
        "doc_id", *carry, "content", "error"
    )
