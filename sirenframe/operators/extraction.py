"""Rules that turn page text into incident fields.

Columns used: pages(doc_id, page_no from 0, text),
activity(doc_id, pos, unit_id, ts, status).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sirenframe.functions import parse_datetime_text, split_datetime
from sirenframe.schemas import DATE_AND_TIME, HEADER_LABELS, INCIDENT, STATUS_FIELDS, TIME_FIELDS

# Pages put together in one row of `assemble_pages`.
PAGES_PER_PART = 1000

# Line numbers of one page; a line's place in a document is page_no * this + line.
LINES_PER_PAGE = 1 << 32


# --- pages ------------------------------------------------------------------


def assemble_pages(pages: DataFrame, pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """One row per part of a document: its pages in page order, as one text and as a list.

    A part is a stretch of `pages_per_part` page numbers, so that no task has to
    hold a document of unlimited length; `part_no` numbers them, whatever the
    length. `n_pages` is the page count of the whole document, on every row.
    The page texts are moved once; only counts go the second way.
    """
    part = F.floor(F.col("page_no") / pages_per_part).alias("part_no")
    counts = (
        pages.groupBy("doc_id", part)
        .agg(F.count("*").alias("_own"))
        .withColumn("n_pages", F.sum("_own").over(W.partitionBy("doc_id")))
        .drop("_own")
    )
    texts = pages.groupBy("doc_id", part).agg(
        F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("pages")
    )
    # Plain equality keeps the partitioning of the texts; a null key counts for itself.
    return texts.join(counts, ["doc_id", "part_no"], "left").select(
        "doc_id",
        "part_no",
        F.coalesce("n_pages", F.size("pages").cast("bigint")).alias("n_pages"),
        F.array_join(F.col("pages.text"), "\n").alias("text"),
        "pages",
    )


def page_text(pages: DataFrame, page_no: int) -> DataFrame:
    """The page with this index (from 0) of every document."""
    return pages.filter(F.col("page_no") == page_no)


# --- header -----------------------------------------------------------------


def _alternatives(labels: Sequence[str]) -> str:
    longest_first = sorted(labels, key=len, reverse=True)
    return "|".join(re.escape(label).replace(r"\ ", "[ \\t]+") for label in longest_first)


def _labelled(labels: Sequence[str], all_labels: Sequence[str]) -> str:
    """Pattern of "label: value" on one line, or a value on the line below its label."""
    return (
        rf"(?im)^[ \t]*(?:{_alternatives(labels)})[ \t]*"
        r"(?::[ \t]*|:?[ \t]*\r?\n[ \t]*)"
        rf"(?!(?:{_alternatives(all_labels)})[ \t]*(?::|$))"
        r"(\S(?:[^\r\n]*\S)?)"
    )


def header_lines(text: Column, labels: Mapping[str, Sequence[str]] = HEADER_LABELS) -> Column:
    """The labelled lines of a page, found in one pass over its text; a null text has none."""
    every = [label for group in labels.values() for label in group]
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_labelled(every, every)), F.lit(0))
    return F.array_join(found, "\n")


def header_fields(
    lines: Column, labels: Mapping[str, Sequence[str]] = HEADER_LABELS
) -> dict[str, Column]:
    """One column per field from the labelled lines; null where the label is absent."""
    every = [label for group in labels.values() for label in group]
    return {
        field: F.nullif(F.regexp_extract(lines, _labelled(group, every), 1), F.lit(""))
        for field, group in labels.items()
    }


def extract_header_fields(
    pages: DataFrame, labels: Mapping[str, Sequence[str]] = HEADER_LABELS
) -> DataFrame:
    """One row per document; each field from the first page that has its label."""
    lines = pages.select("doc_id", "page_no", header_lines(F.col("text"), labels).alias("lines"))
    per_page = lines.select("doc_id", "page_no", *_aliased(header_fields(F.col("lines"), labels)))
    return per_page.groupBy("doc_id").agg(
        *[first_by(field, "page_no", F.col(field).isNotNull()) for field in labels]
    )


def _aliased(columns: Mapping[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def first_by(value: str, order: str, only: Column) -> Column:
    """The value with the lowest order among the rows where `only` holds."""
    return F.min_by(F.when(only, F.col(value)), F.when(only, F.col(order))).alias(value)


# --- unit activity ----------------------------------------------------------


def _activity_line(statuses: Sequence[str]) -> str:
    spaced = [s for s in statuses if " " in s]
    status = "|".join([*[re.escape(s).replace(r"\ ", "[ \\t]+") for s in spaced], r"\S+"])
    return (
        r"(?m)^[ \t]*(\S+)[ \t]+([0-9]{1,2}/[0-9]{1,2}/[0-9]{4}[ \t]+"
        rf"[0-9]{{1,2}}:[0-9]{{1,2}}:[0-9]{{1,2}})[ \t]+({status})(?=[ \t\r]|$)"
    )


def activity_lines(text: Column, statuses: Sequence[str] = tuple(STATUS_FIELDS)) -> Column:
    """The unit-activity lines of a page, in line order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_activity_line(statuses)), F.lit(0))


def activity_columns(
    line: Column, statuses: Sequence[str] = tuple(STATUS_FIELDS)
) -> dict[str, Column]:
    """unit_id, clock text and status of one unit-activity line."""
    pattern = _activity_line(statuses)
    return {
        "unit_id": F.regexp_extract(line, pattern, 1),
        "clock": F.regexp_extract(line, pattern, 2),
        "status": F.regexp_replace(F.regexp_extract(line, pattern, 3), r"[ \t]+", " "),
    }


def activity_rows(
    pages: DataFrame, statuses: Sequence[str] = tuple(STATUS_FIELDS)
) -> DataFrame:
    """One row per unit-activity line: doc_id, pos (line order), unit_id, ts, status.

    What follows the status (the dispatcher) is left out. A line whose date does
    not exist keeps its row, with a null `ts`.
    """
    lines = pages.select(
        "doc_id", "page_no", F.posexplode(activity_lines(F.col("text"), statuses)).alias("line_no", "line")
    )
    place = F.col("page_no") * F.lit(LINES_PER_PAGE) + F.col("line_no")
    return lines.select(
        "doc_id", place.alias("pos"), *_aliased(activity_columns(F.col("line"), statuses))
    ).select("doc_id", "pos", "unit_id", parse_datetime_text(F.col("clock")).alias("ts"), "status")


def match_dispatched_unit(
    activity: DataFrame, headers: DataFrame, match_unit: bool = True
) -> DataFrame:
    """Activity rows of the dispatched unit; all rows where matching is off.

    `headers` has one row per document, so a document with very many activity
    rows is split by the adaptive skew join.
    """
    if not match_unit:
        return activity
    dispatched = headers.select("doc_id", F.col("unit_dispatched").alias("unit_id"))
    return activity.join(dispatched, ["doc_id", "unit_id"])


def status_field(status: Column, mapping: Mapping[str, str] = STATUS_FIELDS) -> Column:
    """Record field of a status; null where it has none. A literal map, no join."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), status)


def map_status(activity: DataFrame, mapping: Mapping[str, str] = STATUS_FIELDS) -> DataFrame:
    """Add `field`; rows of a status without a field are dropped."""
    return activity.withColumn("field", status_field(F.col("status"), mapping)).filter(
        F.col("field").isNotNull()
    )


def first_occurrence(mapped: DataFrame) -> DataFrame:
    """Per document and field the row first in line order, which may not be the earliest."""
    return mapped.groupBy("doc_id", "field").agg(F.min_by("ts", "pos").alias("ts"))


def pivot_times(mapped: DataFrame, fields: Sequence[str] = TIME_FIELDS) -> DataFrame:
    """One row per document, one column per field, first occurrence each.

    First occurrence and pivot are one hash aggregate with map-side partials: one
    shuffle, and a document with very many rows arrives as one row per task.
    """
    return mapped.groupBy("doc_id").agg(
        *[
            F.min_by(
                F.when(F.col("field") == f, F.col("ts")), F.when(F.col("field") == f, F.col("pos"))
            ).alias(f)
            for f in fields
        ]
    )


# --- record -----------------------------------------------------------------

NOT_FOUND = "not found in document"
NOT_A_DATETIME = "not a valid mm/dd/yyyy hh:mm:ss date and time"
NO_ADDRESS = "no street address in location text"
UNPARSEABLE = "no incident field could be extracted from the document"


def parsing_errors(problems: Sequence[tuple[str, str, Column]]) -> Column:
    """Array of (field, error) for the problems that hold; null where none does."""
    entries = F.array(
        *[
            F.when(
                holds, F.struct(F.lit(field).alias("field"), F.lit(error).alias("error"))
            )
            for field, error, holds in problems
        ]
    )
    kept = F.filter(entries, lambda entry: entry.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def incident_record(
    cad: Column,
    unit_dispatched: Column,
    incident_type: Column,
    times: Mapping[str, Column],
    location: Column,
    errors: Column,
) -> Column:
    """The nested incident record; objects without any field are null."""
    clocks = {f: split_datetime(times[f]) for f in TIME_FIELDS if f in times}
    times_object = F.lit(None).cast(DATE_AND_TIME)
    if clocks:
        some = F.coalesce(*clocks.values()).isNotNull()
        times_object = F.when(some, F.struct(*_aliased(clocks)))
    header = F.struct(
        cad.alias("cad"),
        unit_dispatched.alias("unit_dispatched"),
        incident_type.alias("incident_type"),
        times_object.alias("times"),
    )
    has_header = (
        cad.isNotNull()
        | unit_dispatched.isNotNull()
        | incident_type.isNotNull()
        | times_object.isNotNull()
    )
    return F.struct(
        F.when(has_header, header).alias("incidentTimes"),
        location.alias("incidentLocation"),
        errors.alias("parsingErrors"),
    )


def build_incident_json(record: Column, pretty: bool = False) -> Column:
    """JSON text of a record; null fields are left out."""
    return F.to_json(record, {"pretty": str(pretty).lower()})


def error_json(error: Column) -> Column:
    """`{"error": …}`, the whole answer for a document nothing was read from."""
    return F.to_json(F.struct(error.alias("error")))


def read_incident_json(content: Column) -> Column:
    """Incident JSON text -> nested record."""
    return F.from_json(content, INCIDENT)
