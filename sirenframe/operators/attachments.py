"""Choosing and naming message attachments.

Columns used: mailbox, seq, part_no, content_type, content_disposition,
filename, payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenframe.functions import contains_ignore_case

# --- fixed values -----------------------------------------------------------
PDF_TYPE = "application/pdf"
OCTET_TYPE = "application/octet-stream"
NEVER_ATTACHMENTS = ("text/plain", "text/html", "multipart/alternative", "multipart/mixed")


def _is_type(content_type: str) -> Column:
    return F.col("content_type") == content_type


def select_attachments(parts: DataFrame) -> DataFrame:
    """Parts that are attachments by disposition, or PDF or octet-stream by type."""
    disposition = F.col("content_disposition")
    attached = contains_ignore_case(disposition, "attachment") | contains_ignore_case(
        disposition, "inline"
    )
    return parts.filter(
        ~F.col("content_type").isin(*NEVER_ATTACHMENTS)
        & (attached | _is_type(PDF_TYPE) | _is_type(OCTET_TYPE))
    )


def attachment_filenames(parts: DataFrame, batch_time: str) -> DataFrame:
    """Set the final `filename` and drop parts that have none or are no PDF.

    A nameless PDF or octet-stream gets `fax_{seq}_{batch_time}_{part_no}.pdf`.
    An octet-stream of another name gets `.pdf` added; any other type has to
    end in `.pdf` already, in any letter case.
    """
    given = F.nullif(F.col("filename"), F.lit(""))
    made = F.when(
        _is_type(PDF_TYPE) | _is_type(OCTET_TYPE),
        F.concat(
            F.lit("fax_"), F.col("seq"), F.lit(f"_{batch_time}_"), F.col("part_no"), F.lit(".pdf")
        ),
    )
    name = F.col("filename")
    is_pdf_name = F.endswith(F.lower(name), F.lit(".pdf"))
    return (
        parts.withColumn("filename", F.coalesce(given, made))
        .filter(name.isNotNull() & (is_pdf_name | _is_type(OCTET_TYPE)))
        .withColumn(
            "filename", F.when(is_pdf_name, name).otherwise(F.concat(name, F.lit(".pdf")))
        )
    )


def drop_empty_payloads(parts: DataFrame) -> DataFrame:
    """Parts that carry at least one byte."""
    return parts.filter(F.length("payload") > 0)


def dedupe_filenames(
    parts: DataFrame, existing_names: DataFrame, batch_time: str
) -> DataFrame:
    """mailbox, seq, part_no and a `filename` that no other part has, for every part.

    Messages are handled newest first, so the newest holder of a new name keeps
    it. Where the name is taken, by such a part or in `existing_names(filename)`,
    `_{batch_time}_{mailbox}_{seq}_{part_no}` goes before the last extension, and
    a checksum of these after it in case that name is taken, too. Only keys and
    names are moved: a hot name is counted map-side, and joins are by row key or
    by names that differ.
    """
    key = ["mailbox", "seq", "part_no"]
    rows = parts.select(*key, "filename")
    taken = existing_names.select("filename").distinct()
    place = F.struct("mailbox", (-F.col("seq")).alias("newest"), "part_no", "seq")
    keepers = (
        rows.groupBy("filename")
        .agg(F.min(place).alias("first"))
        .join(taken, "filename", "left_anti")
        .select(*[F.col(f"first.{c}").alias(c) for c in key], F.lit(True).alias("_keeps"))
    )
    extension = F.substring_index("filename", ".", -1)
    stem = F.left("filename", F.length("filename") - F.length(extension) - 1)
    suffix = F.concat_ws("_", F.lit(batch_time), *[F.col(c).cast("string") for c in key])
    made = F.concat(stem, F.lit("_"), suffix, F.lit("."), extension)
    surer = F.concat(stem, F.lit("_"), suffix, F.lit("_"), F.sha2(suffix, 256), F.lit("."), extension)
    named = rows.join(keepers, key, "left").withColumns(
        {"_made": F.when(F.col("_keeps").isNull(), made), "_surer": surer}
    )
    given = (
        rows.select("filename").union(taken).distinct().select(F.col("filename").alias("_made"), F.lit(True).alias("_held"))
    )
    # A name that stays has no made one: its row must not go to one task with the others.
    probe = F.coalesce("_made", F.concat(F.lit("/"), suffix))
    return (
        named.withColumn("_made", probe)
        .join(given, "_made", "left")
        .select(
            *key,
            F.when(F.col("_keeps"), F.col("filename"))
            .when(F.col("_held"), F.col("_surer"))
            .otherwise(F.col("_made"))
            .alias("filename"),
        )
    )
