"""Structured Streaming jobs."""

from sirenframe.streaming.dedup import dedup_messages
from sirenframe.streaming.documents import ingest_documents
from sirenframe.streaming.ingest import (
    compact_incidents,
    current_incidents,
    incident_files,
    incident_table,
    ingest_pages,
    ingest_responses,
    ingested,
    merge_log,
    outcomes,
    quarantine,
)
from sirenframe.streaming.mail import mail_ids, mail_rounds, mail_stats, saved_attachments
from sirenframe.streaming.pages import data_batches_only, hold_pages
from sirenframe.streaming.table import PartitionedTable

__all__ = [
    "PartitionedTable",
    "compact_incidents",
    "current_incidents",
    "data_batches_only",
    "dedup_messages",
    "hold_pages",
    "incident_files",
    "incident_table",
    "ingest_documents",
    "ingest_pages",
    "ingest_responses",
    "ingested",
    "mail_ids",
    "mail_rounds",
    "mail_stats",
    "merge_log",
    "outcomes",
    "quarantine",
    "saved_attachments",
]
