"""Files in, tables out."""

from sirenframe.sources.documents import quarantine_errors, scan_documents, stream_documents
from sirenframe.sources.messages import message_headers, message_parts, scan_messages
from sirenframe.sources.state import append_processed_ids, load_processed_ids

__all__ = [
    "append_processed_ids",
    "load_processed_ids",
    "message_headers",
    "message_parts",
    "quarantine_errors",
    "scan_documents",
    "scan_messages",
    "stream_documents",
]
