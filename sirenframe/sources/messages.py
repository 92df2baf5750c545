"""Raw messages (RFC 822 bytes) -> headers and parts.

The one place where Python code runs in tasks: MIME has no Spark expression.
The standard `email` package parses each message inside `mapInPandas`; a
header or part that cannot be decoded is a row with `error`, not an exception.
"""

from __future__ import annotations

import email
import email.header
import email.message
import email.parser
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenframe.schemas import MESSAGE_HEADERS, MESSAGE_PARTS


# Message bytes after which a task hands over the parts it has.
BYTES_PER_FRAME = 32 * 1024 * 1024


def scan_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Message files `folder/{mailbox}/{seq}.eml` -> mailbox, seq, seen, content.

    Such an export holds read messages only, so all of them count as seen.
    """
    files = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/*/*.eml")
    path = F.split("path", "/")
    return files.select(
        F.element_at(path, -2).alias("mailbox"),
        F.regexp_extract(F.element_at(path, -1), r"^([0-9]+)[.]eml$", 1)
        .try_cast("bigint")
        .alias("seq"),
        F.lit(True).alias("seen"),
        "content",
    )


def decode_header(value: object) -> str:
    """Header text with its encoded words decoded, fragments joined by one space."""
    fragments = email.header.decode_header(str(value)) if value else []
    return " ".join(
        text.decode(charset or "utf-8", errors="ignore") if isinstance(text, bytes) else text
        for text, charset in fragments
    )


def _text(value: object) -> str:
    return "" if value is None else str(value)


def _header_row(mailbox: str, seq: int, seen: bool, content: bytes) -> tuple:
    """An undecodable subject is null, an undecodable sender stays as it is written."""
    message_id, subject, sender, errors = "", None, "", []
    try:
        head = email.parser.BytesHeaderParser().parsebytes(content)
        message_id = _text(head.get("Message-ID")).strip()
    except Exception as problem:  # noqa: BLE001 - the row reports it
        return mailbox, seq, seen, message_id, subject, sender, str(problem)
    try:
        subject = decode_header(head.get("Subject"))
    except Exception as problem:  # noqa: BLE001 - the row reports it
        errors.append(str(problem))
    try:
        sender = decode_header(head.get("From"))
    except Exception as problem:  # noqa: BLE001 - the row reports it
        sender = _text(head.get("From"))
        errors.append(str(problem))
    return mailbox, seq, seen, message_id, subject, sender, "; ".join(errors) or None


def _part_row(key: tuple, part_no: int, part: email.message.Message) -> tuple:
    """A part whose name or payload cannot be decoded has neither, and says why."""
    kind = disposition = None
    try:
        kind = part.get_content_type()
        given = part.get("Content-Disposition")
        disposition = given and str(given)
        name = decode_header(part.get_filename()) or None
        return *key, part_no, kind, disposition, name, part.get_payload(decode=True), None
    except Exception as problem:  # noqa: BLE001 - the row reports it
        return *key, part_no, kind, disposition, None, None, str(problem)


def _part_rows(mailbox: str, seq: int, content: bytes) -> list[tuple]:
    message_id = ""
    try:
        message = email.message_from_bytes(content)
        message_id = _text(message.get("Message-ID")).strip()
        leaves = [p for p in message.walk() if p.get_content_maintype() != "multipart"]
    except Exception as problem:  # noqa: BLE001 - the row reports it
        return [(mailbox, seq, message_id, None, None, None, None, None, str(problem))]
    key = (mailbox, seq, message_id)
    return [_part_row(key, part_no, part) for part_no, part in enumerate(leaves)]


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        columns = (batch[c] for c in ("mailbox", "seq", "seen", "content"))
        yield pd.DataFrame([_header_row(*m) for m in zip(*columns)], columns=MESSAGE_HEADERS.names)


def _parts_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=MESSAGE_PARTS.names).astype({"part_no": "Int32"})


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for message in zip(batch["mailbox"], batch["seq"], batch["content"]):
            rows += _part_rows(*message)
            size += len(message[-1])
            if size > BYTES_PER_FRAME:
                yield _parts_frame(rows)
                rows, size = [], 0
        if rows:
            yield _parts_frame(rows)


def message_headers(raw: DataFrame) -> DataFrame:
    """One row per message: mailbox, seq, seen, message_id, subject, sender, error.

    `raw` has mailbox, seq, seen, content. Only the bytes before the first
    empty line go to Python. `subject` is null where it cannot be decoded.
    """
    # Latin-1 maps every byte to one character and back.
    text = F.decode("content", "ISO-8859-1")
    head = F.regexp_extract(text, r"(?s)\A(.*?)(?:\r?\n\r?\n|\z)", 1)
    return raw.select(
        "mailbox", "seq", "seen", F.encode(head, "ISO-8859-1").alias("content")
    ).mapInPandas(_headers, MESSAGE_HEADERS)


def message_parts(raw: DataFrame) -> DataFrame:
    """One row per non-container part, in walk order; `payload` is transfer-decoded.

    `raw` has mailbox, seq, content. A part that cannot be decoded has `error`;
    a message that cannot be read at all is one row without `part_no`.
    """
    return raw.select("mailbox", "seq", "content").mapInPandas(_parts, MESSAGE_PARTS)
