"""One round over the mailboxes: messages -> attachments, statistics, new seen-set IDs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenframe.operators.attachments import (
    attachment_filenames,
    dedupe_filenames,
    drop_empty_payloads,
    select_attachments,
)
from sirenframe.operators.selection import (
    cut_at_failures,
    filter_sender_seen,
    handled_ids,
    poll_stats,
    take_until_stop,
)
from sirenframe.schemas import NEWEST_PER_MAILBOX
from sirenframe.session import written
from sirenframe.sources.messages import message_headers, message_parts


@dataclass
class Round:
    """Results of a round. `new_ids` are to be appended to the seen-set last.

    `failed` (mailbox, seq, message_id) are messages to be tried again; their
    parts before the one that failed are among the attachments.
    """

    attachments: DataFrame
    stats: DataFrame
    new_ids: DataFrame
    failed: DataFrame


def poll_round(
    raw: DataFrame,
    processed_ids: DataFrame,
    existing_names: DataFrame,
    sender: str,
    subject: str,
    batch_time: str,
    n: int = NEWEST_PER_MAILBOX,
    policy: str = "reference",
) -> Round:
    """`raw` has mailbox, seq, seen, content.

    Unread mail never reaches Python. Headers are parsed once to choose
    messages; bodies are parsed once, for the few that are left (at most `n` per
    mailbox). A message that fails (in its subject, its sender, or a part that
    would be saved) is checked but not processed, and its ID is not marked; with
    policy "reference" it ends the pass over its mailbox.
    """
    headers = message_headers(raw.filter("seen"))
    candidates = filter_sender_seen(headers, sender)
    chosen = written(take_until_stop(candidates, processed_ids, subject, n, policy), "reached")
    bodies = raw.join(chosen.filter("processed").select("mailbox", "seq"), ["mailbox", "seq"], "left_semi")
    # A message without part_no could not be read at all.
    parts = message_parts(bodies)
    broken = parts.filter("part_no IS NULL").unionByName(
        select_attachments(parts.filter("part_no IS NOT NULL"))
    )
    found = written(broken, "parts")
    failures = found.filter("error IS NOT NULL").groupBy("mailbox", "seq").agg(
        F.min(F.coalesce("part_no", F.lit(0))).alias("_fails_at")
    )
    reached = written(cut_at_failures(chosen, failures, policy), "reached")
    saved = (
        found.filter("error IS NULL")
        .join(reached.filter("processed OR failed").select("mailbox", "seq"), ["mailbox", "seq"], "left_semi")
        .join(failures, ["mailbox", "seq"], "left")
        .filter("_fails_at IS NULL OR part_no < _fails_at")
        .drop("_fails_at")
    )
    named = drop_empty_payloads(attachment_filenames(saved, batch_time))
    names = dedupe_filenames(named, existing_names, batch_time)
    attachments = named.drop("filename").join(names, ["mailbox", "seq", "part_no"])
    return Round(
        attachments,
        poll_stats(reached, raw.select("mailbox").distinct()),
        handled_ids(reached),
        reached.filter("failed").select("mailbox", "seq", "message_id"),
    )


def as_files(attachments: DataFrame, folder: str, at: str) -> DataFrame:
    """Attachments in the shape of document files: path, modificationTime, length, content."""
    return attachments.select(
        F.concat(F.lit(folder.rstrip("/") + "/"), F.col("filename")).alias("path"),
        F.to_timestamp(F.lit(at), "yyyyMMdd_HHmmss").alias("modificationTime"),
        F.length("payload").cast("bigint").alias("length"),
        F.col("payload").alias("content"),
    )


def save_attachments(attachments: DataFrame, folder: str, at: str) -> None:
    """Append attachments to a table of document files."""
    as_files(attachments, folder, at).write.mode("append").parquet(folder)
