"""Mailbox rounds as a stream over an export of messages, safe to repeat.

A micro-batch is a round. It has two sinks, attachments and handled IDs, and may end
between them. So every round writes folders of its own, `round_no=N`, which a repeat
overwrites, and reads only what the rounds before it wrote: a round that is repeated
gives what it would have given at first. The IDs are written last; a round counts for
the ones after it when its IDs are written in full.

Under the root: `begun` (the time of the round, kept for a repeat), `attachments`, `stats`, `ids`,
and `seen`, the IDs of all rounds but the last two in few files.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sirenframe.plans.poll import as_files, poll_round
from sirenframe.schemas import NEWEST_PER_MAILBOX
from sirenframe.sources.state import append_processed_ids, load_processed_ids

_ROUND = "round_no"
_STAMP = "%Y%m%d_%H%M%S"
_FILES = "path string, modificationTime timestamp, length bigint, content binary"
_SINKS = {
    "begun": "at string",
    "attachments": _FILES,
    "stats": "mailbox string, emails_checked bigint, emails_processed bigint",
    "ids": "message_id string",
}


def _whole_rounds(spark: SparkSession, root: str, sink: str) -> list[int]:
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{sink}/{_ROUND}=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def _read(spark: SparkSession, root: str, sink: str, first: int, last: int) -> DataFrame:
    """What rounds first to last wrote; `round_no` is a folder, so the filter prunes."""
    schema = f"{_SINKS[sink]}, {_ROUND} bigint"
    if first > last:
        return spark.createDataFrame([], schema)
    base = f"{root}/{sink}"
    rows = spark.read.schema(schema).option("basePath", base).parquet(base)
    return rows.filter(F.col(_ROUND).between(first, last))


def _ended(spark: SparkSession, root: str, sink: str) -> DataFrame:
    root = root.rstrip("/")
    return _read(spark, root, sink, 0, max(_whole_rounds(spark, root, "ids"), default=-1))


def saved_attachments(spark: SparkSession, root: str) -> DataFrame:
    """Attachments of the rounds that ended, as document files."""
    return _ended(spark, root, "attachments")


def mail_ids(spark: SparkSession, root: str) -> DataFrame:
    """IDs handled by the rounds that ended."""
    return _ended(spark, root, "ids")


def mail_stats(spark: SparkSession, root: str) -> DataFrame:
    """Statistics of the rounds that ended, per mailbox."""
    return _ended(spark, root, "stats")


def _known_ids(spark: SparkSession, root: str, round_no: int) -> DataFrame:
    """IDs of the rounds before this one: of the latest from their folders, of older ones from a seen-set.

    What the round but one before wrote is final, so adding it to the seen-set again changes nothing.
    """
    state = f"{root}/seen"
    if round_no > 1:
        append_processed_ids(spark, _read(spark, root, "ids", round_no - 2, round_no - 2), state)
    latest = _read(spark, root, "ids", max(0, round_no - 2), round_no - 1).select("message_id")
    return load_processed_ids(spark, state).unionByName(latest)


def _write(rows: DataFrame, root: str, sink: str, round_no: int) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/{sink}/{_ROUND}={round_no}")


def _began(spark: SparkSession, root: str, round_no: int, at: str | None) -> str:
    """The time of a round, the same when it is repeated."""
    if round_no not in _whole_rounds(spark, root, "begun"):
        now = at or datetime.now(UTC).strftime(_STAMP)
        _write(spark.createDataFrame([(now,)], _SINKS["begun"]).coalesce(1), root, "begun", round_no)
    return _read(spark, root, "begun", round_no, round_no).first()["at"]


def mail_rounds(
    raw: DataFrame,
    root: str,
    checkpoint: str,
    sender: str,
    subject: str,
    seen: DataFrame | None = None,
    n: int = NEWEST_PER_MAILBOX,
    policy: str = "reference",
    at: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Stream of (mailbox, seq, seen, content): one round per micro-batch.

    `seen` are IDs handled before the stream began. `at` (yyyyMMdd_HHmmss) is the time
    of the rounds, else the clock when a round is first begun. Attachments go to
    `attachments` in the shape of document files, under names no earlier round used.
    """
    root = root.rstrip("/")

    def write(batch: DataFrame, round_no: int) -> None:
        spark = batch.sparkSession
        known = _known_ids(spark, root, round_no)
        if seen is not None:
            known = known.unionByName(seen.select("message_id"))
        held = _read(spark, root, "attachments", 0, round_no - 1).select(
            F.substring_index("path", "/", -1).alias("filename")
        )
        time = _began(spark, root, round_no, at)
        result = poll_round(batch, known, held, sender, subject, time, n, policy)
        _write(as_files(result.attachments, f"{root}/attachments", time), root, "attachments", round_no)
        _write(result.stats, root, "stats", round_no)
        _write(result.new_ids, root, "ids", round_no)

    return (
        raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
