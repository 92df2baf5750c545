"""Documents -> incident table as a stream.

The sink is a log: every micro-batch writes one folder `batch_no={id}`, split
by `success`. Delivering a batch again overwrites its own folder, so the log,
and every table read from it, stays as it was. Writing costs the size of the
batch, not of the table.

- incident table: last good row per key        (`current_incidents`)
- quarantine:     failed documents             (`quarantine`)
- outcomes:       one row per document         (`outcomes`)

`compact_incidents` writes the incident table of a log to a snapshot folder
named by its last batch; `incident_table` starts from the newest snapshot and
folds the later batches only. `merge_log` keeps the table in partitions by key
(`incident_files`), of which it rewrites those that the new batches touch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from sirenframe.operators.extraction import error_json
from sirenframe.operators.upsert import latest_by_key, upsert_incidents
from sirenframe.plans.extraction import extract_incidents
from sirenframe.plans.ingest import prepare_responses
from sirenframe.schemas import INCIDENT_KEY, INCIDENT_PAYLOAD
from sirenframe.session import shared_dir
from sirenframe.sources.documents import quarantine_errors
from sirenframe.streaming.pages import HOLD_SECONDS, data_batches_only, hold_pages
from sirenframe.streaming.table import PARTS, PartitionedTable

LOG = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("arrived_at", T.TimestampType()),
        T.StructField("incident_number", T.LongType()),
        T.StructField("unit_id", T.StringType()),
        T.StructField("created_date", T.TimestampType()),
        T.StructField("content", T.StringType()),
        T.StructField("incident_date", T.TimestampType()),
        T.StructField("location", T.StringType()),
        T.StructField("incident_type", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("batch_no", T.LongType()),
        T.StructField("success", T.BooleanType()),
    ]
)
# Error of a document of which not all pages have come in time.
INCOMPLETE = "incomplete document, pages here: "
# Order in which documents are processed; the last one of a key wins.
PROCESSING_ORDER = ("batch_no", "arrived_at", "doc_id")


def _write_batch(prepared: DataFrame, log: str, batch_no: int) -> None:
    (
        prepared.write.mode("overwrite")
        .partitionBy("success")
        .parquet(f"{log.rstrip('/')}/batch_no={batch_no}")
    )


def _start(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, options: dict
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**options)
        .start()
    )


def ingest_responses(
    responses: DataFrame,
    log: str,
    checkpoint: str,
    created: Column | None = None,
    **trigger,
) -> StreamingQuery:
    """Stream of (doc_id, arrived_at, response_text) -> log.

    `created` is the creation time of a row that turns out to be an insert; by
    default the time its document arrived, which is the same when a batch is
    delivered again. A trigger may be named (`availableNow=True`).
    """
    at = F.col("arrived_at") if created is None else created

    def write(batch: DataFrame, batch_no: int) -> None:
        _write_batch(prepare_responses(batch, at, ["doc_id", "arrived_at"]), log, batch_no)

    return _start(responses, write, checkpoint, trigger)


def ingest_pages(
    pages: DataFrame,
    log: str,
    checkpoint: str,
    created: Column | None = None,
    rules: dict | None = None,
    hold_seconds: int = HOLD_SECONDS,
    **trigger,
) -> StreamingQuery:
    """Stream of (doc_id, arrived_at, page_no, n_pages, text) -> log.

    `n_pages` is the page count of the document. A document may come in several
    micro-batches: its pages are held until all have come (`hold_pages`) and it is
    stored with the last one. One that is not complete after `hold_seconds`, or of which the
    count is not known by then, is quarantined, not stored in part.
    """
    at = F.col("arrived_at") if created is None else created

    def write(batch: DataFrame, batch_no: int) -> None:
        # Both sides of the join read the batch, which would run the held state twice.
        folder = shared_dir(batch.sparkSession, "released")
        batch.write.option("compression", "zstd").parquet(folder)
        batch = batch.sparkSession.read.schema(batch.schema).parquet(folder)
        incidents = extract_incidents(batch, carry=["arrived_at"], **(rules or {}))
        counts = batch.groupBy("doc_id").agg(
            F.count("*").alias("_here"), F.max("n_pages").alias("_pages"), F.bool_and("complete").alias("_whole")
        )
        problem = F.concat(
            F.lit(INCOMPLETE), F.col("_here"), F.lit(" of "), F.coalesce(F.col("_pages").cast("string"), F.lit("?"))
        )
        # A null ID is a document like others.
        same = incidents["doc_id"].eqNullSafe(counts["doc_id"])
        responses = incidents.join(counts, same).select(
            incidents["doc_id"],
            "arrived_at",
            F.when(F.col("_whole"), F.col("content")).otherwise(error_json(problem)).alias("response_text"),
        )
        _write_batch(prepare_responses(responses, at, ["doc_id", "arrived_at"]), log, batch_no)
        path = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

    held = hold_pages(pages, hold_seconds)
    if not trigger.get("availableNow"):
        return _start(held, write, checkpoint, trigger)
    with data_batches_only(pages.sparkSession):
        return _start(held, write, checkpoint, trigger)


def ingested(spark: SparkSession, log: str) -> DataFrame:
    """All rows of a log. `batch_no` and `success` are folders, so filters on them prune.

    A log without any batch yet has no rows.
    """
    if not _folders(spark, log, "batch_no"):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).option("basePath", log).parquet(log)


def current_incidents(rows: DataFrame) -> DataFrame:
    """The incident table of log rows, unique by (incident_number, unit_id)."""
    return latest_by_key(
        rows.filter("success"),
        [F.col(c) for c in PROCESSING_ORDER],
        INCIDENT_KEY,
        INCIDENT_PAYLOAD,
    )


def quarantine(rows: DataFrame, at: Column | None = None) -> DataFrame:
    """Quarantine entries of log rows; `doc_id` is the path of the document."""
    failed = rows.filter(~F.col("success")).withColumn(
        "original_file", F.substring_index("doc_id", "/", -1)
    )
    return quarantine_errors(failed, F.col("created_date") if at is None else at)


def outcomes(rows: DataFrame) -> DataFrame:
    """doc_id, success, incident_number, unit_id, error of log rows."""
    good = F.col("success")
    return rows.select(
        "doc_id",
        "success",
        F.when(good, F.col("incident_number")).alias("incident_number"),
        F.when(good, F.col("unit_id")).alias("unit_id"),
        "error",
    )


def _folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers n of the folders `{path}/{name}={n}` that are written in full."""
    # A log has two levels below a batch, a snapshot has one: both end in a success mark.
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def incident_table(spark: SparkSession, log: str, snapshots: str) -> DataFrame:
    """The incident table of a log: the newest snapshot, and the batches after it."""
    rows = ingested(spark, log)
    taken = _folders(spark, snapshots, "batch_no")
    if not taken:
        return current_incidents(rows)
    before = spark.read.parquet(f"{snapshots.rstrip('/')}/batch_no={taken[-1]}")
    later = rows.filter(F.col("success") & (F.col("batch_no") > taken[-1]))
    return upsert_incidents(before, later, PROCESSING_ORDER)


def compact_incidents(spark: SparkSession, log: str, snapshots: str) -> None:
    """Write a snapshot as of the last batch, from the one before; nothing if there is no new batch."""
    batches, taken = _folders(spark, log, "batch_no"), _folders(spark, snapshots, "batch_no")
    if batches and (not taken or taken[-1] < batches[-1]):
        table = incident_table(spark, log, snapshots)
        table.write.mode("overwrite").parquet(f"{snapshots.rstrip('/')}/batch_no={batches[-1]}")


def merge_log(spark: SparkSession, log: str, table: PartitionedTable) -> list[int]:
    """Fold the batches of a log that a partitioned table does not have into it; the partitions rewritten.

    The merge is named by the last batch. Batches without a good row leave the table as it is.
    """
    batches, merged = _folders(spark, log, "batch_no"), table.versions()
    later = [b for b in batches if not merged or b > merged[-1]]
    if not later:
        return []
    rows = ingested(spark, log).filter(F.col("success") & F.col("batch_no").between(later[0], later[-1]))
    return table.merge(rows, PROCESSING_ORDER, later[-1])


def incident_files(spark: SparkSession, path: str, parts: int = PARTS) -> PartitionedTable:
    """The incident table as partitioned files."""
    return PartitionedTable(spark, path, LOG, parts)
