"""Document files read by a stream that a bad file does not end.

The stream carries the listing only. In each micro-batch the files are read together;
where that fails, halves of them are tried until the files that cannot be read are
found, and these go to quarantine while the others are stored. A file may have vanished, may be
damaged, forbidden, or longer than the limit. Both sinks write a folder per batch,
which a repeated batch overwrites.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sirenframe.schemas import BINARY_FILE
from sirenframe.sources.documents import DOCUMENT_GLOB, quarantine_errors, stream_documents

MAX_BYTES = 1 << 28
TOO_LONG = "file is longer than the limit of {} bytes: {}"
# A failed job shows as either, depending on where it failed.
_PROBLEMS = (PySparkException, Py4JJavaError)
_BATCH = "batch_no"
_FAILED = "doc_id string, original_file string, error string"


def _content(spark: SparkSession, paths: list[str]) -> DataFrame:
    # A path is read as it is spelt, not as a pattern.
    plain = [re.sub(r"([\\*?\[\]{}])", r"\\\1", path) for path in paths]
    return spark.read.format("binaryFile").load(plain)


def _why(problem: Exception) -> str:
    """First line of the innermost cause."""
    text = str(problem)
    causes = re.findall(r"^Caused by: (.*)$", text, re.MULTILINE)
    return (causes[-1] if causes else text.strip().splitlines()[0])[:500]


def unreadable(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The files that cannot be read, each with the reason; the others are read in few jobs."""
    try:
        _content(spark, paths).select(F.length("content")).write.format("noop").mode("overwrite").save()
    except _PROBLEMS as problem:
        if len(paths) == 1:
            return {paths[0]: _why(problem)}
        middle = len(paths) // 2
        return unreadable(spark, paths[:middle]) | unreadable(spark, paths[middle:])
    return {}


def ingest_documents(
    spark: SparkSession,
    folder: str,
    root: str,
    checkpoint: str,
    glob: str = DOCUMENT_GLOB,
    max_files_per_trigger: int = 1000,
    max_bytes: int = MAX_BYTES,
    at: Column | None = None,
    **trigger,
) -> StreamingQuery:
    """Files of a folder -> `{root}/documents` (with content) and `{root}/quarantine`, each file once.

    The driver holds the listing of a micro-batch, at most `max_files_per_trigger` rows.
    A file that is gone before it is listed was never there. `at` is the time of the
    quarantine entries, by default the time of the batch. A failure that is no file's fault
    (no file can be read at all because the cluster fails) shows as entries too; their files
    stay where they are, to be delivered again.
    """
    listing = stream_documents(
        spark, folder, glob, max_files_per_trigger, ignoreMissingFiles="true"
    ).select("path", "modificationTime", "length")
    root = root.rstrip("/")

    def write(batch: DataFrame, batch_no: int) -> None:
        session = batch.sparkSession
        files = {f.path: f.length for f in batch.collect()}
        failed = {p: TOO_LONG.format(max_bytes, n) for p, n in files.items() if n > max_bytes}
        while True:
            paths = [p for p in files if p not in failed]
            try:
                rows = _content(session, paths) if paths else session.createDataFrame([], BINARY_FILE)
                rows.write.mode("overwrite").parquet(f"{root}/documents/{_BATCH}={batch_no}")
                break
            except _PROBLEMS:
                found = unreadable(session, paths)
                if not found:
                    raise
                failed |= found
        data = [(p, p.rsplit("/", 1)[-1], why) for p, why in sorted(failed.items())]
        entries = quarantine_errors(
            session.createDataFrame(data, _FAILED), F.current_timestamp() if at is None else at
        )
        entries.write.mode("overwrite").parquet(f"{root}/quarantine/{_BATCH}={batch_no}")

    return listing.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
