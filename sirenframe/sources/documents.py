"""Document files and the quarantine of failed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenframe.schemas import BINARY_FILE

DOCUMENT_GLOB = "*.pdf"
STAMP_FORMAT = "yyyyMMdd_HHmmss"


def _matches(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return found is not None and len(found) > 0


def scan_documents(
    spark: SparkSession, folder: str, glob: str = DOCUMENT_GLOB, with_content: bool = False
) -> DataFrame:
    """Top-level files that match `glob` (case-sensitive), oldest first, path breaking ties.

    Without `content` only the listing is sorted and no file is opened. A folder
    without a match, or that does not exist yet, has no files.
    """
    # The glob is part of the path: files of the folder itself, no subfolders.
    path = f"{folder.rstrip('/')}/{glob}"
    if _matches(spark, path):
        files = spark.read.format("binaryFile").load(path)
    else:
        files = spark.createDataFrame([], BINARY_FILE)
    return (files if with_content else files.drop("content")).orderBy("modificationTime", "path")


def stream_documents(
    spark: SparkSession,
    folder: str,
    glob: str = DOCUMENT_GLOB,
    max_files_per_trigger: int = 1000,
    **options: str,
) -> DataFrame:
    """The same files as a stream: each once per checkpoint, oldest first.

    `options` go to the reader, such as cleanSource="archive" with sourceArchiveDir.
    """
    reader = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .option("latestFirst", "false")
        .option("pathGlobFilter", glob)
        .options(**options)
    )
    return reader.load(folder)


def file_name(path: Column) -> Column:
    """Last segment of a path."""
    return F.substring_index(path, "/", -1)


def error_file_name(name: Column, at: Column) -> Column:
    """`{stem}_{yyyyMMdd_HHmmss}{suffix}`; a name that only starts with a dot has no suffix."""
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    stem = F.left(name, F.length(name) - F.length(suffix))
    return F.concat(stem, F.lit("_"), F.date_format(at, STAMP_FORMAT), suffix)


def quarantine_errors(failed: DataFrame, at: Column) -> DataFrame:
    """Quarantine entries of failed documents (doc_id, original_file, error)."""
    return failed.select(
        "doc_id",
        error_file_name(F.col("original_file"), at).alias("error_file"),
        "original_file",
        at.alias("error_at"),
        "error",
    )


def append_quarantine(entries: DataFrame, path: str) -> None:
    """Append entries, partitioned by the date of the error."""
    (
        entries.withColumn("error_date", F.to_date("error_at"))
        .write.mode("append")
        .partitionBy("error_date")
        .parquet(path)
    )
