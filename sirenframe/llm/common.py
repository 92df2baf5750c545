"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenframe import configure as base_configure
from sirenframe import shared_dir

# Rows and bytes of one batch handed to Python: a few long texts must not add up.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings of the library and the batch size these operators count on."""
    base_configure(spark)
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(rows: DataFrame, purpose: str) -> DataFrame:
    """Write rows to a new folder of the shared root and read them back: lineage ends here."""
    path = shared_dir(rows.sparkSession, purpose)
    rows.write.option("compression", "zstd").parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out.staged_path = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Delete the folders of staged tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(table.staged_path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(rows: DataFrame, wanted: str) -> str:
    """A column name that rows does not have yet, whatever its case."""
    taken = {c.lower() for c in rows.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def numbered(rows: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """Rows with a unique number each, written out so that the numbers stay as they are."""
    name = free_name(rows, "row_no")
    return staged(rows.withColumn(name, F.monotonically_increasing_id()), purpose), name


def text_of(column: Column) -> Column:
    """Text of a column of any type; null is the empty text."""
    return F.coalesce(column.cast("string"), F.lit(""))


def only_rows(rows: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """The rows whose number is in kept (one column of that name), without the number."""
    return rows.join(kept, key, "left_semi").drop(key)
