"""The incident table as files, of which a batch rewrites only the partitions it touches.

Keys are dealt by hash to a fixed number of partitions. A merge reads the partitions
its rows fall in, folds the rows into them and writes them anew, to a folder named by the
merge: `version=N/part=K`. The newest version of a partition that is written in full is its
content; all other partitions stay as they are, file by file. So a merge costs what it
touches, a merge that fails or is repeated leaves or gives the same table, and a
reader never meets half a merge, which overwriting files in place could not promise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sirenframe.operators.upsert import upsert_incidents
from sirenframe.schemas import INCIDENT_KEY, INCIDENT_PAYLOAD

PARTS = 256
_VERSION, _PART = "version=", "part="


class PartitionedTable:
    """A keyed table under `path`. All who write it name the same number of partitions."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        parts: int = PARTS,
        key: Sequence[str] = INCIDENT_KEY,
        payload: Sequence[str] = INCIDENT_PAYLOAD,
        created: str = "created_date",
    ):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts
        self.key, self.payload, self.created = list(key), list(payload), created
        columns = [*self.key, created, *self.payload]
        self.schema = T.StructType([schema[c] for c in columns])

    def _found(self, pattern: str) -> list[tuple[int, str]]:
        """(version, last name) of every path below a version that matches."""
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{_VERSION}*/{pattern}")
        fs = hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        paths = [f.getPath() for f in fs.globStatus(hadoop_path) or []]
        return [(int(p.getParent().getName().removeprefix(_VERSION)), p.getName()) for p in paths]

    def versions(self) -> list[int]:
        """Merges that are written in full."""
        return sorted(v for v, _ in self._found("_SUCCESS"))

    def _current(self, before: int | None = None) -> dict[int, int]:
        """Partition -> its newest whole version (older than `before`)."""
        whole = {v for v in self.versions() if before is None or v < before}
        newest: dict[int, int] = {}
        for version, name in sorted(self._found(f"{_PART}*")):
            if version in whole:
                newest[int(name.removeprefix(_PART))] = version
        return newest

    def _read(self, current: dict[int, int]) -> DataFrame:
        if not current:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/{_VERSION}{v}/{_PART}{k}" for k, v in sorted(current.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The table: at most one folder per partition, whatever the number of merges."""
        return self._read(self._current())

    def merge(self, rows: DataFrame, order: Sequence[str], version: int) -> list[int]:
        """Fold rows into the table as merge number `version`; the partitions that were rewritten.

        The same merge again writes the same partitions from the same versions.
        Rows of a null key are a key like others. `rows` is read twice.
        """
        part = F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")
        # At most `parts` numbers.
        touched = [r[0] for r in rows.select(part.alias("part")).distinct().collect()]
        if not touched:
            return []
        current = {k: v for k, v in self._current(version).items() if k in touched}
        merged = upsert_incidents(self._read(current), rows, order, self.key, self.payload, self.created)
        (
            # A partition is a file where it is small, and as many as its size asks for where it is not.
            merged.withColumn(_PART[:-1], part)
            .hint("rebalance", F.col(_PART[:-1]))
            .write.mode("overwrite")
            .partitionBy(_PART[:-1])
            .parquet(f"{self.path}/{_VERSION}{version}")
        )
        return sorted(touched)

    def drop_old(self, keep: int = 1) -> None:
        """Remove versions of a partition that are older than its newest and the `keep` before it."""
        whole = set(self.versions())
        held: dict[str, list[int]] = {}
        for version, name in self._found(f"{_PART}*"):
            if version in whole:
                held.setdefault(name, []).append(version)
        for name, versions in held.items():
            for version in sorted(versions)[: -1 - keep]:
                old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{_VERSION}{version}/{name}")
                old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
