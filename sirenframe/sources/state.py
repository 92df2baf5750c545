"""The seen-set: message IDs already handled, one per line of text files.

Beside the plain files a user may put there, a state folder holds generations.
`since-K` takes the appends of generation K; once it holds many files, all IDs
known are written to `generation-(K+1)`, and appends go to `since-(K+1)`. Readers use the
newest generation that is written in full and the appends from the generation before
on, so they see the same IDs before, during and after the change, and an append that
was under way is not lost. Generations older than that are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenframe.functions import strip_space

NO_IDS = "message_id string"
# Files of appends after which a new generation is written.
MAX_FILES = 64
_GENERATION, _SINCE = "generation-", "since-"


def _folder(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _names(spark: SparkSession, path: str) -> list[str] | None:
    """Names in a folder, None where there is none."""
    fs, folder = _folder(spark, path)
    if not fs.exists(folder):
        return None
    return [s.getPath().getName() for s in fs.listStatus(folder)]


def _numbers(names: list[str], prefix: str) -> list[int]:
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def _newest(spark: SparkSession, path: str, names: list[str]) -> int:
    """The newest generation written in full, 0 before the first."""
    whole = [g for g in _numbers(names, _GENERATION) if "_SUCCESS" in _names(spark, f"{path}/{_GENERATION}{g}")]
    return whole[-1] if whole else 0


def _paths(spark: SparkSession, path: str) -> list[str]:
    """What a reader has to read."""
    fs, root = _folder(spark, path)
    names = _names(spark, path)
    if names is None or fs.getFileStatus(root).isFile():
        return [] if names is None else [path]
    newest = _newest(spark, path, names)
    plain = [n for n in names if not n.startswith(("_", ".", _GENERATION, _SINCE))]
    kept = [f"{_GENERATION}{newest}"] if newest else []
    kept += [f"{_SINCE}{k}" for k in _numbers(names, _SINCE) if k >= newest - 1]
    return [f"{path}/{name}" for name in plain + kept]


def load_processed_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct IDs: lines stripped, blank ones dropped; an absent state is empty."""
    paths = _paths(spark, path.rstrip("/"))
    if not paths:
        return spark.createDataFrame([], NO_IDS)
    return (
        spark.read.schema("value string").text(paths)
        .select(strip_space(F.col("value")).alias("message_id"))
        .filter(F.col("message_id") != "")
        .distinct()
    )


def append_processed_ids(spark: SparkSession, ids: DataFrame, path: str, max_files: int = MAX_FILES) -> None:
    """Append the IDs the state does not have yet. No ID is ever removed.

    Once the appends hold `max_files` files, they are folded into a new generation.
    """
    path = path.rstrip("/")
    new = ids.select("message_id").filter(F.col("message_id") != "").distinct()
    new = new.join(load_processed_ids(spark, path), "message_id", "left_anti")
    since = (_numbers(_names(spark, path) or [], _SINCE) or [0])[-1]
    new.write.mode("append").text(f"{path}/{_SINCE}{since}")
    files = [n for n in _names(spark, f"{path}/{_SINCE}{since}") if not n.startswith(("_", "."))]
    if len(files) >= max_files:
        compact_processed_ids(spark, path)


def compact_processed_ids(spark: SparkSession, path: str) -> None:
    """Write all IDs as one generation; a run that fails is repeated by the next, and readers never notice."""
    path = path.rstrip("/")
    fs, _ = _folder(spark, path)
    names = _names(spark, path) or []
    newest = _newest(spark, path, names)
    after = max([newest, *_numbers(names, _SINCE), 0]) + 1
    # From here on appends go to a folder that this generation does not count on.
    fs.mkdirs(_folder(spark, f"{path}/{_SINCE}{after}")[1])
    load_processed_ids(spark, path).write.mode("overwrite").text(f"{path}/{_GENERATION}{after}")
    for prefix in (_GENERATION, _SINCE):
        for old in _numbers(names, prefix):
            if old < (newest if prefix == _GENERATION else after - 1):
                fs.delete(_folder(spark, f"{path}/{prefix}{old}")[1], True)
