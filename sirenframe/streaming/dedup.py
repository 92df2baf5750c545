"""Each message ID once over the life of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

SALTS = 64
SALT = "_salt"
# Groups of IDs that share a state, where there is a seen-set to start from.
BUCKETS = 4096
BUCKET = "_bucket"


def dedup_messages(
    messages: DataFrame,
    within: str | None = None,
    event_time: str | None = None,
    seen: DataFrame | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """First copy of every non-blank `message_id`.

    By default an ID is remembered for ever, and the state grows with the
    number of IDs: run it on the RocksDB state store. With `within` (a delay)
    and `event_time` an ID is forgotten once the watermark has passed, which
    bounds the state.

    `seen` (message_id) are IDs handled before the stream began: they never come
    out. They become the state the stream starts from; a restart goes on with the
    state of its checkpoint and does not read them again.

    One ID may be most of the stream: copies are dropped by (message_id, salt)
    first, the salt being the task that read the row, so no task gets all copies.
    At most `SALTS` rows of an ID, over all time, reach the second step. Where there
    is a seen-set, copies are dropped within the batches of rows handed to Python first.
    """
    if seen is not None:
        if within is not None:
            raise ValueError("a seen-set is never forgotten: no delay")
        return _dedup_after(messages, seen, buckets)
    named = messages.filter(F.col("message_id") != "").withColumn(
        SALT, F.spark_partition_id() % SALTS
    )
    if within is None:
        return named.dropDuplicates(["message_id", SALT]).dropDuplicates(["message_id"]).drop(SALT)
    if event_time is None:
        raise ValueError("a bounded dedup needs the event_time column")
    late = named.withWatermark(event_time, within)
    spread = late.dropDuplicatesWithinWatermark(["message_id", SALT])
    return spread.dropDuplicatesWithinWatermark(["message_id"]).drop(SALT)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("message_id"), F.lit(buckets)).alias(BUCKET)


def _dedup_after(messages: DataFrame, seen: DataFrame, buckets: int) -> DataFrame:
    named = messages.filter(F.col("message_id") != "")
    spread = named.mapInArrow(_once_a_batch, named.schema)
    known = seen.filter(F.col("message_id") != "").select("message_id").distinct()
    return spread.select(_bucket(buckets), *messages.columns).groupBy(BUCKET).transformWithState(
        _FirstCopy(messages.columns),
        T.StructType(messages.schema.fields),
        "Append",
        "None",
        initialState=known.select(_bucket(buckets), "message_id").groupBy(BUCKET),
    )


def _once_a_batch(batches: Iterator) -> Iterator:
    """Batches without later copies of an ID in the same batch: of a hot ID one row in thousands is left."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("message_id")).to_pandas()
        yield batch.filter((~ids.duplicated()).to_numpy())


class _FirstCopy(StatefulProcessor):
    """The IDs of a bucket that have come out, or were handled before."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle) -> None:
        self.ids = handle.getMapState("ids", "message_id string", "seen boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        if isinstance(initialState, pd.DataFrame):
            found = initialState["message_id"]
        else:
            found = [initialState["message_id"]]
        for message_id in found:
            self.ids.updateValue((message_id,), (True,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        met = set()
        for row in rows:
            message_id = row["message_id"]
            if message_id in met:
                continue
            met.add(message_id)
            if not self.ids.containsKey((message_id,)):
                self.ids.updateValue((message_id,), (True,))
                yield Row(**{c: row[c] for c in self.columns})

    def close(self) -> None:
        pass
