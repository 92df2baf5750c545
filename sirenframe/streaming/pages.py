"""Pages of a document that arrive in several micro-batches, held until all are there."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Groups of documents that share a state. A state is asked for once a group and
# micro-batch, so there are far fewer of them than documents.
BUCKETS = 4096
HOLD_SECONDS = 3600
# Pages handed over at a time when a document is released.
SENT_PAGES = 1000
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
_BUCKET = "_bucket"
_COLUMNS = ["doc_id", "page_no", "n_pages", "arrived", "text"]
_PAGE = "page_no long"
_BODY = "n_pages long, arrived long, text string"
_OUT = f"doc_id string, {_PAGE}, {_BODY}, complete boolean"


def hold_pages(pages: DataFrame, hold_seconds: int = HOLD_SECONDS, buckets: int = BUCKETS) -> DataFrame:
    """Stream of (doc_id, arrived_at, page_no, n_pages, text) -> the same pages, document by document.

    A document comes out, `complete` true, in the micro-batch in which the last of
    its `n_pages` pages has come. What has come of a document is held in the state of
    the stream, which outlives a restart; after `hold_seconds` without the rest it comes out with
    `complete` false (in the first micro-batch after that time). A page that comes
    twice counts once, the copy that arrived last. A page of a document that was held
    and is finished is dropped if it arrived no later than the document did, for as
    long as pages are held; later copies start a new document. Null IDs are one
    document without end, and a document without a page count is never complete.

    The time is looked at in every micro-batch. With trigger availableNow start the query
    inside `data_batches_only`, as Spark else adds batches without data for as long as it may have
    to look.

    The pages of a document go through one task, as one document becomes one record, in
    Arrow batches; what is held lies in the state store, not in memory.
    """
    rows = pages.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias(_BUCKET),
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("page_no").cast("long").alias("page_no"),
        F.col("n_pages").cast("long").alias("n_pages"),
        F.unix_micros(F.col("arrived_at").cast("timestamp")).alias("arrived"),
        "text",
    )
    held = rows.groupBy(_BUCKET).transformWithStateInPandas(
        _HoldPages(hold_seconds * 1000), _OUT, "Append", "ProcessingTime"
    )
    return held.withColumn("arrived_at", F.timestamp_micros("arrived")).drop("arrived")


@contextmanager
def data_batches_only(spark: SparkSession) -> Iterator[None]:
    """A query started in here runs no micro-batch without new data."""
    before = spark.conf.get(_IDLE)
    spark.conf.set(_IDLE, "false")
    try:
        yield
    finally:
        spark.conf.set(_IDLE, before)


class _HoldPages(StatefulProcessor):
    """State of a bucket: pages by (document, page), and a line about each document held or lately finished."""

    def __init__(self, hold_ms: int):
        self.hold_ms = hold_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", f"doc_id string, {_PAGE}", _BODY)
        # since: processing time of the first page, or of the end; last: latest arrival.
        self.documents = handle.getMapState(
            "documents", "doc_id string", "n_pages long, here long, last long, since long, finished boolean"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        known = {k[0]: v for k, v in self.documents.iterator()}
        quiet, ended = not known, set()
        for batch in rows:
            batch = batch.sort_values("arrived", kind="stable").drop_duplicates(["doc_id", "page_no"], keep="last")
            of_document = batch.groupby("doc_id", dropna=False)
            whole = of_document["page_no"].transform("size") >= of_document["n_pages"].transform("max")
            whole &= batch["doc_id"].notna() & ~batch["doc_id"].isin(list(known))
            if whole.any():
                yield _out(batch[whole], True)
            # Plain rows: a frame for each document would cost more than its pages.
            parts: dict[str | None, list[tuple]] = {}
            for doc_id, *page in batch.loc[~whole, _COLUMNS].itertuples(index=False, name=None):
                parts.setdefault(_plain(doc_id), []).append(tuple(map(_plain, page)))
            for doc_id, part in parts.items():
                self._hold(doc_id, part, known, ended, now)
        yield from self._released(ended, True)
        if quiet and known:
            self.handle.registerTimer(now + max(1, self.hold_ms))

    def _hold(self, doc_id, part: list[tuple], known: dict, ended: set, now: int) -> None:
        """Add pages to a document; it goes to `ended` if it is complete with them."""
        total, here, last, since, finished = known.get(doc_id, (None, 0, 0, now, False))
        if finished and doc_id not in ended:
            part = [page for page in part if page[2] is not None and page[2] > last]
            if not part:
                return
            total, here, since, finished = None, 0, now, False
        # Only pages of earlier batches are looked up: this one has each page once.
        held = here > 0
        for page, n, arrived, text in part:
            place = (doc_id, page)
            before = self.pages.getValue(place) if held else None
            if before is None or (before[1] or 0) <= (arrived or 0):
                self.pages.updateValue(place, (n, arrived, text))
            here += before is None
            last = max(last, arrived or 0)
            total = n if total is None else max(total, n or 0)
        if doc_id is not None and total is not None and here >= total:
            ended.add(doc_id)
            since, finished = now, True
        known[doc_id] = (total, here, last, since, finished)
        self.documents.updateValue((doc_id,), known[doc_id])

    def _released(self, ended: set, complete: bool) -> Iterator[pd.DataFrame]:
        """All pages held of these documents, which then are held no more."""
        if not ended:
            return
        places, rows = [], []
        for place, body in self.pages.iterator():
            if place[0] in ended:
                places.append(place)
                rows.append((*place, *body))
                if len(rows) == SENT_PAGES:
                    yield _out(_frame(rows), complete)
                    rows = []
        if rows:
            yield _out(_frame(rows), complete)
        for place in places:
            self.pages.removeKey(place)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        known = {k[0]: v for k, v in self.documents.iterator()}
        over = {doc_id: v for doc_id, v in known.items() if v[3] + self.hold_ms <= now}
        yield from self._released({doc_id for doc_id, v in over.items() if not v[4]}, False)
        for doc_id in over:
            self.documents.removeKey((doc_id,))
        later = [v[3] for doc_id, v in known.items() if doc_id not in over]
        if later:
            self.handle.registerTimer(min(later) + self.hold_ms)

    def close(self) -> None:
        pass


def _plain(value):
    """A value of a pandas row as the state store takes it."""
    if value is None or pd.isna(value):
        return None
    return value if isinstance(value, str) else int(value)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_COLUMNS)
    return frame.astype({"page_no": "Int64", "n_pages": "Int64", "arrived": "Int64"})


def _out(rows: pd.DataFrame, complete: bool) -> pd.DataFrame:
    return rows[_COLUMNS].assign(complete=complete)
