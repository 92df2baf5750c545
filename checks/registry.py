"""One query per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checks import views as v
from sirenframe import functions as fn
from sirenframe import shared_dir
from sirenframe.operators import attachments, extraction, records, reports, responses, selection
from sirenframe.operators.upsert import upsert_incidents as upsert
from sirenframe.plans.extraction import extract_fields, extract_incidents
from sirenframe.plans.ingest import prepare_responses
from sirenframe.plans.poll import poll_round as run_round
from sirenframe.schemas import INCIDENT_TYPE_MAX_CHARS, LOCATION_MAX_CHARS, TIME_FIELDS
from sirenframe.session import written
from sirenframe.sources import documents, messages, state
from sirenframe.streaming import (
    PartitionedTable,
    compact_incidents,
    dedup_messages,
    incident_table,
    ingest_responses,
    ingested,
    saved_attachments,
)
from sirenframe.streaming import ingest_documents as contained_documents
from sirenframe.streaming import ingest_pages as stored_pages
from sirenframe.streaming import mail_rounds as rounds
from sirenframe.streaming.ingest import INCOMPLETE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _times_as_text(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f: fn.as_text(F.col(f)) for f in TIME_FIELDS if f in rows.columns})


# --- sources, sinks, state --------------------------------------------------


# Bytes of text of one file, and orders of one file: files grow in number, not in size.
TEXT_BYTES = 1 << 18
ORDERS_PER_FILE = 50_000


def _text_folder(spark: SparkSession, sf_dir: str) -> str:
    """All document texts as text files, by document number; each file in a folder of its own."""
    folder = shared_dir(spark, "texts")
    d = v.table(spark, sf_dir, "documents").select(
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = -(-size // TEXT_BYTES) or 1
    texts = d.select((F.col("doc_id") % files).alias("file"), "text")
    texts.repartition(files, "file").write.partitionBy("file").text(folder)
    return f"{folder}/file=*"


def _lines(files: DataFrame) -> DataFrame:
    """Every line of the files; each text ends with a line feed."""
    content = F.regexp_replace(F.decode("content", "UTF-8"), r"\n\z", "")
    return files.select(F.explode(F.split(content, "\n")).alias("line"))


@query
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _text_folder(spark, sf_dir)
    files = documents.scan_documents(spark, folder, "*.txt", with_content=True)
    return _lines(files).groupBy("line").agg(F.count("*").alias("n"))


@query
def stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, folder = _text_folder(spark, sf_dir), shared_dir(spark, "documents")
    stream = documents.stream_documents(spark, source, "*.txt")
    _run(_lines(stream), folder)
    return spark.read.parquet(f"{folder}/rows").groupBy("line").agg(F.count("*").alias("n"))


@query
def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, root = _text_folder(spark, sf_dir), shared_dir(spark, "documents")
    contained_documents(
        spark, source, root, f"{root}/checkpoint", "*.txt", max_bytes=TEXT_BYTES, availableNow=True
    ).awaitTermination()
    lines = _lines(spark.read.parquet(f"{root}/documents")).groupBy("line").agg(F.count("*").alias("n"))
    bad = spark.read.parquet(f"{root}/quarantine").agg(F.count("*").alias("n"))
    return lines.select(F.lit("read").alias("kind"), "line", "n").unionByName(
        bad.select(F.lit("too long").alias("kind"), F.lit(None).cast("string").alias("line"), "n")
    )


def _run(stream: DataFrame, folder: str) -> None:
    (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{folder}/rows")
        .awaitTermination()
    )


@query
def message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = messages.message_parts(v.raw_messages(spark, sf_dir))
    return parts.select(
        "mailbox",
        "seq",
        "message_id",
        F.col("part_no").cast("bigint").alias("part_no"),
        "content_type",
        "content_disposition",
        "filename",
        F.md5("payload").alias("payload_md5"),
        "error",
    )


@query
def message_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.message_headers(v.raw_messages(spark, sf_dir))


@query
def load_processed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "seen-set")
    ids = v.labelled_ids(spark, sf_dir)
    padded = ids.select(F.explode(F.array(F.concat(F.lit(" "), "message_id"), "message_id", F.lit(" "))))
    padded.write.text(path)
    return state.load_processed_ids(spark, path)


@query
def append_processed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "seen-set")
    state.append_processed_ids(spark, v.processed_ids(spark, sf_dir), path)
    reached = _reached(spark, sf_dir, state.load_processed_ids(spark, path))
    state.append_processed_ids(spark, selection.handled_ids(reached), path)
    return state.load_processed_ids(spark, path)


@query
def seen_set_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labelled IDs in rounds that overlap, a generation every few rounds."""
    path = shared_dir(spark, "seen-set")
    ids = v.labelled_ids(spark, sf_dir).withColumn("place", F.pmod(F.hash("message_id"), F.lit(6)))
    for i in range(6):
        state.append_processed_ids(spark, ids.filter(F.col("place").between(i - 1, i)), path, max_files=2)
    return state.load_processed_ids(spark, path)


def _incident_text(table: DataFrame) -> DataFrame:
    return table.withColumns({c: fn.as_text(F.col(c)) for c in ("created_date", "incident_date")})


@query
def upsert_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.incident_rows(spark, sf_dir)
    table = PartitionedTable(spark, shared_dir(spark, "incidents"), rows.schema, parts=16)
    table.merge(rows.filter(~F.col("second_batch")), ["place"], 0)
    table.merge(rows.filter("second_batch"), ["place"], 1)
    return _incident_text(table.read())


@query
def upsert_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.incident_rows(spark, sf_dir)
    first, second = rows.filter(~F.col("second_batch")), rows.filter("second_batch")
    none = rows.drop("place", "second_batch").limit(0)
    table = upsert(upsert(none, first, ["place"]), second, ["place"])
    return _incident_text(table)


@query
def quarantine_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = responses.route_errors(responses.parse_response(v.responses(spark, sf_dir)))
    named = bad.withColumn("original_file", F.concat(F.lit("d.o"), "doc_id", F.lit(".pdf")))
    at = F.lit("2025-01-02 03:04:05").cast("timestamp_ntz")
    entries = documents.quarantine_errors(named, at)
    return entries.withColumn("error_at", fn.as_text(F.col("error_at")))


# --- message selection ------------------------------------------------------


def _thin(rows: DataFrame) -> DataFrame:
    return rows.select("mailbox", "seq", "message_id")


@query
def filter_sender_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thin(selection.filter_sender_seen(v.messages(spark, sf_dir), v.SENDER))


@query
def newest_n_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.newest_n_messages(_thin(v.messages(spark, sf_dir)))


@query
def subject_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thin(selection.subject_match(v.messages(spark, sf_dir), v.SUBJECT))


@query
def anti_join_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.anti_join_processed(
        _thin(v.messages(spark, sf_dir)), v.processed_ids(spark, sf_dir)
    )


@query
def anti_join_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.anti_join_processed(
        _thin(v.messages(spark, sf_dir)), v.processed_ids(spark, sf_dir), filter_bytes=8 << 20
    )


def _reached(
    spark: SparkSession, sf_dir: str, seen: DataFrame, policy: str = "reference"
) -> DataFrame:
    wanted = selection.filter_sender_seen(v.messages(spark, sf_dir), v.SENDER)
    return selection.take_until_stop(wanted, seen, v.SUBJECT, policy=policy)


@query
def take_until_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = _reached(spark, sf_dir, v.processed_ids(spark, sf_dir))
    return reached.select("mailbox", "seq", "message_id", "processed")


@query
def take_until_stop_seen_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = _reached(spark, sf_dir, v.processed_ids(spark, sf_dir), "seen_only")
    return reached.select("mailbox", "seq", "message_id", "processed")


@query
def poll_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    mailboxes = v.messages(spark, sf_dir).select("mailbox").distinct()
    reached = _reached(spark, sf_dir, v.processed_ids(spark, sf_dir))
    return selection.poll_stats(reached, mailboxes)


@query
def poll_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = v.table(spark, sf_dir, "region").select(F.lit("fax.pdf").alias("filename"))
    result = run_round(
        v.raw_messages(spark, sf_dir),
        v.processed_ids(spark, sf_dir),
        held,
        v.SENDER,
        v.SUBJECT,
        v.BATCH_TIME,
    )
    return result.attachments.select(
        "mailbox", "seq", "filename", F.md5("payload").alias("payload_md5")
    )


@query
def mail_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds, a half of the mailboxes each, over a growing export."""
    folder, raw = shared_dir(spark, "mail"), v.raw_messages(spark, sf_dir)
    export, root = f"{folder}/export", f"{folder}/root"
    half = F.conv(F.substring(F.md5("mailbox"), 1, 1), 16, 10).cast("int") % 2
    for i in range(2):
        raw.filter(half == i).write.mode("append").parquet(export)
        stream = spark.readStream.schema(raw.schema).parquet(export)
        rounds(
            stream, root, f"{folder}/checkpoint", v.SENDER, v.SUBJECT, v.processed_ids(spark, sf_dir),
            at=v.BATCH_TIME, availableNow=True,
        ).awaitTermination()
    saved = saved_attachments(spark, root)
    return saved.select(
        F.substring_index("path", "/", -1).alias("filename"), F.md5("content").alias("payload_md5"), "length", "round_no"
    )


@query
def stream_dedup_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = v.table(spark, sf_dir, "events")
    folder = shared_dir(spark, "dedup")
    message_id = F.concat_ws("-", "user_id", "event_type").alias("message_id")
    state.append_processed_ids(spark, source.filter(v.every("user_id", 5)).select(message_id), f"{folder}/state")
    stream = spark.readStream.schema(source.schema).parquet(v.stream_path(sf_dir, "events"))
    seen = state.load_processed_ids(spark, f"{folder}/state")
    _run(dedup_messages(stream.select(message_id), seen=seen), folder)
    return spark.read.parquet(f"{folder}/rows")


@query
def stream_dedup_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = v.table(spark, sf_dir, "events")
    folder = shared_dir(spark, "dedup")
    stream = spark.readStream.schema(source.schema).parquet(v.stream_path(sf_dir, "events"))
    ids = stream.select(F.concat_ws("-", "user_id", "event_type").alias("message_id"))
    _run(dedup_messages(ids), folder)
    return spark.read.parquet(f"{folder}/rows")


_PART = ("mailbox", "seq", "filename")


@query
def select_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = attachments.select_attachments(v.parts(spark, sf_dir))
    return kept.select(*_PART, "content_type", "content_disposition")


def _named(parts: DataFrame) -> DataFrame:
    kept = attachments.select_attachments(parts)
    return attachments.attachment_filenames(kept, v.BATCH_TIME)


@query
def attachment_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(v.parts(spark, sf_dir)).select(*_PART)


@query
def drop_empty_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = attachments.drop_empty_payloads(v.parts(spark, sf_dir))
    return kept.select("mailbox", "seq", F.length("payload").cast("bigint").alias("n_bytes"))


@query
def dedupe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _named(v.parts(spark, sf_dir))
    old = (F.col("mailbox") == "m0") & v.every("seq", 2)
    return attachments.dedupe_filenames(rows.filter(~old), rows.filter(old), v.BATCH_TIME).select(
        *_PART
    )


@query
def daypart(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = v.table(spark, sf_dir, "events")
    return selection.count_by_daypart(events, fn.daypart(F.col("ts")))


# --- extraction -------------------------------------------------------------


@query
def assemble_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    assembled = extraction.assemble_pages(v.conversation_pages(spark, sf_dir))
    return assembled.select("doc_id", "part_no", "n_pages", "text")


@query
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.page_text(v.conversation_pages(spark, sf_dir), 1)


@query
def extract_header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_header_fields(v.dispatch_pages(spark, sf_dir))


@query
def activity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extraction.activity_rows(v.dispatch_pages(spark, sf_dir))
    return rows.withColumn("ts", fn.as_text(F.col("ts")))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.activity(spark, sf_dir)
    return extraction.match_dispatched_unit(
        rows.drop("unit_dispatched"), v.activity_headers(rows)
    )


@query
def match_dispatched_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).withColumn("ts", fn.as_text(F.col("ts")))


@query
def map_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = extraction.map_status(v.activity(spark, sf_dir))
    return mapped.select("doc_id", "pos", "status", "field")


@query
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    backwards = _matched(spark, sf_dir).withColumn("pos", -F.col("pos"))
    first = extraction.first_occurrence(extraction.map_status(backwards))
    return first.withColumn("ts", fn.as_text(F.col("ts")))


def _pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.pivot_times(extraction.map_status(_matched(spark, sf_dir)))


@query
def pivot_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times_as_text(_pivoted(spark, sf_dir))


@query
def derived_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times_as_text(fn.with_derived_times(_pivoted(spark, sf_dir)))


@query
def split_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = v.table(spark, sf_dir, "events")
    return events.select("event_id", fn.split_datetime(F.col("ts")).alias("t")).select(
        "event_id", "t.date", "t.time"
    )


@query
def location_territory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.locations(spark, sf_dir)
    return rows.select("k", fn.location_territory(F.col("raw")).alias("territory"))


@query
def location_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.locations(spark, sf_dir)
    return rows.select("k", fn.location_segments(F.col("raw")).alias("s")).select("k", "s.*")


@query
def parsing_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = extract_fields(v.dispatch_pages(spark, sf_dir))
    return fields.select("doc_id", F.inline("parsing_errors"))


@query
def unparseable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    incidents = extract_incidents(v.labelled_documents(spark, sf_dir))
    return incidents.filter(F.col("error").isNotNull()).select("doc_id", "content")


@query
def build_incident_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_incidents(v.dispatch_pages(spark, sf_dir)).select("doc_id", "content")


# --- responses --------------------------------------------------------------


@query
def strip_code_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.responses(spark, sf_dir)
    return rows.select("doc_id", fn.strip_code_fences(F.col("response_text")).alias("text"))


@query
def parse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = responses.parse_response(v.responses(spark, sf_dir))
    return parsed.select(
        "doc_id",
        F.get_json_object("content", "$.k").cast("bigint").alias("k"),
        "error",
        "raw_response",
    )


@query
def route_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = responses.route_errors(responses.parse_response(v.responses(spark, sf_dir)))
    return good.select("doc_id", F.lit("good").alias("route")).unionByName(
        bad.select("doc_id", F.lit("bad").alias("route"))
    )


@query
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = responses.parse_response(v.responses(spark, sf_dir))
    attached = parsed.filter("error IS NULL").select(
        "doc_id",
        responses.attach_token_usage(F.col("content"), F.col("token_usage")).alias("content"),
    )
    stored = attached.withColumn("stored", responses.drop_token_usage(F.col("content")))
    return stored.select(
        "doc_id",
        "content",
        F.get_json_object("stored", "$.k").alias("stored_k"),
        F.contains("stored", F.lit("_token_usage")).alias("stored_usage"),
    )


# --- records ----------------------------------------------------------------


@query
def resolve_unit_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.record_fields(spark, sf_dir)
    given = F.when(v.every("k", 3), F.lit("")).when(v.every("k", 4), F.lit("GIVEN"))
    return rows.select(
        "k",
        records.resolve_unit_id(F.col("unit")).alias("dispatched"),
        records.resolve_unit_id(F.col("unit"), given).alias("resolved"),
    )


@query
def cast_cad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.record_fields(spark, sf_dir)
    return rows.select("k", records.cast_cad(F.col("cad")).alias("incident_number"))


@query
def parse_incident_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.record_fields(spark, sf_dir)
    parsed = records.incident_date(F.col("date"), F.col("time"))
    return rows.select("k", fn.as_text(parsed).alias("incident_date"))


@query
def bound_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.record_fields(spark, sf_dir).select(
        "k",
        fn.bound_text(F.col("raw"), LOCATION_MAX_CHARS).alias("location"),
        fn.bound_text(F.col("type"), INCIDENT_TYPE_MAX_CHARS).alias("incident_type"),
    )


@query
def serialize_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = responses.route_errors(responses.parse_response(v.responses(spark, sf_dir)))
    return good.select("doc_id", "content")


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = responses.parse_response(v.record_responses(spark, sf_dir)).drop("error")
    return records.validate_record(parsed)


@query
def validate_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select("k", "error")


@query
def outcome_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.outcome_rows(_validated(spark, sf_dir), records.SAVE_FAILED)


@query
def enforce_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, rejected = records.enforce_constraints(v.incident_rows(spark, sf_dir))
    return taken.select("place", F.lit(None).cast("string").alias("violated")).unionByName(
        rejected.select("place", "violated")
    )


@query
def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.key_violations(v.incident_rows(spark, sf_dir))


# --- reports, whole chain ---------------------------------------------------


@query
def incident_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = fn.with_derived_times(_pivoted(spark, sf_dir))
    nothing = v.null_text()
    record = extraction.incident_record(
        nothing, nothing, nothing, {f: F.col(f) for f in TIME_FIELDS}, nothing, nothing
    )
    stored = times.select("doc_id", extraction.build_incident_json(record).alias("content"))
    timeline = reports.incident_timeline(stored, ["doc_id"])
    return timeline.withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query
def incident_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.locations(spark, sf_dir)
    location = F.when(~v.every("k", 11), fn.parse_location(F.col("raw")))
    cad = F.when(~v.every("k", 6), F.col("k").cast("string"))
    nothing = v.null_text()
    record = extraction.incident_record(cad, nothing, nothing, {}, location, nothing)
    stored = rows.select("k", extraction.build_incident_json(record).alias("content"))
    return reports.incident_summary(stored, ["k"])


@query
def ingest_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "ingest")
    log, snapshots, inbox = f"{folder}/log", f"{folder}/snapshots", f"{folder}/inbox"
    source = v.table(spark, sf_dir, "orders")

    def deliver(checkpoint: str) -> None:
        """Everything in the inbox that the checkpoint does not know, a quarter of the files per micro-batch."""
        stream = (
            spark.readStream.schema(source.schema).option("maxFilesPerTrigger", -(-n // 4)).parquet(inbox)
        )
        texts = v.as_responses(v.as_record_fields(stream), "customer")
        created = F.lit("2025-01-02 03:04:05").cast("timestamp")
        ingest_responses(texts, log, checkpoint, created, availableNow=True).awaitTermination()

    # All orders of a customer are in one file, so the last one is the same in any file order.
    n = max(4, -(-source.count() // ORDERS_PER_FILE))
    files = source.repartition(n, "o_custkey")
    late = F.pmod(F.hash("o_custkey"), F.lit(4)) == 3
    files.filter(~late).write.parquet(inbox)
    deliver(f"{folder}/checkpoint")
    # A lost checkpoint: all batches so far come once more.
    deliver(f"{folder}/checkpoint-again")
    compact_incidents(spark, log, snapshots)
    files.filter(late).write.mode("append").parquet(inbox)
    deliver(f"{folder}/checkpoint")
    table = incident_table(spark, log, snapshots)
    return table.select(
        "incident_number",
        "unit_id",
        fn.as_text(F.col("created_date")).alias("created_date"),
        fn.as_text(F.col("incident_date")).alias("incident_date"),
        "location",
        "incident_type",
    )


@query
def ingest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which pages come later, never, or once more, in three deliveries."""
    folder = shared_dir(spark, "ingest")
    log, inbox = f"{folder}/log", f"{folder}/inbox"
    pages = v.dispatch_pages(spark, sf_dir)
    n_pages = F.count("*").over(W.partitionBy("doc_id"))
    pages = written(
        pages.select(
            F.col("doc_id").cast("string").alias("doc_id"),
            F.lit("2025-01-02 03:04:05").cast("timestamp").alias("arrived_at"),
            F.col("page_no").cast("long").alias("page_no"),
            n_pages.cast("long").alias("n_pages"),
            "text",
        ),
        "pages",
    )
    number, odd = F.col("doc_id").cast("long"), F.col("page_no") % 2 == 1
    split, lost = number % 3 == 0, number % 21 == 0
    for delivery in (~split | ~odd, split & odd & ~lost, number % 5 == 0):
        pages.filter(delivery).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(pages.schema).parquet(inbox)
        stored_pages(stream, log, f"{folder}/checkpoint", hold_seconds=0, availableNow=True).awaitTermination()
    kind = F.when(F.col("success"), F.lit("stored")).otherwise(
        F.when(F.startswith("error", F.lit(INCOMPLETE)), F.lit("incomplete")).otherwise(F.lit("rejected"))
    )
    return ingested(spark, log).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        kind.alias("kind"),
        F.when(F.col("success"), F.col("content")).alias("content"),
    ).distinct()


@query
def prepared_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without a record, and whole records, good ones too."""
    created = F.lit("2025-01-02 03:04:05").cast("timestamp")
    answers = v.responses(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "response_text")
    whole = v.record_responses(spark, sf_dir).select("doc_id", "response_text")
    rows = prepare_responses(answers.unionByName(whole), created, ["doc_id"])
    return rows.groupBy("success", "error", "incident_type").agg(F.count("*").alias("n"), F.sum("incident_number").cast("long").alias("numbers"))
