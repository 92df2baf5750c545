"""Inputs of the registered queries, derived from the given tables.

Every view covers all rows and whole texts of its table. The moduli only decide
what a row looks like (a missing field, a wrong date), never whether it is in.
Each view has its SQL twin in `checks.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenframe import configure

BATCH_TIME = "20250102_030405"
SENDER = "EN.Desk@"
SUBJECT = "THE "
UNDECODABLE = "=?no-such-charset?q?x?="


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stream_path(sf_dir: str, name: str) -> str:
    """Path of a table for a file stream, be it one file or a folder of files."""
    return f"{sf_dir.rstrip('/')}/{{{name}.parquet}}"


def every(key: str, n: int) -> Column:
    return F.col(key) % n == 0


def null_text() -> Column:
    return F.lit(None).cast("string")


# --- unit activity ----------------------------------------------------------

_STATUS = {
    "view": "RESP",
    "click": "ONLOC",
    "signup": "TO HOSP",
    "purchase": "AT HOSP",
    "error": "CLEAR",
}


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per user and day of month; three units; some unmapped statuses."""
    status = F.lit(None).cast("string")
    for event_type, code in _STATUS.items():
        status = F.when(F.col("event_type") == event_type, F.lit(code)).otherwise(status)
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("doc_id"),
        F.col("event_id").alias("pos"),
        F.concat(F.lit("U"), F.col("event_id") % 3).alias("unit_id"),
        F.concat(F.lit("U"), F.col("user_id") % 3).alias("unit_dispatched"),
        F.when(every("event_id", 7), F.lit("STAGED")).otherwise(status).alias("status"),
        F.date_trunc("second", F.col("ts")).cast("timestamp_ntz").alias("ts"),
    )


def activity_headers(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.max("unit_dispatched").alias("unit_dispatched"))


# Activity lines per page of a dispatch text.
LINES = 1000


def dispatch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity written out as page text under a header with some defects."""
    rows = activity(spark, sf_dir)
    line = F.concat_ws(
        " ",
        "unit_id",
        F.date_format("ts", "MM/dd/yyyy HH:mm:ss"),
        "status",
        F.concat(F.lit("D"), F.col("pos") % 5),
    )
    lines = (
        rows.withColumn("line", line)
        .groupBy("doc_id", "unit_dispatched", F.floor(F.col("pos") / LINES).alias("page_no"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    )
    user = F.floor(F.col("doc_id") / 100)
    day = F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0")

    def labelled(label: str, value: Column, gap: int) -> Column:
        return F.when(user % gap != 0, F.concat(F.lit(label), value))

    clock = F.when(user % 17 == 0, F.lit("02/30/2024 06:07:08")).otherwise(
        F.concat(F.lit("01/"), day, F.lit("/2024 06:07:08"))
    )
    place = F.when(user % 23 == 0, F.lit("EASTON TWP")).otherwise(
        F.concat(F.lit("EASTON TWP PLAZA / "), user, F.lit(" MAIN ST #"), F.col("doc_id") % 100)
    )
    header = F.concat_ws(
        "\n",
        F.lit("COUNTY DISPATCH"),
        labelled("CAD: ", F.col("doc_id").cast("string"), 11),
        F.concat(F.lit("Unit Dispatched: "), F.col("unit_dispatched")),
        labelled("Incident Type: ", F.lit("MEDICAL"), 13),
        F.concat(F.lit("Dispatch Time\n"), clock),
        labelled("Location: ", place, 19),
        F.when(
            user % 5 == 0,
            F.concat(F.lit("Arrived At Patient: 01/"), day, F.lit("/2024 07:08:09")),
        ),
        F.lit("Unit ID Date / Time Status Dispatcher"),
    )
    text = F.concat(header, F.lit("\n"), F.array_join(F.col("lines.line"), "\n"))
    return lines.select("doc_id", "page_no", text.alias("text"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts as one-page documents, one in three under a number label.

    One page in eleven could not be read: its text is null.
    """
    label = F.when(every("doc_id", 3), F.concat(F.lit("CAD: "), F.col("doc_id"), F.lit("\n")))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.lit(0).alias("page_no"),
        F.when(
            ~every("doc_id", 11), F.concat(F.coalesce(label, F.lit("")), F.col("text"))
        ).alias("text"),
    )


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"
    )


# --- records ----------------------------------------------------------------


def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_record_fields(table(spark, sf_dir, "orders"))


def as_record_fields(orders: DataFrame) -> DataFrame:
    """Fields of an incident record per order, some missing, some wrong."""
    k = "o_orderkey"
    key_text = F.col(k).cast("string")
    return orders.select(
        F.col(k).alias("k"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderdate").alias("ordered"),
        F.when(every(k, 11), null_text())
        .when(every(k, 13), F.concat(F.lit("X"), key_text))
        .when(every(k, 5), F.concat(F.lit(" "), key_text, F.lit("\u3000")))
        .otherwise(key_text)
        .alias("cad"),
        F.when(every(k, 7), null_text())
        .when(every(k, 31), F.lit(""))
        .otherwise(F.concat(F.lit("U"), F.col(k) % 4))
        .alias("unit"),
        F.when(every(k, 17), F.lit("02/30/1998"))
        .when(every(k, 19), F.lit(""))
        .otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
        .alias("date"),
        F.lit("1:2:3").alias("time"),
        F.when(every(k, 29), F.repeat(key_text, 60))
        .otherwise(F.concat(F.lit("EASTON TWP "), key_text, F.lit(" MAIN ST")))
        .alias("raw"),
        F.repeat(F.col("o_orderpriority"), 3).alias("type"),
    )


def _pair(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))


def record_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_responses(record_fields(spark, sf_dir), "cad")


def as_responses(f: DataFrame, cad: str) -> DataFrame:
    """Record fields as the text of a model response; `cad` names the number column."""
    number = F.col(cad).cast("string")
    notified = F.concat(
        F.lit('"times":{"notifiedByDispatch":{'),
        F.concat_ws(",", _pair("date", F.col("date")), _pair("time", F.col("time"))),
        F.lit("}}"),
    )
    times = F.when(every("k", 23), F.lit('"times":null')).otherwise(notified)
    header = F.concat_ws(
        ",",
        _pair("cad", number),
        _pair("unit_dispatched", F.col("unit")),
        _pair("incident_type", F.col("type")),
        times,
    )
    body = F.concat(
        F.lit('{"incidentTimes":{'),
        header,
        F.lit('},"incidentLocation":{'),
        _pair("raw", F.col("raw")),
        F.lit("}}"),
    )
    text = F.when(every("k", 2), F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return f.select(
        F.col("k").cast("string").alias("doc_id"),
        F.col("ordered").cast("timestamp").alias("arrived_at"),
        text.alias("response_text"),
        "k",
    )


# --- upsert -----------------------------------------------------------------


def incident_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident rows with repeated keys: two batches, some nulls in the payload."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("incident_number"),
        F.col("event_type").alias("unit_id"),
        F.col("ts").alias("created_date"),
        F.when(~every("event_id", 10), F.col("props")).alias("content"),
        F.col("ts").alias("incident_date"),
        F.when(~every("event_id", 9), F.concat(F.lit("L"), F.col("event_id"))).alias("location"),
        F.col("event_type").alias("incident_type"),
        F.col("event_id").alias("place"),
        (F.dayofmonth("ts") > 15).alias("second_batch"),
    )


# --- locations --------------------------------------------------------------


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    raw = F.concat(
        F.col("n_name"),
        F.when(k % 3 == 0, F.lit(" TWP")).when(k % 3 == 1, F.lit(" BORO")).otherwise(F.lit("")),
        F.when(k % 4 == 0, F.lit(" SITE & CO / ")).otherwise(F.lit(" ")),
        k.cast("string"),
        F.lit(" MAIN ST"),
        F.when(k % 7 == 0, F.lit(" & OAK AVE")).otherwise(F.lit("")),
        F.when(k % 5 == 0, F.concat(F.lit(" #"), k % 50)).otherwise(F.lit("")),
    )
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        k.alias("k"), raw.alias("raw")
    )


# --- responses --------------------------------------------------------------


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as model responses: bare, fenced, cut, `error` key, list."""
    e = "event_id"
    body = (
        F.when(every(e, 14), F.lit('{"error":null}'))
        .when(every(e, 22), F.lit("[1]"))
        .when(every(e, 10), F.left("props", F.length("props") - 1))
        .when(every(e, 26), F.concat(F.col("props"), F.lit(" as asked")))
        .otherwise(F.col("props"))
    )
    text = (
        F.when(F.col(e) % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col(e) % 3 == 2, F.concat(F.lit(" ```\n"), body, F.lit("\n``` ")))
        .otherwise(body)
    )
    tokens = F.struct(
        F.col(e).alias("prompt_tokens"),
        (F.col(e) % 100).alias("completion_tokens"),
        (F.col(e) + F.col(e) % 100).alias("total_tokens"),
    )
    return table(spark, sf_dir, "events").select(
        F.col(e).alias("doc_id"), text.alias("response_text"), tokens.alias("token_usage")
    )


# --- messages ---------------------------------------------------------------


def _message_id(doc_id: Column) -> Column:
    return F.concat(F.lit("<"), doc_id, F.lit(">"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mailbox per source; whole texts as subjects; blank and repeated IDs."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("mailbox"),
        d.alias("seq"),
        F.when(d % 17 == 0, F.lit(""))
        .when(d % 23 == 0, _message_id(d - 20))
        .otherwise(_message_id(d))
        .alias("message_id"),
        F.col("text").alias("subject"),
        F.concat(F.col("lang"), F.lit(".desk@example.org")).alias("sender"),
        (F.col("n_chars") % 5 != 0).alias("seen"),
    )


def labelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ID for every label."""
    labels = table(spark, sf_dir, "labels")
    return labels.select(_message_id(F.col("doc_id")).alias("message_id"))


def processed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which messages were handled before: one labelled document in seven."""
    return (
        table(spark, sf_dir, "labels")
        .filter(every("doc_id", 7))
        .select(_message_id(F.col("doc_id")).alias("message_id"))
    )


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages as RFC 822 bytes: the text as a plain part and as an attachment."""
    m = messages(spark, sf_dir)

    def encoded_word(text: Column) -> Column:
        return F.concat(F.lit("=?utf-8?B?"), F.base64(text.cast("binary")), F.lit("?="))

    subject = F.concat(F.lit("report the "), F.col("seq"))
    from_ = F.when(
        every("seq", 37), F.concat(F.lit(UNDECODABLE + " <"), F.col("sender"), F.lit(">"))
    ).otherwise(F.col("sender"))
    head = F.concat_ws(
        "\r\n",
        F.concat(F.lit("Message-ID:  "), F.col("message_id"), F.lit(" ")),
        F.concat(F.lit("Subject: "), encoded_word(subject)),
        F.concat(F.lit("From: "), from_),
        F.lit("MIME-Version: 1.0"),
        F.lit('Content-Type: multipart/mixed; boundary="=_part_=_"'),
        F.lit("\r\n--=_part_=_"),
        F.lit("Content-Type: text/plain; charset=utf-8"),
        F.lit("Content-Transfer-Encoding: 8bit\r\n\r\n"),
    )

    def attachment(name: str) -> Column:
        lines = F.concat_ws(
            "\r\n",
            F.lit("\r\n--=_part_=_"),
            F.lit("Content-Type: application/octet-stream"),
            F.lit(f'Content-Disposition: ATTACHMENT; filename="{name}"'),
            F.lit("Content-Transfer-Encoding: base64\r\n\r\n"),
        )
        return F.concat(lines, F.base64(F.col("subject").cast("binary")))

    # A second attachment whose name cannot be decoded.
    bad_name = F.when(every("seq", 29), attachment(UNDECODABLE)).otherwise(F.lit(""))
    content = F.concat(
        head, F.col("subject"), attachment("fax"), bad_name, F.lit("\r\n--=_part_=_--\r\n")
    )
    return m.select("mailbox", "seq", "seen", content.cast("binary").alias("content"))


# --- parts ------------------------------------------------------------------


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as message parts: the last URL segment as name, six content types."""
    p = F.col("page_id")
    content_type = (
        F.when(p % 6 == 0, F.lit("application/pdf"))
        .when(p % 6 == 1, F.lit("application/octet-stream"))
        .when(p % 6 == 2, F.lit("text/plain"))
        .when(p % 6 == 3, F.lit("image/png"))
        .when(p % 6 == 4, F.lit("application/octet-stream"))
        .otherwise(F.lit("application/x-page"))
    )
    disposition = (
        F.when(p % 4 == 0, F.lit('ATTACHMENT; filename="x"'))
        .when(p % 4 == 1, F.lit("inline"))
        .when(p % 4 == 2, null_text())
        .otherwise(F.lit("form-data"))
    )
    name = F.substring_index("url", "/", -1)
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("m"), p % 3).alias("mailbox"),
        p.alias("seq"),
        F.lit(0).alias("part_no"),
        content_type.alias("content_type"),
        disposition.alias("content_disposition"),
        F.when(p % 9 == 0, null_text())
        .when(p % 5 == 0, F.concat(name, F.lit(".PDF")))
        .otherwise(name)
        .alias("filename"),
        F.when(p % 12 == 0, F.lit("")).otherwise(F.col("html")).cast("binary").alias("payload"),
    )
