import json

from pyspark.sql import functions as F

from conftest import rows
from sirenframe import functions as fn
from sirenframe.operators import extraction as x
from sirenframe.operators import reports
from sirenframe.plans.extraction import extract_fields, extract_incidents

SHEET = """COUNTY DISPATCH
CAD: 123456
Unit Dispatched: U1
Incident Type: EMS
Dispatch Time
11/20/2025 23:49:01
Location: HARBOR TWP FERRY HOUSE / QUAY 3 #1-A
Unit ID Date / Time Status Dispatcher
U2 11/20/2025 23:50:00 RESP D1
U1 11/20/2025 23:55:00 RESP D1
U1 11/20/2025 23:59:15 ONLOC"""
BACK = """U1 11/20/2025 23:58:00 ONLOC
U1 11/21/2025 00:10:00 STAGED D2
U1 11/21/2025 00:40:00 CLEAR D2"""
PAGES = "doc_id string, page_no int, text string"


def incident(spark, *pages, **rules):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(pages)], PAGES)
    row = extract_incidents(df, **rules).first()
    return json.loads(row.content)


def clocks(record):
    return {f: f'{t["date"]} {t["time"]}' for f, t in record["incidentTimes"]["times"].items()}


def test_sheet_over_two_pages(spark):
    record = incident(spark, SHEET, BACK)
    assert clocks(record) == {
        "notifiedByDispatch": "11/20/2025 23:49:01",
        "enRoute": "11/20/2025 23:55:00",
        "onScene": "11/20/2025 23:59:15",
        "arrivedAtPatient": "11/21/2025 00:01:15",
        "backInService": "11/21/2025 00:40:00",
    }
    assert record["incidentTimes"]["cad"] == "123456"
    assert record["incidentLocation"] == {
        "raw": "HARBOR TWP FERRY HOUSE / QUAY 3 #1-A",
        "territory": "HARBOR TWP",
        "location_name": "FERRY HOUSE",
        "street_address": "QUAY 3",
        "apartment": "1-A",
    }
    assert "parsingErrors" not in record


def test_older_rule_takes_all_units(spark):
    assert clocks(incident(spark, SHEET, BACK, match_unit=False))["enRoute"] == "11/20/2025 23:50:00"


def test_stated_times_win_over_derived_ones(spark):
    stated = SHEET + "\nArrived At Patient: 11/20/2025 23:59:59\nU1 11/21/2025 00:30:00 AT HOSP"
    got = clocks(incident(spark, stated))
    assert got["arrivedAtPatient"] == "11/20/2025 23:59:59"
    assert got["destinationPatientTransferOfCare"] == "11/21/2025 00:35:00"


def test_labels_are_parameters(spark):
    text = "Run no: 7\nUnit Dispatched: U1"
    got = incident(spark, text, labels={**x.HEADER_LABELS, "cad": ("Run no",)})
    assert got["incidentTimes"]["cad"] == "7"


def test_defects_are_reported_and_the_rest_is_kept(spark):
    text = "CAD: 5\nUnit Dispatched: U1\nLocation:\nDispatch Time: 02/30/2025 1:1:1\nU1 13/45/2025 10:00:00 RESP\nU1 1/1/2025 10:00:00 RESP"
    record = incident(spark, text)
    assert "times" not in record["incidentTimes"]
    assert {(e["field"], e["error"]) for e in record["parsingErrors"]} == {
        ("incident_type", x.NOT_FOUND),
        ("incidentLocation.raw", x.NOT_FOUND),
        ("notifiedByDispatch", x.NOT_A_DATETIME),
        ("enRoute", x.NOT_A_DATETIME),
    }


def test_raw_location_is_kept_when_it_has_no_address(spark):
    record = incident(spark, SHEET.replace(" FERRY HOUSE / QUAY 3 #1-A", ""))
    assert record["incidentLocation"] == {"raw": "HARBOR TWP", "territory": "HARBOR TWP"}
    assert record["parsingErrors"] == [{"field": "incidentLocation", "error": x.NO_ADDRESS}]


def test_illegible_document_gives_only_an_error(spark):
    assert incident(spark, "nothing to see", "") == {"error": x.UNPARSEABLE}


def test_activity_rows(spark):
    text = "U1  1/2/2025   3:04:05  TO   HOSP D 1\r\nno row\nU2 1/2/2025 3:04:06 TO\nU3 2/30/2025 1:1:1 CLEAR\nU4 1/2/2025 3:04 RESP"
    got = x.activity_rows(spark.createDataFrame([("d", 2, text)], PAGES))
    base = 2 * x.LINES_PER_PAGE
    assert rows(got.select("pos", "unit_id", fn.as_text(F.col("ts")), "status"), "pos") == [
        (base, "U1", "2025-01-02 03:04:05", "TO HOSP"),
        (base + 1, "U2", "2025-01-02 03:04:06", "TO"),
        (base + 2, "U3", None, "CLEAR"),
    ]


def test_first_occurrence_is_by_line_not_by_time(spark):
    data = [("d", 1, "onScene", "2025-01-01 10:00:00"), ("d", 0, "onScene", "2025-01-01 11:00:00")]
    df = spark.createDataFrame(data, "doc_id string, pos long, field string, t string")
    df = df.withColumn("ts", F.col("t").cast("timestamp_ntz"))
    assert x.first_occurrence(df).select(F.hour("ts")).first()[0] == 11
    assert x.pivot_times(df).select(F.hour("onScene")).first()[0] == 11


def test_fused_plan_equals_the_single_operators(spark):
    """Many documents with several units over several pages, one of them very long."""
    lines = spark.range(0, 6000, 1, 5).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), F.col("id") % 40)).alias("doc_id"),
        F.floor(F.col("id") / 500).alias("page_no"),
        "id",
        F.concat(
            F.lit("U"), F.col("id") % 7, F.lit(" 1/"), F.col("id") % 28 + 1, F.lit("/2025 10:"),
            F.col("id") % 60, F.lit(":00 "),
            F.element_at(F.array(*[F.lit(s) for s in [*x.STATUS_FIELDS, "STAGED"]]), (F.hash("id") % 3 + 3).cast("int")),
        ).alias("line"))
    pages = lines.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("l")).select(
        "doc_id", "page_no", F.concat(F.lit("Unit Dispatched: U2\n"), F.array_join("l.line", "\n")).alias("text"))
    headers = x.extract_header_fields(pages)
    matched = x.match_dispatched_unit(x.activity_rows(pages), headers)
    single = fn.with_derived_times(x.pivot_times(x.map_status(matched)))
    fused = extract_fields(pages)
    columns = ["doc_id", *x.TIME_FIELDS]
    have = [c for c in columns if c != "notifiedByDispatch"]
    assert rows(fused.select(*have).filter("coalesce(enRoute, onScene, leftScene, backInService, ptArrivedAtDestination) is not null")) == rows(single.select(*have))


def test_fused_plan_reads_pages_once_and_shuffles_twice(spark):
    df = spark.createDataFrame([("d", 0, SHEET)], PAGES)
    plan = extract_incidents(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ExistingRDD") == 1 and plan.count("Exchange hashpartitioning") == 2
    assert "Join" not in plan and "Window" not in plan


def test_assemble_pages_splits_long_documents(spark):
    df = spark.createDataFrame([("d", i, f"p{i}") for i in range(25)], PAGES)
    got = rows(x.assemble_pages(df, pages_per_part=10).select("part_no", "n_pages", "text"))
    assert [(a, b) for a, b, _ in got] == [(0, 25), (1, 25), (2, 25)]
    assert "\n".join(t for _, _, t in got) == "\n".join(f"p{i}" for i in range(25))
    assert rows(x.page_text(df, 3).select("text")) == [("p3",)]
    long = spark.createDataFrame([("e", i, "p") for i in range(1001)] + [("f", 0, None)], PAGES)
    assert rows(x.assemble_pages(long).select("doc_id", "part_no", "n_pages")) == [
        ("e", 0, 1001), ("e", 1, 1001), ("f", 0, 1)]


def test_page_texts_move_once_when_pages_are_put_together(spark):
    plan = x.assemble_pages(spark.createDataFrame([("d", 0, "p")], PAGES))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # Texts by part; counts by part, by document, and by part again.
    assert len(moved) == 4 and plan.count("collect_list") == 2


def test_documents_without_text_are_not_lost(spark):
    df = spark.createDataFrame([("a", 0, SHEET), ("b", 0, None), ("c", 0, None), ("c", 1, SHEET)], PAGES)
    got = {r.doc_id: r.error for r in extract_incidents(df).collect()}
    assert got == {"a": None, "b": x.UNPARSEABLE, "c": None}
    assert rows(x.activity_rows(df.filter("doc_id = 'b'"))) == []


def test_two_statuses_may_stand_for_one_field(spark):
    df = spark.createDataFrame([("d", 0, "Unit Dispatched: U1\nU1 1/1/2025 1:2:3 SCENE\nU1 1/1/2025 1:2:9 ONLOC")], PAGES)
    got = extract_fields(df, mapping={"ONLOC": "onScene", "SCENE": "onScene"}).first()
    assert str(got.onScene) == "2025-01-01 01:02:03"


def test_pretty_json(spark):
    df = spark.createDataFrame([("d", 0, SHEET)], PAGES)
    fields = extract_fields(df)
    record = F.struct(F.struct(F.col("cad")).alias("incidentTimes"))
    text = fields.select(x.build_incident_json(record, pretty=True)).first()[0]
    assert text.splitlines()[1].startswith('  "incidentTimes"')


def test_timeline_and_summary(spark):
    content = json.dumps({
        "incidentTimes": {"times": {
            "onScene": {"date": "1/1/2025", "time": "10:00:00"}, "note": "x", "zz": None,
            "enRoute": {"date": "1/1/2025"}}},
        "incidentLocation": {"territory": "", "apartment": "2"}})
    df = spark.createDataFrame([(1, content), (2, "{}")], "k int, content string")
    assert rows(reports.incident_timeline(df, ["k"])) == [
        (1, 0, "onScene", "1/1/2025", "10:00:00"), (1, 3, "enRoute", "1/1/2025", "")]
    twice = spark.createDataFrame([(1, '{"incidentTimes":{"times":{"a":{"date":"1"},"b":{"date":"2"},"a":{"date":"3"}}}}')], "k int, content string")
    assert rows(reports.incident_timeline(twice, ["k"])) == [(1, 0, "a", "3", ""), (1, 1, "b", "2", "")]
    assert rows(reports.incident_summary(df, ["k"]), "k") == [
        (1, "N/A", "N/A", None, None, None, "2"), (2, "N/A", "N/A", None, None, None, None)]


def test_timeline_is_linear_in_the_keys_of_a_record(spark):
    """Of a key given twice the last value at the place of the first; a record of very many keys."""
    keys = [f"k{(i * 7919) % 5000}" for i in range(5000)] + ["k0", "k7"]
    times = ",".join(f'"{k}":{{"date":"d{i}"}}' for i, k in enumerate(keys))
    df = spark.createDataFrame([(1, '{"incidentTimes":{"times":{' + times + "}}}"), (2, "{}"), (3, None)], "id int, content string")
    got = rows(reports.incident_timeline(df, ["id"]).select("ordinal", "event", "date"), "ordinal")
    order = list(dict.fromkeys(keys))
    last = {k: f"d{i}" for i, k in enumerate(keys)}
    assert got == [(i, k, last[k]) for i, k in enumerate(order)]
