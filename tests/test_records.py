import json

from pyspark.sql import functions as F

from conftest import rows
from sirenframe.operators import records as r
from sirenframe.operators import responses as m
from sirenframe.operators.upsert import upsert_incidents
from sirenframe.plans.ingest import prepare_responses

GOOD_TIME = {"notifiedByDispatch": {"date": "1/2/2025", "time": "3:4:5"}}


def incident(**header):
    return {"incidentTimes": {"cad": "12", "unit_dispatched": "U1", "times": GOOD_TIME} | header}


def without(record, key):
    header = {k: v for k, v in record["incidentTimes"].items() if k != key}
    return {**record, "incidentTimes": header}


def notified(value):
    return incident(times={"notifiedByDispatch": value})


FAILED = "Database operation failed: "
MISSING = "Missing required field in PCR JSON: "
NULL_GET = FAILED + "'NoneType' object has no attribute 'get'"
NO_UNIT = MISSING + "'incidentTimes.unit_dispatched not found and unit_id not provided'"
NO_CLOCK = MISSING + "'notifiedByDispatch.date or notifiedByDispatch.time'"
NO_NOTIFIED = MISSING + "'incidentTimes.times.notifiedByDispatch'"


def bad_cad(text):
    return FAILED + f"CAD number '{text}' cannot be converted to integer"


def bad_clock(text, why):
    return FAILED + f"Failed to parse datetime '{text}': {why}"


CASES = [
    (incident(), None),
    (incident(cad=" 12 "), None),
    (incident(cad="+12"), None),
    (incident(cad="1_000"), None),
    (incident(cad=12.7), None),
    (incident(cad=True), None),
    (incident(unit_dispatched=7), None),
    (incident(unit_dispatched="0"), None),
    (incident() | {"incidentLocation": {"raw": ""}}, None),
    (incident() | {"incidentLocation": {"raw": "12 OAK"}, "parsingErrors": [{"field": "x"}]}, None),
    (incident() | {"incidentLocation": {"raw": "1" * 301}}, None),
    ({}, NO_UNIT),
    ({"incidentTimes": None}, NULL_GET),
    ({"incidentTimes": [1]}, FAILED + "'list' object has no attribute 'get'"),
    (without(incident(), "unit_dispatched"), NO_UNIT),
    (incident(unit_dispatched=""), NO_UNIT),
    (incident(unit_dispatched=0), NO_UNIT),
    (incident(unit_dispatched=None), NO_UNIT),
    (without(incident(), "cad"), MISSING + "'incidentTimes.cad'"),
    (incident(cad=None), MISSING + "'incidentTimes.cad'"),
    (incident(cad="X1"), bad_cad("X1")),
    (incident(cad=""), bad_cad("")),
    (incident(cad="12.7"), bad_cad("12.7")),
    (incident(cad="1__0"), bad_cad("1__0")),
    (incident(cad="9" * 20), FAILED + f'value "{"9" * 20}" is out of range for type bigint'),
    (without(incident(), "times"), NO_NOTIFIED),
    (incident(times=None), NULL_GET),
    (incident(times={}), NO_NOTIFIED),
    (notified(None), NO_NOTIFIED),
    (notified({}), NO_NOTIFIED),
    (notified("soon"), FAILED + "'str' object has no attribute 'get'"),
    (notified({"date": "1/2/2025"}), NO_CLOCK),
    (notified({"date": "1/2/2025", "time": ""}), NO_CLOCK),
    (notified({"date": None, "time": "1:2:3"}), NO_CLOCK),
    (
        notified({"date": "02/30/2025", "time": "1:2:3"}),
        bad_clock("02/30/2025 1:2:3", "day is out of range for month"),
    ),
    (incident() | {"incidentLocation": None}, NULL_GET),
    (incident() | {"incidentLocation": {"raw": 5}}, FAILED + "object of type 'int' has no len()"),
    (incident(incident_type=True), FAILED + "object of type 'bool' has no len()"),
    # Two defects: the earlier check speaks.
    (incident(cad="X", times=None), bad_cad("X")),
    (incident(cad="9" * 20) | {"incidentLocation": None}, NULL_GET),
]


def test_every_message_of_the_checks(spark):
    data = [(i, json.dumps(record)) for i, (record, _) in enumerate(CASES)]
    got = r.validate_record(spark.createDataFrame(data, "doc_id int, content string"))
    assert [(i, e) for i, e in rows(got.select("doc_id", "error"))] == [
        (i, error) for i, (_, error) in enumerate(CASES)
    ]


def test_stored_columns(spark):
    record = incident(cad=" +1_2 ", incident_type="T" * 21) | {"incidentLocation": {"raw": "ü" * 301}}
    df = spark.createDataFrame([(json.dumps(record),)], "content string")
    row = r.validate_record(df).first()
    assert (row.incident_number, row.unit_id) == (12, "U1")
    assert row.location == "ü" * 300 and row.incident_type == "T" * 20
    assert row.incident_date.isoformat() == "2025-01-02T03:04:05"


def test_given_unit_takes_precedence(spark):
    data = [("A", json.dumps(incident())), ("", json.dumps(incident())), (None, json.dumps(incident())),
            ("B", json.dumps(without(incident(), "unit_dispatched")))]
    df = spark.createDataFrame(data, "g string, content string")
    got = r.validate_record(df, given_unit="g").select("unit_id", "error")
    assert sorted(rows(got)) == [("", None), ("A", None), ("B", None), ("U1", None)]


RESPONSES = [
    ('{"a":1}', None),
    ('```json\n{"a":1}\n```', None),
    ('```\n{"a":1}\n```', None),
    ('{"a":1,"a":2}', None),
    ('{"a":NaN}', None),
    ('{"parsingErrors":[{"field":"error"}]}', None),
    ('{"x":{"error":1}}', None),
    ('{"error":null}', "None"),
    ('{"error":"illegible"}', "illegible"),
    ('{"\\u0065rror":"spelt"}', "spelt"),
    ("[1]", "API call failed: list indices must be integers or slices, not str"),
    ("12", "API call failed: 'int' object does not support item assignment"),
    ("null", "API call failed: 'NoneType' object does not support item assignment"),
    ('Sure: ```json\n{"a":1}\n```', "Failed"),
    ('{"a":1', "Failed"),
    ('{"a":1} and more', "Failed"),
    ('{"a":1}] and more', "Failed"),
    ('{"a":1},{"b":2}', "Failed"),
    ("{'a':1}", "Failed"),
    ('{"a":1,}', "Failed"),
    ("", "Failed"),
]


def test_parse_and_route(spark):
    data = [(i, text) for i, (text, _) in enumerate(RESPONSES)]
    df = spark.createDataFrame(data, "doc_id int, response_text string")
    good, bad = m.route_errors(m.parse_response(df))
    assert {x.doc_id for x in good.collect()} == {i for i, (_, e) in enumerate(RESPONSES) if e is None}
    for row in bad.collect():
        expected = RESPONSES[row.doc_id][1]
        if expected == "Failed":
            assert row.error.startswith("Failed to parse JSON response: ")
            assert row.raw_response is not None and row.content is None
        else:
            assert row.error == expected and row.raw_response is None


def test_token_usage_is_attached_last(spark):
    df = spark.createDataFrame(
        [('{"a":1 }', (1, 2, 3)), ("{}", (1, 2, 3)), ("{}", None)],
        "content string, usage struct<prompt_tokens:long,completion_tokens:long,total_tokens:long>",
    )
    texts = [x[0] for x in df.select(m.attach_token_usage(F.col("content"), F.col("usage"))).collect()]
    usage = {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}
    assert [json.loads(t) for t in texts] == [{"a": 1, "_token_usage": usage}, {"_token_usage": usage}, {}]
    back = df.select(m.drop_token_usage(m.attach_token_usage(F.col("content"), F.col("usage"))))
    assert [json.loads(r[0]) for r in back.collect()] == [{"a": 1}, {}, {}]
    kept = spark.createDataFrame([('{"b" : [1, {"c":null}] }',), ('{"_token_usage":{},"b":[1,{"c":"é"}]}',)], "t string")
    texts = [r[0] for r in kept.select(m.drop_token_usage(F.col("t"))).collect()]
    assert texts[0] == '{"b" : [1, {"c":null}] }' and json.loads(texts[1]) == {"b": [1, {"c": "é"}]}


def test_good_and_bad_make_up_the_input(spark):
    data = [(str(i), json.dumps(c)) for i, (c, _) in enumerate(CASES)]
    data += [(f"r{i}", t) for i, (t, _) in enumerate(RESPONSES)]
    df = spark.createDataFrame(data, "doc_id string, response_text string")
    got = prepare_responses(df, F.current_timestamp(), ["doc_id"])
    assert sorted(x.doc_id for x in got.collect()) == sorted(d for d, _ in data)
    assert got.filter("success").count() == sum(e is None for _, e in CASES)


SCHEMA = (
    "incident_number long, unit_id string, created_date timestamp, content string,"
    "incident_date timestamp, location string, incident_type string, place long"
)


def row(key, place, location="L"):
    from datetime import datetime, timedelta

    at = datetime(2025, 1, 1) + timedelta(hours=place)
    return (key, "U", at, f"c{place}", at, location, "T", place)


def table(df):
    return rows(df.select("incident_number", F.hour("created_date"), "content", "location"))


def test_upsert_overwrites_with_nulls_and_keeps_the_creation_time(spark):
    none = spark.createDataFrame([], SCHEMA).drop("place")
    first = spark.createDataFrame([row(1, 0), row(1, 1), row(2, 2)], SCHEMA)
    second = spark.createDataFrame([row(1, 5, None), row(3, 6)], SCHEMA)
    once = upsert_incidents(none, first, ["place"])
    twice = upsert_incidents(once, second, ["place"])
    want = [(1, 0, "c5", None), (2, 2, "c2", "L"), (3, 6, "c6", "L")]
    assert table(twice) == want
    assert table(upsert_incidents(twice, second, ["place"])) == want
    assert r.key_violations(twice).count() == 0
    # The same rows in one batch give the same table.
    assert table(upsert_incidents(none, first.unionByName(second), ["place"])) == want


def test_upsert_aggregates_before_the_shuffle(spark):
    df = spark.createDataFrame([row(1, 0)], SCHEMA)
    plan = upsert_incidents(df.drop("place"), df, ["place"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_max_by" in plan and "Window" not in plan


def test_constraints(spark):
    data = [row(1, 0), (None, *row(1, 1)[1:]), (*row(2, 2)[:3], None, *row(2, 2)[4:])]
    df = spark.createDataFrame(data, SCHEMA)
    taken, rejected = r.enforce_constraints(df)
    assert taken.count() == 1
    assert sorted(x.violated for x in rejected.collect()) == ["content", "incident_number"]


def test_fences_are_stripped_in_steps(spark):
    """Each strip is in the plan of a parsed response once or twice, not once per use of its result."""
    responses = spark.range(3).select(F.col("id").cast("string").alias("response_text"))
    plan = m.parse_response(responses)._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("trim(") <= 2
    assert plan.count("RLIKE") == 0


def test_white_space_around_responses(spark):
    body = json.dumps(incident())
    texts = [f"{a}{f}{body}{g}{b}" for a in ("", " ", "　\x1f") for b in ("", "\n", "\x85 ")
             for f, g in (("", ""), ("```json\n", "\n```"), ("``` ", "```"))]
    odd = ["", " ", "```", "```json", " ```json ``` ", None, "​1"]
    given = spark.createDataFrame([(t,) for t in texts + odd], "response_text string")
    got = {x.response_text: x.content for x in m.parse_response(given).collect()}
    assert got == {**dict.fromkeys(texts, body), **dict.fromkeys(odd)}
