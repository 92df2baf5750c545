from conftest import rows
from sirenframe.operators import attachments as a

SCHEMA = (
    "mailbox string, seq long, part_no int, content_type string, content_disposition string,"
    "filename string, payload binary"
)
AT = "20250102_030405"
PDF, OCTET = "application/pdf", "application/octet-stream"


def part(seq, content_type, disposition, filename, payload=b"x", part_no=0, mailbox="m"):
    return (mailbox, seq, part_no, content_type, disposition, filename, payload)


def test_rule_in_order(spark):
    data = [
        part(1, PDF, "INLINE", "a.pdf"),
        part(2, OCTET, None, None),
        part(3, OCTET, None, "scan"),
        part(4, OCTET, None, "scan.PDF"),
        part(5, "text/plain", "attachment", "a.pdf"),
        part(6, "text/html", "inline", "b.pdf"),
        part(7, "image/png", "attachment", "p.png"),
        part(8, "image/png", "attachment; x=1", "p.pdf"),
        part(9, "image/png", None, "p.pdf"),
        part(10, "image/png", "attachment", None),
        part(11, PDF, None, "", part_no=2),
        part(12, PDF, None, "no-extension"),
    ]
    kept = a.select_attachments(spark.createDataFrame(data, SCHEMA))
    got = a.attachment_filenames(kept, AT).select("seq", "filename")
    assert rows(got, "seq") == [
        (1, "a.pdf"),
        (2, f"fax_2_{AT}_0.pdf"),
        (3, "scan.pdf"),
        (4, "scan.PDF"),
        (8, "p.pdf"),
        (11, f"fax_11_{AT}_2.pdf"),
    ]


def test_empty_payloads_are_dropped(spark):
    df = spark.createDataFrame([part(1, PDF, None, "a", b""), part(2, PDF, None, "a", None), part(3, PDF, None, "a")], SCHEMA)
    assert [r.seq for r in a.drop_empty_payloads(df).collect()] == [3]


def test_names_are_unique_and_nothing_is_lost(spark):
    data = [part(s, PDF, None, "a.b.pdf", mailbox=m) for m in ("m1", "m2") for s in (5, 20_005)]
    data += [part(1, PDF, None, "held.pdf"), part(2, PDF, None, "held.pdf"), part(3, PDF, None, "new.pdf")]
    held = spark.createDataFrame([("held.pdf",), ("held.pdf",), ("other.pdf",)], "filename string")
    got = a.dedupe_filenames(spark.createDataFrame(data, SCHEMA), held, AT)
    # Newest first: the highest number of the first mailbox keeps the name.
    assert rows(got.select("mailbox", "seq", "filename"), "mailbox", "seq") == [
        ("m", 1, f"held_{AT}_m_1_0.pdf"),
        ("m", 2, f"held_{AT}_m_2_0.pdf"),
        ("m", 3, "new.pdf"),
        ("m1", 5, f"a.b_{AT}_m1_5_0.pdf"),
        ("m1", 20_005, "a.b.pdf"),
        ("m2", 5, f"a.b_{AT}_m2_5_0.pdf"),
        ("m2", 20_005, f"a.b_{AT}_m2_20005_0.pdf"),
    ]


def test_made_names_do_not_meet_given_or_existing_ones(spark):
    made = [f"a_{AT}_m_{s}_0.pdf" for s in (1, 2)]
    data = [part(s, PDF, None, "a.pdf") for s in (1, 2, 3)] + [part(4, PDF, None, made[0])]
    held = spark.createDataFrame([(made[1],)], "filename string")
    got = [r.filename for r in a.dedupe_filenames(spark.createDataFrame(data, SCHEMA), held, AT).collect()]
    assert len(got) == len(set(got)) == 4 and made[1] not in got
    assert "a.pdf" in got and made[0] in got


def test_payload_does_not_move_when_names_are_made(spark):
    df = spark.createDataFrame([part(1, PDF, None, "a.pdf")], SCHEMA)
    held = spark.createDataFrame([("a.pdf",)], "filename string")
    plan = a.dedupe_filenames(df, held, AT)._jdf.queryExecution().optimizedPlan().toString()
    joins = plan[: plan.index("LogicalRDD")]
    assert "payload" not in joins
