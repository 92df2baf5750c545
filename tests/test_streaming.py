import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sirenframe import streaming as st
from sirenframe.sources.state import append_processed_ids, load_processed_ids

RESPONSES = "doc_id string, arrived_at timestamp, response_text string"


def response(cad, place="L", clock="1:1:1"):
    return json.dumps({
        "incidentTimes": {"cad": cad, "unit_dispatched": "U", "times": {"notifiedByDispatch": {"date": "1/1/2025", "time": clock}}},
        "incidentLocation": {"raw": place}})


def put(spark, folder, name, data, schema=RESPONSES):
    df = spark.createDataFrame(data, schema.replace("arrived_at timestamp", "arrived_at string"))
    df = df.withColumn("arrived_at", F.col("arrived_at").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(folder)


def ingest(spark, folder, log, checkpoint, created="2025-02-01"):
    stream = spark.readStream.schema(RESPONSES).parquet(folder)
    st.ingest_responses(
        stream, log, checkpoint, F.lit(created).cast("timestamp"), availableNow=True
    ).awaitTermination()


def table(spark, log):
    return rows(st.current_incidents(st.ingested(spark, log)).select(
        "incident_number", "location", F.month("created_date")))


BATCH1 = [("a.pdf", "2025-01-01 00:00:02", response("1", "late")), ("b.pdf", "2025-01-01 00:00:01", response("1", "early")),
          ("c.pdf", "2025-01-01 00:00:01", "scrawl"), ("d.pdf", "2025-01-01 00:00:01", response("2"))]
BATCH2 = [("e.pdf", "2025-01-01 00:00:00", response("1", None)), ("f.pdf", "2025-01-01 00:00:00", response("x")),
          ("g.pdf", "2025-01-01 00:00:00", '```json\n{"error":"blank page"}\n```')]


def test_ingest_batch_by_batch(spark, folder):
    source, log, check = f"{folder}/in", f"{folder}/log", f"{folder}/check"
    put(spark, source, "1", BATCH1)
    ingest(spark, source, log, check)
    assert table(spark, log) == [(1, "late", 2), (2, "L", 2)]
    put(spark, source, "2", BATCH2)
    ingest(spark, source, log, check, "2025-03-01")
    # The later batch wins, its null too; the creation time stays.
    want = [(1, None, 2), (2, "L", 2)]
    assert table(spark, log) == want

    log_rows = st.ingested(spark, log)
    assert {(r.doc_id, r.error) for r in st.quarantine(log_rows).collect()} == {
        ("c.pdf", "Failed to parse JSON response: the text is not one JSON value"),
        ("f.pdf", "Database save failed: Database operation failed: CAD number 'x' cannot be converted to integer"),
        ("g.pdf", "blank page"),
    }
    assert {r.error_file for r in st.quarantine(log_rows).collect()} >= {"c_20250201_000000.pdf"}
    done = rows(st.outcomes(log_rows).select("doc_id", "success"))
    assert len(done) == 7 and sum(ok for _, ok in done) == 4

    def stored():
        return rows(st.incident_table(spark, log, f"{folder}/snapshots").select(
            "incident_number", "location", F.month("created_date")))

    assert stored() == want
    st.compact_incidents(spark, log, f"{folder}/snapshots")
    st.compact_incidents(spark, log, f"{folder}/snapshots")
    assert os.listdir(f"{folder}/snapshots") == ["batch_no=1"] and stored() == want
    put(spark, source, "3", [("h.pdf", "2025-01-01 00:00:00", response("2", "new")), ("i.pdf", "2025-01-01 00:00:00", response("3"))])
    ingest(spark, source, log, check, "2025-04-01")
    assert stored() == table(spark, log) == [(1, None, 2), (2, "new", 2), (3, "L", 4)]
    plan = st.incident_table(spark, log, f"{folder}/snapshots")._jdf.queryExecution().executedPlan().toString()
    assert "batch_no#" in plan and "> 1)" in plan
    st.compact_incidents(spark, log, f"{folder}/snapshots")
    assert stored() == table(spark, log)


def test_empty_log_has_no_rows(spark, folder):
    assert st.ingested(spark, f"{folder}/none").count() == 0
    assert st.incident_table(spark, f"{folder}/none", f"{folder}/snapshots").count() == 0
    st.compact_incidents(spark, f"{folder}/none", f"{folder}/snapshots")
    assert not os.path.exists(f"{folder}/snapshots")


def test_default_creation_time_is_the_same_on_redelivery(spark, folder):
    source, log = f"{folder}/in", f"{folder}/log"
    put(spark, source, "1", BATCH1)
    before = None
    for checkpoint in ("one", "two"):
        stream = spark.readStream.schema(RESPONSES).parquet(source)
        st.ingest_responses(stream, log, f"{folder}/{checkpoint}", availableNow=True).awaitTermination()
        now = sorted(map(str, st.ingested(spark, log).collect()))
        assert before in (None, now)
        before = now


def test_redelivery_changes_nothing(spark, folder):
    source, log = f"{folder}/in", f"{folder}/log"
    put(spark, source, "1", BATCH1)
    ingest(spark, source, log, f"{folder}/check")
    before = sorted(map(str, st.ingested(spark, log).collect()))
    # A lost checkpoint: the same documents come once more, as the same batch.
    ingest(spark, source, log, f"{folder}/check-again")
    assert sorted(map(str, st.ingested(spark, log).collect())) == before


def test_log_filters_prune_folders(spark, folder):
    source, log = f"{folder}/in", f"{folder}/log"
    put(spark, source, "1", BATCH1)
    ingest(spark, source, log, f"{folder}/check")
    plan = st.current_incidents(st.ingested(spark, log))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(success" in plan
    assert os.path.isdir(f"{log}/batch_no=0/success=true")


PAGES = "doc_id string, arrived_at timestamp, page_no int, n_pages int, text string"
SHEET = "CAD: 7\nUnit Dispatched: U1\nIncident Type: EMS\nDispatch Time: 1/1/2025 1:1:1\nLocation: EASTON 1 MILL RD"
DAY1, DAY2 = "2025-01-01 00:00:00", "2025-01-02 00:00:00"


def pages_in(spark, folder, *batches, hold_seconds=3600):
    """Every batch in a run of its own, from the state the run before left; the log after each."""
    logs = []
    for i, batch in enumerate(batches):
        put(spark, f"{folder}/in", str(i), batch, PAGES)
        stream = spark.readStream.schema(PAGES).parquet(f"{folder}/in")
        st.ingest_pages(
            stream, f"{folder}/log", f"{folder}/check", hold_seconds=hold_seconds, availableNow=True
        ).awaitTermination()
        logs.append(st.ingested(spark, f"{folder}/log"))
    return logs


def test_ingest_pages(spark, folder):
    first = [("a.pdf", DAY1, 0, 2, SHEET), ("a.pdf", DAY1, 1, 2, "U1 1/1/2025 1:2:3 RESP"),
             ("b.pdf", DAY1, 0, 1, "?"), ("c.pdf", DAY1, 0, 2, SHEET.replace("7", "8")), ("d.pdf", DAY1, 3, None, "x")]
    second = [("e.pdf", DAY1, 0, 1, SHEET.replace("7", "9"))]
    third = [("c.pdf", DAY1, 1, 2, "U1 1/1/2025 1:2:4 RESP"), ("a.pdf", DAY1, 1, 2, "U1 1/1/2025 1:2:3 RESP"), ("a.pdf", DAY1, 0, 2, SHEET)]
    again = [("c.pdf", DAY1, 0, 2, SHEET.replace("7", "8"))]
    log_rows = pages_in(spark, folder, first, second, third, again)[-1]
    got = {r.incident_number: json.loads(r.content) for r in st.current_incidents(log_rows).collect()}
    assert {k: v["incidentTimes"]["times"].get("enRoute", {}).get("time") for k, v in got.items()} == {
        7: "01:02:03", 8: "01:02:04", 9: None}
    assert {r.doc_id for r in st.quarantine(log_rows).collect()} == {"b.pdf"}
    done = [r.doc_id for r in st.outcomes(log_rows).collect()]
    # The document delivered twice in full is processed twice, the held one once.
    assert sorted(done) == ["a.pdf", "a.pdf", "b.pdf", "c.pdf", "e.pdf"]


def test_pages_that_never_come_are_quarantined_after_the_time(spark, folder):
    first = [("c.pdf", DAY1, 0, 2, SHEET), ("n.pdf", DAY1, 0, None, "x"), ("s.pdf", DAY1, 1, 2, "U1 1/1/2025 1:2:3 RESP"),
             (None, DAY1, 0, 1, "x")]
    second = [("s.pdf", DAY1, 0, 2, SHEET), ("o.pdf", DAY1, 0, 1, SHEET)]
    logs = pages_in(spark, folder, first, second, [("q.pdf", DAY1, 0, 1, SHEET)], hold_seconds=0)
    failed = {r.doc_id: r.error for r in st.quarantine(logs[-1]).collect()}
    assert failed == {
        "c.pdf": "incomplete document, pages here: 1 of 2",
        "n.pdf": "incomplete document, pages here: 1 of ?",
        None: "incomplete document, pages here: 1 of 1",
    }
    assert {r.doc_id for r in st.outcomes(logs[-1]).filter("success").collect()} == {"s.pdf", "o.pdf", "q.pdf"}


def test_held_pages_keep_the_copy_that_arrived_last(spark, folder):
    batches = [[("a", DAY2, 0, 3, "new"), ("b", DAY1, 0, 2, "b0")], [("a", DAY1, 0, 3, "old"), ("a", DAY1, 1, 3, None)],
               [("a", DAY1, 2, 3, "p2"), ("b", DAY1, 1, 2, "b1")], [("b", DAY1, 1, 2, "late copy")], [("b", DAY2, 0, 2, "c0"), ("b", DAY2, 1, 2, "c1")]]
    seen = []
    for i, batch in enumerate(batches):
        put(spark, f"{folder}/in", str(i), batch, PAGES)
        held = st.hold_pages(spark.readStream.schema(PAGES).parquet(f"{folder}/in"), buckets=1)
        out = held.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True)
        with st.data_batches_only(spark):
            query = out.start(f"{folder}/out")
        query.awaitTermination()
        now = rows(spark.read.parquet(f"{folder}/out").select("doc_id", "page_no", "text", "complete", F.day("arrived_at")))
        seen.append(now)
    assert seen[1] == []
    assert seen[2] == seen[3] == [("a", 0, "new", True, 2), ("a", 1, None, True, 1), ("a", 2, "p2", True, 1),
                                  ("b", 0, "b0", True, 1), ("b", 1, "b1", True, 1)]
    assert [r for r in seen[4] if r not in seen[3]] == [("b", 0, "c0", True, 2), ("b", 1, "c1", True, 2)]


def test_dedup_over_restarts(spark, folder):
    source, out = f"{folder}/in", f"{folder}/out"

    def run(ids):
        spark.createDataFrame([(i,) for i in ids], "message_id string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("message_id string").parquet(source)
        (st.dedup_messages(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/c")
         .trigger(availableNow=True).start(out).awaitTermination())
        return rows(spark.read.parquet(out))

    assert run(["<a>", "<b>", "<a>", ""]) == [("<a>",), ("<b>",)]
    assert run(["<b>", "<c>"]) == [("<a>",), ("<b>",), ("<c>",)]


def test_dedup_of_a_hot_id_over_a_restart(spark, folder):
    source, out = f"{folder}/in", f"{folder}/out"
    hot = F.when(F.col("id") % 3 == 0, F.lit("<hot>")).otherwise(F.concat(F.lit("<"), F.col("id") % 500, F.lit(">")))
    for _ in range(2):
        spark.range(3000).repartition(4).select(hot.alias("message_id")).write.mode("append").parquet(source)
        stream = spark.readStream.schema("message_id string").parquet(source)
        query = (st.dedup_messages(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/c")
                 .trigger(availableNow=True).start(out))
        query.awaitTermination()
        got = [r.message_id for r in spark.read.parquet(out).collect()]
        assert len(got) == len(set(got)) == 501


def seeded(spark, folder, ids, seen, buckets=8):
    spark.createDataFrame(ids, "message_id string, n long, at timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("message_id string, n long, at timestamp").parquet(f"{folder}/in")
    out = st.dedup_messages(stream, seen=seen, buckets=buckets).writeStream.format("parquet")
    out.option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return rows(spark.read.parquet(f"{folder}/out").select("message_id", "n"))


def test_dedup_starts_from_a_seen_set(spark, folder):
    state = f"{folder}/state"
    append_processed_ids(spark, spark.createDataFrame([("<a>",), ("<z>",)], "message_id string"), state)
    seen = load_processed_ids(spark, state)
    big = 2**60 + 1
    assert seeded(spark, folder, [("<a>", 1, None), ("<b>", big, None), ("", 3, None), (None, 4, None)], seen) == [("<b>", big)]
    # A restart goes on from its checkpoint, whatever it is given.
    nothing = load_processed_ids(spark, f"{folder}/none")
    got = seeded(spark, folder, [("<a>", 5, None), ("<b>", 6, None), ("<z>", 7, None), ("<c>", None, None)], nothing)
    assert got == [("<b>", big), ("<c>", None)]


def test_dedup_from_a_seen_set_with_a_hot_id(spark, folder):
    seen = spark.range(250).select(F.concat(F.lit("<"), "id", F.lit(">")).alias("message_id"))
    data = [(f"<{'hot' if i % 3 else i % 500}>", i, None) for i in range(3000)]
    got = seeded(spark, folder, data, seen.union(seen))
    assert sorted(m for m, _ in got) == sorted({m for m, *_ in data if m == "<hot>" or int(m[1:-1]) >= 250})
    assert seeded(spark, folder, data, seen) == got


def incident(number, unit, place, doc_id="d"):
    return (doc_id, None, number, unit, None, "{}", None, place, None, None, 0, True)


def test_merge_rewrites_touched_partitions_only(spark, folder):
    table = st.incident_files(spark, f"{folder}/table", parts=16)
    assert table.read().count() == 0
    everything = spark.createDataFrame([], st.ingest.LOG)

    def merge(version, data):
        nonlocal everything
        batch = spark.createDataFrame(data, st.ingest.LOG).withColumn("batch_no", F.lit(version).cast("long"))
        everything = everything.unionByName(batch)
        touched = table.merge(batch, st.ingest.PROCESSING_ORDER, version)
        want = st.current_incidents(everything).select(table.read().columns)
        assert sorted(map(str, table.read().collect())) == sorted(map(str, want.collect()))
        return touched

    def files():
        return {
            os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns
            for d, _, names in os.walk(f"{folder}/table") for n in names if n.endswith(".parquet")
        }

    assert len(merge(0, [incident(i, "U", f"p{i}") for i in range(200)])) == 16
    before = files()
    second = [incident(3, "U", None, "e"), incident(3, "U", "late", "f"), incident(1000, None, "new"), incident(None, None, "x")]
    touched = merge(1, second)
    assert 1 <= len(touched) <= 3
    after = files()
    assert before.items() <= after.items()
    assert {f.split("part=")[1].split("/")[0] for f in after.keys() - before.keys()} == {str(k) for k in touched}
    # The same merge again, and one that ended before its end.
    assert merge(1, second) == touched
    os.remove(f"{folder}/table/version=1/_SUCCESS")
    assert table.versions() == [0] and table.read().filter("incident_number = 1000").count() == 0
    assert merge(1, second) == touched
    merge(2, second)
    table.drop_old(keep=0)
    assert len({f.split("part=")[1].split("/")[0] for f in files()}) == 16
    assert not os.path.exists(f"{folder}/table/version=1/part={touched[0]}")
    merge(3, [incident(5, "U", "p")])


def test_log_into_partitioned_table(spark, folder):
    source, log, check = f"{folder}/in", f"{folder}/log", f"{folder}/check"
    table = st.incident_files(spark, f"{folder}/table", parts=4)
    assert st.merge_log(spark, log, table) == []
    for i, batch in enumerate((BATCH1, BATCH2, [("z.pdf", "2025-01-01 00:00:00", "scrawl")])):
        put(spark, source, str(i), batch)
        ingest(spark, source, log, check, f"2025-0{i + 2}-01")
        touched = st.merge_log(spark, log, table)
        assert bool(touched) == (i < 2) and st.merge_log(spark, log, table) == []
        got = table.read().select("incident_number", "location", F.month("created_date"))
        assert rows(got) == globals()["table"](spark, log)


HEAD = ("Message-ID: {id}\r\nFrom: desk@x.org\r\nSubject: a fax\r\nMIME-Version: 1.0\r\n"
        "Content-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: application/pdf\r\n"
        "Content-Disposition: attachment; filename=fax.pdf\r\n\r\n{id}\r\n--b--\r\n")
RAW = "mailbox string, seq long, seen boolean, content binary"


def mail_round(spark, folder, export, *numbers, first=None):
    if numbers:
        data = [("box", n, True, HEAD.format(id=f"<{n}>").encode()) for n in numbers]
        spark.createDataFrame(data, RAW).coalesce(1).write.mode("append").parquet(export)
    stream = spark.readStream.schema(RAW).parquet(export)
    seen = spark.createDataFrame([("<9>",)], "message_id string")
    st.mail_rounds(
        stream, f"{folder}/root", f"{folder}/c", "DESK@", "fax", seen, at=first, availableNow=True
    ).awaitTermination()
    saved = st.saved_attachments(spark, f"{folder}/root").select(F.element_at(F.split("path", "/"), -1), "length")
    return rows(saved), rows(st.mail_ids(spark, f"{folder}/root").select("message_id"))


def test_mail_round_that_fails_between_its_sinks_is_repeated_whole(spark, folder, monkeypatch):
    from sirenframe.streaming import mail

    results = {}
    for case in ("clean", "killed"):
        root, export = f"{folder}/{case}", f"{folder}/{case}-export"
        mail_round(spark, root, export, 1, 2, first="20250102_030405")
        if case == "killed":
            real = mail._write

            def failing(rows_, root_, sink, round_no):
                if sink == "ids":
                    raise RuntimeError("killed between the sinks")
                real(rows_, root_, sink, round_no)

            monkeypatch.setattr(mail, "_write", failing)
            with pytest.raises(Exception, match="killed"):
                mail_round(spark, root, export, 3, 4, first="20250103_030405")
            # The attachments of the round are written, but it has not ended.
            assert os.path.exists(f"{root}/root/attachments/round_no=1/_SUCCESS")
            assert len(rows(st.saved_attachments(spark, f"{root}/root"))) == 2
            monkeypatch.undo()
            # A later time does not change the names of a round that was begun.
            mail_round(spark, root, export, first="20250109_090909")
        else:
            mail_round(spark, root, export, 3, 4, first="20250103_030405")
        mail_round(spark, root, export, 5, first="20250104_030405")
        results[case] = mail_round(spark, root, export, 6, 5, 1, first="20250105_030405")
    assert results["clean"] == results["killed"]
    names, ids = results["clean"]
    assert len(names) == len({n for n, _ in names}) == 6 and ids == [(f"<{i}>",) for i in range(1, 7)]
    stats = rows(st.mail_stats(spark, f"{folder}/clean/root").select("round_no", "emails_checked", "emails_processed"))
    assert stats == [(0, 2, 2), (1, 2, 2), (2, 1, 1), (3, 2, 1)]


def document_files(folder, **files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(f"{folder}/{name}.pdf", "w") as f:
            f.write(text)


def take_documents(spark, folder, **options):
    st.ingest_documents(
        spark, f"{folder}/in", f"{folder}/out", f"{folder}/c", max_bytes=100, availableNow=True, **options
    ).awaitTermination()
    good = spark.read.parquet(f"{folder}/out/documents").select(F.element_at(F.split("path", "/"), -1), F.col("content").cast("string"))
    bad = spark.read.parquet(f"{folder}/out/quarantine").select("original_file", "error")
    return rows(good), dict(rows(bad))


def test_bad_files_do_not_end_the_stream(spark, folder, monkeypatch):
    from sirenframe.streaming import documents

    inbox = f"{folder}/in"
    document_files(inbox, a="one", b="two", c="three", long="x" * 101, **{"odd[1]{2}*": "four"})
    # A checksum file that does not fit makes a file unreadable.
    with open(f"{inbox}/.b.pdf.crc", "wb") as f:
        f.write(b"crc\x00\x00\x00\x02\x00" + b"\x01\x02\x03\x04")
    real = documents._content

    def vanishing(session, paths):
        if os.path.exists(f"{inbox}/c.pdf"):
            os.remove(f"{inbox}/c.pdf")
        return real(session, paths)

    monkeypatch.setattr(documents, "_content", vanishing)
    good, bad = take_documents(spark, folder)
    assert good == [("a.pdf", "one"), ("odd[1]{2}*.pdf", "four")]
    assert bad.keys() == {"b.pdf", "c.pdf", "long.pdf"} and "limit of 100" in bad["long.pdf"]
    assert "hecksum" in bad["b.pdf"] and all(bad.values())
    document_files(inbox, e="five")
    good, bad = take_documents(spark, folder)
    assert [n for n, _ in good] == ["a.pdf", "e.pdf", "odd[1]{2}*.pdf"] and len(bad) == 3


def test_no_document_at_all(spark, folder):
    document_files(f"{folder}/in", long="x" * 101)
    assert take_documents(spark, folder, max_files_per_trigger=1)[0] == []


def test_held_state_is_run_once_a_batch(spark, folder, monkeypatch):
    """The incidents and the page counts come from one reading of what is released."""
    ran = spark.sparkContext.accumulator(0)

    def counted(pages, hold_seconds):
        def run(batches):
            for batch in batches:
                ran.add(len(batch))
                yield batch.assign(complete=True)

        return pages.mapInPandas(run, f"{PAGES}, complete boolean")

    monkeypatch.setattr("sirenframe.streaming.ingest.hold_pages", counted)
    logs = pages_in(spark, folder, [(f"{i}.pdf", DAY1, 0, 1, SHEET.replace("7", str(i))) for i in range(1, 6)])
    assert logs[0].filter("success").count() == 5 and ran.value == 5
