import random

import pytest

from conftest import rows
from sirenframe.operators import selection as s
from pyspark.sql import functions as F

SCHEMA = "mailbox string, seq long, message_id string, subject string, sender string, seen boolean"


def mail(mailbox, seq, message_id, subject="1 page FAX received", sender="Desk@x.org", seen=True):
    return (mailbox, seq, message_id, subject, sender, seen)


def reached_by_hand(mails, seen_ids, needle, n, policy):
    """The pass over each mailbox, one row after the other."""
    out = []
    for box in {m[0] for m in mails}:
        known = set(seen_ids)
        newest = sorted((m for m in mails if m[0] == box), key=lambda m: -m[1])[:n]
        for _, seq, mid, subject, *_ in newest:
            match = needle.lower() in (subject or "").lower()
            stop = mid in known if mid else False
            if policy == "reference":
                stop = stop or not mid or not match
            out.append((box, seq, not stop and bool(mid) and match))
            if stop:
                break
            known.add(mid)
    return sorted(out)


@pytest.mark.parametrize("policy", ["reference", "seen_only"])
def test_take_until_stop_equals_the_row_by_row_pass(spark, policy):
    dice = random.Random(7)
    mails = [
        mail(f"m{b}", seq, dice.choice(["", f"<{b}.{seq}>", f"<{b}.{dice.randrange(40)}>"] + [f"<{b}.{seq}>"] * 12),
             dice.choice(["a Fax"] * 12 + ["other", None]))
        for b in range(40)
        for seq in range(dice.randrange(1, 30))
    ]
    seen = [f"<{b}.{dice.randrange(60)}>" for b in range(40)]
    got = s.take_until_stop(
        spark.createDataFrame(mails, SCHEMA),
        spark.createDataFrame([(i,) for i in seen], "message_id string"),
        "fax",
        policy=policy,
    ).select("mailbox", "seq", "processed")
    assert rows(got) == reached_by_hand(mails, seen, "fax", 15, policy)


def test_stop_rows_count_as_checked(spark):
    mails = [mail("a", i, f"<{i}>") for i in range(20)] + [
        mail("b", 3, "<b3>"), mail("b", 2, "<b2>", "lunch"), mail("b", 1, "<b1>"),
        mail("c", 2, ""), mail("c", 1, "<c1>"),
        mail("d", 3, "<d>"), mail("d", 2, "<d>"), mail("d", 1, "<d1>"),
    ]
    state = spark.createDataFrame([("<9>",)], "message_id string")
    reached = s.take_until_stop(spark.createDataFrame(mails, SCHEMA), state, "fax").cache()
    assert rows(s.poll_stats(reached)) == [("a", 11, 10), ("b", 2, 1), ("c", 1, 0), ("d", 2, 1)]
    boxes = spark.createDataFrame([("a",), ("quiet",)], "mailbox string")
    assert ("quiet", 0, 0) in rows(s.poll_stats(reached, boxes)) and ("a", 11, 10) in rows(s.poll_stats(reached, boxes))
    new = {r[0] for r in rows(s.handled_ids(reached))}
    # The mismatch is remembered, the rows behind a stop are not.
    assert {"<b3>", "<b2>", "<d>"} <= new and not new & {"<b1>", "<c1>", "<d1>", ""}


def test_sender_seen_and_subject_filters(spark):
    df = spark.createDataFrame(
        [mail("a", 1, "<1>"), mail("a", 2, "<2>", seen=False), mail("a", 3, "<3>", sender="no@x.org"),
         mail("a", 4, "<4>", None)], SCHEMA)
    assert {r.seq for r in s.filter_sender_seen(df, "DESK@X").collect()} == {1, 4}
    assert {r.seq for r in s.subject_match(df, "Page Fax").collect()} == {1, 2, 3}


def test_anti_join_keeps_blank_ids(spark):
    df = spark.createDataFrame([mail("a", i, "" if i % 2 else f"<{i}>") for i in range(10)], SCHEMA)
    state = spark.createDataFrame([("<0>",), ("<4>",), ("",)], "message_id string").filter("message_id <> ''")
    assert {r.seq for r in s.anti_join_processed(df, state).collect()} == {1, 2, 3, 5, 6, 7, 8, 9}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_newest_n_drops_rows_before_the_shuffle(spark):
    df = spark.createDataFrame([mail("a", 1, "<1>")], SCHEMA)
    plan = plan_of(s.newest_n_messages(df))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_hot_id_is_split_by_the_skew_join(spark):
    """A third of all rows under one ID: the join splits that partition, nothing is lost."""
    own = spark.newSession()
    for k, value in SKEW.items():
        own.conf.set(k, value)
    ids = F.when(F.col("id") % 3 == 0, F.lit("<hot>")).otherwise(F.concat(F.lit("<"), "id", F.lit(">")))
    mails = own.range(0, 120_000, 1, 12).select(
        F.lit("a").alias("mailbox"), F.col("id").alias("seq"), ids.alias("message_id"))
    state = own.range(0, 60_000, 1, 4).select(F.concat(F.lit("<"), "id", F.lit(">")).alias("message_id"))
    left = s.anti_join_processed(mails, state)
    assert len(left.collect()) == 40_000 + 40_000
    assert "skew=true" in plan_of(left)


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.mark.parametrize("filter_bytes", [1, 4096, 1 << 20])
def test_filtered_anti_join_equals_the_plain_one(spark, filter_bytes):
    ids = spark.range(9000).select(F.when(F.col("id") % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("<"), "id", F.lit(">"))).alias("message_id"))
    messages = ids.select(F.lit("m").alias("mailbox"), F.monotonically_increasing_id().alias("seq"), "message_id")
    seen = spark.range(20000).filter("id % 7 = 0").select(F.concat(F.lit("<"), "id", F.lit(">")).alias("message_id"))
    for known in (seen, seen.limit(0)):
        want = rows(s.anti_join_processed(messages, known).select("seq", "message_id"))
        assert rows(s.anti_join_processed(messages, known, filter_bytes).select("seq", "message_id")) == want


def test_filter_is_bounded_and_keeps_new_ids_from_the_shuffle(spark):
    seen = spark.range(200_000).select(F.concat(F.lit("<"), "id", F.lit(">")).alias("message_id"))
    bitmaps, buckets = s.seen_filter(seen, 1 << 20)
    assert buckets == -(-2_000_000 // 32768)
    assert bitmaps.agg(F.sum(F.length("bits"))).first()[0] <= 1 << 20
    assert s.seen_filter(seen, 1 << 14)[1] == 4
    new = spark.range(200_000, 300_000).select(F.concat(F.lit("<"), "id", F.lit(">")).alias("message_id"))
    maybe = s._maybe_seen(new, s.seen_filter(seen, 1 << 20)).filter("_maybe").count()
    assert maybe < 5000
    assert s._maybe_seen(seen, s.seen_filter(seen, 1 << 14)).filter("NOT _maybe").count() == 0
    messages = new.select(F.lit("m").alias("mailbox"), F.lit(1).alias("seq"), "message_id")
    plan = s.anti_join_processed(messages, seen, 1 << 20)._jdf.queryExecution().executedPlan().toString()
    # New IDs go by the branch without an exchange; only hits are joined.
    assert "Union" in plan and plan.count("LeftAnti") == 1
