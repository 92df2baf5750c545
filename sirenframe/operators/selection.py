"""Choosing which messages of a mailbox to work on.

Columns used: mailbox, seq (bigint, newest is highest), message_id, subject,
sender, seen (boolean).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sirenframe.functions import contains_ignore_case
from sirenframe.schemas import NEWEST_PER_MAILBOX


def filter_sender_seen(messages: DataFrame, sender: str) -> DataFrame:
    """Read messages whose sender contains `sender` in any letter case."""
    return messages.filter(F.col("seen") & contains_ignore_case(F.col("sender"), sender))


def newest_n_messages(messages: DataFrame, n: int = NEWEST_PER_MAILBOX) -> DataFrame:
    """The `n` highest sequence numbers of each mailbox.

    `row_number() <= n` is planned as a window group limit: each task drops all
    but its own `n` rows of a mailbox before the shuffle, so one mailbox may
    hold most of the rows.
    """
    newest_first = W.partitionBy("mailbox").orderBy(F.col("seq").desc())
    return (
        messages.withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )


def subject_match(messages: DataFrame, subject: str) -> DataFrame:
    """Messages whose subject contains `subject` in any letter case."""
    return messages.filter(contains_ignore_case(F.col("subject"), subject))


def _probe(messages: DataFrame) -> DataFrame:
    """Add a second join column that spreads blank IDs.

    A blank ID is never in the seen-set, and there may be very many of them:
    unlike real IDs they must not all go to one task.
    """
    spread = F.when(F.col("message_id") == "", F.xxhash64("mailbox", "seq")).otherwise(F.lit(0))
    return messages.withColumn("_spread", spread.cast("bigint"))


def _seen(processed_ids: DataFrame) -> DataFrame:
    return processed_ids.select(
        F.col("message_id"), F.lit(0).cast("bigint").alias("_spread")
    ).distinct()


def anti_join_processed(
    messages: DataFrame, processed_ids: DataFrame, filter_bytes: int | None = None
) -> DataFrame:
    """Messages whose ID is not in the seen-set.

    The seen-set only grows, so it is not hinted: Spark broadcasts it while it
    is below the broadcast threshold and shuffles after that. An ID with very
    many copies is split by the adaptive skew join, which may split the left
    side of an anti join.

    With `filter_bytes` a Bloom filter of the seen-set, no larger than that, is sent
    to the tasks first. What it does not hold is new and is not shuffled; only the
    rest meets the seen-set. The result is the same with a filter of any size.
    """
    if filter_bytes is not None:
        known = seen_filter(processed_ids, filter_bytes)
        marked = _maybe_seen(messages, known)
        exact = anti_join_processed(marked.filter(_MAYBE).drop(_MAYBE), processed_ids)
        return marked.filter(~F.col(_MAYBE)).drop(_MAYBE).unionByName(exact)
    return (
        _probe(messages)
        .join(_seen(processed_ids), ["message_id", "_spread"], "left_anti")
        .drop("_spread")
    )


# Bits of one bitmap of the Bloom filter, as Spark's bitmap functions build them.
BITMAP_BITS = 32768
BITS_PER_ID = 10
HASHES = 2
_MAYBE = "_maybe"


def seen_filter(processed_ids: DataFrame, max_bytes: int, bits_per_id: int = BITS_PER_ID) -> tuple[DataFrame, int]:
    """(bucket, bits) of a Bloom filter over the IDs, and its number of buckets: `max_bytes` at most."""
    wanted = -(-processed_ids.count() * bits_per_id // BITMAP_BITS)
    buckets = max(1, min(wanted, max_bytes * 8 // BITMAP_BITS))
    places = F.array(*[_place(i, buckets) for i in range(HASHES)])
    rows = processed_ids.select(F.explode(places).alias("place"))
    bitmap = F.bitmap_construct_agg(F.col("place") % BITMAP_BITS).alias("bits")
    return rows.groupBy(F.floor(F.col("place") / BITMAP_BITS).alias("bucket")).agg(bitmap), buckets


def _place(number: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64("message_id", F.lit(number)), F.lit(buckets * BITMAP_BITS))


def _maybe_seen(messages: DataFrame, known: tuple[DataFrame, int]) -> DataFrame:
    """Add whether the filter holds an ID; a blank ID is never in the seen-set."""
    bitmaps, buckets = known
    rows = messages
    for i in range(HASHES):
        # At most max_bytes in all, whatever the size of the seen-set.
        own = F.broadcast(bitmaps.select(F.col("bucket").alias(f"_bucket{i}"), F.col("bits").alias(f"_bits{i}")))
        place = _place(i, buckets)
        rows = rows.withColumn(f"_bucket{i}", F.floor(place / BITMAP_BITS)).join(own, f"_bucket{i}", "left")
        at = place % BITMAP_BITS
        byte = F.conv(F.hex(F.substring(f"_bits{i}", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.getbit(F.coalesce(byte, F.lit(0)), (at % 8).cast("int"))
        rows = rows.withColumn(f"_hit{i}", bit == 1).drop(f"_bits{i}", f"_bucket{i}")
    hit = F.col("message_id") != ""
    for i in range(HASHES):
        hit = hit & F.col(f"_hit{i}")
    return rows.withColumn(_MAYBE, F.coalesce(hit, F.lit(False))).drop(*[f"_hit{i}" for i in range(HASHES)])


def mark_stops(
    messages: DataFrame, processed_ids: DataFrame, policy: str = "reference"
) -> DataFrame:
    """Add `stop`: the row at which a newest-first pass over the mailbox ends.

    `messages` has booleans `matches` and `failed` in place of the subject.

    policy "reference": an ID in the seen-set, a second copy of an ID in the
    same round, a blank ID, a subject that does not match, or a failed message.
    policy "seen_only": an ID in the seen-set, or a second copy.
    """
    if policy not in ("reference", "seen_only"):
        raise ValueError(f"unknown policy: {policy}")
    newest_copy = W.partitionBy("mailbox", "message_id").orderBy(F.col("seq").desc())
    blank = F.col("message_id") == ""
    again = ~blank & (F.col("_copy") > 1)
    stop = F.col("_in_state") | again
    if policy == "reference":
        stop = stop | blank | ~F.col("matches") | F.col("failed")
    return (
        _probe(messages)
        .join(
            _seen(processed_ids).withColumn("_in_state", F.lit(True)),
            ["message_id", "_spread"],
            "left",
        )
        .withColumn("_in_state", F.coalesce("_in_state", F.lit(False)))
        .withColumn("_copy", F.row_number().over(newest_copy))
        .withColumn("stop", stop)
        .drop("_spread", "_in_state", "_copy")
    )


def take_until_stop(
    messages: DataFrame,
    processed_ids: DataFrame,
    subject: str,
    n: int = NEWEST_PER_MAILBOX,
    policy: str = "reference",
) -> DataFrame:
    """The newest `n` rows of each mailbox, newest first, up to the stop row.

    Adds `processed`: true before the stop row, false on it (and, with policy
    "seen_only", on passed-over rows that are blank, failed or do not match).
    Rows past the stop row are not reached. The subject is replaced by `matches`
    and `failed` before anything is sorted; then comes the top-n, so every later
    window holds at most `n` rows of a mailbox.

    A message with an `error` (a column that may be absent) is failed if its
    subject is null or matches: it is to be tried again.
    """
    error = F.col("error") if "error" in messages.columns else F.lit(None).cast("string")
    matches = contains_ignore_case(F.col("subject"), subject)
    tested = messages.withColumns(
        {
            "matches": matches,
            "failed": error.isNotNull() & (F.col("subject").isNull() | matches),
        }
    ).drop("subject")
    marked = mark_stops(newest_n_messages(tested, n), processed_ids, policy)
    before = (
        W.partitionBy("mailbox")
        .orderBy(F.col("seq").desc())
        .rowsBetween(W.unboundedPreceding, -1)
    )
    stops_before = F.coalesce(F.count_if(F.col("stop")).over(before), F.lit(0))
    return (
        marked.withColumn("_stops_before", stops_before)
        .filter(F.col("_stops_before") == 0)
        .withColumn(
            "processed",
            ~F.col("stop")
            & (F.col("message_id") != "")
            & F.col("matches")
            & ~F.col("failed"),
        )
        .drop("_stops_before", "stop")
    )


def poll_stats(reached: DataFrame, mailboxes: DataFrame | None = None) -> DataFrame:
    """Per mailbox: rows reached (the stop row too) and rows processed.

    With `mailboxes` (column mailbox) those without any row have 0 and 0.
    """
    rows = reached.select("mailbox", F.lit(1).alias("_one"), "processed")
    if mailboxes is not None:
        quiet = mailboxes.select("mailbox", F.lit(0).alias("_one"), F.lit(False).alias("processed"))
        rows = rows.unionByName(quiet)
    return rows.groupBy("mailbox").agg(
        F.sum("_one").alias("emails_checked"),
        F.count_if(F.col("processed")).alias("emails_processed"),
    )


def cut_at_failures(
    reached: DataFrame, failures: DataFrame, policy: str = "reference"
) -> DataFrame:
    """`reached` once it is known which messages (mailbox, seq) cannot be processed.

    Such a message is failed and not processed. With policy "reference" it is
    the last one reached.
    """
    known = reached.join(
        failures.select("mailbox", "seq", F.lit(True).alias("_fails")).distinct(),
        ["mailbox", "seq"],
        "left",
    ).withColumn("_fails", F.coalesce("_fails", F.lit(False)) & F.col("processed"))
    # At most the newest n rows of a mailbox are here.
    last = F.max(F.when(F.col("_fails"), F.col("seq"))).over(W.partitionBy("mailbox"))
    kept = known.withColumn("_last", last)
    if policy == "reference":
        kept = kept.filter(F.col("_last").isNull() | (F.col("seq") >= F.col("_last")))
    return kept.withColumns(
        {
            "processed": F.col("processed") & ~F.col("_fails"),
            "failed": F.col("failed") | F.col("_fails"),
        }
    ).drop("_fails", "_last")


def handled_ids(reached: DataFrame) -> DataFrame:
    """IDs a round adds to the seen-set: processed ones and subject mismatches.

    A stop row that is blank or failed adds nothing, and one that is known is known.
    """
    handled = F.col("processed") | (~F.col("matches") & ~F.col("failed"))
    return (
        reached.filter(handled & (F.col("message_id") != ""))
        .select("message_id")
        .distinct()
    )


def count_by_daypart(rows: DataFrame, part: Column) -> DataFrame:
    """Rows per daypart."""
    return rows.groupBy(part.alias("daypart")).agg(F.count("*").alias("n"))
