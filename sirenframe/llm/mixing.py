"""Mixing sources to target weights by histograms of hash thresholds.

Every row gets a key, its hash written as hexadecimal digits. Sizes are summed by source
and the leading digits of the key; the running sums show in which bucket a source's
budget runs out, and only the rows of that bucket are summed again by the digits that
follow, until one row is left. So a source's threshold is found without sorting its
rows, and a hot source is as many groups as there are buckets.

Budgets are nested. Where the row at a threshold is larger than what is left of the
budget, the rows behind it that are no larger than that get a threshold of their own,
and so on, until what is left is below a small part of the target or no row fits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sirenframe.llm.common import staged, text_of

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2
# A source's mix is near enough when less than this part of its target is left.
NEAR = 0.0005
HASH_DIGITS = 20
ROW_DIGITS = 16
STEP_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"
# Sorts after every hexadecimal digit.
AFTER = "~"


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = BUDGET,
    most: int = MOST,
    near: float = NEAR,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, taken.

    Size is the number of words (null text: 0). The sources, in code point order and null
    last, have the given weights in turn and share `budget` times all sizes; no target is
    above `most` times its source's size, and what is too much is shared anew by weight.
    Taken is a multiple of size, `most` times at most, and the same on every run: a source
    takes all its rows as often as its target allows, and the rest of the target by hash
    of (doc_id, text). Of equal rows as many are taken as fit; which of them cannot be told apart.
    A source never takes more than its target. Null IDs and sources are values like others,
    empty texts are taken 0 words, an empty table gives an empty result; other columns
    are not read.
    """
    rows = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            text_of(F.col(text_col)).alias("body"),
        ).select(
            "doc_id",
            "source",
            F.regexp_count("body", F.lit(WORD)).cast("long").alias("size"),
            F.concat(
                F.substring(F.md5(F.concat(text_of(F.col("doc_id")), F.lit(":"), F.col("body"))), 1, HASH_DIGITS),
                F.lower(F.lpad(F.hex(F.monotonically_increasing_id()), ROW_DIGITS, "0")),
            ).alias("key"),
        ),
        "mix-rows",
    )
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most)
    sized = F.col("source_size") > 0
    plan = staged(
        plan.withColumn("whole", F.when(sized, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn(
            "room", F.floor(F.col("target") - F.col("whole") * F.col("source_size"))
        ),
        "mix-plan",
    )
    spans = _spans(rows, plan, near).groupBy("source").agg(F.collect_list(F.struct("low", "high", "fits")).alias("spans"))
    plan = plan.alias("p").join(spans.alias("s"), _same_source(), "left").select("p.*", "spans")
    chosen = F.exists(
        "spans", lambda s: (F.col("key") > s["low"]) & (F.col("key") < s["high"]) & (F.col("size") <= s["fits"])
    )
    again = F.coalesce(chosen, F.lit(False)).cast("long")
    joined = rows.alias("r").join(_salted(plan).alias("p"), _own("p"))
    return joined.select(
        "doc_id", "size", "r.source", "source_size", "target", (F.col("size") * (F.col("whole") + again)).alias("taken")
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(source, source_size) -> source, source_size, target.

    The shares are weight times a level; the level rises until the shares that are not
    above their bound use up what the others leave. Every step is one sum over the
    sources, and fixes one source more at least.
    """
    ranked = _ranked(staged(sizes, "mix-sources"))
    weight = F.element_at(F.lit(list(weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = staged(
        ranked.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("bound")),
        "mix-weights",
    )
    total = budget * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, None
    while level != before:
        above = F.col("weight") * F.lit(level) > F.col("bound")
        fixed, rest = sources.agg(
            F.coalesce(F.sum(F.when(above, F.col("bound"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        before, level = level, (total - fixed) / rest if rest else level
    share = F.col("weight") * F.lit(level)
    return sources.select("source", "source_size", F.least(share, F.col("bound").cast("double")).alias("target"))


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their place (from 0) in code point order, null last; no task holds them all."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = sources.repartitionByRange(*order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    dealt = staged(dealt.withColumn("part", F.spark_partition_id()).withColumn("within", within), "mix-order")
    # One row per partition, so the window is as small as the number of partitions.
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", before.alias("start"))
    return dealt.join(starts, "part").select("source", "source_size", (F.col("start") + F.col("within")).alias("place"))


def _spans(rows: DataFrame, plan: DataFrame, near: float) -> DataFrame:
    """(source, low, high, fits): rows with a key between low and high and no larger than fits are taken."""
    found = [rows.sparkSession.createDataFrame([], "source string, low string, high string, fits long")]
    # What a source has left, the key behind which it goes on, and what fits.
    left = plan.filter("room > 0").select(
        "source", (F.col("target") * near).alias("enough"), "room", F.lit("").alias("low"), F.col("room").alias("fits")
    )
    while not left.isEmpty():
        ended = _thresholds(rows, left)
        found.append(ended.select("source", "low", "high", "fits"))
        left = ended.filter((F.col("high") != AFTER) & (F.col("room") > F.col("enough"))).select(
            "source", "enough", "room", F.concat("high", F.lit(AFTER)).alias("low"), F.col("room").alias("fits")
        )
    return reduce(DataFrame.unionByName, found)


def _thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with room less what is taken below the threshold `high`; AFTER where all that fits is taken."""
    seeking = wanted.withColumn("high", F.lit(""))
    done = []
    digits = 0
    while True:
        # The bucket in which the room runs out, of the rows that share the digits found so far.
        joined = rows.alias("r").join(
            _salted(seeking).alias("w"),
            _own("w")
            & (F.substring("key", 1, digits) == F.col("high"))
            & (F.col("key") > F.col("low"))
            & (F.col("size") <= F.col("fits")),
        )
        bucket = F.substring("key", 1, digits + STEP_DIGITS).alias("bucket")
        sums = joined.filter("size > 0").groupBy("r.source", bucket).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        order = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("until", F.sum("n").over(order))
        end = F.struct("bucket", (F.col("until") - F.col("n")).alias("before"), "rows")
        pick = sums.alias("s").join(seeking.alias("p"), _same_source()).groupBy("s.source").agg(
            F.max("until").alias("all"), F.min(F.when(F.col("until") > F.col("room"), end)).alias("end")
        )
        step = seeking.alias("p").join(pick.alias("s"), _same_source(), "left")
        used = F.coalesce("end.before", "all", F.lit(0))
        step = staged(
            step.select(
                "p.source",
                "enough",
                (F.col("room") - used).alias("room"),
                "low",
                "fits",
                F.coalesce("end.bucket", F.lit(AFTER)).alias("high"),
                F.coalesce("end.rows", F.lit(0)).alias("rows"),
            ),
            "mix-step",
        )
        done.append(step.filter("rows <= 1").drop("rows"))
        seeking = step.filter("rows > 1").drop("rows")
        digits += STEP_DIGITS
        if seeking.isEmpty():
            return reduce(DataFrame.unionByName, done)


def _salted(by_source: DataFrame) -> DataFrame:
    """A row per source and first digit of a key, so that a source's rows meet theirs in many tasks."""
    return by_source.withColumn("salt", F.explode(F.split(F.lit("0123456789abcdef"), "(?!^)")))


def _own(side: str):
    same = F.col("r.source").eqNullSafe(F.col(f"{side}.source"))
    return same & (F.substring("r.key", 1, 1) == F.col(f"{side}.salt"))


def _same_source():
    return F.col("p.source").eqNullSafe(F.col("s.source"))
