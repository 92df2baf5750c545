"""Connected components of a link table, by alternating star contractions.

Every step is a grouping and a join on written tables, so a lost executor repeats
one step. Nothing is collected: the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenframe.llm.common import staged


def connected_components(links: DataFrame) -> DataFrame:
    """Links (a, b) of whole numbers -> one row (node, component) per linked node.

    The component is the smallest node reachable. Links to oneself, repeated links and
    links with a null end are allowed and change nothing; without links the result is
    empty. Hubs are fine: minima are taken map-side, and the joins read written tables,
    which adaptive execution splits.
    """
    links = staged(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    print_before = None
    while True:
        links = _small_star(_large_star(links))
        # Sums of decimals never overflow a long; equal tables have equal sums.
        mark = links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if mark == print_before:
            break
        print_before = mark
    members = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)


def _large_star(links: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest node it sees."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "star")
    tied = both.join(smallest, "a").filter("b > a")
    return staged(tied.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "star")


def _small_star(links: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the smallest of them."""
    smallest = staged(links.groupBy("a").agg(F.min("b").alias("m")), "star")
    tied = links.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = smallest.select("a", F.col("m").alias("b"))
    return staged(tied.unionByName(own).filter("a <> b").distinct(), "star")
