"""Keyed upsert as a fold over batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenframe.schemas import INCIDENT_KEY, INCIDENT_PAYLOAD


def latest_by_key(
    rows: DataFrame,
    order: Sequence[Column],
    key: Sequence[str] = INCIDENT_KEY,
    payload: Sequence[str] = INCIDENT_PAYLOAD,
    created: str = "created_date",
) -> DataFrame:
    """One row per key: payload of the last row in `order`, creation time of the first.

    The whole payload comes from the last row, its nulls too. Both picks are
    aggregates with map-side partials: a key with very many rows reaches its
    task as one row per map task, which a window by key would not do.
    """
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return (
        rows.groupBy(*key)
        .agg(
            F.max_by(F.struct(*payload), place).alias("_last"),
            F.min_by(F.col(created), place).alias(created),
        )
        .select(*key, created, *[F.col(f"_last.{c}").alias(c) for c in payload])
    )


def upsert_incidents(
    target: DataFrame,
    batch: DataFrame,
    order: Sequence[str],
    key: Sequence[str] = INCIDENT_KEY,
    payload: Sequence[str] = INCIDENT_PAYLOAD,
    created: str = "created_date",
) -> DataFrame:
    """`target` after `batch`: new keys inserted, known ones overwritten.

    `order` names the columns of `batch` by which its rows are processed; the
    last row of a key wins. `created` is set at the first insert and kept.
    """
    columns = [*key, created, *payload]
    before = target.select(*columns, F.lit(0).alias("_batch"))
    after = batch.select(*columns, *order, F.lit(1).alias("_batch"))
    return latest_by_key(
        before.unionByName(after, allowMissingColumns=True),
        [F.col("_batch"), *[F.col(c) for c in order]],
        key,
        payload,
        created,
    )
