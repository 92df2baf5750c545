"""Keeping costly columns from being computed twice."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(rows: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """`withColumns` for columns that are costly and filtered on later.

    A filter on a plain computed column is pushed below its projection and
    computes it again, and so do all the columns it is made of. The columns are
    put out by a generator (one row in, one row out), below which a filter on
    them is not pushed.
    """
    made = {name: f"_made_{name}" for name in columns}
    projected = rows.withColumns({made[name]: value for name, value in columns.items()})
    kept = [c for c in rows.columns if c not in columns]
    values = F.struct(*[F.col(column).alias(name) for name, column in made.items()])
    return projected.select(*kept, F.inline(F.array(values)))
