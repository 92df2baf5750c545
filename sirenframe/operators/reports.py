"""Reports over stored incidents. Columns used: content (incident JSON text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenframe.operators.barrier import computed_once
from sirenframe.operators.variants import kind
from sirenframe.schemas import INCIDENT

# Only the times are read, each as it stands, so that the record order is kept.
_TIMES = "incidentTimes struct<times map<string, variant>>"
NOT_AVAILABLE = "N/A"


def incident_timeline(incidents: DataFrame, keys: list[str]) -> DataFrame:
    """One row per time of a record, in record order: keys, ordinal, event, date, time.

    Entries that are no objects are left out; a missing date or time is ''. Of a
    key given twice the last value counts, at the place of the first.
    """
    times = F.map_entries(F.from_json("content", _TIMES)["incidentTimes"]["times"])
    # What the lambdas below look into must be a value by then, not an expression.
    read = computed_once(incidents.select(*keys, times.alias("_times")), {"_times": F.col("_times")})
    read = computed_once(read, {"_places": _sorted_keys(F.col("_times"))})
    once = _last_of_each_key(F.col("_times"), F.col("_places"))
    return (
        read.select(*keys, F.posexplode(once).alias("ordinal", "_entry"))
        .select(*keys, "ordinal", F.col("_entry.key").alias("event"), F.col("_entry.value").alias("value"))
        .filter(kind(F.col("value")) == "dict")
        .select(
            *keys,
            "ordinal",
            "event",
            F.coalesce(F.try_variant_get("value", "$.date", "string"), F.lit("")).alias("date"),
            F.coalesce(F.try_variant_get("value", "$.time", "string"), F.lit("")).alias("time"),
        )
    )


def _sorted_keys(entries: Column) -> Column:
    """Keys with their places, so that copies of a key are neighbours."""
    return F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"))))


def _last_of_each_key(entries: Column, places: Column) -> Column:
    """The last entry of each key, at the place of the key's first entry; no entry is compared with all others."""

    def ends(step: int) -> Column:
        return F.filter(
            places, lambda p, i: F.coalesce(F.get(places, i + step)["key"] != p["key"], F.lit(True))
        )

    pairs = F.zip_with(ends(-1), ends(1), lambda a, b: F.struct(a["at"].alias("first"), b["at"].alias("last")))
    return F.transform(F.array_sort(pairs), lambda p: F.get(entries, p["last"]))


def incident_summary(incidents: DataFrame, keys: list[str]) -> DataFrame:
    """Incident number and raw location, 'N/A' where absent, and the location parts, '' as null."""
    record = F.from_json("content", INCIDENT)
    place = "_record.incidentLocation"
    return incidents.withColumn("_record", record).select(
        *keys,
        F.coalesce("_record.incidentTimes.cad", F.lit(NOT_AVAILABLE)).alias("cad"),
        F.coalesce(f"{place}.raw", F.lit(NOT_AVAILABLE)).alias("location"),
        *[
            F.nullif(F.col(f"{place}.{part}"), F.lit("")).alias(part)
            for part in ("territory", "location_name", "street_address", "apartment")
        ],
    )
