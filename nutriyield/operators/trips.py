"""Trip records: region fill by tracker, and per-trip nutrient yields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nutriyield.operators.verbs import mode_by
from nutriyield.sources import literals as L

_LF_FIELDS = ["catch", "weight"] + L.NUTRIENTS_MU


def fill_region_by_tracker(trips: DataFrame) -> DataFrame:
    """``reporting_region`` = municipality, or when that is NULL the most frequent
    municipality of the same tracker (ties: alphabetical first).

    The reference full-joins the per-tracker table; every tracker comes from
    trips, so this is a left join.  NULL trackers stay unmatched.
    """
    fill = mode_by(trips, "tracker_imei", "municipality", "reporting_region_fill")
    return (trips.join(fill, "tracker_imei", "left")
            .withColumn("reporting_region", F.coalesce(F.col("municipality"), F.col("reporting_region_fill")))
            .drop("reporting_region_fill"))


def catch_rows(landing_catch: Column, keep_null_catch: bool = False) -> Column:
    """All ``length_frequency`` rows of a trip as one array (two-level unnest
    inside the row: NULL or empty lists contribute nothing)."""
    inner = F.filter(landing_catch, lambda x: x["length_frequency"].isNotNull())
    flat = F.flatten(F.transform(inner, lambda x: x["length_frequency"]))
    if keep_null_catch:
        return flat
    return F.filter(flat, lambda r: r["catch"].isNotNull())


def _strict_array_sum(rows: Column, field: str) -> Column:
    """Sum of one field over an array; NULL if any element is NULL (R ``sum``)."""
    return F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + r[field])


def trip_window(trips: DataFrame, start: str, end: str, regions: Sequence[str]) -> DataFrame:
    """The trip-level filters of ``trip_yields``: a landing id, a month bin in
    [start, end] and a reporting region in ``regions``.  They read trip heads
    only, so they can run before the nested catch is built or joined."""
    period = F.trunc(F.col("landing_date"), "MM")
    return (trips.where(F.col("landing_id").isNotNull())
            .where((period >= F.lit(start).cast("date")) & (period <= F.lit(end).cast("date")))
            .where(F.col("reporting_region").isin(list(regions))))


def trip_yields(trips: DataFrame, start: str, end: str, regions: Sequence[str]) -> DataFrame:
    """Per-trip catch and nutrient yield in tonnes (``kobo_trips``).

    Month bin, fisher count (NULL if any part is NULL), period and region filter,
    two-level unnest of the catch, rows with NULL catch dropped, then per
    (landing_id, landing_period) the trip attributes and the sums / 1000.

    The unnest and the per-trip sums run inside each row with higher-order
    functions, so only one row per trip reaches the (landing_id, period) shuffle.
    """
    df = (trip_window(trips, start, end, regions)
          .withColumn("landing_period", F.trunc(F.col("landing_date"), "MM"))
          .withColumn("__rows", catch_rows(F.col("landing_catch")))
          .where(F.size("__rows") > 0))
    attrs = F.struct(
        F.col("municipality").alias("reporting_region"),
        "landing_date",
        F.col("trip_length").alias("trip_duration"),
        (F.col("fisher_number_man") + F.col("fisher_number_woman") + F.col("fisher_number_child")).alias("n_fishers"),
        "habitat",
        F.col("gear").alias("gear_type"),
        "mesh_size",
        F.col("propulsion_gear").alias("vessel_type"),
        F.col("landing_catch_price").alias("landing_value"),
    )
    per_row = df.select("landing_id", "landing_period", attrs.alias("__a"),
                        *[_strict_array_sum(F.col("__rows"), f).alias(f) for f in _LF_FIELDS])
    # strict sum across rows of one (landing_id, period); NULL poisons
    agg = per_row.groupBy("landing_id", "landing_period").agg(
        F.min("__a").alias("__a"),
        *[F.when(F.count(f) == F.count(F.lit(1)), F.sum(f)).alias(f) for f in _LF_FIELDS])
    out = agg.select("landing_id", "landing_period", "__a.*",
                     *[(F.col(f) / 1000.0).alias(f) for f in _LF_FIELDS])
    return out.withColumn("habitat", F.when(F.col("habitat") == "Traditional FAD", F.lit("FAD"))
                          .otherwise(F.col("habitat")))


def unnest_catch(df: DataFrame) -> DataFrame:
    """Row form of the two-level unnest (``unnest(landing_catch)``, then
    ``unnest(length_frequency)``): empty / NULL lists drop the row."""
    a = df.select(*[c for c in df.columns if c != "landing_catch"], F.inline("landing_catch"))
    return a.select(*[c for c in a.columns if c != "length_frequency"], F.inline("length_frequency"))
