"""Habitat x gear x nutrient yield shares, flow-axis table, regional map frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nutriyield.functions import in_levels
from nutriyield.operators.composition import rename_nutrients
from nutriyield.operators.density import nutrient_title
from nutriyield.sources import literals as L


def yield_shares(trips: DataFrame) -> DataFrame:
    """Share (%) of each nutrient's total yield per (habitat, gear); ``Deep`` is
    shown as ``Pelagic``.  The per-nutrient total is a 7-row aggregate joined back."""
    df = trips.withColumn("habitat", F.when(F.col("habitat") == "Deep", F.lit("Pelagic"))
                          .otherwise(F.col("habitat")))
    df = rename_nutrients(df.select("habitat", "gear_type", *L.NUTRIENTS_MU))
    long = df.unpivot(["habitat", "gear_type"], L.NUTRIENTS, "nutrient", "concentration_g")
    per = long.groupBy("habitat", "gear_type", "nutrient").agg(
        F.coalesce(F.sum("concentration_g"), F.lit(0.0)).alias("concentration_g"))
    tot = per.groupBy("nutrient").agg(F.sum("concentration_g").alias("__tot"))
    out = per.join(F.broadcast(tot), "nutrient")  # one row per nutrient: 7 rows
    out = out.withColumn("concentration_g", F.try_divide(F.col("concentration_g"), F.col("__tot")) * 100.0)
    return out.withColumn("nutrient", nutrient_title("nutrient")).drop("__tot")


def flow_axes(shares: DataFrame, drop_selenium: bool = True) -> DataFrame:
    """Parallel-sets stacking: each share row repeated once per axis
    (Nutrient, Habitat, Gear type) with the axis value as a level-checked factor;
    rows with an out-of-level value are dropped, as the chart does."""
    df = shares
    if drop_selenium:
        df = df.where(F.col("nutrient") != "Selenium")
    df = df.withColumn("id", F.concat_ws("|", "habitat", "gear_type", "nutrient"))
    long = df.select("id", "habitat", "gear_type", "nutrient", "concentration_g",
                     F.inline(F.array(
                         F.struct(F.lit("Nutrient").alias("x"), F.col("nutrient").alias("y")),
                         F.struct(F.lit("Habitat").alias("x"), F.col("habitat").alias("y")),
                         F.struct(F.lit("Gear type").alias("x"), F.col("gear_type").alias("y")))))
    long = long.withColumn("y", in_levels("y", L.FLOW_LEVELS))
    return long.where(F.col("y").isNotNull() & F.col("habitat").isNotNull() & F.col("gear_type").isNotNull()
                      & F.col("concentration_g").isNotNull())


def map_frame(map_adj: DataFrame, map_tot: DataFrame, boundaries: DataFrame,
              total_label: str = "National") -> DataFrame:
    """Regional map frame: adjusted WRA %, unadjusted annual catch, geometry.

    Right join onto the boundaries (every polygon kept), then the totals."""
    fix = {"Liquiça": "Liquica"}

    def spell(c):
        e = F.col(c)
        for a, b in fix.items():
            e = F.when(F.col(c) == a, F.lit(b)).otherwise(e)
        return e

    adj = (map_adj.withColumnRenamed("area", "region").where(F.col("region") != total_label)
           .withColumn("region", spell("region")))
    tot = (map_tot.select(F.col("area").alias("region"), F.col("annual_catch").alias("annual_catch_tot"),
                          F.col("WRA").alias("WRA_tot")).withColumn("region", spell("region")))
    out = adj.join(boundaries, "region", "right").join(tot, "region", "left")
    return out.select("region", "annual_catch_tot", "WRA", "geometry")
