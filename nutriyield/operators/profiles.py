"""Trip nutrient profiles: model features, model frames, profile summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nutriyield.functions import drop_na_rows, paste
from nutriyield.functions.distributions import t_quantile
from nutriyield.operators.composition import rename_nutrients
from nutriyield.operators.density import nutrient_title
from nutriyield.operators.verbs import exact_median_by, with_scalars
from nutriyield.sources import literals as L

FEATURES = L.NUTRIENTS_NO_SE


def profile_features(trips: DataFrame, rdi: DataFrame, gill_net: bool = True) -> DataFrame:
    """Six per-trip features: people whose daily need 1 kg of the catch covers,
    per nutrient (selenium excluded).

    ``gill_net`` keeps gill-net trips (and ``mesh_size`` as a key); otherwise all
    other gears.  The study's long -> join -> wide round trip is six column
    expressions against a one-row RDI frame; the median per trip key follows it.
    """
    gear = F.col("gear_type")
    df = trips.where(gear == "gill net") if gill_net else trips.where(gear != "gill net")
    rdi_row = rdi.groupBy().pivot("nutrient", FEATURES).agg(F.first("conv_factor")) \
        .select(*[F.col(n).alias("__rdi_" + n) for n in FEATURES])
    x = with_scalars(rename_nutrients(df.drop("Selenium_mu")), rdi_row)
    keys = ["landing_id", "landing_date", "quarter", "vessel_type", "habitat", "gear_type"]
    if gill_net:
        keys.append("mesh_size")
    x = x.withColumn("quarter", F.quarter("landing_date").cast("int"))
    # a trip of no weight has no features and goes with the incomplete rows
    x = x.select(*keys, *[(F.try_divide(F.col(n), F.col("weight")) * 1000.0 / F.col("__rdi_" + n)).alias(n) for n in FEATURES])
    out = x.groupBy(*keys).agg(*[F.median(n).alias(n) for n in FEATURES])
    return drop_na_rows(out)


def _r_number(c) -> Column:
    """R's default printing of a double in ``paste``: whole numbers without '.0'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(c.cast("string"))


def model_frame(clustered: DataFrame, gill_net: bool = True, keep=()) -> DataFrame:
    """Model table: interaction column, predictors and the cluster label as strings.

    ``keep`` carries id columns along (an ID role, not a predictor)."""
    if gill_net:
        return clustered.select(
            *keep, F.col("quarter").cast("string").alias("quarter"), "habitat",
            paste("habitat", _r_number("mesh_size"), sep="_").alias("habitat_mesh"),
            "mesh_size", "vessel_type", F.col("clusters").alias("cluster"))
    return clustered.select(
        *keep, F.col("quarter").cast("string").alias("quarter"),
        paste("habitat", "gear_type", sep="_").alias("habitat_gear"),
        "habitat", "gear_type", "vessel_type", F.col("clusters").alias("cluster"))


def _long_titles(clustered: DataFrame) -> DataFrame:
    long = clustered.select("clusters", *FEATURES).unpivot(["clusters"], FEATURES, "name", "value")
    return long.withColumn("name", nutrient_title("name"))


def profile_medians(clustered: DataFrame) -> DataFrame:
    """Median feature per cluster; bar label NULL when the median is <= 0.5."""
    med = exact_median_by(clustered, ["clusters"], FEATURES)
    long = med.unpivot(["clusters"], FEATURES, "name", "value").withColumn("name", nutrient_title("name"))
    return long.withColumn("labels", F.when(F.col("value") > 0.5, F.col("value")))


def profile_mean_ci(clustered: DataFrame, level: float = 0.98) -> DataFrame:
    """Mean, sd, n, standard error and two-sided t interval per cluster and feature.

    One partial/final aggregate per (cluster, feature); the t quantile is then a
    column of the few groups.
    """
    long = _long_titles(clustered)
    g = long.groupBy("clusters", "name").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.count(F.lit(1)).alias("n"))
    g = g.withColumn("se", F.col("sd") / F.sqrt(F.col("n").cast("double")))
    p = 1 - (1 - level) / 2
    g = g.withColumn("__q", t_quantile(p, F.col("n") - 1))
    return (g.withColumn("ci_lower", F.col("mean") - F.col("__q") * F.col("se"))
            .withColumn("ci_upper", F.col("mean") + F.col("__q") * F.col("se")).drop("__q"))
