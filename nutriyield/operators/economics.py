"""Single-catch trips, per-taxon price model and affordability vs nutrient density."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nutriyield.functions import n_distinct_r
from nutriyield.operators.composition import rename_nutrients
from nutriyield.operators.trips import catch_rows
from nutriyield.operators.verbs import with_scalars
from nutriyield.sources import literals as L

_SUM_FIELDS = ["weight"] + L.NUTRIENTS_MU


def single_catch_trips(catch_data: DataFrame, taxa: DataFrame | None = None,
                       fixed_taxa: Sequence[str] | None = None, with_share: bool = False) -> DataFrame:
    """Trips whose catch is exactly one row (non-NULL weight and value), for the
    given taxa, summed per (trip, taxon).

    The per-trip row count is taken inside the row (array filter + size), so no
    shuffle is needed to find single-row trips.  ``with_share`` adds the share of
    single-row trips of each taxon (the appendix variant).
    """
    rows = F.filter(catch_rows_with_taxon(F.col("landing_catch")), lambda r: r["weight"].isNotNull())
    df = (catch_data.where(F.col("landing_value").isNotNull())
          .withColumn("__rows", rows)
          .where(F.size("__rows") == 1)
          .select("landing_id", "landing_value", F.col("__rows")[0].alias("__r"))
          .select("landing_id", "landing_value", "__r.*"))
    if with_share:
        tot = df.agg(n_distinct_r("landing_id").alias("__tot"))
        share = (df.groupBy("catch_taxon").agg(F.count(F.lit(1)).alias("__k")))
        share = with_scalars(share, tot).select("catch_taxon", (F.col("__k") / F.col("__tot") * 100.0)
                                                .alias("catch_percent"))
        df = df.join(share, "catch_taxon", "left")
    if taxa is not None:
        df = df.join(taxa.select(F.col("interagency_code").alias("catch_taxon")).distinct(), "catch_taxon",
                     "left_semi")
    if fixed_taxa is not None:
        df = df.where(F.col("catch_taxon").isin(list(fixed_taxa)))
    extra = ["catch_percent"] if with_share else []
    # exactly one row per trip, so per (trip, taxon) the sums are the row itself
    return df.select("landing_id", "catch_taxon", "landing_value", *extra, *_SUM_FIELDS)


def catch_rows_with_taxon(landing_catch):
    """Flattened catch rows carrying their taxon (no catch filter)."""
    inner = F.filter(landing_catch, lambda x: x["length_frequency"].isNotNull())
    per_taxon = F.transform(inner, lambda x: F.transform(
        x["length_frequency"], lambda r: r.withField("catch_taxon", x["catch_taxon"])))
    return F.flatten(per_taxon)


def price_model(single: DataFrame, at: float = 1000.0, literal_double_log: bool = True) -> DataFrame:
    """Per-taxon OLS of log(value) on log(weight), price = round(exp(pred) * 10, 2).

    The study evaluates the fitted line at ``log(log(at))`` (its prediction data
    frame holds ``weight = log(at)`` and the formula logs it again); that is the
    default.  One aggregate per taxon, no per-group model objects.
    """
    y, x = F.log(F.col("landing_value")), F.log(F.col("weight"))
    fit = single.groupBy("catch_taxon").agg(F.regr_slope(y, x).alias("slope"),
                                            F.regr_intercept(y, x).alias("intercept"))
    import math
    point = math.log(math.log(at)) if literal_double_log else math.log(at)
    pred = F.col("intercept") + F.col("slope") * F.lit(point)
    return fit.select("catch_taxon", F.bround(F.exp(pred) * 10.0, 2).alias("price"))


def affordability(single: DataFrame, prices: DataFrame, rdi: DataFrame, catch_groups: DataFrame,
                  top: DataFrame | None = None) -> DataFrame:
    """Nutrient density (people supplied per 100 g, six nutrients) of each taxon's
    first trip (lowest landing id), with its modelled price and group."""
    x = rename_nutrients(single)
    rdi_row = rdi.groupBy().pivot("nutrient", L.NUTRIENTS_NO_SE).agg(F.first("conv_factor"))
    rdi_row = rdi_row.select(*[F.col(n).alias("__rdi_" + n) for n in L.NUTRIENTS_NO_SE])
    x = with_scalars(x, rdi_row)
    inds = None
    for n in L.NUTRIENTS_NO_SE:
        e = (F.try_divide(F.col(n), F.col("weight")) * 100.0) / F.col("__rdi_" + n) * 100.0
        inds = e if inds is None else inds + e
    # one row per (trip, taxon) already, so the per-trip total is the row sum
    per = x.select("landing_id", "catch_taxon", *(["catch_percent"] if "catch_percent" in x.columns else []),
                   inds.alias("inds_100"))
    first = per.groupBy("catch_taxon").agg(
        F.min_by("inds_100", "landing_id").alias("inds"),
        *([F.min_by("catch_percent", "landing_id").alias("catch_percent")] if "catch_percent" in per.columns else []))
    out = first.join(prices, "catch_taxon", "left").withColumnRenamed("catch_taxon", "interagency_code")
    out = out.join(F.broadcast(catch_groups.select("interagency_code", "catch_name")), "interagency_code", "left")
    if top is not None:
        out = out.join(top.select("fish_group", "catch_name", "catch_percent"), "catch_name", "left")
        return out.select("fish_group", "catch_name", "price", "inds", "catch_percent")
    return out.select("catch_name", "catch_percent", "price", "inds")
