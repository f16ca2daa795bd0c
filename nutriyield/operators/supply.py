"""Regional nutrient supply: yields, edible adjustment, population, supply tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nutriyield.functions import comma_format, str_remove_first, strict_sum
from nutriyield.operators.composition import rename_nutrients
from nutriyield.operators.verbs import arrange, add_total_row, with_scalars
from nutriyield.sources import literals as L

YIELD_COLS = ["catch"] + L.NUTRIENTS


def region_yields(parts: DataFrame, nutrients: DataFrame) -> DataFrame:
    """Monthly regional catch per taxon times nutrient concentration (kg).

    ``nutrients`` has one row per taxon code; AQE measures it at runtime before
    choosing a broadcast, and falls back to a shuffle join otherwise.
    """
    df = parts.select("region", "date_bin_start", "grouped_taxa", "catch").join(
        nutrients.select("grouped_taxa", *L.NUTRIENTS_MU), "grouped_taxa", "left")
    df = df.select("region", "date_bin_start", "grouped_taxa", "catch",
                   *[(F.col(c) * F.col("catch")).alias(c) for c in L.NUTRIENTS_MU])
    return rename_nutrients(df)


def edible_adjusted(yields: DataFrame, edible: DataFrame, before: str) -> DataFrame:
    """Rows before ``before`` with catch and nutrients scaled by the taxon's
    edible share; a taxon without one gets NULLs."""
    df = (yields.where(F.col("date_bin_start") < F.lit(before).cast("date"))
          .join(edible.select("grouped_taxa", "ep_coeff"), "grouped_taxa", "left"))
    return (df.select("region", "date_bin_start", "grouped_taxa",
                      *[(F.col(c) * F.col("ep_coeff")).alias(c) for c in YIELD_COLS]))


def wra_population(census: DataFrame, min_age: int = 14, max_age: int = 50,
                   total_label: str = "All") -> DataFrame:
    """Women of reproductive age per region (exclusive age bounds) plus a total row."""
    w = census.where((F.col("gender") == "Female") & (F.col("age") > min_age) & (F.col("age") < max_age))
    per = w.groupBy("region").agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("population"))
    tot = per.agg(F.sum("population").cast("long").alias("population")).withColumn("region", F.lit(total_label))
    return per.unionByName(tot)


def monthly_totals(adjusted: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Strict (NULL-poisoning) sums per (region, month), with ``year``.

    A year filter is applied to the raw month column so Parquet can prune it.
    """
    df = adjusted
    if years:
        lo, hi = min(years), max(years)
        df = df.where((F.col("date_bin_start") >= F.lit(f"{lo}-01-01").cast("date"))
                      & (F.col("date_bin_start") < F.lit(f"{hi + 1}-01-01").cast("date")))
    out = (df.groupBy("region", "date_bin_start")
           .agg(*[strict_sum(c).alias(c) for c in YIELD_COLS])
           .withColumn("year", F.year("date_bin_start").cast("int")))
    if years:
        out = out.where(F.col("year").isin(list(years)))
    return out


def mean_annual_supply(adjusted: DataFrame, years: Sequence[int], total_label: str = "National") -> DataFrame:
    """Mean annual supply per region over ``years`` (catch in tonnes) plus a total row."""
    m = monthly_totals(adjusted, years)
    annual = m.groupBy("year", "region").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in YIELD_COLS])
    mean = annual.groupBy("region").agg(*[F.avg(c).alias(c) for c in YIELD_COLS])
    mean = mean.withColumn("catch", F.col("catch") / 1000.0)
    total = mean.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in YIELD_COLS]) \
        .withColumn("region", F.lit(total_label))
    return mean.unionByName(total)


def _rdi_row(rdi: DataFrame, prefix: str = "rdi_") -> DataFrame:
    """The RDI table as one row with one column per nutrient (bounded: 7 values)."""
    return rdi.groupBy().pivot("nutrient", L.NUTRIENTS).agg(F.first("conv_factor")) \
        .select(*[F.col(n).alias(prefix + n) for n in L.NUTRIENTS])


def population_supplied(supply: DataFrame, rdi: DataFrame, population: DataFrame,
                        total_label: str = "National") -> DataFrame:
    """Women supplied per region: nutrient kg / RDI, summed over the six
    nutrients without selenium, against the regional population.

    The reference's long -> join -> wide round trip is six column expressions
    against a one-row RDI frame.
    """
    df = with_scalars(supply, _rdi_row(rdi))
    wra = {n: F.col(n) / F.col("rdi_" + n) for n in L.NUTRIENTS_NO_SE}
    total = None
    for n in L.NUTRIENTS_NO_SE:
        e = F.coalesce(wra[n], F.lit(0.0))
        total = e if total is None else total + e
    df = df.select("region", total.alias("total"))
    df = df.join(population.select("region", "population"), "region", "left")
    pop_sum = df.agg(F.sum("population").alias("__pop_sum"))
    df = with_scalars(df, pop_sum).withColumn(
        "population", F.when(F.col("region") == total_label, F.col("__pop_sum")).otherwise(F.col("population")))
    df = df.withColumn("perc", F.try_divide(F.col("total"), F.col("population")) * 100.0)
    out = df.select("region", F.col("population").cast("long").alias("population"), "total",
                    (F.col("population") * (F.col("perc") / 100.0)).alias("number_of_people"), "perc")
    return arrange(out, [F.desc_nulls_last("perc"), F.asc("region")])


def map_data(supply: DataFrame, supplied: DataFrame) -> DataFrame:
    """(area, annual_catch, WRA %) per region (the map table)."""
    return (supply.select("region", "catch").join(supplied.select("region", "perc"), "region", "left")
            .select(F.col("region").alias("area"), F.col("catch").alias("annual_catch"), F.col("perc").alias("WRA")))


def summary_table(adjusted: DataFrame, population: DataFrame, rdi: DataFrame, year: int,
                  rdi_share: float = 0.20, total_label: str = "All") -> DataFrame:
    """Annual nutrient supply, people supplied daily and share of population per
    region and nutrient for one year, with an all-region row per nutrient."""
    r = rdi.withColumn("conv_factor", F.col("conv_factor") * F.lit(rdi_share)) if rdi_share != 1.0 else rdi
    m = monthly_totals(adjusted, [year])
    # per-region rows and the all-region row from one ROLLUP; grouping_id (not
    # IS NULL) labels the total, so a real NULL region is never merged into it
    g = m.rollup("year", "region").agg(*[strict_sum(c).alias(c) for c in L.NUTRIENTS],
                                       F.grouping_id("year", "region").alias("__gid"))
    g = (g.where(F.col("__gid") <= 1)
         .withColumn("region", F.when(F.col("__gid") == 1, F.lit(total_label)).otherwise(F.col("region")))
         .drop("__gid"))
    nut = g.unpivot(["region", "year"], L.NUTRIENTS, "nutrient", "kg")
    tab = (nut.join(population.select("region", "population"), "region", "left")
           .join(F.broadcast(r.select("nutrient", "conv_factor")), "nutrient", "left"))
    rni = F.col("conv_factor") / 1000.0
    people = F.try_divide(F.col("kg"), rni) / 365.0
    pct = F.try_divide(people, F.col("population")) * 100.0
    tab = tab.select(
        "region", "nutrient", "population",
        F.bround(F.col("kg"), 4).alias("annual_kg"),
        F.bround(people, 3).alias("people_supplied_daily"),
        F.bround(pct, 3).alias("percent_population_supplied"))
    label = F.concat(F.col("region"), F.lit(" ("), F.coalesce(comma_format("population"), F.lit("NA")), F.lit(")"))
    return tab.select(label.alias("region"), "nutrient", "annual_kg", "people_supplied_daily",
                      "percent_population_supplied")


def summary_wide(summary: DataFrame, population: DataFrame) -> DataFrame:
    """Wide percent-of-population table: one column per nutrient (without selenium),
    ``total`` over the six, region label stripped of its population suffix."""
    all_n = (summary.where(F.col("nutrient") != "selenium").groupBy("region")
             .agg(strict_sum("percent_population_supplied").alias("percent_population_supplied"))
             .withColumn("nutrient", F.lit("total")))
    long = summary.select("region", "nutrient", "percent_population_supplied").unionByName(all_n)
    levels = L.NUTRIENTS_NO_SE + ["total"]
    wide = long.groupBy("region").agg(*[
        F.max(F.when(F.col("nutrient") == n, F.col("percent_population_supplied"))).alias(n) for n in levels])
    wide = wide.withColumn("region", str_remove_first("region", r"\s*\([^)]*\)"))
    return wide.join(population.select("region", "population"), "region", "left")


def log_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(log(x+1) - min) / (max - min)`` per column (the table's colour score).

    Min and max are one aggregate row; a constant column gives NULL.
    """
    lg = {c: F.log1p(F.col(c)) for c in cols}
    mm = df.agg(*[F.min(lg[c]).alias(f"__mn_{c}") for c in cols], *[F.max(lg[c]).alias(f"__mx_{c}") for c in cols])
    out = with_scalars(df, mm)
    out = out.withColumns({f"{c}_score": F.try_divide(lg[c] - F.col(f"__mn_{c}"),
                                                      F.col(f"__mx_{c}") - F.col(f"__mn_{c}")) for c in cols})
    return out.drop(*[f"__mn_{c}" for c in cols], *[f"__mx_{c}" for c in cols])


__all__ = ["region_yields", "edible_adjusted", "wra_population", "monthly_totals", "mean_annual_supply",
           "population_supplied", "map_data", "summary_table", "summary_wide", "log_minmax", "add_total_row"]
