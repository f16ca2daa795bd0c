"""Functional groups, nutrient density and yield by group / habitat / gear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nutriyield.functions import str_to_title
from nutriyield.operators.composition import rename_nutrients
from nutriyield.operators.verbs import arrange, exact_median_by, top_n_with_ties, with_scalars
from nutriyield.sources import literals as L


def nutrient_title(c) -> Column:
    """Title-cased nutrient name with the two display fixes (Omega-3, Vitamin-A)."""
    t = str_to_title(c)
    out = None
    for src, dst in L.NUTRIENT_TITLES:
        out = F.when(t == src, F.lit(dst)) if out is None else out.when(t == src, F.lit(dst))
    return out.otherwise(t)


def fish_group(df: DataFrame, variant: str, code_col: str = "grouped_taxa",
               merge_label: str | None = None) -> DataFrame:
    """Functional group of each row's taxon code (classifier variant ``variant``).

    The lookup is a literal table (at most a few dozen codes), broadcast.
    A code in no list gets NULL.  With ``merge_label`` the four invertebrate
    groups become that label.
    """
    lk = L.fish_group_df(df.sparkSession, variant).withColumnRenamed("grouped_taxa", "__code")
    out = df.join(F.broadcast(lk), F.col(code_col) == F.col("__code"), "left").drop("__code")
    if merge_label:
        out = out.withColumn("fish_group", F.when(F.col("fish_group").isin(L.INVERTEBRATE_GROUPS),
                                                  F.lit(merge_label)).otherwise(F.col("fish_group")))
    return out


def mean_annual_catch(region_stats: DataFrame, catch_groups: DataFrame) -> DataFrame:
    """Mean annual catch per taxon in tonnes, with the display name."""
    per_year = (region_stats.withColumn("year", F.year("date_bin_start"))
                .groupBy("grouped_taxa", "year")
                .agg(F.when(F.count("catch") == F.count(F.lit(1)), F.sum("catch")).alias("catch")))
    mean = per_year.groupBy("grouped_taxa").agg(F.when(F.count("catch") == F.count(F.lit(1)),
                                                       F.avg("catch")).alias("catch"))
    names = catch_groups.select(F.col("interagency_code").alias("grouped_taxa"), "catch_name")
    return (mean.join(F.broadcast(names), "grouped_taxa", "left")
            .select("catch_name", (F.col("catch") / 1000.0).alias("catch")))


def density_by_taxon(nutrients: DataFrame, catch_groups: DataFrame, rdi: DataFrame,
                     annual_catch: DataFrame) -> DataFrame:
    """Share of daily needs per 100 g of each taxon, by nutrient, with its mean
    annual catch and functional group; taxa with no catch dropped."""
    names = catch_groups.select(F.col("interagency_code").alias("grouped_taxa"), "catch_name")
    base = rename_nutrients(nutrients.join(F.broadcast(names), "grouped_taxa", "left")
                            .select("catch_name", "grouped_taxa", *L.NUTRIENTS_MU))
    long = base.unpivot(["catch_name", "grouped_taxa"], L.NUTRIENTS, "nutrient", "concentration")
    long = long.where((F.col("nutrient") != "selenium")
                      & ~F.coalesce(F.col("catch_name").isin(["Other"]), F.lit(False)))
    long = (long.join(F.broadcast(rdi), "nutrient", "left")
            .withColumn("nutrient", nutrient_title("nutrient"))
            .withColumn("rdi", F.col("concentration") * 100.0 / F.col("conv_factor")))
    # partition total per name: groups are one taxon's six nutrients (bounded)
    long = long.withColumn("tot", F.coalesce(F.sum("rdi").over(Window.partitionBy("catch_name")), F.lit(0.0)))
    long = long.join(annual_catch, "catch_name", "left").withColumn("catch", F.coalesce("catch", F.lit(0.0)))
    long = fish_group(long, "taxon", merge_label="Marine invertebrates")
    return (long.where(F.col("catch") > 0)
            .select("catch_name", "grouped_taxa", "nutrient", "concentration", "conv_factor", "rdi", "tot",
                    F.col("catch").alias("catch_t"), "fish_group"))


def yield_by_group(yields: DataFrame, variant: str = "yield", merge_label: str = "Marine invertebrates",
                   with_labels: bool = True) -> DataFrame:
    """Total nutrient yield per functional group and nutrient (selenium dropped)."""
    g = fish_group(yields, variant)
    sums = (g.groupBy("fish_group").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
                                          for c in ["catch"] + L.NUTRIENTS])
            .where(F.col("fish_group").isNotNull()))
    long = sums.unpivot(["fish_group", "catch"], L.NUTRIENTS, "nutrient", "value")
    out = (long.where(F.col("nutrient") != "selenium")
           .withColumn("fish_group", F.when(F.col("fish_group").isin(L.INVERTEBRATE_GROUPS), F.lit(merge_label))
                       .otherwise(F.col("fish_group")))
           .withColumn("nutrient", nutrient_title("nutrient"))
           .select("fish_group", "nutrient", "value"))
    if with_labels:
        lab = F.broadcast(L.pairs_df(yields.sparkSession, L.FISH_LABELS, "fish_group", "fish_label"))
        out = out.join(lab, "fish_group", "left")
    return arrange(out, [F.desc_nulls_last("value"), F.asc("fish_group")], within=["nutrient"])


def top_taxon_per_group(yields: DataFrame, catch_groups: DataFrame) -> DataFrame:
    """Taxon with the largest share of total catch in each functional group (ties kept)."""
    tot = yields.agg(F.coalesce(F.sum("catch"), F.lit(0.0)).alias("tot_catch"))
    g = fish_group(yields.select("grouped_taxa", "catch"), "yield", merge_label="Marine invertebrates")
    per = g.groupBy("fish_group", "grouped_taxa").agg(F.coalesce(F.sum("catch"), F.lit(0.0)).alias("catch"))
    per = with_scalars(per, tot).withColumn("catch_percent", F.try_divide(F.col("catch"), F.col("tot_catch")) * 100.0)
    top = top_n_with_ties(per, ["fish_group"], F.col("catch_percent"), 1)
    top = top.where(F.col("fish_group").isNotNull() & F.col("catch_percent").isNotNull())
    return (top.join(F.broadcast(catch_groups.select("interagency_code", "catch_name")),
                     F.col("grouped_taxa") == F.col("interagency_code"), "left")
            .select("fish_group", "catch_name", F.col("grouped_taxa").alias("interagency_code"), "catch_percent"))


def density_by(trips: DataFrame, key: str, rdi: DataFrame, recode: dict | None = None,
               title_key: bool = False) -> DataFrame:
    """Median people-supplied score per kg by ``key`` (habitat or gear) and nutrient.

    Score per trip = (nutrient kg / catch weight * 1000) / RDI; the median over
    trips (exact, hot-group safe) / 10 * 100; selenium dropped.
    """
    rdi_row = rdi.groupBy().pivot("nutrient", L.NUTRIENTS_NO_SE).agg(F.first("conv_factor"))
    rdi_row = rdi_row.select(*[F.col(n).alias("__rdi_" + n) for n in L.NUTRIENTS_NO_SE])
    x = with_scalars(rename_nutrients(trips.select(key, "weight", *L.NUTRIENTS_MU)), rdi_row)
    # a trip of no weight has no score
    x = x.select(key, *[(F.try_divide(F.col(n), F.col("weight")) * 1000.0 / F.col("__rdi_" + n)).alias(n)
                        for n in L.NUTRIENTS_NO_SE])
    med = exact_median_by(x, [key], L.NUTRIENTS_NO_SE)
    long = med.unpivot([key], L.NUTRIENTS_NO_SE, "nutrient", "inds_kg")
    long = long.withColumn("inds_kg", F.col("inds_kg") / 10.0 * 100.0)
    if recode:
        e = F.col(key)
        for a, b in recode.items():
            e = F.when(F.col(key) == a, F.lit(b)).otherwise(e)
        long = long.withColumn(key, e)
    if title_key:
        long = long.withColumn(key, str_to_title(key))
    return long.withColumn("nutrient", nutrient_title("nutrient"))
