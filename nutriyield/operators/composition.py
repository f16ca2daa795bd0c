"""Nutrient composition tables (rename rules, food-composition recode, taxon table)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nutriyield.operators.verbs import anti_in, dedupe_first, exact_median_by, with_scalars
from nutriyield.session import cut_lineage
from nutriyield.sources import literals as L


def nutrient_name(name: str, hyphen: bool = False) -> str:
    """Rename rule for one column name: lower-case, strip a trailing ``_mu``,
    then ``omega_3`` and ``vitamin_a`` anywhere in the name."""
    n = re.sub(r"_mu$", "", name.lower())
    n = n.replace("omega_3", "omega-3" if hyphen else "omega3")
    return n.replace("vitamin_a", "vitamin-A" if hyphen else "vitaminA")


def rename_nutrients(df: DataFrame, hyphen: bool = False) -> DataFrame:
    """Rename every column by :func:`nutrient_name` (metadata only, no data pass)."""
    return df.withColumnsRenamed({c: nutrient_name(c, hyphen) for c in df.columns
                                  if nutrient_name(c, hyphen) != c})


def fao_composition(raw: DataFrame) -> DataFrame:
    """Raw-state invertebrate rows of the food-composition table, recoded to
    the six catch codes, with nutrient columns renamed.  Not aggregated."""
    code = F.col("interagency_code")
    recode = None
    for target, codes in L.FAO_GROUPS:
        recode = (F.when(code.isin(codes), F.lit(target)) if recode is None
                  else recode.when(code.isin(codes), F.lit(target)))
    all_codes = [c for _, codes in L.FAO_GROUPS for c in codes]
    df = (raw.withColumnRenamed("integragency_code", "interagency_code")
          .where(F.col("food_state") == "r")
          .where(code.isin(all_codes))
          .withColumn("interagency_code", recode.otherwise(code)))
    return df.select("interagency_code", *[F.col(f"`{src}`").alias(dst) for src, dst in L.FAO_RENAME])


_MG = ["Zinc_mu", "Calcium_mu", "Iron_mu"]
_MCG = ["Selenium_mu", "Vitamin_A_mu"]
_G = ["Omega_3_mu", "Protein_mu"]


def convert_units(df: DataFrame) -> DataFrame:
    """mg/100g, mcg/100g and g/100g to kg per kg of catch."""
    exprs = {c: F.col(c) / 1000.0 / 100.0 for c in _MG}
    exprs.update({c: F.col(c) / 1000000.0 / 100.0 for c in _MCG})
    exprs.update({c: F.col(c) / 1.0 / 100.0 for c in _G})
    return df.withColumns(exprs)


def nutrients_table(predictions: DataFrame, species: DataFrame, fao: DataFrame,
                    summarise: bool = True, convert: bool = True) -> DataFrame:
    """Nutrient concentration per catch code (fraction of mass).

    Species predictions right-joined to the species list, first row per
    (code, species), codes covered by the food-composition table replaced by it,
    flying fish (FLY) set to the median of the CLP/RAX/SDX rows, units
    converted, median per code, remaining NULLs imputed by the column median.
    """
    value_cols = ["Calcium", "Iron", "Omega3", "Protein", "Selenium", "VitaminA", "Zinc"]
    p = predictions.select("SpecCode", *value_cols)
    sp = species.select("SpecCode", "interagency_code")
    joined = p.join(sp, "SpecCode", "right").select("interagency_code", "SpecCode", *value_cols)
    first = dedupe_first(joined, ["interagency_code", "SpecCode"], value_cols)
    tab = first.select(
        "interagency_code",
        F.col("Selenium").alias("Selenium_mu"), F.col("Zinc").alias("Zinc_mu"),
        F.col("Protein").alias("Protein_mu"), F.col("Omega3").alias("Omega_3_mu"),
        F.col("Calcium").alias("Calcium_mu"), F.col("Iron").alias("Iron_mu"),
        F.col("VitaminA").alias("Vitamin_A_mu"))
    tab = (anti_in(tab, fao, "interagency_code")
           .unionByName(fao.select("interagency_code", *L.NUTRIENTS_MU))
           .where(F.col("interagency_code") != "FLY"))
    tab = cut_lineage(tab)  # each median reads its input twice
    fly = (exact_median_by(tab.where(F.col("interagency_code").isin(L.FLY_PROXIES)), [], L.NUTRIENTS_MU)
           .withColumn("interagency_code", F.lit("FLY")))
    tab = tab.unionByName(fly)
    if convert:
        tab = convert_units(tab)
    if summarise:
        tab = exact_median_by(tab, ["interagency_code"], L.NUTRIENTS_MU)
    return impute_median(tab, L.NUTRIENTS_MU)


def impute_median(df: DataFrame, cols) -> DataFrame:
    """``replace_na(x, median(x, na.rm=TRUE))`` per column, exact median.

    The medians are one aggregate row, attached as a scalar subquery.
    """
    df = cut_lineage(df)
    med = exact_median_by(df, [], cols).select(*[F.col(c).alias(f"__med_{c}") for c in cols])
    out = with_scalars(df, med)
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__med_{c}")) for c in cols}) \
        .drop(*[f"__med_{c}" for c in cols])


def nutrients_table_legacy(legacy: DataFrame, species: DataFrame, fao: DataFrame,
                           summarise: bool = True, convert: bool = True) -> DataFrame:
    """Older variant: a per-species ``*_mu`` table, no FLY inference, no imputation;
    final dedup keeps one row per (code, Selenium_mu)."""
    sp = species.select("SpecCode", "interagency_code")
    tab = (legacy.select("SpecCode", *L.NUTRIENTS_MU).join(sp, "SpecCode", "right")
           .select("interagency_code", *L.NUTRIENTS_MU))
    tab = anti_in(tab, fao, "interagency_code").unionByName(fao.select("interagency_code", *L.NUTRIENTS_MU))
    if convert:
        tab = convert_units(tab)
    if summarise:
        tab = exact_median_by(cut_lineage(tab), ["interagency_code"], L.NUTRIENTS_MU)
    rest = [c for c in L.NUTRIENTS_MU if c != "Selenium_mu"]
    return dedupe_first(tab, ["interagency_code", "Selenium_mu"], rest).select("interagency_code", *L.NUTRIENTS_MU)
