"""Exact Shapley values of class probabilities against a background sample.

With p predictors there are 2**p coalitions (p = 5 here, 32 coalitions), so
the kernel estimator is exact.  The value of a coalition S for a row x is the
mean model output over background rows b of the hybrid (x on S, b elsewhere).

Distributed plan: distinct feature tuples of the rows to explain (the model is
a function of the tuple, so duplicates share values) are expanded in-row over
the coalitions and the distinct background rows with their weights (both
bounded: 2**p and ``n_bg`` rows, attached as one broadcast row).  Equal hybrids
add up their weights before they move, each distinct hybrid is scored once by
the model in one ``transform``, and the scores are averaged per (tuple,
coalition, class) and combined with the Shapley weights inside each (tuple,
class) group of 2**p values.  The result is joined back to every row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nutriyield.operators.verbs import exact_median_by, global_top_n_with_ties, sample_n, with_scalars


def kernel_shap(model, df: DataFrame, features: Sequence[str], id_cols: Sequence[str], n_bg: int = 500,
                seed: int = 1) -> DataFrame:
    """Long SHAP table: (id..., class, feature, feature_value, shap), plus
    ``baseline`` (mean prediction over the background) for each class.

    ``model.transform`` must add ``pred_<class>`` columns; ``model.classes``
    lists the classes.
    """
    features = list(features)
    p = len(features)
    spark = df.sparkSession
    bg = sample_n(df.select(*id_cols, *features), id_cols, n_bg, seed).select(*features)
    bg = bg.groupBy(*features).agg(F.count(F.lit(1)).cast("double").alias("__w"))
    bg_row = bg.agg(F.collect_list(F.struct("*")).alias("__bg"))  # n_bg rows at most
    masks = spark.createDataFrame([(m,) for m in range(2 ** p)], "mask int") \
        .agg(F.collect_list("mask").alias("__masks"))
    tuples = df.select(*features).distinct()
    t = tuples.withColumn("__tid", F.md5(F.to_json(F.struct(*features))))
    x = with_scalars(with_scalars(t, bg_row), masks)  # two one-row frames
    x = x.select("__tid", *[F.col(f).alias(f"__x_{f}") for f in features],
                 F.explode("__masks").alias("mask"), "__bg")
    x = x.select("*", F.explode("__bg").alias("__b")).drop("__bg")
    hybrid = {f: F.when((F.col("mask").bitwiseAND(1 << j)) != 0, F.col(f"__x_{f}")).otherwise(F.col("__b")[f])
              for j, f in enumerate(features)}
    h = x.select("__tid", "mask", F.col("__b")["__w"].alias("__w"), F.struct(*[e.alias(f) for f, e in hybrid.items()]).alias("__s"))
    h = h.groupBy("__tid", "mask", "__s").agg(F.sum("__w").alias("__w")).withColumn("__hid", F.md5(F.to_json("__s")))
    classes = list(model.classes)
    scored = model.transform(h.groupBy("__hid").agg(F.first("__s").alias("__s")).select("__hid", "__s.*")) \
        .select("__hid", *[f"pred_{c}" for c in classes])
    v = h.join(scored, "__hid").groupBy("__tid", "mask").agg(
        *[(F.sum(F.col(f"pred_{c}") * F.col("__w")) / F.sum("__w")).alias(c) for c in classes])
    v = v.unpivot(["__tid", "mask"], classes, "class", "v")
    arr = v.groupBy("__tid", "class").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("mask", "v"))), lambda s: s["v"]).alias("__v"))
    weights = [math.factorial(s) * math.factorial(p - s - 1) / math.factorial(p) for s in range(p)]
    w_arr = F.array(*[F.lit(w) for w in weights])
    phis = []
    for j, f in enumerate(features):
        bit = 1 << j
        phi = F.aggregate(
            F.sequence(F.lit(0), F.lit(2 ** p - 1)), F.lit(0.0),
            lambda acc, s: acc + F.when((s.bitwiseAND(bit)) == 0,
                                        F.element_at(w_arr, F.bit_count(s) + 1)
                                        * (F.element_at(F.col("__v"), s.bitwiseOR(bit) + 1)
                                           - F.element_at(F.col("__v"), s + 1))).otherwise(F.lit(0.0)))
        phis.append(F.struct(F.lit(f).alias("feature"), phi.alias("shap")))
    res = arr.select("__tid", "class", F.element_at("__v", 1).alias("baseline"),
                     F.element_at("__v", 2 ** p).alias("prediction"), F.inline(F.array(*phis)))
    rows = df.select(*id_cols, *features).withColumn("__tid", F.md5(F.to_json(F.struct(*features))))
    out = rows.join(res, "__tid")
    fv = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("string"))])
    return out.select(*id_cols, "class", "feature", fv[F.col("feature")].alias("feature_value"), "shap",
                      "baseline", "prediction", *features)


def shap_for(shap: DataFrame, feature: str, keys: Sequence[str]) -> DataFrame:
    """One feature's SHAP values with chosen feature columns (picked by name)."""
    return shap.where(F.col("feature") == feature).select("class", *keys, "shap")


def shap_effects(shap: DataFrame, feature: str, keys: Sequence[str], recode: dict | None = None,
                 prefix: str = "FNP-") -> DataFrame:
    """Median SHAP of ``feature`` per (profile, keys), positive ones only."""
    s = shap_for(shap, feature, keys).withColumn("profile", F.concat(F.lit(prefix), F.col("class")))
    med = exact_median_by(s, ["profile", *keys], ["shap"]).where(F.col("shap") > 0)
    if recode:
        for col, (a, b) in recode.items():
            med = med.withColumn(col, F.when(F.col(col) == a, F.lit(b)).otherwise(F.col(col)))
    return med


def lump_near_zero(shap: DataFrame, level_col: str, value_col: str = "shap", n: int = 10,
                   other: str = "Others") -> DataFrame:
    """The ``n`` levels whose mean -|shap| is highest (closest to zero, ties kept)
    become ``other``.  Level means are one aggregate; the top-n is a global
    distributed top-n with a threshold."""
    lv = shap.groupBy(level_col).agg(F.avg(-F.abs(F.col(value_col))).alias("zero_dist"))
    top = global_top_n_with_ties(lv, "zero_dist", n).select(F.col(level_col).alias("__lv"))
    out = shap.join(top, shap[level_col] == top["__lv"], "left")
    return out.withColumn(level_col, F.when(F.col("__lv").isNotNull(), F.lit(other)).otherwise(F.col(level_col))) \
        .drop("__lv")
