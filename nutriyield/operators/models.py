"""Profile classifier: splits, recipe steps, boosted trees, tuning, evaluation.

Training uses Spark ML; every evaluation metric is a DataFrame aggregate over
the predictions table (truth, predicted class, one probability per class), so
the same numbers can be reproduced in SQL.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nutriyield.operators.verbs import bucketed_rank, hash_key, with_hash_cut, with_scalars
from nutriyield.session import cut_lineage

# --------------------------------------------------------------------------- splits (ML-4, ML-5)


def stratified_split(df: DataFrame, label: str, id_cols: Sequence[str], prop: float = 0.8,
                     seed: int = 234) -> DataFrame:
    """Adds ``split`` = train/test: per stratum the first floor(prop * n) rows by
    md5(seed, id) train.  Each stratum's cut is a threshold; no row is ranked or moved."""
    x = with_hash_cut(df.withColumn("__h", hash_key(seed, *id_cols)), [label], prop, "__h", list(id_cols))
    return x.withColumn("split", F.when(F.col("__in"), F.lit("train")).otherwise(F.lit("test"))).drop("__h", "__in")


def stratified_folds(df: DataFrame, label: str, id_cols: Sequence[str], v: int = 10, seed: int = 567) -> DataFrame:
    """Adds ``fold`` in 0..v-1: rows of each stratum dealt round-robin in hash order."""
    x = df.withColumn("__h", hash_key(seed, *id_cols))
    x = bucketed_rank(x, [label], "__h", tie_cols=list(id_cols))
    return x.withColumn("fold", ((F.col("__pos") - 1) % v).cast("int")).drop("__h", "__pos")


# --------------------------------------------------------------------------- recipe steps (ML-6..9)


def drop_zero_variance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop numeric columns with a single distinct non-NULL value (one aggregate)."""
    row = df.agg(*[(F.min(c) == F.max(c)).alias(c) for c in cols]).first()
    drop = [c for c in cols if row[c] is None or row[c]]
    return df.drop(*drop)


def lump_rare(df: DataFrame, cols: Sequence[str], threshold: float = 0.05, other: str = "other") -> DataFrame:
    """Levels whose share of rows is below ``threshold`` become ``other``.

    Per column, level counts are a partial/final aggregate joined back (level
    tables are small; AQE picks the join)."""
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    out = df
    for c in cols:
        share = with_scalars(df.groupBy(c).agg(F.count(F.lit(1)).alias("__k")), n) \
            .select(c, (F.col("__k") / F.col("__n")).alias(f"__s_{c}"))
        out = out.join(share, out[c].eqNullSafe(share[c]), "left").drop(share[c])
        out = out.withColumn(c, F.when(F.col(f"__s_{c}") < threshold, F.lit(other)).otherwise(F.col(c))) \
            .drop(f"__s_{c}")
    return out


def dummies(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Treatment (dummy) coding: one 0/1 column per level except the first
    (alphabetical), named ``{col}_{level}``.  Level lists are collected (they
    are the column's distinct categories, not data)."""
    out = df
    for c in cols:
        levels = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect())
        for lv in levels[1:]:
            name = f"{c}_{lv}".replace(" ", "_").replace(".", "_")
            out = out.withColumn(name, (F.col(c) == F.lit(lv)).cast("double"))
        out = out.drop(c)
    return out


def average_ranks(long: DataFrame, keys: Sequence[str], value: str, ranges: int = 1000) -> DataFrame:
    """(keys, value, rank): the average rank of each distinct value of a group, ties sharing theirs.

    Equal values are counted before they move, so a hot value is one row.  Distinct
    values are dealt into value ranges (approximate quantiles, any bounds give the
    same ranks); range totals become offsets, and only one range is ordered together.
    """
    keys = list(keys)
    counts = long.groupBy(*keys, F.col(value).alias("v")).agg(F.sum("n").alias("n"))
    q = [i / ranges for i in range(1, ranges)]
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("v", q, 10 * ranges).alias("cuts"))  # ranges numbers a group
    placed = counts.join(F.broadcast(cuts), keys).withColumn("at", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    totals = placed.groupBy(*keys, "at").agg(F.sum("n").alias("t"))
    # at most ``ranges`` rows a group
    before = totals.withColumn("before", F.sum("t").over(Window.partitionBy(*keys).orderBy("at")) - F.col("t")).drop("t")
    upto = F.sum("n").over(Window.partitionBy(*keys, "at").orderBy("v"))
    ranked = placed.join(before, [*keys, "at"]).withColumn("upto", upto)
    return ranked.select(*keys, F.col("v").alias(value), (F.col("before") + F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))


def spearman_matrix(df: DataFrame, cols: Sequence[str], salts: int = 16) -> DataFrame:
    """(a, b, rho) for every two of ``cols``, a before b; NULL where a column is constant.

    Rows with a NULL or NaN in one of them are left out.  Rows that agree in all
    columns count as one tuple with a weight; tuples meet the ranks of their values
    in a join whose hot values are spread by a salt, and centred products are summed.
    """
    cols = list(cols)
    x = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{j}") for j, c in enumerate(cols)])
    x = x.where(" AND ".join(f"c{j} IS NOT NULL AND NOT isnan(c{j})" for j in range(len(cols))))
    x = x.select(*[(F.col(f"c{j}") + 0.0).alias(f"c{j}") for j in range(len(cols))])  # -0 is 0
    tuples = x.groupBy(*x.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("cell", F.md5(F.to_json(F.struct(*x.columns))))
    tuples = cut_lineage(tuples)
    long = tuples.unpivot(["cell", "n"], x.columns, "var", "v")
    ranks = average_ranks(long, ["var"], "v").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    long = long.withColumn("salt", F.pmod(F.xxhash64("cell"), F.lit(salts)).cast("int"))
    per = long.join(ranks, ["var", "v", "salt"]).groupBy("cell", "n").agg(*[F.max(F.when(F.col("var") == c, F.col("rank"))).alias(c) for c in x.columns])
    per = with_scalars(per, tuples.agg(((F.sum("n") + 1) / 2).alias("mid")))
    pairs = [(a, b) for a in range(len(cols)) for b in range(a, len(cols))]
    s = per.agg(*[F.sum(F.col("n") * (F.col(f"c{a}") - F.col("mid")) * (F.col(f"c{b}") - F.col("mid"))).alias(f"s{a}_{b}") for a, b in pairs])
    rows = [F.struct(F.lit(cols[a]).alias("a"), F.lit(cols[b]).alias("b"), F.try_divide(F.col(f"s{a}_{b}"), F.sqrt(F.col(f"s{a}_{a}") * F.col(f"s{b}_{b}"))).alias("rho"))
            for a, b in pairs if a < b]
    return s.select(F.inline(F.array(*rows))) if rows else df.sparkSession.createDataFrame([], "a string, b string, rho double")


def drop_correlated(df: DataFrame, cols: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """Remove numeric columns so no pair exceeds |rank correlation| > threshold.

    The filter works on the d x d matrix: for each pair above the cut-off, the
    column with the larger mean absolute correlation goes.  A constant column has
    no correlation with another."""
    cols = list(cols)
    m = {c: {c: 1.0} for c in cols}
    for r in spearman_matrix(df, cols).collect():  # d (d - 1) / 2 rows
        m[r["a"]][r["b"]] = m[r["b"]][r["a"]] = r["rho"] or 0.0
    avg = {c: sum(abs(v) for v in m[c].values()) / len(cols) for c in cols}
    drop: list[str] = []
    for j, b in enumerate(cols):
        for a in cols[:j]:
            if abs(m[a][b]) > threshold:
                worse = b if avg[b] > avg[a] else a
                if worse not in drop:
                    drop.append(worse)
    return df.drop(*drop)


# --------------------------------------------------------------------------- classifier (ML-11..14)


def _feature_stages(cat_cols: Sequence[str], num_cols: Sequence[str]):
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep", stringOrderType="alphabetAsc")
           for c in cat_cols]
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in cat_cols], outputCols=[f"{c}__ohe" for c in cat_cols],
                        dropLast=False, handleInvalid="keep")
    va = VectorAssembler(inputCols=[f"{c}__ohe" for c in cat_cols] + list(num_cols), outputCol="features",
                         handleInvalid="keep")
    return idx + [ohe, va]


class ProfileClassifier:
    """Multiclass profile classifier returning one probability per class.

    ``kind="gbt"``: one binary gradient-boosted model per class (Spark's GBT is
    binary), probabilities normalised to sum to one; ``kind="rf"``: a native
    multiclass random forest.
    """

    def __init__(self, cat_cols, num_cols, label: str = "cluster", kind: str = "gbt", params: dict | None = None,
                 seed: int = 891):
        self.cat_cols, self.num_cols, self.label = list(cat_cols), list(num_cols), label
        self.kind, self.params, self.seed = kind, dict(params or {}), seed
        self.classes: list[str] = []
        self.models = []

    def _estimator(self, label_col: str):
        from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
        p = self.params
        if self.kind == "rf":
            return RandomForestClassifier(labelCol=label_col, featuresCol="features", seed=self.seed,
                                          numTrees=int(p.get("trees", 100)), maxDepth=int(p.get("tree_depth", 6)),
                                          minInstancesPerNode=int(p.get("min_n", 1)),
                                          subsamplingRate=float(p.get("sample_size", 1.0)))
        return GBTClassifier(labelCol=label_col, featuresCol="features", seed=self.seed,
                             maxIter=int(p.get("trees", 20)), maxDepth=int(p.get("tree_depth", 5)),
                             minInstancesPerNode=int(p.get("min_n", 1)),
                             minInfoGain=float(p.get("loss_reduction", 0.0)),
                             subsamplingRate=float(p.get("sample_size", 1.0)),
                             stepSize=float(p.get("learn_rate", 0.1)),
                             featureSubsetStrategy=str(p.get("mtry", "all")))

    def fit(self, train: DataFrame) -> "ProfileClassifier":
        from pyspark.ml import Pipeline
        self.classes = sorted(r[0] for r in train.select(self.label).distinct().collect())  # k labels
        prep = Pipeline(stages=_feature_stages(self.cat_cols, self.num_cols)).fit(train)
        x = prep.transform(train)
        self.prep = prep
        attrs = x.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
        names = {}
        for group in attrs.values():
            for a in group:
                names[a["idx"]] = a["name"]
        self.feature_names = [names.get(j, f"f{j}") for j in range(len(names))]
        if self.kind == "rf":
            from pyspark.ml.feature import StringIndexer
            self.lab_idx = StringIndexer(inputCol=self.label, outputCol="__y", stringOrderType="alphabetAsc").fit(x)
            self.models = [self._estimator("__y").fit(self.lab_idx.transform(x))]
        else:
            self.models = [self._estimator("__y").fit(x.withColumn("__y", (F.col(self.label) == c).cast("double")))
                           for c in self.classes]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``pred_<class>`` probabilities and ``pred_class`` (argmax, ties to the first class)."""
        from pyspark.ml.functions import vector_to_array
        x = self.prep.transform(df)
        if self.kind == "rf":
            y = self.models[0].transform(x).withColumn("__p", vector_to_array("probability"))
            probs = {c: F.col("__p")[i] for i, c in enumerate(self.classes)}
            y = y.select(*df.columns, *[probs[c].alias(f"pred_{c}") for c in self.classes])
        else:
            y = x
            for c, m in zip(self.classes, self.models):
                m = m.copy()
                m.setProbabilityCol(f"__prob_{c}").setRawPredictionCol(f"__raw_{c}").setPredictionCol(f"__pr_{c}")
                y = m.transform(y).withColumn(f"__p_{c}", vector_to_array(f"__prob_{c}")[1])
            tot = None
            for c in self.classes:
                tot = F.col(f"__p_{c}") if tot is None else tot + F.col(f"__p_{c}")
            y = y.select(*df.columns, *[(F.col(f"__p_{c}") / tot).alias(f"pred_{c}") for c in self.classes])
        best = F.array_max(F.array(*[F.struct(F.col(f"pred_{c}").alias("p"), F.lit(-i).alias("neg_i"),
                                              F.lit(c).alias("c")) for i, c in enumerate(self.classes)]))
        return y.withColumn("pred_class", best["c"])

    def feature_importance(self) -> list[tuple[str, float]]:
        """(encoded feature, importance), averaged over the per-class models."""
        acc = [0.0] * len(self.feature_names)
        for m in self.models:
            for j, v in enumerate(m.featureImportances.toArray()):
                if j < len(acc):
                    acc[j] += float(v) / len(self.models)
        return list(zip(self.feature_names, acc))


def lhs_grid(n: int = 20, seed: int = 42, n_features: int = 5) -> list[dict]:
    """Latin-hypercube grid over the eight boosted-tree settings (dials ranges);
    ``n`` driver-side rows, one stratified draw per parameter and row."""
    rng = random.Random(seed)
    ranges = {
        "trees": (1, 2000, "int"), "tree_depth": (1, 15, "int"), "min_n": (2, 40, "int"),
        "loss_reduction": (-10.0, 1.5, "log10"), "sample_size": (0.1, 1.0, "float"),
        "learn_rate": (-10.0, -1.0, "log10"), "stop_iter": (3, 20, "int"), "mtry": (1, n_features, "int"),
    }
    cols = {}
    for k, (lo, hi, kind) in ranges.items():
        perm = list(range(n))
        rng.shuffle(perm)
        vals = []
        for i in range(n):
            u = (perm[i] + rng.random()) / n
            v = lo + u * (hi - lo)
            vals.append(int(round(v)) if kind == "int" else (10 ** v if kind == "log10" else v))
        cols[k] = vals
    grid = [{k: cols[k][i] for k in ranges} for i in range(n)]
    for g in grid:
        g["mtry"] = str(max(1, min(n_features, int(g["mtry"]))))
    return grid


def tune(train: DataFrame, folds_col: str, make, grid: Sequence[dict], label: str = "cluster",
         parallelism: int = 4):
    """Grid search over folds; the mean Hand-Till AUC per grid point is kept on
    the driver (one number per point).

    Every (grid point, fold) fit is an independent distributed job; like Spark
    ML's ``CrossValidator(parallelism=n)``, up to ``parallelism`` of them are
    submitted at once from driver threads and share the executors.
    """
    from concurrent.futures import ThreadPoolExecutor
    from nutriyield.session import cut_lineage
    # read by every fit and every scoring: written once to the shared checkpoint
    # folder, so concurrent jobs neither race to compute it nor replay its lineage
    train = cut_lineage(train)
    folds = sorted(r[0] for r in train.select(folds_col).distinct().collect())

    def one(task):
        params, f = task
        tr = train.where(F.col(folds_col) != f)
        te = train.where(F.col(folds_col) == f)
        model = make(params).fit(tr)
        pred = model.transform(te).persist()  # scored once, read by every class pair
        try:
            return roc_auc_hand_till(pred, label, model.classes).first()["estimate"]
        finally:
            pred.unpersist()

    tasks = [(params, f) for params in grid for f in folds]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        aucs = list(pool.map(one, tasks))
    results = []
    for gi in range(len(grid)):
        a = [x for x in aucs[gi * len(folds):(gi + 1) * len(folds)] if x is not None]
        # folds without a usable class pair count neither in the sum nor in the number
        results.append((gi, float(sum(a) / len(a)) if a else float("nan")))
    best = max(results, key=lambda r: (-1.0 if r[1] != r[1] else r[1], -r[0]))
    return grid[best[0]], results


# --------------------------------------------------------------------------- evaluation (ML-15..18)


def confusion(pred: DataFrame, truth: str, classes: Sequence[str], pred_col: str = "pred_class") -> DataFrame:
    """Long confusion matrix (prediction, truth, n), zero-filled over all class pairs."""
    cnt = pred.groupBy(F.col(pred_col).alias("prediction"), F.col(truth).alias("truth")).agg(
        F.count(F.lit(1)).alias("n"))
    spark = pred.sparkSession
    grid = spark.createDataFrame([(p, t) for p in classes for t in classes], "prediction string, truth string")
    return grid.join(cnt, ["prediction", "truth"], "left").select(
        "prediction", "truth", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _mann_whitney(pred: DataFrame, truth: str, pos: str, neg: str, score: str, buckets: int = 65536) -> DataFrame:
    """U statistic of ``score`` for class ``pos`` above class ``neg`` (ties 1/2).

    Counts per distinct score are pre-aggregated; prefix counts come from fixed
    score buckets (a window over at most ``buckets`` rows), then within a bucket."""
    x = (pred.where(F.col(truth).isin(pos, neg))
         .groupBy(F.col(score).alias("s"))
         .agg(F.count(F.when(F.col(truth) == pos, 1)).alias("np"), F.count(F.when(F.col(truth) == neg, 1)).alias("nn")))
    x = x.withColumn("b", F.least(F.floor(F.col("s") * buckets), F.lit(buckets - 1)).cast("int"))
    bc = x.groupBy("b").agg(F.sum("nn").alias("bn"))
    bc = bc.withColumn("off", F.sum("bn").over(Window.orderBy("b")) - F.col("bn"))  # <= buckets rows
    x = x.join(bc.select("b", "off"), "b")
    w = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("below", F.col("off") + F.coalesce(F.sum("nn").over(w), F.lit(0)))
    return x.agg(F.sum(F.col("np") * (F.col("below") + 0.5 * F.col("nn"))).alias("u"),
                 F.sum("np").alias("n_pos"), F.sum("nn").alias("n_neg"))


def roc_auc_hand_till(pred: DataFrame, truth: str, classes: Sequence[str]) -> DataFrame:
    """Multiclass ROC AUC of Hand and Till: mean over class pairs of the averaged
    pairwise AUCs A(i|j), A(j|i) (probability columns ``pred_<class>``)."""
    parts = None
    for i, a in enumerate(classes):
        for b in classes[i + 1:]:
            u1 = _mann_whitney(pred, truth, a, b, f"pred_{a}")
            u2 = _mann_whitney(pred, truth, b, a, f"pred_{b}")
            # a class without rows makes its pairs NULL, and the mean is over the others
            a1 = u1.select(F.try_divide(F.col("u"), F.col("n_pos") * F.col("n_neg")).alias("a1"))
            a2 = u2.select(F.try_divide(F.col("u"), F.col("n_pos") * F.col("n_neg")).alias("a2"))
            pair = with_scalars(a1, a2).select(((F.col("a1") + F.col("a2")) / 2.0).alias("a"))
            parts = pair if parts is None else parts.unionByName(pair)
    return parts.agg(F.avg("a").alias("estimate")).select(F.lit("roc_auc").alias("metric"), "estimate")


def roc_curves(pred: DataFrame, truth: str, classes: Sequence[str], buckets: int = 65536) -> DataFrame:
    """One-vs-all ROC points per class: at each distinct score threshold, share
    of positives / negatives at or above it (sensitivity, 1 - specificity).

    Counts above come from fixed score buckets (a window over at most
    ``buckets`` rows), then from a window inside one bucket."""
    out = None
    for c in classes:
        x = (pred.groupBy(F.col(f"pred_{c}").alias("threshold"))
             .agg(F.count(F.when(F.col(truth) == c, 1)).alias("tp"), F.count(F.when(F.col(truth) != c, 1)).alias("fp")))
        x = x.withColumn("b", F.least(F.floor(F.col("threshold") * buckets), F.lit(buckets - 1)).cast("int"))
        per = x.groupBy("b").agg(F.sum("tp").alias("__tp"), F.sum("fp").alias("__fp"))
        above = Window.orderBy(F.col("b").desc())  # <= buckets rows
        per = per.select("b", *[(F.sum(f"__{k}").over(above) - F.col(f"__{k}")).alias(f"__{k}") for k in ("tp", "fp")])
        tot = x.agg(F.sum("tp").alias("P"), F.sum("fp").alias("N"))
        w = Window.partitionBy("b").orderBy(F.col("threshold").desc())
        x = x.join(per, "b").select("threshold", *[(F.col(f"__{k}") + F.sum(k).over(w)).alias(f"c{k}") for k in ("tp", "fp")])
        x = with_scalars(x, tot).select(
            F.lit(c).alias("level"), "threshold",
            F.try_divide(F.col("ctp"), F.col("P")).alias("sensitivity"),
            (F.lit(1.0) - F.try_divide(F.col("cfp"), F.col("N"))).alias("specificity"))
        out = x if out is None else out.unionByName(x)
    return out


def classification_metrics(conf: DataFrame) -> DataFrame:
    """Macro-averaged metric set from a long confusion table (prediction, truth, n).

    accuracy, kappa, mcc are multiclass forms; the rest are per-class values
    averaged over classes.  All computed on the k x k table.
    """
    n = conf.agg(F.sum("n").cast("double").alias("N"))
    diag = conf.where(F.col("prediction") == F.col("truth")).groupBy(F.col("truth").alias("c")).agg(F.sum("n").alias("tp"))
    t = conf.groupBy(F.col("truth").alias("c")).agg(F.sum("n").alias("t"))
    p = conf.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("p"))
    per = with_scalars(diag.join(t, "c").join(p, "c"), n).select(
        "c", *[F.col(x).cast("double").alias(x) for x in ("tp", "t", "p")], "N")
    per = per.select("c", "tp", "t", "p", "N",
                     (F.col("p") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"))
    per = per.withColumn("tn", F.col("N") - F.col("tp") - F.col("fp") - F.col("fn"))
    sens = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    spec = F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))
    ppv = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    npv = F.try_divide(F.col("tn"), F.col("tn") + F.col("fn"))
    per = per.select("*", sens.alias("sens"), spec.alias("spec"), ppv.alias("ppv"), npv.alias("npv"))
    f1 = F.try_divide(2 * F.col("ppv") * F.col("sens"), F.col("ppv") + F.col("sens"))
    agg = per.agg(
        (F.sum("tp") / F.first("N")).alias("accuracy"),
        F.avg("sens").alias("sens"), F.avg("spec").alias("spec"), F.avg("ppv").alias("ppv"),
        F.avg("npv").alias("npv"), F.avg(F.col("sens") + F.col("spec") - 1).alias("j_index"),
        F.avg((F.col("sens") + F.col("spec")) / 2).alias("bal_accuracy"),
        F.avg(F.col("p") / F.col("N")).alias("detection_prevalence"),
        F.avg("ppv").alias("precision"), F.avg("sens").alias("recall"), F.avg(f1).alias("f_meas"),
        F.first("N").alias("N"), F.sum("tp").alias("sum_tp"), F.sum(F.col("p") * F.col("t")).alias("sum_pt"),
        F.sum(F.col("p") * F.col("p")).alias("sum_pp"), F.sum(F.col("t") * F.col("t")).alias("sum_tt"))
    po = F.col("sum_tp") / F.col("N")
    pe = F.col("sum_pt") / (F.col("N") * F.col("N"))
    kappa = F.try_divide(po - pe, F.lit(1.0) - pe)
    mcc = F.try_divide(F.col("N") * F.col("sum_tp") - F.col("sum_pt"),
                       F.sqrt((F.col("N") * F.col("N") - F.col("sum_pp")) * (F.col("N") * F.col("N") - F.col("sum_tt"))))
    agg = agg.withColumn("kappa", kappa).withColumn("mcc", mcc)
    names = ["accuracy", "kappa", "sens", "spec", "ppv", "npv", "mcc", "j_index", "bal_accuracy",
             "detection_prevalence", "precision", "recall", "f_meas"]
    return agg.unpivot([], names, "metric", "estimate")


def metric_report(per_model: dict[str, DataFrame], digits: int = 2) -> DataFrame:
    """Metrics of several models side by side (one column per model), rounded."""
    out = None
    for name, m in per_model.items():
        d = m.select("metric", F.col("estimate").alias("estimate")).withColumn("model", F.lit(name))
        out = d if out is None else out.unionByName(d)
    models = list(per_model)
    return out.groupBy("metric").agg(*[F.bround(F.max(F.when(F.col("model") == m, F.col("estimate"))), digits).alias(m)
                                       for m in models])


def importance_by_feature(importance: DataFrame, rules: Sequence[tuple[str, str]], model: str,
                          titles: dict | None = None) -> DataFrame:
    """Sum importance by source feature: the first rule whose pattern the encoded
    name contains gives the category (order matters), else ``other``."""
    cat = None
    for pat, name in rules:
        cat = F.when(F.col("variable").contains(pat), F.lit(name)) if cat is None else \
            cat.when(F.col("variable").contains(pat), F.lit(name))
    g = importance.withColumn("category", cat.otherwise(F.lit("other"))).groupBy("category") \
        .agg(F.sum("importance").alias("aggregated_importance"))
    g = g.withColumn("model", F.lit(model))
    if titles:
        e = F.col("category")
        for a, b in titles.items():
            e = F.when(F.col("category") == a, F.lit(b)).otherwise(e)
        g = g.withColumn("category", F.initcap(F.regexp_replace(e, "^(.*?)_", "$1 ")))
    return g

