"""Registered queries: splits, recipe steps, classifier, evaluation, SHAP."""

from __future__ import annotations

from pyspark.sql import functions as F

from nutriyield.functions import snap_doubles
from nutriyield.operators import boosting as BO
from nutriyield.operators import boosting_levels as BL
from nutriyield.operators import explain as EX
from nutriyield.operators import models as M
from nutriyield.operators import oversample as OS
from nutriyield.operators import profiles as PR
from nutriyield.operators.verbs import exact_median_by, separate, with_scalars
from nutriyield.plans import oracle as O
from nutriyield.plans.catalog import NUT6, register
from nutriyield.plans.catalog_domain import _clustered, _profile_sql
from nutriyield.plans.inputs import Inputs
from nutriyield.session import cut_lineage
from nutriyield.sources import driver as D

CL = D.SCORED_CLASSES

# ------------------------------------------------------------------ scored events (evaluation fixtures)


def _scored_sql() -> dict:
    raw = {c: f"(CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR)), {4 * i + 1}, 4)) AS INTEGER) + 1.0 + "
              f"CASE WHEN truth = '{c}' THEN 20000.0 ELSE 0.0 END)" for i, c in enumerate(CL)}
    tot = raw[CL[0]]
    for c in CL[1:]:
        tot = f"({tot} + {raw[c]})"
    types = " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in zip(D.SCORED_TYPES, CL))
    best = " ".join(f"WHEN pred_{c} >= greatest({', '.join(f'pred_{x}' for x in CL[i + 1:])}) THEN '{c}'" for i, c in enumerate(CL[:-1]))
    d = {
        "ev": f"SELECT event_id, CASE event_type {types} END AS truth FROM events",
        "sc0": "SELECT event_id, truth, " + ", ".join(f"{raw[c]} / {tot} AS pred_{c}" for c in CL)
               + " FROM ev WHERE truth IS NOT NULL",
        "scored": f"SELECT *, CASE {best} ELSE '{CL[-1]}' END AS pred_class FROM sc0",
        "classes": O.values([(c,) for c in CL], ["c"]),
        "conf": "SELECT p.c AS prediction, t.c AS truth, CAST(coalesce(x.n, 0) AS BIGINT) AS n "
                "FROM classes p CROSS JOIN classes t LEFT JOIN (SELECT pred_class, truth, count(*) AS n FROM scored "
                "GROUP BY 1, 2) x ON x.pred_class = p.c AND x.truth = t.c",
    }
    pairs = []
    for i, a in enumerate(CL):
        for b in CL[i + 1:]:
            for pos, neg in ((a, b), (b, a)):
                k = f"mw_{pos}_{neg}"
                d[k] = (f"SELECT sum(np * (below + 0.5 * nn)) / (sum(np) * sum(nn)) AS a FROM ("
                        f"SELECT s, np, nn, coalesce(sum(nn) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING "
                        f"AND 1 PRECEDING), 0) AS below FROM (SELECT pred_{pos} AS s, "
                        f"count(*) FILTER (WHERE truth = '{pos}') AS np, count(*) FILTER (WHERE truth = '{neg}') AS nn "
                        f"FROM scored WHERE truth IN ('{pos}', '{neg}') GROUP BY pred_{pos}) x) y")
            pairs.append(f"SELECT ((SELECT a FROM mw_{a}_{b}) + (SELECT a FROM mw_{b}_{a})) / 2.0 AS a")
    d["auc"] = "SELECT 'roc_auc' AS metric, avg(a) AS estimate FROM (" + " UNION ALL ".join(pairs) + ") p"
    d["roc"] = " UNION ALL ".join(
        f"SELECT '{c}' AS level, threshold, {O.dv('ctp', 'P')} AS sensitivity, 1.0 - {O.dv('cfp', 'N')} AS specificity "
        f"FROM (SELECT threshold, sum(tp) OVER (ORDER BY threshold DESC) AS ctp, "
        f"sum(fp) OVER (ORDER BY threshold DESC) AS cfp, sum(tp) OVER () AS P, sum(fp) OVER () AS N FROM "
        f"(SELECT pred_{c} AS threshold, count(*) FILTER (WHERE truth = '{c}') AS tp, "
        f"count(*) FILTER (WHERE truth <> '{c}') AS fp FROM scored GROUP BY pred_{c}) x) y" for c in CL)
    d["per"] = ("SELECT t.truth AS c, CAST(d.tp AS DOUBLE) AS tp, CAST(t.t AS DOUBLE) AS t, CAST(p.p AS DOUBLE) AS p, "
                "(SELECT CAST(sum(n) AS DOUBLE) FROM conf) AS N FROM "
                "(SELECT truth, sum(n) AS t FROM conf GROUP BY truth) t "
                "JOIN (SELECT prediction, sum(n) AS p FROM conf GROUP BY prediction) p ON t.truth = p.prediction "
                "JOIN (SELECT truth, sum(n) AS tp FROM conf WHERE prediction = truth GROUP BY truth) d "
                "ON t.truth = d.truth")
    d["per2"] = ("SELECT *, p - tp AS fp, t - tp AS fn, N - tp - (p - tp) - (t - tp) AS tn FROM per")
    d["per3"] = (f"SELECT *, {O.dv('tp', 'tp + fn')} AS sens, {O.dv('tn', 'tn + fp')} AS spec, "
                 f"{O.dv('tp', 'tp + fp')} AS ppv, {O.dv('tn', 'tn + fn')} AS npv FROM per2")
    d["m"] = (f"SELECT sum(tp) / first(N) AS accuracy, avg(sens) AS sens, avg(spec) AS spec, avg(ppv) AS ppv, "
              f"avg(npv) AS npv, avg(sens + spec - 1) AS j_index, avg((sens + spec) / 2) AS bal_accuracy, "
              f"avg(p / N) AS detection_prevalence, avg(ppv) AS precision, avg(sens) AS recall, "
              f"avg({O.dv('2 * ppv * sens', 'ppv + sens')}) AS f_meas, first(N) AS N, sum(tp) AS sum_tp, "
              f"sum(p * t) AS sum_pt, sum(p * p) AS sum_pp, sum(t * t) AS sum_tt FROM per3")
    d["m2"] = (f"SELECT *, {O.dv('sum_tp / N - sum_pt / (N * N)', '1.0 - sum_pt / (N * N)')} AS kappa, "
               f"{O.dv('N * sum_tp - sum_pt', 'sqrt((N * N - sum_pp) * (N * N - sum_tt))')} AS mcc FROM m")
    names = ["accuracy", "kappa", "sens", "spec", "ppv", "npv", "mcc", "j_index", "bal_accuracy",
             "detection_prevalence", "precision", "recall", "f_meas"]
    d["metrics"] = " UNION ALL ".join(f"SELECT '{n}' AS metric, {n} AS estimate FROM m2" for n in names)
    return d


@register("ml_confusion", O.with_base("SELECT * FROM conf", _scored_sql()))
def _conf(i: Inputs):
    """ML-15: zero-filled confusion matrix of a scored table."""
    return M.confusion(D.scored_events(i.t), "truth", CL)


@register("ml_roc_auc_hand_till", O.with_base(O.snap_select("SELECT * FROM auc", ["estimate"], ["metric"]),
                                              _scored_sql()))
def _auc(i: Inputs):
    """ML-16: multiclass ROC AUC (Hand-Till) from score-level counts."""
    return M.roc_auc_hand_till(D.scored_events(i.t), "truth", CL)


@register("ml_roc_curves", O.with_base(O.snap_select(
    "SELECT * FROM roc", ["threshold", "sensitivity", "specificity"], ["level"]), _scored_sql()))
def _roc(i: Inputs):
    """ML-17: one-vs-all ROC points per class."""
    return M.roc_curves(D.scored_events(i.t), "truth", CL)


@register("ml_classification_metrics", O.with_base(O.snap_select("SELECT * FROM metrics", ["estimate"], ["metric"]),
                                                   _scored_sql()))
def _metrics(i: Inputs):
    """ML-18: macro-averaged metric set from the confusion table."""
    return M.classification_metrics(M.confusion(D.scored_events(i.t), "truth", CL))


# ------------------------------------------------------------------ splits and recipe steps


def _frame(i: Inputs, gn: bool):
    return PR.model_frame(_clustered(i, gn), gn, keep=("landing_id",))


def _split_sql(gn: bool, seed: int = 234, prop: float = 0.8) -> dict:
    p = "gn_" if gn else "ag_"
    d = _profile_sql(gn)
    if gn:
        frame = (f"SELECT landing_id, CAST(quarter AS VARCHAR) AS quarter, habitat, coalesce(habitat, 'NA') || '_' || "
                 f"coalesce(CASE WHEN mesh_size = floor(mesh_size) THEN CAST(CAST(floor(mesh_size) AS BIGINT) "
                 f"AS VARCHAR) ELSE CAST(mesh_size AS VARCHAR) END, 'NA') AS habitat_mesh, mesh_size, vessel_type, "
                 f"clusters AS cluster FROM {p}clustered")
    else:
        frame = (f"SELECT landing_id, CAST(quarter AS VARCHAR) AS quarter, coalesce(habitat, 'NA') || '_' || "
                 f"coalesce(gear_type, 'NA') AS habitat_gear, habitat, gear_type, vessel_type, clusters AS cluster "
                 f"FROM {p}clustered")
    d["mframe"] = frame
    d["split"] = (f"SELECT * EXCLUDE (pos, n), CASE WHEN pos <= floor(n * {prop!r}) THEN 'train' ELSE 'test' END "
                  f"AS split FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY "
                  f"md5('{seed}|' || landing_id), landing_id) AS pos, count(*) OVER (PARTITION BY cluster) AS n "
                  f"FROM mframe) x")
    d["folds"] = ("SELECT * EXCLUDE (pos), CAST((pos - 1) % 10 AS INTEGER) AS fold FROM (SELECT *, row_number() OVER "
                  "(PARTITION BY cluster ORDER BY md5('567|' || landing_id), landing_id) AS pos FROM "
                  "(SELECT * EXCLUDE (split) FROM split WHERE split = 'train') t) x")
    return d


_GN_FRAME_COLS = ["landing_id", "quarter", "habitat", "habitat_mesh", "vessel_type", "cluster"]


@register("ml_stratified_split_gn", O.with_base(O.snap_select(
    "SELECT * FROM split", ["mesh_size"], _GN_FRAME_COLS + ["split"]), _split_sql(True)))
def _split(i: Inputs):
    """ML-4: stratified 80/20 split by cluster, hash-ordered within strata."""
    return M.stratified_split(_frame(i, True), "cluster", ["landing_id"], 0.8, 234)


@register("ml_stratified_folds_gn", O.with_base(O.snap_select(
    "SELECT * FROM folds", ["mesh_size"], _GN_FRAME_COLS + ["fold"]), _split_sql(True)))
def _folds(i: Inputs):
    """ML-5: stratified 10-fold assignment of the training rows."""
    tr = M.stratified_split(_frame(i, True), "cluster", ["landing_id"], 0.8, 234).where(F.col("split") == "train")
    return M.stratified_folds(tr.drop("split"), "cluster", ["landing_id"], 10, 567)


def _lump_sql() -> dict:
    d = _split_sql(False)
    cols = ["habitat_gear", "habitat", "gear_type"]
    sel = ", ".join(
        f"CASE WHEN (SELECT CAST(count(*) AS DOUBLE) FROM mframe y WHERE y.{c} IS NOT DISTINCT FROM x.{c}) / "
        f"(SELECT CAST(count(*) AS DOUBLE) FROM mframe) < 0.05 THEN 'other' ELSE x.{c} END AS {c}" for c in cols)
    d["lumped"] = f"SELECT x.landing_id, x.quarter, {sel}, x.vessel_type, x.cluster FROM mframe x"
    return d


@register("ml_lump_rare_ag", O.with_base("SELECT * FROM lumped", _lump_sql()))
def _lump(i: Inputs):
    """ML-8: levels under 5 % of rows pooled into "other"."""
    return M.lump_rare(_frame(i, False), ["habitat_gear", "habitat", "gear_type"], 0.05)


@register("ml_zero_variance_gn")
def _zv(i: Inputs):
    """ML-7: numeric predictors with one distinct value dropped."""
    return M.drop_zero_variance(_frame(i, True), ["mesh_size"])


@register("ml_correlation_filter_gn")
def _corr(i: Inputs):
    """ML-6: Spearman correlation filter (|r| > 0.7) over numeric features."""
    return M.drop_correlated(_clustered(i, True), CORR_COLS, 0.7)


CORR_COLS = ["mesh_size", "zinc", "protein", "omega3", "calcium", "iron", "vitaminA"]


def _spearman_sql() -> dict:
    d = _profile_sql(True)
    fine = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in CORR_COLS)
    d["sp_ranks"] = "SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in CORR_COLS) + f" FROM ({O.snap_select('SELECT * FROM gn_clustered', CORR_COLS, ['landing_id'])}) x WHERE {fine}"
    return d


@register("ml_spearman_matrix_gn", O.with_base(O.snap_select("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN min({a}) = max({a}) OR min({b}) = max({b}) THEN NULL ELSE corr({a}, {b}) END AS rho FROM sp_ranks"
    for j, a in enumerate(CORR_COLS) for b in CORR_COLS[j + 1:]) + ") u", ["rho"], ["a", "b"]), _spearman_sql()))
def _spearman(i: Inputs):
    """ML-6: rank correlations (ties share their average rank) behind the filter."""
    # ties must not hang on the last bits of sums made in another order
    return M.spearman_matrix(snap_doubles(_clustered(i, True).select(*CORR_COLS)), CORR_COLS)


@register("ml_dummies_gn")
def _dummies(i: Inputs):
    """ML-9: treatment coding of the nominal predictors."""
    return M.dummies(_frame(i, True), ["quarter", "habitat", "habitat_mesh", "vessel_type"])


def _smote_sql(gn: bool, k: int = 5, seed: int = 1) -> dict:
    p = "gn_" if gn else "ag_"
    d = _profile_sql(gn)
    unit = lambda tag: (f"CAST(('0x' || substr(md5('{seed}{tag}|' || id || '|' || CAST(number AS VARCHAR)), 1, 8)) AS BIGINT) "  # noqa: E731
                        f"/ 4294967296.0")
    far = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in NUT6)
    d["sm_rows"] = f"SELECT clusters AS label, landing_id AS id, {', '.join(NUT6)} FROM {p}clustered WHERE " + " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in NUT6)
    d["sm_n"] = "SELECT label, count(*) AS n FROM sm_rows GROUP BY label"
    d["sm_seeds"] = (f"SELECT r.*, n, (SELECT max(n) FROM sm_n) - n AS m, row_number() OVER (PARTITION BY r.label ORDER BY md5('{seed}|' || id), id) AS pos "
                     "FROM sm_rows r JOIN sm_n USING (label) WHERE n > 1")
    d["sm_made"] = "SELECT *, unnest(range(1, CAST(m // n + CASE WHEN pos <= m % n THEN 1 ELSE 0 END AS BIGINT) + 1)) AS number FROM sm_seeds WHERE m > 0"
    d["sm_near"] = (f"SELECT * FROM (SELECT a.id AS seed_id, b.id AS neighbour, row_number() OVER (PARTITION BY a.id ORDER BY {far}, b.id) AS nth, "
                    + ", ".join(f"b.{c} AS o_{c}" for c in NUT6) + " FROM sm_rows a JOIN sm_rows b ON a.label = b.label AND a.id <> b.id "
                    "JOIN sm_n ON sm_n.label = a.label WHERE n < (SELECT max(n) FROM sm_n)) t WHERE nth <= " + str(k))
    d["sm_pick"] = f"SELECT *, CAST(floor({unit('n')} * least({k}, n - 1)) AS BIGINT) + 1 AS nth, {unit('u')} AS u FROM sm_made"
    d["smote"] = ("SELECT id AS landing_id, CAST(number AS INTEGER) AS number, neighbour, label AS clusters, "
                  + ", ".join(f"{c} + u * (o_{c} - {c}) AS {c}" for c in NUT6)
                  + " FROM sm_pick p JOIN sm_near q ON p.id = q.seed_id AND p.nth = q.nth")
    return d


def _register_smote(gn: bool, tag: str):
    @register(f"ml_smote_{tag}", O.with_base(O.snap_select(
        "SELECT * FROM smote", NUT6, ["landing_id", "number", "neighbour", "clusters"]), _smote_sql(gn)))
    def _smote(i: Inputs):
        """ML-10: synthetic rows that fill every profile up to the largest one (k = 5)."""
        return OS.smote(_clustered(i, gn), "clusters", NUT6, "landing_id")


_register_smote(True, "gn")
_register_smote(False, "ag")


# ------------------------------------------------------------------ classifier, evaluation, SHAP

GN_CAT, GN_NUM = ["quarter", "habitat", "habitat_mesh", "vessel_type"], ["mesh_size"]
AG_CAT, AG_NUM = ["quarter", "habitat_gear", "habitat", "gear_type", "vessel_type"], []


def _fit(i: Inputs, gn: bool):
    """The best point of the tuned grid on all training rows, and the training and test rows."""
    tr, te, feats, tuned = _tuned(i, gn)
    return BO.CellModel(tr, feats, BO.best_point(tuned)), tr, te


@register("ml_fit_predict_gn")
def _fit_predict(i: Inputs):
    """ML-11/14: boosted trees of the tuned point fit on train, class probabilities on test."""
    model, _, te = _fit(i, True)
    return model.transform(te)


@register("ml_metric_report")
def _report(i: Inputs):
    """ML-19: AUC and metric set of both models side by side, rounded to 2."""
    per = {}
    for gn, name in ((True, "Gill nets"), (False, "Other gears")):
        model, _, te = _fit(i, gn)
        pred = cut_lineage(model.transform(te))  # fitted and scored once, read by every metric
        auc = M.roc_auc_hand_till(pred, "cluster", model.classes)
        mets = M.classification_metrics(M.confusion(pred, "cluster", model.classes))
        per[name] = auc.unionByName(mets)
    return M.metric_report(per)


@register("ml_importance_by_feature")
def _importance(i: Inputs):
    """ML-20: importance summed by source feature, both models, display titles."""
    out = None
    rules = {True: [("mesh_size", "mesh_size"), ("habitat_mesh", "habitat_mesh"), ("habitat", "habitat"),
                    ("quarter", "quarter"), ("vessel_type", "vessel_type")],
             False: [("gear_type", "gear_type"), ("habitat_gear", "habitat_gear"), ("habitat", "habitat"),
                     ("quarter", "quarter"), ("vessel_type", "vessel_type")]}
    titles = {"habitat_gear": "habitat x gear type", "habitat_mesh": "habitat x mesh size"}
    for gn, name in ((False, "Other gears"), (True, "Gill nets")):
        model, _, _ = _fit(i, gn)
        imp = i.spark.createDataFrame(model.feature_importance(), "variable string, importance double")
        g = M.importance_by_feature(imp, rules[gn], name, titles)
        out = g if out is None else out.unionByName(g)
    return out


_TUNED: dict[tuple, tuple] = {}


def _tuned(i: Inputs, gn: bool):
    """Training rows, test rows and the tuned grid: 20 points x 10 folds, every setting as drawn.

    Tuned once per application, folder and data set: the rows with their folds and
    the grid's results are checkpointed, and every report starts from those.
    """
    key = (i.spark.sparkContext.applicationId, i.sf_dir, gn)
    if key not in _TUNED:
        s = cut_lineage(M.stratified_split(_frame(i, gn), "cluster", ["landing_id"], 0.8, 234))
        tr = cut_lineage(M.stratified_folds(s.where(F.col("split") == "train").drop("split"), "cluster", ["landing_id"], 10, 567))
        feats = GN_CAT + GN_NUM if gn else AG_CAT
        grid = M.lhs_grid(20, seed=891, n_features=len(feats))
        _TUNED[key] = tr, s.where(F.col("split") == "test"), feats, cut_lineage(BO.tune_cells(tr, "fold", feats, grid))
    return _TUNED[key]


def _register_tuned(gn: bool, tag: str):
    @register(f"ml_tune_{tag}")
    def _tune(i: Inputs):
        """ML-12/13: Latin-hypercube grid, stratified folds, mean Hand-Till AUC, best point marked."""
        *_, tuned = _tuned(i, gn)
        top = F.struct(F.col("mean_roc_auc"), -F.col("grid_point"))
        return with_scalars(tuned, tuned.agg(F.max(top).alias("__top"))).withColumn("best", top == F.col("__top")).drop("__top")

    @register(f"ml_final_fit_{tag}")
    def _final(i: Inputs):
        """ML-13/14: the best point refitted on all training rows, class probabilities of the test rows."""
        tr, te, feats, tuned = _tuned(i, gn)
        return BO.fit_predict_cells(tr, te, feats, BO.best_point(tuned))


_register_tuned(True, "gn")
_register_tuned(False, "ag")


#: two points, one fitted on all training rows, one once for each fold held out
LEVEL_FITS = [{"trees": 2, "tree_depth": 2, "min_n": 1, "loss_reduction": 0.0, "sample_size": 1.0, "learn_rate": 0.3, "stop_iter": 5, "mtry": 5, "fold": None}] + [
    {"trees": 1, "tree_depth": 1, "min_n": 5, "loss_reduction": 0.01, "sample_size": 1.0, "learn_rate": 0.5, "stop_iter": 5, "mtry": 5, "fold": f} for f in range(10)]
LEVEL_CLASSES = ["1", "2", "3"]


def _levels_sql() -> dict:
    d, feats = _split_sql(True), GN_CAT + GN_NUM
    same = " || '|' || ".join(f"coalesce(CAST({f} AS VARCHAR), '?')" for f in feats)
    d["bl_fits"] = "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, {'NULL' if f['fold'] is None else f['fold']}, {f['trees']}, {f['tree_depth']}, {float(f['min_n'])}, {max(f['loss_reduction'], 1e-12)!r}, {f['learn_rate']!r})"
        for i, f in enumerate(LEVEL_FITS)) + ") t(fit, away, trees, depth, least, gamma, rate)"
    d["bl_rows"] = f"SELECT *, {same} AS id FROM folds"
    d["bl_feat"] = f"SELECT DISTINCT id, {', '.join(feats)} FROM bl_rows"
    d["bl_value"] = " UNION ALL ".join(
        f"SELECT id, {j} AS pred, " + (f"CAST(NULL AS VARCHAR) AS text, CAST({f} AS DOUBLE) AS num" if f in GN_NUM else f"coalesce({f}, 'NA') AS text, CAST(NULL AS DOUBLE) AS num")
        + " FROM bl_feat" for j, f in enumerate(feats))
    d["bl_n"] = ("SELECT fit, id, c, CAST(count(*) FILTER (WHERE (away IS NULL OR fold <> away) AND CAST(cluster AS VARCHAR) = c) AS DOUBLE) AS n, "
                 "CAST(count(*) FILTER (WHERE (away IS NULL OR fold <> away)) AS DOUBLE) AS m FROM bl_rows, bl_fits, "
                 "(SELECT unnest(['1', '2', '3']) AS c) k GROUP BY ALL")
    d["bl_s0"] = "SELECT *, CAST(0 AS DOUBLE) AS score FROM bl_n"
    rounds = max(f["trees"] for f in LEVEL_FITS)
    for r in range(1, rounds + 1):
        d[f"bl_p{r}"] = (f"SELECT s.*, exp(score) / sum(exp(score)) OVER (PARTITION BY fit, id) AS p FROM bl_s{r - 1} s JOIN bl_fits USING (fit) WHERE trees >= {r}")
        d[f"bl_{r}_0"] = (f"SELECT fit, id, c, n, m, score, m * p - n AS g, CASE WHEN m > 0 THEN greatest(m * p * (1 - p), 1e-16) ELSE 0 END AS h, "
                          f"0 AS node, CAST(NULL AS DOUBLE) AS leaf FROM bl_p{r}")
        deep = max(f["tree_depth"] for f in LEVEL_FITS if f["trees"] >= r)
        for l in range(deep + 1):
            at, t = f"bl_{r}_{l}", f"{r}_{l}"
            d[f"bl_v{t}"] = f"SELECT fit, c, node, pred, text, num, sum(g) AS g, sum(h) AS h FROM {at} JOIN bl_value USING (id) WHERE leaf IS NULL AND m > 0 GROUP BY ALL"
            d[f"bl_c{t}"] = ("SELECT *, sum(g) OVER w AS gs, sum(h) OVER w AS hs, CASE WHEN text IS NULL THEN sum(g) OVER o ELSE g END AS gl, CASE WHEN text IS NULL THEN sum(h) OVER o ELSE h END AS hl "
                             f"FROM bl_v{t} WINDOW w AS (PARTITION BY fit, c, node, pred), "
                             "o AS (PARTITION BY fit, c, node, pred ORDER BY num NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
            d[f"bl_g{t}"] = f"SELECT *, round(0.5 * (gl * gl / (hl + 1) + (gs - gl) * (gs - gl) / (hs - hl + 1) - gs * gs / (hs + 1)), 9) AS gain FROM bl_c{t}"
            d[f"bl_b{t}"] = (f"SELECT fit, c, node, pred, text, num FROM bl_g{t} JOIN bl_fits USING (fit) WHERE depth > {l} AND hl >= least AND hs - hl >= least AND gain > gamma "
                             "QUALIFY row_number() OVER (PARTITION BY fit, c, node ORDER BY gain DESC, pred, num NULLS LAST, text) = 1")
            d[f"bl_w{t}"] = f"SELECT fit, c, node, -sum(g) / (sum(h) + 1) AS own FROM {at} WHERE leaf IS NULL GROUP BY ALL"
            d[f"bl_{r}_{l + 1}"] = (
                "SELECT a.fit, a.id, a.c, a.n, a.m, a.score, a.g, a.h, CASE WHEN a.leaf IS NULL AND b.pred IS NOT NULL THEN 2 * a.node + "
                "CASE WHEN b.text IS NULL THEN (CASE WHEN v.num <= b.num THEN 0 ELSE 1 END) ELSE (CASE WHEN v.text = b.text THEN 0 ELSE 1 END) END ELSE a.node END AS node, "
                f"CASE WHEN a.leaf IS NOT NULL THEN a.leaf WHEN b.pred IS NULL THEN w.own END AS leaf FROM {at} a "
                f"LEFT JOIN bl_b{t} b ON a.fit = b.fit AND a.c = b.c AND a.node = b.node AND a.leaf IS NULL "
                f"LEFT JOIN bl_w{t} w ON a.fit = w.fit AND a.c = w.c AND a.node = w.node AND a.leaf IS NULL LEFT JOIN bl_value v ON v.id = a.id AND v.pred = b.pred")
        d[f"bl_s{r}"] = (f"SELECT s.fit, s.id, s.c, s.n, s.m, s.score + coalesce(rate * t.leaf, 0) AS score FROM bl_s{r - 1} s JOIN bl_fits USING (fit) "
                         f"LEFT JOIN bl_{r}_{deep + 1} t ON s.fit = t.fit AND s.id = t.id AND s.c = t.c")
    d["bl_out"] = (f"SELECT fit, {', '.join(feats)}, CAST(min(m) AS BIGINT) AS n_rows, " + ", ".join(
        f"sum(exp(score)) FILTER (WHERE c = '{c}') / sum(exp(score)) AS pred_{c}" for c in LEVEL_CLASSES)
        + f" FROM bl_s{rounds} JOIN bl_feat USING (id) GROUP BY fit, {', '.join(feats)}")
    return d


@register("ml_boost_levels_gn", O.with_base(O.snap_select(
    "SELECT * FROM bl_out", ["mesh_size"] + [f"pred_{c}" for c in LEVEL_CLASSES], ["fit", *GN_CAT, "n_rows"]), _levels_sql()))
def _levels(i: Inputs):
    """ML-11/13/14: boosted trees level by level on Spark, a final fit and one per fold together."""
    tr = M.stratified_split(_frame(i, True), "cluster", ["landing_id"], 0.8, 234).where(F.col("split") == "train")
    tr = M.stratified_folds(tr.drop("split"), "cluster", ["landing_id"], 10, 567)
    feats = GN_CAT + GN_NUM
    cells = BO.class_cells(BL.binned(cut_lineage(tr), feats), feats, "cluster", LEVEL_CLASSES, ["fold"])
    got = BL.boost_levels(cells, feats, LEVEL_CLASSES, LEVEL_FITS, fold="fold")
    total = F.aggregate("n", F.lit(0.0), lambda a, b: a + b).cast("bigint")
    return got.select("fit", *feats, total.alias("n_rows"), *[F.get("p", F.lit(j)).alias(f"pred_{c}") for j, c in enumerate(LEVEL_CLASSES)])


def _shap(i: Inputs, gn: bool):
    model, tr, _ = _fit(i, gn)
    feats = GN_CAT + GN_NUM if gn else AG_CAT
    return EX.kernel_shap(model, tr, feats, ["landing_id"], n_bg=500, seed=1)


@register("ml_kernel_shap_gn")
def _shap_q(i: Inputs):
    """ML-21/22: exact Shapley values of class probabilities (32 coalitions, 500 background rows)."""
    return _shap(i, True)


@register("ml_shap_effects_gn")
def _shap_eff(i: Inputs):
    """ML-23: median mesh-size SHAP per profile, habitat and mesh size; positive only."""
    return EX.shap_effects(_shap(i, True), "mesh_size", ["habitat", "mesh_size"], recode={"habitat": ("Deep", "Pelagic")})


@register("ml_lump_near_zero_ag")
def _lump_zero(i: Inputs):
    """ML-23/24 (other gears): gear-type SHAP by profile; the habitat x gear label
    split into habitat and gear (title-cased); the 15 gear levels with mean
    -|shap| nearest zero pooled to "Others"; median per (profile, gear, habitat),
    positive only, Deep shown as Pelagic."""
    s = EX.shap_for(_shap(i, False), "gear_type", ["habitat_gear"])
    s = separate(s, "habitat_gear", ["habitat", "gear_fact"], "_")
    s = s.withColumn("gear_fact", F.initcap("gear_fact")).withColumn("profile", F.concat(F.lit("FNP-"), "class"))
    s = EX.lump_near_zero(s, "gear_fact", "shap", 15)
    med = exact_median_by(s, ["profile", "gear_fact", "habitat"], ["shap"]).where(F.col("shap") > 0)
    return med.withColumn("habitat", F.when(F.col("habitat") == "Deep", F.lit("Pelagic")).otherwise(F.col("habitat")))
