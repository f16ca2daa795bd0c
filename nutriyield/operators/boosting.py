"""Boosted trees on distinct predictor tuples, so that a full tuning grid is affordable.

The study's predictors are a few factors and a mesh size: rows that agree in all
of them are one cell with a count per class.  Spark reduces the training rows to
cells (map-side, a bounded table: the product of the predictors' levels), and
every (grid point, fold) fit is one group of ``applyInPandas`` over the cells,
so the whole grid runs as one distributed job.  A fit on cells equals the fit on
the rows they stand for.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nutriyield.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package on their path


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def encode(frame: pd.DataFrame, features: Sequence[str]) -> tuple[np.ndarray, list[int], list[bool]]:
    """Level numbers of each predictor (in order of value; missing is a level), level counts, and which are ordered."""
    codes, sizes, ordered = [], [], []
    for f in features:
        numeric = pd.api.types.is_numeric_dtype(frame[f])
        level, values = pd.factorize(frame[f] if numeric else frame[f].astype(object).where(frame[f].notna(), "NA"), sort=True, use_na_sentinel=False)
        codes.append(level)
        sizes.append(len(values))
        ordered.append(numeric)
    return np.array(codes, np.int64).T.reshape(len(frame), len(features)), sizes, ordered


def level_numbers(frame: pd.DataFrame, train: pd.DataFrame, features: Sequence[str]) -> np.ndarray:
    """``frame``'s values as level numbers of ``train`` (see ``encode``) that take the same side of every split.

    An ordered value between two levels counts as the upper one, an unknown level of a factor as -1."""
    codes = []
    for f in features:
        if pd.api.types.is_numeric_dtype(train[f]):
            levels = np.unique(train[f].to_numpy(np.float64, na_value=np.nan))  # a missing one comes last
            codes.append(np.searchsorted(levels, frame[f].to_numpy(np.float64, na_value=np.nan)))
        else:
            text = lambda x: x.astype(object).where(x.notna(), "NA")
            levels = pd.Index(pd.factorize(text(train[f]), sort=True)[1])
            codes.append(levels.get_indexer(text(frame[f])))
    return np.array(codes, np.int64).T.reshape(len(frame), len(features))


def _grow(codes, sizes, ordered, at_cell, g, h, params, rng, gains, levels) -> np.ndarray:
    """Leaf value of every cell in one tree per class, (classes, cells). Trees grow level by level.

    ``codes``: (predictors, classes * cells).  ``g``, ``h`` are those of the entries
    with rows, class by class, ``at_cell`` the places of their cells in ``codes``; sums
    run over the entries, nodes are kept per cell.  ``gains`` adds up each predictor's
    splits.  ``levels`` (a list, or None) receives each level's splits, leaf values and children.
    """
    k, total = int(params["classes"]), codes.shape[1]
    node, value = np.repeat(np.arange(k), total // k), np.zeros(total)
    live, nodes, is_ordered, widths = None, k, np.array(ordered), np.array(sizes)
    least, gamma, mtry = float(params["min_n"]), float(params["loss_reduction"]), int(params["mtry"])
    for depth in range(int(params["tree_depth"]) + 1):
        here = node if live is None else node[live]
        at = node[at_cell]
        gs, hs = np.bincount(at, g, nodes), np.bincount(at, h, nodes)
        best, split = np.full(nodes, max(gamma, 1e-12)), np.full((nodes, 2), -1)
        if depth < int(params["tree_depth"]):
            js = rng.choice(len(sizes), min(mtry, len(sizes)), replace=False)
            # two children of ``least`` each need a node of twice that, and two entries
            fit_for = (hs >= 1.999 * least) & (np.bincount(at, minlength=nodes) > 1)
            able = np.flatnonzero(fit_for)
            slot, w, d = np.zeros(nodes, np.int64), widths[js], len(able)
            slot[able] = np.arange(d)
            few = d < nodes
            mine = np.flatnonzero(fit_for[at]) if few else slice(None)
            start = np.append(0, (d * w).cumsum())  # each predictor's nodes x levels, one after another
            where = at_cell[mine]
            key = (slot[at[mine]] * w[:, None] + codes[js[:, None], where] + start[:-1, None]).ravel()
            gl, hl = (np.bincount(key, np.tile(x[mine], len(js)), start[-1]) for x in (g, h))
            for i in np.flatnonzero(is_ordered[js]):
                for x in (gl, hl):
                    x[start[i]:start[i + 1]] = x[start[i]:start[i + 1]].reshape(d, w[i]).cumsum(1).ravel()
            # a level without entries splits like the one before it or not at all: only met levels are compared
            met = np.zeros(start[-1], bool)
            met[key] = True
            met = np.flatnonzero(met)
            gl, hl = gl[met], hl[met]
            i = np.repeat(np.arange(len(js)), np.diff(np.searchsorted(met, start)))
            place, level = np.divmod(met - start[i], w[i])
            gn, hn = gs[able], hs[able]
            gr, hr = gn[place] - gl, hn[place] - hl
            gain = 0.5 * (gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gn**2 / (hn + 1))[place])
            gain[(hl < least) | (hr < least)] = -np.inf
            most, top = np.full((len(js), d), -np.inf), np.zeros((len(js), d), np.int64)
            if len(met):
                group = i * d + place
                first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                high = np.maximum.reduceat(gain, first)
                tops = np.flatnonzero(gain == np.repeat(high, np.diff(np.append(first, len(gain)))))
                most.ravel()[group[first]] = high
                top.ravel()[group[first]] = level[tops[np.searchsorted(tops, first)]]
                pick, each = most.argmax(0), np.arange(d)
                better = np.flatnonzero(most[pick, each] > best[able])
                pick, to = pick[better], able[better]
                best[to], split[to, 0], split[to, 1] = most[pick, better], js[pick], top[pick, better]
            np.add.at(gains, split[split[:, 0] >= 0, 0], best[split[:, 0] >= 0])
        own, leaf = -gs / (hs + 1), split[:, 0] < 0
        ends = leaf[here]
        live = np.arange(total) if live is None else live
        value[live[ends]] = own[here[ends]]
        node[live[ends]] = 0  # no longer read
        children = np.full(2 * nodes, -1)
        if levels is not None:
            levels.append((split, own, children))
        if ends.all():
            break
        if leaf.any():
            live, here = live[~ends], here[~ends]
            stay = np.flatnonzero(~leaf[at])
            at_cell, g, h = at_cell[stay], g[stay], h[stay]
        j, cut = split[here, 0], split[here, 1]
        mine = codes[j, live]
        right = np.where(is_ordered[j], mine > cut, mine != cut)
        to = 2 * here + right
        kinds = np.flatnonzero(np.bincount(to, minlength=2 * nodes))
        children[kinds] = np.arange(len(kinds))
        node[live] = children[to]
        nodes = len(kinds)
    return value.reshape(k, -1)


def boost(codes: np.ndarray, sizes: list[int], ordered: list[bool], counts: np.ndarray, params: dict, seed: int,
          gains: np.ndarray | None = None, trees: list | None = None) -> tuple[np.ndarray, int]:
    """(class probabilities of every cell, rounds). Cells without counts are only scored.

    Softmax boosting with second-order leaf values; stops after ``stop_iter``
    rounds without a lower training loss (no rows are set aside for it).
    ``gains`` (one place per predictor) receives the gain of all splits, ``trees`` the
    trees' levels (for ``score_cells``).

    Rows of ``codes`` that are equal (a cell met in several folds) are sampled one by
    one, then their counts are added up: the trees sum and keep one entry a tuple, so
    the work of a level grows with the distinct tuples, not with the folds.
    """
    rng = np.random.default_rng(seed)
    gains = np.zeros(len(sizes)) if gains is None else gains
    same, first, of = np.unique(codes, axis=0, return_index=True, return_inverse=True)
    of, k, m = of.ravel(), counts.shape[1], len(same)
    as_met = np.argsort(first)  # sums run in the order of the rows
    by_tuple = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[by_tuple], np.arange(m))
    merged = lambda x: np.add.reduceat(x[by_tuple], starts, axis=0) if m else x
    wide = np.ascontiguousarray(np.tile(same.T, (1, k)))
    whole, every, total = counts.astype(np.int64), merged(counts), counts.sum()
    score, low, since, done = np.zeros((m, k)), np.inf, 0, 0
    share, p = float(params["sample_size"]), softmax(score)
    params = {**params, "classes": k}
    for done in range(1, int(params["trees"]) + 1):
        c = merged(rng.binomial(whole, share)) if share < 1 else every
        n = c.sum(1, keepdims=True)
        used = as_met[n[as_met, 0] > 0]
        p, n, c = p[used], n[used], c[used]
        at_cell = (used + m * np.arange(k)[:, None]).ravel()
        levels = None if trees is None else []
        score += float(params["learn_rate"]) * _grow(wide, sizes, ordered, at_cell, (n * p - c).T.ravel(), np.maximum(n * p * (1 - p), 1e-16).T.ravel(), params, rng, gains, levels).T
        if trees is not None:
            trees.append(levels)
        p = softmax(score)
        loss = -(every * np.log(np.maximum(p, 1e-15)))[as_met].sum() / max(total, 1)
        low, since = (loss, 0) if loss < low else (low, since + 1)
        if since >= int(params["stop_iter"]):
            break
    return p[of], done


def score_cells(codes: np.ndarray, ordered: list[bool], trees: list, k: int, rate: float) -> np.ndarray:
    """Class probabilities of cells (level numbers as ``level_numbers`` gives them) from the trees of a fit."""
    m = len(codes)
    wide, is_ordered, score = np.ascontiguousarray(np.tile(codes.T, (1, k))), np.array(ordered), np.zeros((m, k))
    for levels in trees:
        value, live, node = np.zeros(k * m), np.arange(k * m), np.repeat(np.arange(k), m)
        for split, own, children in levels:
            j, cut = split[node, 0], split[node, 1]
            ends = j < 0
            value[live[ends]] = own[node[ends]]
            live, node, j, cut = live[~ends], node[~ends], j[~ends], cut[~ends]
            mine = wide[j, live]
            node = children[2 * node + np.where(is_ordered[j], mine > cut, mine != cut)]
        score += rate * value.reshape(k, m).T
    return softmax(score)


def hand_till(p: np.ndarray, counts: np.ndarray) -> float | None:
    """Hand and Till's AUC of cells with class counts; pairs without rows are left out."""
    def above(score, pos, neg):
        if not pos.sum() or not neg.sum():
            return None
        _, tie = np.unique(score, return_inverse=True)
        a, b = np.bincount(tie, pos), np.bincount(tie, neg)
        return (a * (b.cumsum() - b / 2)).sum() / (pos.sum() * neg.sum())

    k, out = counts.shape[1], []
    for i in range(k):
        for j in range(i + 1, k):
            x, y = above(p[:, i], counts[:, i], counts[:, j]), above(p[:, j], counts[:, j], counts[:, i])
            if x is not None and y is not None:
                out.append((x + y) / 2)
    return float(np.mean(out)) if out else None


def class_cells(rows: DataFrame, features: Sequence[str], label: str, classes: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per distinct predictor tuple (and ``keys``) with a count per class, ``n_<class>``."""
    return rows.groupBy(*keys, *features).agg(*[F.count(F.when(F.col(label) == c, 1)).alias(f"n_{c}") for c in classes])


#: cells that one fit may hold: some 50 MB a task
MAX_CELLS = 500_000


def bounded(cells: DataFrame) -> DataFrame:
    """``cells``, checkpointed, if one fit can hold them; a continuous predictor must be binned first."""
    cells = cut_lineage(cells)
    n = cells.count()
    if n > MAX_CELLS:
        raise ValueError(f"{n} distinct predictor tuples, more than {MAX_CELLS}: bin the continuous predictors")
    return cells


def tune_cells(train: DataFrame, fold: str, features: Sequence[str], grid: Sequence[dict], label: str = "cluster", seed: int = 891) -> DataFrame:
    """(grid_point, settings, mean_roc_auc, folds, best): every grid point on every fold."""
    features, spark = list(features), train.sparkSession
    classes = sorted(r[0] for r in train.select(label).distinct().collect())  # k labels
    cells = bounded(class_cells(train, features, label, classes, [fold]))
    folds = sorted(r[0] for r in cells.select(fold).distinct().collect())
    names = [f"n_{c}" for c in classes]

    costs = [int(p["trees"]) * int(p["tree_depth"]) * int(p["mtry"]) for p in grid]
    order = sorted(range(len(grid) * len(folds)), key=lambda t: -costs[t // len(folds)])  # the longest fits begin first

    def run(batches):
        pdf = pd.concat(batches)
        key = order[int(pdf["task"].iloc[0])]
        g, f = divmod(key, len(folds))
        pdf = pdf.sort_values([*features, fold], kind="stable")
        held = (pdf[fold] == folds[f]).to_numpy()
        codes, sizes, ordered = encode(pdf, features)
        counts = pdf[names].to_numpy(np.float64)
        p, rounds = boost(codes, sizes, ordered, np.where(held[:, None], 0, counts), grid[g], seed + key)
        yield pd.DataFrame({"grid_point": [g], "fold": [folds[f]], "auc": [hand_till(p[held], counts[held])], "rounds": [rounds]})

    # every fit is a partition of its own, whatever the shuffle settings; the cells are bounded
    tasks = spark.range(0, len(order), 1, max(1, len(order))).select(F.col("id").alias("task")).crossJoin(F.broadcast(cells))
    got = tasks.mapInPandas(run, "grid_point int, fold int, auc double, rounds int")
    mean = got.groupBy("grid_point").agg(F.avg("auc").alias("mean_roc_auc"), F.count("auc").alias("folds"), F.avg("rounds").alias("mean_rounds"))
    rows = [(g, *[float(p[k]) for k in SETTINGS]) for g, p in enumerate(grid)]
    table = spark.createDataFrame(rows, "grid_point int, " + ", ".join(f"{k} double" for k in SETTINGS))
    return table.join(F.broadcast(mean), "grid_point")  # one row per grid point


SETTINGS = ["trees", "tree_depth", "min_n", "loss_reduction", "sample_size", "learn_rate", "stop_iter", "mtry"]


def best_point(tuned: DataFrame) -> dict:
    """Settings of the point with the highest mean AUC; ties go to the first."""
    r = tuned.orderBy(F.col("mean_roc_auc").desc_nulls_last(), "grid_point").first()
    return {k: r[k] for k in SETTINGS}


def fit_predict_cells(train: DataFrame, test: DataFrame, features: Sequence[str], params: dict, label: str = "cluster", seed: int = 891, share: int = 4096) -> DataFrame:
    """``test`` with ``pred_<class>`` and ``pred_class`` from one fit with ``params`` on all training rows."""
    features = list(features)
    classes = sorted(r[0] for r in train.select(label).distinct().collect())  # k labels
    key, names = F.md5(F.to_json(F.struct(*features))), [f"n_{c}" for c in classes]
    cells = bounded(class_cells(train, features, label, classes).withColumn("__cell", key)).withColumn("__fit", F.lit(True))
    ask = cut_lineage(test.select(*features).distinct().withColumns({n: F.lit(0).cast("bigint") for n in names}).withColumn("__cell", key)).withColumn("__fit", F.lit(False))
    shares = max(1, -(-ask.count() // share))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__cell")
        fit, mine = pdf[pdf["__fit"]], pdf[~pdf["__fit"]]
        codes, sizes, ordered = encode(fit, features)
        trees: list = []
        boost(codes, sizes, ordered, fit[names].to_numpy(np.float64), params, seed, trees=trees)
        p = score_cells(level_numbers(mine, fit, features), ordered, trees, len(classes), float(params["learn_rate"]))
        return pd.DataFrame({"__cell": mine["__cell"], **{f"pred_{c}": p[:, i] for i, c in enumerate(classes)}})

    # the fit, over a table bounded by the predictors' levels, is made anew beside each share of the cells to score
    both = cells.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).unionByName(
        ask.withColumn("__share", F.pmod(F.xxhash64("__cell"), F.lit(shares)).cast("int")))
    scored = both.groupBy("__share").applyInPandas(run, "__cell string, " + ", ".join(f"pred_{c} double" for c in classes))
    out = test.withColumn("__cell", key).join(scored, "__cell").drop("__cell")
    best = F.array_max(F.array(*[F.struct(F.col(f"pred_{c}").alias("p"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(classes)]))
    return out.withColumn("pred_class", best["c"])


class CellModel:
    """The final fit as a model: scores any frame with the predictors, and tells their importance.

    Cells that are only scored don't change the fit, so every use fits anew with the same result.
    """

    def __init__(self, train: DataFrame, features: Sequence[str], params: dict, label: str = "cluster", seed: int = 891):
        self.train, self.features, self.params, self.label, self.seed = train, list(features), dict(params), label, seed
        self.classes = sorted(r[0] for r in train.select(label).distinct().collect())  # k labels

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``pred_<class>`` probabilities and ``pred_class``."""
        return fit_predict_cells(self.train, df, self.features, self.params, self.label, self.seed)

    def feature_importance(self) -> list[tuple[str, float]]:
        """(predictor, share of the gain of all splits)."""
        features, classes, params, seed = self.features, self.classes, self.params, self.seed
        cells = bounded(class_cells(self.train, features, self.label, classes).withColumn("__cell", F.md5(F.to_json(F.struct(*features)))))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, gains = pdf.sort_values("__cell"), np.zeros(len(features))
            boost(*encode(pdf, features), pdf[[f"n_{c}" for c in classes]].to_numpy(np.float64), params, seed, gains)
            return pd.DataFrame({"feature": features, "share": gains / max(gains.sum(), 1e-300)})

        got = cells.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(run, "feature string, share double")
        return [(r["feature"], r["share"]) for r in got.collect()]  # one row per predictor
