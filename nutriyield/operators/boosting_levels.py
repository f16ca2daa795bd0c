"""Boosted trees grown level by level as Spark aggregates, for any number of predictor tuples.

All fits (grid points x folds) advance together.  The state is one row per fit
and distinct predictor tuple, with arrays over the classes: row counts, scores
and the tuple's node in each class's tree.  One level of every tree of a round is

1. one ``groupBy(fit, class, node, predictor, value)`` sum of gradients and
   curvatures (map-side first, so a hot value or node moves a row per task),
2. prefix sums along the ordered predictors' values, at most ``max_bins`` of
   them, and the best split of each node,
3. a join of the state with the splits (a row per node) that moves the tuples
   into the children, or gives those of a finished node their leaf value.

Only a row per fit (its training loss) and the gain per predictor come back to
the driver.  The state is checkpointed after each level, so a lost executor
costs a re-read.

Splits: ordered predictors go left up to a value, others one value against the
rest; missing is a value of its own, the last one.  The gain is rounded to nine
decimals; ties go to the earlier predictor, then to the smaller value.  Row
sampling keeps floor(share * n + u) of a tuple's n rows, with u from a hash;
``mtry`` predictors of a level come from the order of a hash.  Both are the
same whatever the partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nutriyield.session import cut_lineage

#: smallest curvature of a tuple that has rows
LEAST_H = 1e-16
#: split rows that are broadcast; a level with more nodes is joined by shuffle
BROADCAST_NODES = 100_000


def binned(rows: DataFrame, features: Sequence[str], max_bins: int = 256) -> DataFrame:
    """``rows`` with every numeric predictor of more than ``max_bins`` values replaced by its bin's upper edge."""
    for f in features:
        if not isinstance(rows.schema[f].dataType, T.NumericType):
            continue
        if rows.select(f).distinct().limit(max_bins + 1).count() <= max_bins:
            continue
        x = F.col(f).cast("double")
        edges = sorted(set(rows.agg(F.percentile_approx(x, [i / max_bins for i in range(1, max_bins + 1)], 100 * max_bins)).first()[0]))
        edge = F.element_at(F.filter(F.array(*map(F.lit, edges)), lambda e: e >= F.least(x, F.lit(edges[-1]))), 1)
        rows = rows.withColumn(f, F.when(x.isNotNull(), edge))
    return rows


def _unit(*parts) -> Column:
    """A number in [0, 1) from a hash of ``parts``."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def chosen_predictors(features: Sequence[str], mtry: int, *key) -> list[int]:
    """The ``mtry`` predictors of a level, by the order of a hash."""
    order = sorted(range(len(features)), key=lambda j: hashlib.md5("|".join(map(str, (*key, features[j]))).encode()).hexdigest())
    return sorted(order[:max(1, mtry)])


def initial_state(cells: DataFrame, features: Sequence[str], classes: Sequence[str], fits: Sequence[dict], fold: str | None = None) -> DataFrame:
    """One row per fit and predictor tuple: ``n`` rows learned from and ``held`` rows (of the fit's fold), by class."""
    names, k = [f"n_{c}" for c in classes], len(classes)
    table = cells.sparkSession.createDataFrame([(i, f.get("fold")) for i, f in enumerate(fits)], "fit int, __held int")  # a row per fit
    away = (F.col(fold) == F.col("__held")) if fold else F.lit(False)
    away = F.coalesce(away, F.lit(False))
    wide = cells.withColumn("fit", F.explode(F.sequence(F.lit(0), F.lit(len(fits) - 1)))).join(F.broadcast(table), "fit")
    sums = [F.sum(F.when(away if held else ~away, F.col(n)).otherwise(0)).cast("double").alias(f"{tag}{i}")
            for held, tag in ((False, "__n"), (True, "__h")) for i, n in enumerate(names)]
    state = wide.groupBy("fit", *features).agg(*sums)
    return state.select("fit", *features, F.array(*[f"__n{i}" for i in range(k)]).alias("n"), F.array(*[f"__h{i}" for i in range(k)]).alias("held"),
                        F.array(*[F.lit(0.0)] * k).alias("score"))


def probabilities(score: Column) -> Column:
    e = F.transform(score, lambda x: F.exp(x - F.array_max(score)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _settings(state: DataFrame, fits: Sequence[dict], live: Sequence[int], features: Sequence[str], seed: int, round_: int, level: int) -> DataFrame:
    """A row per live fit with what a level needs."""
    rows = [(i, float(fits[i]["min_n"]), max(float(fits[i]["loss_reduction"]), 1e-12), level < int(fits[i]["tree_depth"]),
             chosen_predictors(features, int(fits[i]["mtry"]), seed, i, round_, level)) for i in live]
    return F.broadcast(state.sparkSession.createDataFrame(rows, "fit int, least double, gamma double, grows boolean, mine array<int>"))


def best_splits(state: DataFrame, features: Sequence[str], settings: DataFrame) -> DataFrame:
    """(fit, class, node, leaf, gain, predictor, text, num): a row per node; without a predictor the node is a leaf."""
    ordered = [isinstance(state.schema[f].dataType, T.NumericType) for f in features]
    value = F.array(*[F.struct(F.lit(j).alias("predictor"), (F.lit(None) if ordered[j] else F.coalesce(F.col(f).cast("string"), F.lit("NA"))).cast("string").alias("text"),
                               (F.col(f) if ordered[j] else F.lit(None)).cast("double").alias("num")) for j, f in enumerate(features)])
    each = state.where("size(filter(n, x -> x > 0)) > 0").withColumn("v", F.explode(value)) \
        .select("fit", "v.*", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("g") - 1).alias("class"), "node", "g", "h")).alias("c")) \
        .select("fit", F.col("c.class").alias("class"), F.col("c.node").alias("node"), "predictor", "text", "num", F.col("c.g").alias("g"), F.col("c.h").alias("h")).where("node >= 0")
    per = each.groupBy("fit", "class", "node", "predictor", "text", "num").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    group = Window.partitionBy("fit", "class", "node", "predictor")  # at most max_bins values, or a factor's levels
    along = group.orderBy(F.col("num").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    is_ordered = F.element_at(F.array(*map(F.lit, ordered)), F.col("predictor") + 1)
    sums = per.select("*", F.sum("g").over(group).alias("gs"), F.sum("h").over(group).alias("hs"),
                      *[F.when(is_ordered, F.sum(c).over(along)).otherwise(F.col(c)).alias(f"{c}l") for c in "gh"])
    term = lambda g, h: g * g / (h + 1)
    gr, hr = F.col("gs") - F.col("gl"), F.col("hs") - F.col("hl")
    gain = F.round(0.5 * (term(F.col("gl"), F.col("hl")) + term(gr, hr) - term(F.col("gs"), F.col("hs"))), 9)
    fits = F.array_contains("mine", F.col("predictor")) & F.col("grows") & (F.col("hl") >= F.col("least")) & (hr >= F.col("least")) & (gain > F.col("gamma"))
    # sums of one node differ in their last bits between predictors: the first one's stand for the node
    ranked = sums.join(settings, "fit").withColumn("gain", F.when(fits, gain))
    first = F.struct(F.when(F.col("gain").isNotNull(), -F.col("gain")).otherwise(F.lit(float("inf"))).alias("a"), "predictor", F.col("num").isNull().alias("b"), "num", "text")
    best = ranked.groupBy("fit", "class", "node").agg(
        F.min_by(F.struct("gain", "predictor", "text", "num"), first).alias("s"), F.min_by(-F.col("gs") / (F.col("hs") + 1), F.struct("predictor", "num", "text")).alias("leaf"))
    some = F.col("s.gain").isNotNull()
    return best.select("fit", "class", "node", "leaf", "s.gain", F.when(some, F.col("s.predictor")).alias("predictor"), "s.text", "s.num")


def _descend(state: DataFrame, splits: DataFrame, features: Sequence[str], rate: Column, k: int, small: bool) -> DataFrame:
    """Tuples move to the children of their nodes; those of a leaf get its value and node -1."""
    one = F.struct("class", "node", "leaf", "predictor", "text", "num")
    of_fit = splits.select("fit", *[F.when(F.col("class") == c, F.col("node")).alias(f"node{c}") for c in range(k)], one.alias("s"))
    score, node = [], []
    for c in range(k):  # a join per class: a row of the state is in one node of each class's tree
        mine = of_fit.where(F.col("s.class") == c).select("fit", F.col(f"node{c}").alias(f"__node{c}"), F.col("s").alias(f"s{c}"))
        state = state.withColumn(f"__node{c}", F.get("node", F.lit(c))).join(F.broadcast(mine) if small else mine, ["fit", f"__node{c}"], "left")
        s, at = F.col(f"s{c}"), F.col(f"__node{c}")
        right = F.lit(False)
        for j, f in enumerate(features):
            if isinstance(state.schema[f].dataType, T.NumericType):
                beyond = F.coalesce(F.col(f) > s["num"], F.col(f).isNull() & s["num"].isNotNull())
            else:
                beyond = F.coalesce(F.col(f).cast("string"), F.lit("NA")) != s["text"]
            right = F.when(s["predictor"] == j, beyond).otherwise(right)
        done = s["predictor"].isNull()
        node.append(F.when((at < 0) | done, F.lit(-1).cast("bigint")).otherwise(2 * at + right.cast("bigint")))
        score.append(F.get("score", F.lit(c)) + F.when((at >= 0) & done, rate * F.coalesce(s["leaf"], F.lit(0.0))).otherwise(0.0))
    return state.select("fit", *features, "n", "held", F.array(*score).alias("score"), F.array(*node).alias("node"), "g", "h")


def boost_levels(cells: DataFrame, features: Sequence[str], classes: Sequence[str], fits: Sequence[dict], seed: int = 891,
                 fold: str | None = None, gains: dict | None = None) -> DataFrame:
    """(fit, predictors, n, held, score, p): class probabilities of every tuple under every fit.

    ``cells`` has a row per predictor tuple (and ``fold``) with ``n_<class>``
    counts; ``fits`` are settings, each with the ``fold`` that it holds out, if
    any.  A fit ends after its ``trees`` rounds, or ``stop_iter`` rounds without
    a lower training loss.  ``gains`` receives {(fit, predictor): gain}.
    """
    clash = {"fit", "n", "held", "score", "p"} & set(features)
    if clash:
        raise ValueError(f"predictors may not be named {sorted(clash)}")
    named, k = list(features), len(classes)
    features = [f"x{j}" for j in range(len(named))]  # apart from the state's own columns
    cells = cells.select(*[F.col(f).alias(x) for f, x in zip(named, features)], *[f"n_{c}" for c in classes], *([F.col(fold).alias("__fold")] if fold else []))
    fold = "__fold" if fold else None
    state = cut_lineage(initial_state(cells, features, classes, fits, fold))
    live, low, since = list(range(len(fits))), {}, {}
    finished = []
    for round_ in range(1, max((int(f["trees"]) for f in fits), default=0) + 1):
        table = state.sparkSession.createDataFrame([(i, float(fits[i]["learn_rate"]), float(fits[i]["sample_size"])) for i in live], "fit int, rate double, share double")
        key = F.concat_ws("|", F.lit(str(seed)), "fit", F.lit(str(round_)), *[F.coalesce(F.col(f).cast("string"), F.lit("NA")) for f in features])
        u = _unit(key)
        state = state.join(F.broadcast(table), "fit").withColumn("c", F.when(F.col("share") < 1, F.transform("n", lambda x: F.floor(x * F.col("share") + u).cast("double"))).otherwise(F.col("n")))
        total, p = F.aggregate("c", F.lit(0.0), lambda a, b: a + b), probabilities(F.col("score"))
        state = state.withColumns({"p": p, "m": total}).withColumns({
            "g": F.zip_with("p", "c", lambda a, b: F.col("m") * a - b),
            "h": F.transform("p", lambda a: F.when(F.col("m") > 0, F.greatest(F.col("m") * a * (1 - a), F.lit(LEAST_H))).otherwise(0.0)),
            "node": F.array(*[F.lit(0).cast("bigint")] * k)}).select("fit", *features, "n", "held", "score", "node", "g", "h")
        depth = max(int(fits[i]["tree_depth"]) for i in live)
        rates = F.element_at(F.create_map(*[x for i in live for x in (F.lit(i), F.lit(float(fits[i]["learn_rate"])))]), F.col("fit"))
        for level in range(depth + 1):
            splits = cut_lineage(best_splits(state, features, _settings(state, fits, live, features, seed, round_, level)))
            if gains is not None:
                for r in splits.where("predictor is not null").groupBy("fit", "predictor").agg(F.sum("gain").alias("x")).collect():  # fits x predictors
                    at = (r["fit"], named[r["predictor"]])
                    gains[at] = gains.get(at, 0.0) + r["x"]
            nodes, split = splits.agg(F.count("*"), F.count("predictor")).first()
            state = cut_lineage(_descend(state, splits, features, rates, k, nodes <= BROADCAST_NODES))
            if not split:
                break
        state = state.select("fit", *features, "n", "held", "score")
        loss = F.aggregate(F.zip_with("n", probabilities(F.col("score")), lambda a, b: -a * F.log(F.greatest(b, F.lit(1e-15)))), F.lit(0.0), lambda a, b: a + b)
        for r in state.groupBy("fit").agg(F.round(F.sum(loss), 9).alias("loss")).collect():  # a row per fit
            better = r["loss"] < low.get(r["fit"], float("inf"))
            low[r["fit"]], since[r["fit"]] = (r["loss"], 0) if better else (low[r["fit"]], since[r["fit"]] + 1)
        over = [i for i in live if round_ >= int(fits[i]["trees"]) or since.get(i, 0) >= int(fits[i]["stop_iter"])]
        if over:
            finished.append(state.where(F.col("fit").isin(over)))
            live = [i for i in live if i not in over]
            if not live:
                break
            state = state.where(F.col("fit").isin(live))
    out = finished[0] if finished else state
    for part in finished[1:]:
        out = out.unionByName(part)
    return out.select("fit", *[F.col(x).alias(f) for x, f in zip(features, named)], "n", "held", "score", probabilities(F.col("score")).alias("p"))
