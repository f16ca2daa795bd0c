"""Clustering and PERMANOVA, with the heavy work as distributed DataFrame jobs.

* k-means: all restarts of a multi-start Lloyd run advance together in one
  aggregate per step (lowest cost kept), clusters relabelled by centroid
  order so labels do not depend on the restart; and a
  deterministic Lloyd form (fixed hash-chosen seeds, fixed iteration count)
  whose every step is an aggregate, reproducible in SQL.
* PERMANOVA: sums of squares from centroids (no n x n distance matrix); label
  permutations by hash ranks computed per permutation over hash buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nutriyield.operators.verbs import hash_key, with_scalars
from nutriyield.session import cut_lineage, spread

# --------------------------------------------------------------------------- k-means (Spark ML)


def _assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def cluster_profiles(df: DataFrame, cols: Sequence[str], id_cols: Sequence[str], k: int = 3,
                     restarts: int = 500, seed: int = 555, max_iter: int = 10, label_col: str = "clusters", transfers: bool = True):
    """Multi-start k-means on unscaled ``cols``; returns (frame, model).

    All ``restarts`` runs advance together.  Each step explodes the rows once
    per restart inside the pipeline and joins the restart's k centroids from a
    restart-keyed table (restarts x k rows, a size fixed by the parameters, so
    it is broadcast).  The nearest centroid is picked with plain column
    expressions, and a partial ``groupBy(restart, cluster)`` aggregate reduces
    every partition to restarts x k rows before the shuffle.  Seeds of restart r
    are the k rows with the smallest md5(seed, r, id); only rows with small hashes
    are ordered for that (``_restart_seeds``).

    The run with the lowest total within-cluster sum of squares is kept (ties:
    lowest restart) and improved by Hartigan-Wong transfers (``transfer_rows``).  Cluster ids are renumbered 1..k by ascending centroid
    (lexicographic over ``cols``) and returned as strings.  The model is the
    bounded dict {centers, tot_withinss, restart, iterations}.
    """
    cols, id_cols = list(cols), list(id_cols)
    spark = df.sparkSession
    x = cut_lineage(df)
    x = spread(x)
    runs = F.explode(F.sequence(F.lit(1), F.lit(int(restarts)))).alias("__r")
    e = x.select(*id_cols, *[F.col(f"`{c}`") for c in cols], runs)
    seeds = _restart_seeds(x, id_cols, cols, k, restarts, seed).collect()  # restarts x k rows
    cents: dict[int, list[list[float]]] = {}
    for r in sorted(seeds, key=lambda r: (r["__r"], r["__i"])):
        cents.setdefault(r["__r"], []).append([float(r[c]) for c in cols])

    def step(cents):
        rows = [(r, *[v for c in cs for v in c]) for r, cs in cents.items()]
        schema = "__r int, " + ", ".join(f"__c{i}_{j} double" for i in range(k) for j in range(len(cols)))
        table = F.broadcast(spark.createDataFrame(rows, schema))
        j = e.join(table, "__r")
        d = []
        for i in range(k):
            t = None
            for jx, c in enumerate(cols):
                diff = F.col(f"`{c}`") - F.col(f"__c{i}_{jx}")
                t = diff * diff if t is None else t + diff * diff
            d.append(t)
        m = F.least(*d)
        cid = F.when(d[0] == m, F.lit(0))
        for i in range(1, k):
            cid = cid.when(d[i] == m, F.lit(i))
        j = j.select("__r", *[F.col(f"`{c}`") for c in cols], cid.alias("__cid"), m.alias("__d"))
        agg = (j.groupBy("__r", "__cid")
               .agg(F.sum("__d").alias("__ss"), *[F.avg(f"`{c}`").alias(c) for c in cols]).collect())
        new = {r: [list(c) for c in cs] for r, cs in cents.items()}
        wss = dict.fromkeys(cents, 0.0)
        for a in agg:
            if a["__cid"] is None:
                continue
            new[a["__r"]][a["__cid"]] = [float(a[c]) for c in cols]
            wss[a["__r"]] += float(a["__ss"])
        return new, wss

    it = 0
    for it in range(1, max_iter + 1):
        nxt, _ = step(cents)
        if nxt == cents:
            break
        cents = nxt
    _, wss = step(cents)  # within-SS of the final centroids of every restart
    best = min(wss, key=lambda r: (wss[r], r))
    centers = sorted(tuple(c) for c in cents[best])
    out = _assign(x, cols, _cents_frame(spark, [[i + 1, *c] for i, c in enumerate(centers)],
                                         "cid int, " + ", ".join(f"`{c}` double" for c in cols), cols))
    if transfers:
        out, centers, wss[best] = transfer_rows(out, cols, id_cols, "__cid")
    out = out.withColumn(label_col, F.col("__cid").cast("string")).drop("__cid")
    model = {"centers": centers, "tot_withinss": wss[best], "restart": best, "iterations": it}
    return out, model


def _restart_seeds(x: DataFrame, id_cols: Sequence[str], cols: Sequence[str], k: int, restarts: int, seed: int) -> DataFrame:
    """(__r, __i, cols): the k rows with the smallest md5(seed, r, id) of every restart r.

    Hashes are uniform, so the k smallest of n lie below a few k / n of their range:
    only rows under that bound are ordered.  Restarts with fewer than k rows there are
    asked again under a wider bound, up to the whole range."""
    from pyspark.sql import Window
    n = x.count()
    part, todo, found = (k + 4 * k ** 0.5 + 4) / max(n, 1), list(range(1, int(restarts) + 1)), []
    w = Window.partitionBy("__r").orderBy("__h", *id_cols)
    while todo:
        e = x.select(*id_cols, *[F.col(f"`{c}`") for c in cols], F.explode(F.array(*[F.lit(r) for r in todo])).alias("__r"))
        e = e.withColumn("__h", hash_key(seed, "__r", *id_cols))
        if part < 1:
            e = e.where(F.col("__h") < F.lit(f"{int(part * 16 ** 12):012x}"))
        got = cut_lineage(e.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= k))  # restarts x k rows at most
        full = set(todo) if part >= 1 else {r["__r"] for r in got.where(F.col("__i") == k).select("__r").collect()}
        found.append(got.where(F.col("__r").isin(sorted(full))))
        todo, part = [r for r in todo if r not in full], part * 8
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("__r", "__i", *[F.col(f"`{c}`") for c in cols])


def transfer_rows(df: DataFrame, cols: Sequence[str], id_cols: Sequence[str], label: str, batch: int = 1000, max_passes: int = 100):
    """Hartigan-Wong transfers after Lloyd; returns (frame, sorted centroids, within-cluster sum of squares).

    Moving a row from its cluster l to m changes the within-cluster sum by
    n_m / (n_m + 1) d_m^2 - n_l / (n_l - 1) d_l^2.  A pass finds this gain in the
    row from the k cluster sizes and sums; the ``batch`` largest gains (a bounded
    table; ties by id) are applied on the driver one after another, each checked
    against the sums as the moves before it left them, so every move lowers the
    sum.  The rows are written once; a pass joins them with the table of the rows moved
    so far.  Passes go on until no row gains.  A row alone in its cluster stays, and rows
    with a NULL in a column keep their label.  Ids must be distinct.  Labels
    become 1..k by ascending centroid.
    """
    cols, id_cols = list(cols), list(id_cols)
    spark, point = df.sparkSession, F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    x = df.withColumns({label: F.col(label).cast("int"), "__x": point})
    base = x = cut_lineage(x.withColumn("__x", F.when(~F.exists("__x", lambda v: v.isNull() | F.isnan(v)), F.col("__x"))))
    kinds = ", ".join(f"`{c}` {t}" for c, t in x.select(*id_cols).dtypes)
    moved: dict[tuple, int] = {}  # the last cluster of every row that moved, at most batch x max_passes rows

    def sizes():
        got = x.where(F.col("__x").isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("__x")[j]) for j in range(len(cols))]).alias("s")).collect()
        return {r[label]: (r["n"], list(r["s"])) for r in got}  # k rows

    def far(v, n, s):
        return sum((a - b / n) ** 2 for a, b in zip(v, s))

    for _ in range(max_passes):
        k = sizes()
        table = spark.createDataFrame([(c, n, [v / n for v in s]) for c, (n, s) in sorted(k.items())], "c int, n long, m array<double>")
        table = table.agg(F.array_sort(F.collect_list(F.struct("c", "n", "m"))).alias("__k"))
        d2 = lambda m: F.aggregate(F.zip_with("__x", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, e: acc + e)
        y = with_scalars(x.where(F.col("__x").isNotNull()), table)
        own = F.filter("__k", lambda t: t["c"] == F.col(label))[0]
        leave = F.when(own["n"] > 1, own["n"] / (own["n"] - 1) * d2(own["m"]))
        join = F.array_min(F.transform(F.filter("__k", lambda t: t["c"] != F.col(label)), lambda t: F.struct((t["n"] / (t["n"] + 1) * d2(t["m"])).alias("d"), t["c"].alias("c"))))
        y = y.select(*id_cols, label, "__x", (leave - join["d"]).alias("__gain"), leave.alias("__cost"))
        top = y.where(F.col("__gain") > 1e-12 * (F.col("__cost") + 1)).orderBy(F.desc("__gain"), *id_cols).limit(batch).collect()
        moves = []
        for r in top:
            v, at = r["__x"], r[label]
            n, s = k[at]
            if n < 2:
                continue
            cost = n / (n - 1) * far(v, n, s)
            better, to = min((m / (m + 1) * far(v, m, t), c) for c, (m, t) in k.items() if c != at)
            if cost - better > 1e-12 * (cost + 1):
                k[at] = n - 1, [b - a for a, b in zip(v, s)]
                k[to] = k[to][0] + 1, [b + a for a, b in zip(v, k[to][1])]
                moves.append((*[r[c] for c in id_cols], to))
        if not moves:
            break
        moved.update({m[:-1]: m[-1] for m in moves})
        table = F.broadcast(spark.createDataFrame([(*key, to) for key, to in moved.items()], f"{kinds}, __to int"))
        x = base.join(table, id_cols, "left").withColumn(label, F.coalesce("__to", label)).drop("__to")
    k = sizes()
    order = sorted(k, key=lambda c: [v / k[c][0] for v in k[c][1]])
    centers = [tuple(v / k[c][0] for v in k[c][1]) for c in order]
    number = F.create_map(*[F.lit(v) for i, c in enumerate(order) for v in (c, i + 1)])
    x = x.withColumn(label, number[F.col(label)])
    near = F.array(*[F.array(*[F.lit(v) for v in c]) for c in centers])
    wss = x.agg(F.sum(F.aggregate(F.zip_with("__x", F.element_at(near, F.col(label)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, e: acc + e)).alias("w")).first()["w"]
    return x.drop("__x"), centers, float(wss or 0.0)


def lloyd_kmeans(df: DataFrame, cols: Sequence[str], id_cols: Sequence[str], k: int = 3, iters: int = 5,
                 seed: int = 555, label_col: str = "clusters") -> DataFrame:
    """Deterministic k-means: seeds are the k rows with the smallest md5(seed, id);
    each Lloyd step assigns rows to the nearest centroid (ties to the lower id) in
    the row, via an array of the k centroids, and averages per cluster.

    The input is checkpointed once (shared checkpoint folder) so every step scans
    it instead of replaying its lineage.  Between steps only the k centroids
    (k x d numbers, bounded model state, as Spark ML keeps them) travel through
    the driver, as a one-row literal frame attached to every row.
    """
    cols = list(cols)
    spark = df.sparkSession
    x = cut_lineage(df)
    h = hash_key(seed, *id_cols)
    init = x.withColumn("__h", h).orderBy("__h").limit(k).collect()
    cents = [[i + 1] + [float(r[c]) if r[c] is not None else None for c in cols] for i, r in enumerate(init)]
    schema = "cid int, " + ", ".join(f"`{c}` double" for c in cols)
    for _ in range(iters):  # at most; a step that moves nothing is the last
        cdf = _cents_frame(spark, cents, schema, cols)
        means = {r["__cid"]: r for r in _assign(x, cols, cdf).groupBy("__cid")
                 .agg(*[F.avg(c).alias(c) for c in cols]).collect()}
        # a cluster that lost all rows keeps its old centroid
        moved = [[c[0]] + ([float(means[c[0]][col]) for col in cols] if c[0] in means else c[1:]) for c in cents]
        if moved == cents:
            break
        cents = moved
    out = _assign(x, cols, _cents_frame(spark, cents, schema, cols))
    return out.withColumn(label_col, F.col("__cid").cast("string")).drop("__cid")


def _cents_frame(spark, cents, schema, cols) -> DataFrame:
    c = spark.createDataFrame([tuple(r) for r in cents], schema)
    return c.select(F.collect_list(F.struct(F.col("cid"), *[F.col(f"`{x}`") for x in cols])).alias("__c"))


def _assign(df: DataFrame, cols: Sequence[str], cents: DataFrame) -> DataFrame:
    x = with_scalars(df, cents)

    def dist(c):
        e = None
        for col in cols:
            d = (F.col(col) - c[col]) * (F.col(col) - c[col])
            e = d if e is None else e + d
        return e

    best = F.array_min(F.transform("__c", lambda c: F.struct(dist(c).alias("d"), c["cid"].alias("cid"))))
    return x.withColumn("__cid", best["cid"]).drop("__c")


def project_clusters(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Standardise ``cols`` and project to the first two principal components.

    A component's sign is fixed: its largest loading (the first of equal ones) is positive."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array
    x = _assemble(df, cols, "__raw")
    pipe = Pipeline(stages=[StandardScaler(inputCol="__raw", outputCol="__std", withMean=True, withStd=True),
                            PCA(k=2, inputCol="__std", outputCol="__pc")]).fit(x)
    y = pipe.transform(x).withColumn("__a", vector_to_array("__pc"))
    loadings = pipe.stages[1].pc.toArray()  # d x 2
    sign = [1.0 if max(c, key=abs) >= 0 else -1.0 for c in loadings.T.tolist()]
    return y.withColumns({f"pc{j + 1}": F.col("__a")[j] * sign[j] for j in range(2)}).drop("__raw", "__std", "__pc", "__a")


def silhouette(df: DataFrame, cols: Sequence[str], cluster: str = "clusters") -> DataFrame:
    """(k, wss, silhouette) of a clustering: within-cluster sum of squares and mean silhouette (squared distances).

    A row's mean squared distance to a cluster follows from the cluster's size, sums
    and sum of squares, so one aggregate gives k small rows and no pair of rows is
    formed.  Rows are centred first.  A row alone in its cluster has silhouette 0.
    """
    cols = list(cols)
    z = _centered(df.where(F.col(cluster).isNotNull()), cols)
    sq = _sq(cols, "__z_")
    per = z.groupBy(F.col(cluster).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum(sq).alias("q"), F.array(*[F.sum(f"__z_{c}") for c in cols]).alias("s"))
    table = per.agg(F.array_sort(F.collect_list(F.struct("c", "n", "q", "s"))).alias("__k"))  # k rows
    point = F.array(*[F.col(f"__z_{c}") for c in cols])
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda acc, e: acc + e)
    x = with_scalars(z.withColumns({"__x": point, "__q": sq}), table)
    far = F.transform("__k", lambda k: F.struct(k["c"].alias("c"), k["n"].alias("n"), (k["n"] * F.col("__q") - 2 * dot(F.col("__x"), k["s"]) + k["q"]).alias("t")))
    x = x.withColumn("__t", far)
    own = F.filter("__t", lambda t: t["c"] == F.col(cluster))[0]
    other = F.array_min(F.transform(F.filter("__t", lambda t: t["c"] != F.col(cluster)), lambda t: F.greatest(t["t"], F.lit(0.0)) / t["n"]))
    x = x.withColumns({"__a": F.try_divide(F.greatest(own["t"], F.lit(0.0)), own["n"] - 1), "__b": other})
    score = F.coalesce(F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), F.try_divide(F.col("__b") - F.col("__a"), F.greatest("__a", "__b"))), F.lit(0.0))
    within = per.select((F.col("q") - dot(F.col("s"), F.col("s")) / F.col("n")).alias("w")).agg(F.sum("w").alias("wss"), F.count(F.lit(1)).cast("int").alias("k"))
    return with_scalars(x.agg(F.avg(score).alias("silhouette")), within).select("k", "wss", "silhouette")


def k_scan(df: DataFrame, cols: Sequence[str], id_cols: Sequence[str], ks: Sequence[int], iters: int = 10, seed: int = 555) -> DataFrame:
    """Within-cluster sum of squares and silhouette for each k (choosing k), on the deterministic Lloyd form."""
    out, df = None, cut_lineage(df)  # read by every k
    for k in ks:
        row = silhouette(lloyd_kmeans(df, cols, id_cols, k, iters, seed), cols).withColumn("k", F.lit(int(k)))
        out = row if out is None else out.unionByName(row)
    return out


# --------------------------------------------------------------------------- PERMANOVA


def _centered(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    x = with_scalars(df, means)
    return x.select("*", *[(F.col(c) - F.col(f"__m_{c}")).alias(f"__z_{c}") for c in cols]) \
        .drop(*[f"__m_{c}" for c in cols])


def _sq(cols: Sequence[str], prefix: str):
    e = None
    for c in cols:
        t = F.col(prefix + c) * F.col(prefix + c)
        e = t if e is None else e + t
    return e


def permanova(df: DataFrame, group: str, cols: Sequence[str], id_cols: Sequence[str],
              permutations: int = 999, seed: int = 555, perm_chunk: int = 250) -> DataFrame:
    """Euclidean PERMANOVA of ``cols`` by ``group``.

    SS_T = sum ||x - mean||^2; SS_W(labels) = SS_T - sum_g ||S_g||^2 / n_g with
    S_g the sum of centred rows of group g.  Each permutation gives every row the
    label at its hash rank (rank of md5(seed, perm, id) inside the permutation);
    one aggregate per (perm, label) yields S_g.

    One pass over rows x permutations does it: the rows around a boundary's expected
    hash keep their own key, all others are summed before they move
    (``_labelled_sums``).  Chunks of ``perm_chunk`` permutations run one after another.
    p = (1 + #{F_perm >= F_obs - sqrt(eps)}) / (permutations + 1).
    """
    cols = list(cols)
    z = _centered(df.where(F.col(group).isNotNull()), cols)
    zc = [f"__z_{c}" for c in cols]
    z = cut_lineage(z.select(group, *id_cols, *zc))
    # group sizes: k rows (bounded by the number of groups)
    sizes = z.groupBy(group).agg(F.count(F.lit(1)).alias("n_g"))
    sizes_rows = sorted((r[group], r["n_g"]) for r in sizes.collect())
    labels = [g for g, _ in sizes_rows]
    n = sum(s for _, s in sizes_rows)
    k = len(labels)
    cuts, acc = [], 0
    for _, s in sizes_rows:
        acc += s
        cuts.append(acc)

    ss_t = z.agg(F.sum(_sq(cols, "__z_")).alias("ss_t"))

    def ss_between(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
        g = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(c) for c in zc])
        g = g.withColumn("__b", _sq(cols, "__z_") / F.col("__n"))
        rest = [c for c in keys if c != "__lab"]
        return g.groupBy(*rest).agg(F.sum("__b").alias("ss_b")) if rest else g.agg(F.sum("__b").alias("ss_b"))

    obs = with_scalars(ss_between(z.withColumn("__lab", F.col(group)), ["__lab"]), ss_t)

    def fstat(ssb, sst):
        ssw = sst - ssb
        return ((sst - ssw) / F.lit(float(k - 1))) / (ssw / F.lit(float(n - k)))

    obs = obs.select("ss_t", "ss_b", fstat(F.col("ss_b"), F.col("ss_t")).alias("f_obs"))

    lab_arr = F.array(*[F.lit(str(g)) for g in labels])
    z, f_row = spread(z), obs.first()
    ge, todo, sigmas = 0, list(range(1, permutations + 1)), 4.0
    while todo:
        again = []
        for start in range(0, len(todo), perm_chunk):
            parts = _labelled_sums(z, todo[start:start + perm_chunk], id_cols, zc, seed, cuts[:-1], n, sigmas)
            parts = cut_lineage(parts)  # a few rows per permutation
            again += [r["__perm"] for r in parts.where("__split").select("__perm").distinct().collect()]
            whole = parts.where(~F.col("__perm").isin(again)).withColumn("__lab", F.element_at(lab_arr, F.col("__idx") + 1))
            g = whole.groupBy("__perm", "__lab").agg(F.sum("__n").alias("__n"), *[F.sum(c).alias(c) for c in zc])
            sb = g.groupBy("__perm").agg(F.sum(_sq(cols, "__z_") / F.col("__n")).alias("ss_b"))
            f = fstat(F.col("ss_b"), F.lit(f_row["ss_t"]))
            ge += sb.agg(F.count(F.when(f >= F.lit(f_row["f_obs"]) - F.lit(1.4901161193847656e-08), 1)).alias("__ge")).first()["__ge"]  # one number per chunk
        todo, sigmas = again, sigmas * 4
    res = obs.withColumn("__ge", F.lit(ge))
    ssw = F.col("ss_t") - F.col("ss_b")
    pval = (F.col("__ge") + 1) / F.lit(float(permutations + 1))
    term = res.select(F.lit(group).alias("term"), F.lit(k - 1).alias("df"), F.col("ss_b").alias("SumOfSqs"),
                      (F.col("ss_b") / F.col("ss_t")).alias("R2"), F.col("f_obs").alias("statistic"),
                      pval.alias("p_value"))
    resid = res.select(F.lit("Residual").alias("term"), F.lit(n - k).alias("df"), ssw.alias("SumOfSqs"),
                       (ssw / F.col("ss_t")).alias("R2"), F.lit(None).cast("double").alias("statistic"),
                       F.lit(None).cast("double").alias("p_value"))
    total = res.select(F.lit("Total").alias("term"), F.lit(n - 1).alias("df"), F.col("ss_t").alias("SumOfSqs"),
                       F.lit(1.0).alias("R2"), F.lit(None).cast("double").alias("statistic"),
                       F.lit(None).cast("double").alias("p_value"))
    return term.unionByName(resid).unionByName(total)


def _rank_windows(cuts: Sequence[int], n: int, sigmas: float) -> list[tuple[float, float]]:
    """Disjoint parts of the hash range in which the keys at the ranks ``cuts`` of n uniform hashes lie, but for chance."""
    out: list[tuple[float, float]] = []
    for c in sorted(cuts):
        p = c / n
        reach = sigmas * ((p * (1 - p) / n) ** 0.5 + 1 / n)
        lo, hi = max(0.0, p - reach), min(1.0, p + reach)
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def _labelled_sums(z: DataFrame, perms: Sequence[int], id_cols: Sequence[str], cols: Sequence[str], seed: int, cuts: Sequence[int], n: int,
                   sigmas: float) -> DataFrame:
    """(__perm, __idx, __n, sums of ``cols``, __split): sums of the rows by the label index of their hash rank.

    The hashes around each boundary's expected place keep their own key, all others
    are summed map-side into the stretch between two such windows, in one pass over
    rows x permutations; some sigmas * sqrt(n) keys a boundary are then ordered.  A
    stretch or key gets the number of ranks in ``cuts`` at or before its first row less
    one; ``__split`` marks a stretch with a boundary inside, whose permutation has to
    be asked again with wider windows (the widest are the whole range).
    """
    from pyspark.sql import Window
    edges = [e for w in _rank_windows(cuts, n, sigmas) for e in w]
    inner = [e for e in edges if 0.0 < e < 1.0]
    first_is_window = bool(edges) and edges[0] == 0.0
    bounds = [f"{int(e * 16 ** 12):012x}" for e in inner]
    p = z.select(*id_cols, *cols, F.explode(F.array(*[F.lit(i) for i in perms])).alias("__perm"))
    p = p.withColumn("__h", hash_key(seed, "__perm", *id_cols))
    at = F.lit(0)
    for b in bounds:
        at = at + (F.col("__h") >= b).cast("int")
    p = p.withColumn("__at", at)
    single = F.col("__at") % 2 == (0 if first_is_window else 1)
    key = [F.when(single, F.col(c)).alias(f"__k{i}") for i, c in enumerate(["__h", *id_cols])]
    p = p.select("__perm", "__at", single.alias("__single"), *key, *cols)
    keys = ["__at", *[f"__k{i}" for i in range(len(key))]]
    g = p.groupBy("__perm", "__single", *keys).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(c) for c in cols])
    before = F.sum("__n").over(Window.partitionBy("__perm").orderBy(*keys)) - F.col("__n")
    g = g.withColumn("__before", before)
    idx, split = F.lit(0), F.lit(False)
    for c in cuts:
        idx = idx + (F.col("__before") >= c).cast("int")
        split = split | (~F.col("__single") & (F.col("__before") < c) & (F.col("__before") + F.col("__n") > c))
    g = g.select("__perm", idx.alias("__idx"), "__n", *cols, split.alias("__split"))
    return g.groupBy("__perm", "__idx", "__split").agg(F.sum("__n").alias("__n"), *[F.sum(c).alias(c) for c in cols])


def permanova_report(results: dict[str, DataFrame], strip: str = "_perm",
                     replace: tuple[str, str] | None = None) -> DataFrame:
    """Tagged union of PERMANOVA tables, rounded to 2 digits, p <= 0.001 as text."""
    out = None
    for name, df in results.items():
        tag = name.replace(strip, "", 1) if strip else name
        if replace and replace[0] in tag:
            tag = tag.replace(replace[0], replace[1], 1)
        d = df.withColumn("subset", F.lit(tag))
        out = d if out is None else out.unionByName(d)
    return out.select(
        "subset", "term", "df",
        F.bround("SumOfSqs", 2).alias("SumOfSqs"), F.bround("R2", 2).alias("R2"),
        F.bround("statistic", 2).alias("statistic"),
        F.when(F.col("p_value") <= 0.001, F.lit("< 0.001")).otherwise(F.col("p_value").cast("string"))
        .alias("p_value"))


def drop_cooks_outliers(df: DataFrame, key: str, x: str, y: str, factor: float = 5.0) -> DataFrame:
    """Drop rows whose Cook's distance in the per-``key`` line y ~ x exceeds
    ``factor`` times the mean Cook's distance over all rows.

    Closed form for one predictor: leverage h = 1/n + (x - xbar)^2 / Sxx,
    D = e^2 / (2 s^2) * h / (1 - h)^2 with s^2 = SSE / (n - 2).
    """
    g = df.groupBy(key).agg(F.regr_slope(y, x).alias("__b1"), F.regr_intercept(y, x).alias("__b0"),
                            F.avg(x).alias("__xbar"), F.regr_sxx(y, x).alias("__sxx"),
                            F.count(F.lit(1)).alias("__n"))
    j = df.join(g, key)
    e = F.col(y) - (F.col("__b0") + F.col("__b1") * F.col(x))
    j = j.withColumn("__e", e)
    sse = j.groupBy(key).agg(F.sum(F.col("__e") * F.col("__e")).alias("__sse"))
    j = j.join(sse, key)
    dx = F.col(x) - F.col("__xbar")
    h = F.lit(1.0) / F.col("__n") + F.try_divide(dx * dx, F.col("__sxx"))
    s2 = F.try_divide(F.col("__sse"), F.col("__n") - 2)
    d = F.try_divide(F.col("__e") * F.col("__e"), 2 * s2) * F.try_divide(h, (1 - h) * (1 - h))
    j = j.withColumn("__d", d)
    mean_d = j.agg(F.avg("__d").alias("__md"))
    j = with_scalars(j, mean_d)
    keep = F.col("__d").isNull() | (F.col("__d") <= F.lit(factor) * F.col("__md"))
    return j.where(keep).select(*df.columns)
