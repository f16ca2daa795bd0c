"""Generic table verbs with explicit null, tie and ordering rules.

Skew rule used throughout: no verb puts a whole group key into one task.
Ranks inside a group are computed over hash buckets (``bucketed_rank``) and
global scalars are one-row aggregates joined back, never unpartitioned windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --------------------------------------------------------------------------- joins


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on every shared column name (dplyr's default ``by``); NULL keys match each other, as in R."""
    on = [c for c in left.columns if c in right.columns]
    if not on:
        raise ValueError("natural_join: no shared columns")
    return nullsafe_join(left, right, on, how)


def nullsafe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join where NULL keys match each other (R's join default)."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        e = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = e if cond is None else cond & e
    out = left.join(r, cond, how)
    if how in ("right", "full", "outer", "full_outer", "right_outer"):
        out = out.withColumns({k: F.coalesce(left[k], r[f"__r_{k}"]) for k in keys})
    return out.drop(*[f"__r_{k}" for k in keys])


def anti_in(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None) -> DataFrame:
    """``!x %in% unique(y)``: keeps left rows whose key is absent, NULL keys kept."""
    rk = right_key or key
    r = right.select(F.col(rk).alias("__k")).where(F.col("__k").isNotNull()).distinct()
    return left.join(r, left[key] == r["__k"], "left_anti")


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row.

    The aggregate becomes one scalar subquery (a struct, computed once and
    inlined as a value): no join and no unpartitioned window."""
    cols = scalars.columns
    s = scalars.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__s")).scalar()
    return df.select("*", *[s[c].alias(c) for c in cols])


# --------------------------------------------------------------------------- reshape


def unpivot_long(df: DataFrame, ids: Sequence[str], values: Sequence[str],
                 names_to: str = "name", values_to: str = "value") -> DataFrame:
    """``pivot_longer``: NULL values are kept (as tidyr does)."""
    return df.unpivot(list(ids), list(values), names_to, values_to)


def pivot_wide(df: DataFrame, ids: Sequence[str], names_from: str, values_from: str,
               levels: Sequence[str]) -> DataFrame:
    """``pivot_wider`` with an explicit level list (no distinct-values pass).

    Keys must be unique per (ids, name); ``first`` of one value is exact then.
    """
    return (df.groupBy(*ids).pivot(names_from, list(levels))
            .agg(F.first(values_from, ignorenulls=False)))


def wide_from_long_exprs(levels: Sequence[str], name_col: str, value_col: str) -> list[Column]:
    """Conditional-aggregate form of a pivot, usable inside a larger ``agg``."""
    return [F.max(F.when(F.col(name_col) == lv, F.col(value_col))).alias(lv) for lv in levels]


def add_total_row(df: DataFrame, key: str, value_aggs: dict[str, Column], label: str,
                  extra_keys: Sequence[str] = ()) -> DataFrame:
    """Rows per ``key`` plus one total row labelled ``label``.

    Uses ROLLUP and ``grouping_id`` so that a real NULL key stays NULL and the
    total is never confused with it.
    """
    keys = list(extra_keys) + [key]
    g = df.rollup(*keys).agg(*[e.alias(n) for n, e in value_aggs.items()],
                             F.grouping_id(*keys).alias("__gid"))
    # keep the per-key rows and the total over ``key`` only (extra keys stay grouped)
    total_gid = 1
    keep = (F.col("__gid") == 0) | (F.col("__gid") == total_gid)
    g = g.where(keep)
    return (g.withColumn(key, F.when(F.col("__gid") == total_gid, F.lit(label)).otherwise(F.col(key)))
            .drop("__gid"))


# --------------------------------------------------------------------------- selection and order


def cols_matching(df: DataFrame, contains: str | None = None, starts_with: str | None = None,
                  without: str | None = None) -> list[str]:
    """Column names by a literal pattern (``contains``, ``starts_with``, ``!contains``), in schema order."""
    return [c for c in df.columns if (contains is None or contains in c)
            and (starts_with is None or c.startswith(starts_with)) and (without is None or without not in c)]


def arrange(df: DataFrame, by: Sequence[Column], within: Sequence[str] = (), rank: str | None = None) -> DataFrame:
    """``arrange(..., .by_group)``: a global sort by the group columns, then ``by``.

    ``rank`` adds the row's position in its group (or in the table).  Positions
    need a total order; they are for report tables, whose groups hold a few rows.
    """
    if rank:
        df = df.withColumn(rank, F.row_number().over(Window.partitionBy(*within).orderBy(*by)))
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in within], *by)


# --------------------------------------------------------------------------- ranks and samples


def top_n_with_ties(df: DataFrame, part: Sequence[str], order: Column, n: int = 1) -> DataFrame:
    """``slice_max(order, n)`` per group, ties kept; a NULL group is a group, NULL values are never kept.

    Two stages so a hot group never sorts in one task: every task keeps the n
    largest values of a group before the shuffle (a group limit), their n-th is the
    group's threshold, and rows at or above it are kept.
    """
    part = list(part)
    x = df.withColumn("__order", order).where(F.col("__order").isNotNull())
    if n == 1:
        best = x.groupBy(*part).agg(F.max("__order").alias("__best"))
    else:
        pos = F.row_number().over(Window.partitionBy(*part).orderBy(F.col("__order").desc()))
        best = x.select(*part, "__order").withColumn("__pos", pos).where(F.col("__pos") <= n).groupBy(*part).agg(F.min("__order").alias("__best"))
    return nullsafe_join(x, best, part, "inner").where(F.col("__order") >= F.col("__best")).drop("__order", "__best")


def global_top_n_with_ties(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """Global ``slice_max`` with ties: threshold from a distributed top-n, then filter."""
    thr = (df.select(order_col).where(F.col(order_col).isNotNull())
           .orderBy(F.col(order_col).desc()).limit(n)
           .agg(F.min(order_col).alias("__thr")))
    return with_scalars(df, thr).where(F.col(order_col) >= F.col("__thr")).drop("__thr")


def hash_key(seed: int | str, *cols) -> Column:
    """Deterministic pseudo-random order key: md5 of the seed and the row key."""
    parts = [F.lit(str(seed))]
    for c in cols:
        parts += [F.lit("|"), F.coalesce(F.col(c).cast("string"), F.lit("NA"))]
    return F.md5(F.concat(*parts))


def bucketed_rank(df: DataFrame, keys: Sequence[str], order_key: str, bucket_digits: int = 3,
                  tie_cols: Sequence[str] = ()) -> DataFrame:
    """1-based position of each row inside its group, ordered by a hex hash column.

    A plain ``row_number`` window sends a whole group into one task.  Here the
    first ``bucket_digits`` hex digits of the (uniform) hash split each group
    into up to 16**digits buckets: counts per bucket become offsets (a window over
    at most 4096 count rows per group), and only rows of one bucket are sorted
    together.  The result equals ``row_number() over (partition by keys order by
    order_key, tie_cols)``.  ``bucket_digits <= 0`` is the plain window, for
    callers that know every group is small and of equal size.
    """
    keys = list(keys)
    if bucket_digits <= 0:
        # groups known to be bounded and unskewed: one sort per group is enough
        w = Window.partitionBy(*keys).orderBy(F.col(order_key), *[F.col(c) for c in tie_cols])
        return df.withColumn("__pos", F.row_number().over(w).cast("long"))
    b = F.conv(F.substring(F.col(order_key), 1, bucket_digits), 16, 10).cast("int")
    x = df.withColumn("__b", b)
    counts = x.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    wo = Window.partitionBy(*keys).orderBy("__b") if keys else Window.orderBy("__b")
    offsets = counts.withColumn("__off", F.sum("__n").over(wo) - F.col("__n")).drop("__n")
    local = Window.partitionBy(*keys, "__b").orderBy(F.col(order_key), *[F.col(c) for c in tie_cols])
    return (x.join(offsets, keys + ["__b"])
            .withColumn("__pos", (F.col("__off") + F.row_number().over(local)).cast("long"))
            .drop("__b", "__off"))


def rank_cuts(df: DataFrame, strata: Sequence[str], ranks: DataFrame, order_key: str, tie_cols: Sequence[str],
              digits: int = 3, limit: int = 50_000) -> DataFrame:
    """Per (stratum, rank) the (hash, ties) of the row at that 1-based rank in hash order: (strata.., __rank, __cut).

    Radix selection over all pairs at once: rows stay where they are, and the
    hashes' next ``digits`` hex digits are counted map-side below the one prefix
    that holds the rank, until it holds at most ``limit`` rows or the hash is used
    up (rows of equal hash then are equal in their ids).  Only the rows of that
    prefix are ordered, so no window holds more than ``limit`` of them.  Ranks
    outside 1..n have no row.  ``ranks``: strata.., __rank (a bounded number of
    pairs, which go to the driver).
    """
    strata, spark = list(strata), df.sparkSession
    kinds = [f"`{k}` {t}" for k, t in df.select(*strata).dtypes]
    schema = ", ".join([*kinds, "__rank long", "__prefix string", "__skip long"])
    key = F.struct(F.col(order_key), *[F.col(c) for c in tie_cols])
    rows = df.select(*strata, F.col(order_key).alias("__h"), key.alias("__key"))
    live = [(*[r[k] for k in strata], r["__rank"], "", 0) for r in ranks.where("__rank > 0").collect()]
    done, depth = [], 0
    while live:
        at = F.broadcast(spark.createDataFrame(live, schema))  # a row per stratum and rank
        under = _below(rows, at, strata, depth)
        counts = under.groupBy(*strata, "__rank", "__skip", F.substring("__h", 1, depth + digits).alias("__prefix")).agg(F.count(F.lit(1)).alias("__n"))
        # at most 16 ** digits rows per pair
        upto = F.col("__skip") + F.sum("__n").over(Window.partitionBy(*strata, "__rank").orderBy("__prefix"))
        found = counts.withColumn("__to", upto).where((F.col("__rank") <= F.col("__to")) & (F.col("__rank") > F.col("__to") - F.col("__n"))).collect()
        depth += digits
        live = []
        for r in found:
            pair = (*[r[k] for k in strata], r["__rank"], r["__prefix"], r["__to"] - r["__n"])
            (live if r["__n"] > limit and depth < 32 else done).append((depth, pair))
        live = [pair for _, pair in live]
    out = None
    for d in sorted({d for d, _ in done}):
        at = F.broadcast(spark.createDataFrame([pair for e, pair in done if e == d], schema))
        pos = F.row_number().over(Window.partitionBy(*strata, "__rank").orderBy("__key"))
        hit = _below(rows, at, strata, d).withColumn("__pos", pos + F.col("__skip")).where(F.col("__pos") == F.col("__rank"))
        hit = hit.select(*strata, "__rank", F.col("__key").alias("__cut"))
        out = hit if out is None else out.unionByName(hit)
    if out is None:
        out = rows.select(*strata, F.lit(0).cast("long").alias("__rank"), F.col("__key").alias("__cut")).limit(0)
    return out


def _below(rows: DataFrame, at: DataFrame, strata: Sequence[str], depth: int) -> DataFrame:
    """``rows`` whose hash starts with the prefix of a pair of their stratum, once per pair."""
    on = F.substring("r.__h", 1, depth) == F.col("a.__prefix")
    for k in strata:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"a.{k}"))
    return rows.alias("r").join(at.alias("a"), on).select(*[F.col(f"r.{k}") for k in strata], "a.__rank", "a.__skip", "r.__h", "r.__key")


def hash_cuts(df: DataFrame, strata: Sequence[str], prop: float, order_key: str, tie_cols: Sequence[str]) -> DataFrame:
    """Per stratum the (hash, ties) of its floor(prop * n)-th row in hash order, as ``__cut`` (no row: none)."""
    ranks = df.groupBy(*strata).agg(F.floor(F.count(F.lit(1)) * F.lit(prop)).cast("long").alias("__rank"))
    return rank_cuts(df, strata, ranks, order_key, tie_cols).drop("__rank")


def with_hash_cut(df: DataFrame, strata: Sequence[str], prop: float, order_key: str, tie_cols: Sequence[str]) -> DataFrame:
    """``df`` with ``__in``: the row is among the first floor(prop * n) of its stratum in hash order."""
    cuts = hash_cuts(df, strata, prop, order_key, tie_cols)
    key = F.struct(F.col(order_key), *[F.col(c) for c in tie_cols])
    if strata:
        on = None
        for k in strata:
            e = F.col(f"x.{k}").eqNullSafe(F.col(f"c.{k}"))
            on = e if on is None else on & e
        x = df.alias("x").join(cuts.alias("c"), on, "left").select("x.*", "__cut")  # one row per stratum; AQE measures it
    else:
        x = with_scalars(df, cuts)
    return x.withColumn("__in", F.coalesce(key <= F.col("__cut"), F.lit(False))).drop("__cut")


def sample_fraction(df: DataFrame, id_cols: Sequence[str], prop: float, seed: int,
                    strata: Sequence[str] = ()) -> DataFrame:
    """Sample ``floor(prop * n)`` rows without replacement (per stratum if given).

    Deterministic: the first ``floor(prop*n)`` rows by md5(seed, id), found by a
    threshold and filtered in place, whatever the partitioning.
    """
    x = df.withColumn("__h", hash_key(seed, *id_cols))
    return with_hash_cut(x, strata, prop, "__h", id_cols).where("__in").drop("__h", "__in")


def sample_n(df: DataFrame, id_cols: Sequence[str], n: int, seed: int) -> DataFrame:
    """Fixed-size sample without replacement (a distributed top-n by hash)."""
    return (df.withColumn("__h", hash_key(seed, *id_cols))
            .orderBy("__h", *id_cols).limit(n).drop("__h"))


def mode_by(df: DataFrame, key: str, value: str, out: str = "mode") -> DataFrame:
    """Most frequent non-NULL ``value`` per ``key``; ties go to the smallest value.

    Counts are pre-aggregated per (key, value) before the per-key reduction, so
    a hot key costs one partial aggregate, not one task holding all its rows.
    """
    c = (df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
         .groupBy(key, value).agg(F.count(F.lit(1)).alias("__n")))
    return c.groupBy(key).agg(
        F.min_by(F.col(value), F.struct((-F.col("__n")).alias("a"), F.col(value).alias("b"))).alias(out))


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``group_by(keys) |> summarise(across(everything(), first))`` with a total order."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in rest])
    okey = F.struct(*[F.col(c) for c in order])
    return (df.groupBy(*keys).agg(F.min_by(packed, okey).alias("__r"))
            .select(*keys, "__r.*"))


def exact_median_by(df: DataFrame, keys: Sequence[str], value_cols: Sequence[str],
                    accuracy: int = 10000) -> DataFrame:
    """Exact interpolated median per group (NULL and NaN skipped), safe for hot groups.

    Spark's ``median`` merges a value->count map of a whole group in one task.
    Here ``percentile_approx`` (a bounded sketch, merged map-side) brackets the
    middle ranks, equal values are counted before they move, and a running count
    over the few distinct values inside the bracket -- about 8 n / ``accuracy``
    at most -- picks the two middle order statistics.  Their mean is the median,
    as R computes it.  One plan for every group size, and no arrays.
    """
    keys = list(keys)
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("var"), F.col(c).cast("double").alias("v"))
                             for c in value_cols])).alias("__kv")
    every = df.select(*keys, kv).select(*keys, "__kv.var", F.nanvl("__kv.v", F.lit(None).cast("double")).alias("v"))
    long = every.where(F.col("v").isNotNull())
    g = keys + ["var"]
    eps = 4.0 / accuracy
    q = F.percentile_approx("v", [max(0.0, 0.5 - eps), min(1.0, 0.5 + eps)], accuracy)
    stats = every.groupBy(*g).agg(F.count("v").alias("__n"), q.alias("__q"))
    stats = stats.select(*g, "__n", F.col("__q")[0].alias("__lo"), F.col("__q")[1].alias("__hi"))
    pick = None
    for k in g:  # a NULL group is a group
        e = F.col(f"a.{k}").eqNullSafe(F.col(f"s.{k}"))
        pick = e if pick is None else pick & e
    counts = long.groupBy(*g, "v").agg(F.count(F.lit(1)).alias("__c"))
    j = counts.alias("a").join(stats.alias("s"), pick).select(*[F.col(f"a.{k}") for k in g], "v", "__c", "__n", "__lo", "__hi")
    # everything below the bracket is one row per group, the values inside keep theirs
    at = F.when(F.col("v") >= F.col("__lo"), F.col("v"))
    inside = j.where(F.col("v") <= F.col("__hi")).groupBy(*g, at.alias("v")).agg(
        F.sum("__c").alias("__c"), F.first("__n").alias("__n"))
    upto = F.sum("__c").over(Window.partitionBy(*g).orderBy(F.col("v").asc_nulls_first()))
    r = inside.withColumn("__to", upto).where(F.col("v").isNotNull())
    low, high = F.floor((F.col("__n") + 1) / 2), F.floor((F.col("__n") + 2) / 2)  # 1-based middle ranks
    has = lambda rank: (F.col("__to") >= rank) & (F.col("__to") - F.col("__c") < rank)
    med = r.groupBy(*g).agg(((F.max(F.when(has(low), F.col("v"))) + F.max(F.when(has(high), F.col("v")))) / 2.0).alias("__med"))
    # a group without values keeps its row
    med = med.unionByName(stats.select(*g, F.lit(None).cast("double").alias("__med")))
    return med.groupBy(*keys).agg(*[F.max(F.when(F.col("var") == c, F.col("__med"))).alias(c) for c in value_cols])


def level_order(df: DataFrame, level: str, measure: str, out: str | None = None) -> DataFrame:
    """``reorder(level, measure)``: 1-based rank of each level by the mean of
    ``measure`` (ties by level).  Level means are one aggregate; the rank window
    runs over the distinct levels only."""
    out = out or f"{level}_order"
    means = df.groupBy(level).agg(F.avg(measure).alias("__m"))
    ranked = means.withColumn(out, F.row_number().over(Window.orderBy(F.col("__m").asc_nulls_last(),
                                                                      F.col(level)))).drop("__m")
    return df.join(ranked, df[level].eqNullSafe(ranked[level]), "left").drop(ranked[level])


def separate(df: DataFrame, col: str, into: Sequence[str], sep: str = "_") -> DataFrame:
    """``tidyr::separate``: split a string column on a literal separator into
    columns; missing pieces are NULL and extra pieces are dropped."""
    import re
    parts = F.split(F.col(col), re.escape(sep))
    return df.select(*[c for c in df.columns if c != col],
                     *[F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(into)])
