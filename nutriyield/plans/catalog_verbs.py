"""Registered queries of verbs and sources that no domain pipeline calls by itself."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from nutriyield.functions.semantics import catch_label, cols_between, level_rank, numeric_cols, r_ifelse
from nutriyield.operators import explain as EX
from nutriyield.operators import models as M
from nutriyield.operators import supply as S
from nutriyield.operators import trips as TR
from nutriyield.operators import verbs as V
from nutriyield.plans import oracle as O
from nutriyield.plans.catalog import NUT_MU, _summary_sql, _summary_window, register
from nutriyield.plans.catalog_domain import _clustered, _profile_sql
from nutriyield.plans.inputs import Inputs
from nutriyield.session import checkpoint_dir
from nutriyield.sources import driver as D
from nutriyield.sources import io as IO

# ------------------------------------------------------------------ order


@register("vrb_summary_sorted", O.with_base(O.snap_select(
    "SELECT region, nutrient, annual_kg, row_number() OVER (ORDER BY annual_kg DESC NULLS LAST, region, nutrient) AS pos FROM summary",
    ["annual_kg"], ["region", "nutrient", "pos"]), _summary_sql()))
def _sorted(i: Inputs):
    """SRT-1: the supply table by falling supply, with the position of each row."""
    i = _summary_window(i)
    t = S.summary_table(i.region_stats_adj, i.population, i.rdi, D.SUMMARY_YEAR, 0.20).select("region", "nutrient", "annual_kg")
    return V.arrange(t, [F.col("annual_kg").desc_nulls_last(), F.col("region"), F.col("nutrient")], rank="pos")


@register("vrb_summary_sorted_by_group", O.with_base(O.snap_select(
    "SELECT region, nutrient, annual_kg, row_number() OVER (PARTITION BY nutrient ORDER BY annual_kg DESC NULLS LAST, region) AS pos FROM summary",
    ["annual_kg"], ["region", "nutrient", "pos"]), _summary_sql()))
def _sorted_group(i: Inputs):
    """SRT-2: within each nutrient by falling supply."""
    i = _summary_window(i)
    t = S.summary_table(i.region_stats_adj, i.population, i.rdi, D.SUMMARY_YEAR, 0.20).select("region", "nutrient", "annual_kg")
    return V.arrange(t, [F.col("annual_kg").desc_nulls_last(), F.col("region")], within=["nutrient"], rank="pos")


# ------------------------------------------------------------------ joins and selection


@register("vrb_natural_join", "SELECT c.c_custkey, c.c_name, o.n_orders FROM (SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS c_custkey, c_name FROM customer) c LEFT JOIN "
          "(SELECT CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS c_custkey, count(*) AS n_orders FROM orders GROUP BY 1) o "
          "ON c.c_custkey IS NOT DISTINCT FROM o.c_custkey")
def _natural(i: Inputs):
    """JON-2: left join on every shared name; the keys that stand for "unknown" (NULL) match each other."""
    known = lambda c: F.when(F.col(c) % 7 != 0, F.col(c)).alias("c_custkey")
    n = i.t.orders.groupBy(known("o_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return V.natural_join(i.t.customer.select(known("c_custkey"), "c_name"), n)


@register("vrb_top3_per_group", "SELECT l_returnflag, l_orderkey, l_linenumber, l_quantity, l_suppkey FROM (SELECT *, rank() OVER (PARTITION BY l_returnflag "
          "ORDER BY l_quantity * 100000 + l_suppkey DESC) AS r FROM lineitem) x WHERE r <= 3")
def _top3(i: Inputs):
    """WIN-5: the three largest rows per group with their ties (few groups, so every group is hot)."""
    top = V.top_n_with_ties(i.t.lineitem, ["l_returnflag"], F.col("l_quantity") * 100000 + F.col("l_suppkey"), 3)
    return top.select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")


@register("vrb_full_join_fill", O.with_base(
    "SELECT coalesce(a.tracker_imei, b.tracker_imei) AS tracker_imei, a.n, b.fill FROM "
    "(SELECT tracker_imei, count(*) AS n FROM trip_head WHERE landing_date >= DATE '2000-01-01' GROUP BY 1) a FULL JOIN "
    "(SELECT tracker_imei, min(municipality) AS fill FROM trip_head WHERE landing_date < DATE '2000-01-01' GROUP BY 1) b "
    "ON a.tracker_imei IS NOT DISTINCT FROM b.tracker_imei"))
def _full(i: Inputs):
    """JON-4: full join where NULL keys match, keys filled from either side."""
    h = D.trip_heads(i.t)
    late = F.col("landing_date") >= F.lit("2000-01-01").cast("date")
    a = h.where(late).groupBy("tracker_imei").agg(F.count(F.lit(1)).alias("n"))
    b = h.where(~late).groupBy("tracker_imei").agg(F.min("municipality").alias("fill"))
    return V.nullsafe_join(a, b, ["tracker_imei"], "full").select("tracker_imei", "n", "fill")


@register("vrb_select_range", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem")
def _range(i: Inputs):
    """PRJ-3: the columns from one name to another, in schema order."""
    return i.t.lineitem.select(*cols_between(i.t.lineitem, "l_orderkey", "l_quantity"))


@register("vrb_select_pattern", O.with_base(O.snap_select(
    f"SELECT grouped_taxa, {', '.join(NUT_MU)} FROM nutrients", NUT_MU, ["grouped_taxa"])))
def _pattern(i: Inputs):
    """PRJ-4: the columns whose name contains a text."""
    return i.nutrients.select("grouped_taxa", *V.cols_matching(i.nutrients, contains="_mu"))


@register("vrb_sum_numeric", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber, "
          + ", ".join(f"{O.snap(f'sum({c})')} AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
          + " FROM lineitem GROUP BY 1")
def _numeric(i: Inputs):
    """AGG-12: sums of all numeric columns but the keys."""
    li = i.t.lineitem
    return li.groupBy("l_returnflag").agg(*[F.sum(c).alias(c) for c in numeric_cols(li, ["l_orderkey", "l_partkey", "l_suppkey"])])


@register("vrb_pivot_wide", "SELECT o_custkey, " + ", ".join(
    f"max(n) FILTER (WHERE o_orderstatus = '{s}') AS \"{s}\"" for s in "FOP")
    + " FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) x GROUP BY 1")
def _pivot(i: Inputs):
    """RSH-2: one column per level of an explicit list."""
    n = i.t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return V.pivot_wide(n, ["o_custkey"], "o_orderstatus", "n", list("FOP"))


@register("vrb_unpivot_long", "SELECT o_custkey, 'a' AS name, min(o_orderkey) AS value FROM orders GROUP BY 1 UNION ALL "
          "SELECT o_custkey, 'b', max(o_orderkey) FROM orders GROUP BY 1")
def _unpivot(i: Inputs):
    """RSH-1: columns to rows."""
    x = i.t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    return V.unpivot_long(x, ["o_custkey"], ["a", "b"])


@register("vrb_unnest_catch", "SELECT CAST(l_orderkey AS VARCHAR) AS landing_id, CAST(count(*) AS BIGINT) AS n_rows, "
          f"{O.snap('sum(l_quantity * (1.0 - l_discount))')} AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def _unnest(i: Inputs):
    """RSH-3: the two-level unnest in row form."""
    rows = TR.unnest_catch(D.catch_data(i.t).select("landing_id", "landing_catch"))
    return rows.groupBy("landing_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("weight").alias("weight"))


@register("vrb_labels", "SELECT o_orderkey, CASE WHEN o_totalprice / 100000.0 < 1 THEN '<1' ELSE "
          "format('{:,}', CAST(round_even(o_totalprice / 100000.0, 0) AS BIGINT)) END AS label, "
          "CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 END AS pos, "
          "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 > 3 THEN 'high' ELSE 'low' END AS side FROM orders")
def _labels(i: Inputs):
    """FN-7, FN-13, FN-16: the "<1" label, a condition whose NULL stays NULL, positions in a level list."""
    o = i.t.orders
    rest = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 7)
    return o.select("o_orderkey", catch_label(F.col("o_totalprice") / 100000.0).alias("label"),
                    level_rank("o_orderstatus", ["P", "O"]).alias("pos"), r_ifelse(rest > 3, "high", "low").alias("side"))


# ------------------------------------------------------------------ Shapley values of a known scorer

SHAP_FEATURES = ["habitat", "propulsion_gear", "mesh_size"]


class LookupScorer:
    """A scorer that SQL can repeat: one product and one sum of the features."""

    classes = ["1", "2"]

    def transform(self, df):
        p = (F.length("habitat") * F.col("mesh_size") + 10 * F.length("propulsion_gear")) / 1000.0
        return df.withColumns({"pred_1": p, "pred_2": 1.0 - p})


def _shap_sql(n_bg: int = 50) -> dict:
    p = len(SHAP_FEATURES)
    take = lambda m: [f"{'t' if m >> j & 1 else 'b'}.{f}" for j, f in enumerate(SHAP_FEATURES)]
    value = lambda m: "avg((length({0}) * {2} + 10 * length({1})) / 1000.0)".format(*take(m))
    d = {"bg": f"SELECT {', '.join(SHAP_FEATURES)} FROM trip_head ORDER BY md5('1|' || landing_id), landing_id LIMIT {n_bg}",
         "tup": f"SELECT DISTINCT {', '.join(SHAP_FEATURES)} FROM trip_head",
         "vals": f"SELECT {', '.join('t.' + f for f in SHAP_FEATURES)}, " + ", ".join(f"{value(m)} AS v{m}" for m in range(2 ** p))
                 + f" FROM tup t, bg b GROUP BY {', '.join('t.' + f for f in SHAP_FEATURES)}"}
    weight = {0: 1 / 3, 1: 1 / 6, 2: 1 / 3}
    rows = []
    for j, f in enumerate(SHAP_FEATURES):
        phi = " + ".join(f"{weight[bin(m).count('1')]!r} * (v{m | 1 << j} - v{m})" for m in range(2 ** p) if not m >> j & 1)
        rows += [f"SELECT {', '.join(SHAP_FEATURES)}, '{c}' AS class, '{f}' AS feature, {sign}({phi}) AS shap FROM vals" for c, sign in (("1", ""), ("2", "-"))]
    d["phi"] = " UNION ALL ".join(rows)
    return d


@register("ml_kernel_shap_lookup", O.with_base(O.snap_select(
    "SELECT h.landing_id, p.class, p.feature, round(p.shap, 9) AS shap FROM trip_head h JOIN phi p ON "
    + " AND ".join(f"h.{f} = p.{f}" for f in SHAP_FEATURES), ["shap"], ["landing_id", "class", "feature"]), _shap_sql()))
def _shap_lookup(i: Inputs):
    """ML-21: exact Shapley values of a scorer that SQL can repeat (8 coalitions, 50 background rows)."""
    s = EX.kernel_shap(LookupScorer(), D.trip_heads(i.t).select("landing_id", *SHAP_FEATURES), SHAP_FEATURES, ["landing_id"], n_bg=50, seed=1)
    return s.select("landing_id", "class", "feature", F.round("shap", 9).alias("shap"))


@register("ml_lump_near_zero_planted", O.snap_select(
    "SELECT name, CAST(count(*) AS BIGINT) AS n, sum(x) AS x FROM (SELECT CASE WHEN r <= 10 THEN 'Others' ELSE p_brand END AS name, x FROM "
    "(SELECT p_brand, p_retailprice * ((p_partkey % 7) - 3) AS x FROM part) a JOIN (SELECT p_brand AS b, rank() OVER (ORDER BY avg(-abs("
    "p_retailprice * ((p_partkey % 7) - 3))) DESC) AS r FROM part GROUP BY 1) l ON a.p_brand = l.b) z GROUP BY 1", ["x"], ["name", "n"]))
def _lump_planted(i: Inputs):
    """ML-24: 10 of 25 levels, those nearest zero, pooled to "Others"."""
    x = i.t.part.select("p_brand", (F.col("p_retailprice") * (F.col("p_partkey") % 7 - 3)).alias("shap"))
    out = EX.lump_near_zero(x, "p_brand", "shap", 10).groupBy(F.col("p_brand").alias("name"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("shap").alias("x"))


@register("ml_dummies_planted", "SELECT o_orderkey, " + ", ".join(
    f"CASE WHEN o_orderstatus = '{s}' THEN 1.0e0 ELSE 0.0e0 END AS o_orderstatus_{s}" for s in "OP") + " FROM orders")
def _dummies_planted(i: Inputs):
    """ML-9: treatment coding against the first level."""
    return M.dummies(i.t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@register("ml_importance_planted", "SELECT category, CAST(sum(importance) AS DOUBLE) AS aggregated_importance, 'All' AS model FROM "
          "(SELECT CASE WHEN contains(p_brand, '1') THEN 'One' WHEN contains(p_brand, '2') THEN 'Two' ELSE 'Other' END AS category, "
          "CAST(p_size AS DOUBLE) AS importance FROM part) x GROUP BY 1")
def _importance_planted(i: Inputs):
    """ML-20: importance summed by the first rule that an encoded name meets."""
    imp = i.t.part.select(F.col("p_brand").alias("variable"), F.col("p_size").cast("double").alias("importance"))
    g = M.importance_by_feature(imp, [("1", "one"), ("2", "two")], "All")
    return g.select(F.initcap("category").alias("category"), "aggregated_importance", "model")


# ------------------------------------------------------------------ sources and sinks


def _folder(i: Inputs) -> str:
    """A new folder under the shared scratch folder of the session."""
    return f"{checkpoint_dir(i.spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


@register("src_csv_scan", "SELECT n_name AS region, c_mktsegment AS gender, CAST(c_custkey % 80 AS INTEGER) AS age, "
          "CAST(c_custkey % 5 + 1 AS INTEGER) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _csv(i: Inputs):
    """SRC-1: a table written as CSV and read with a header and a declared schema."""
    path = _folder(i)
    k = F.col("c_custkey")
    i.t.customer.join(i.t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("region"), F.col("c_mktsegment").alias("gender"), (k % 80).cast("int").alias("age"),
        (k % 5 + 1).cast("int").alias("count")).write.option("header", True).csv(path)
    return IO.read_csv(i.spark, path, IO.CENSUS_SCHEMA)


@register("src_latest_read", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def _read_latest(i: Inputs):
    """SRC-4, SRC-6, SRC-7: versions are written, listed from the store, and the wanted one is read.

    The listing is a table, as an object store's inventory gives it; the sink overwrites and partitions."""
    root = _folder(i)
    for status, version in (("F", "v1"), ("P", "v2")):
        IO.write_table(i.t.orders.where(F.col("o_orderstatus") == status).select("o_orderkey", "o_orderstatus"),
                       f"{root}/orders__{version}__parquet")
    files = IO.list_objects(i.spark, f"{root}/*", "*.parquet")
    folders = files.select(F.element_at(F.split("path", "/"), -2).alias("name"), "updated").groupBy("name").agg(F.max("updated").alias("updated"))
    return IO.read_latest(i.spark, folders, root, "orders", version="v2", extension="parquet", exact_match=True)


@register("src_put_latest", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _put_latest(i: Inputs):
    """SRC-6, SRC-7: two versions are put, and the later one is found by the manifest and read."""
    root, orders = _folder(i), i.t.orders
    IO.put_version(orders.select("o_orderkey", "o_orderstatus"), root, "orders", "v1")
    IO.put_version(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), root, "orders", "v2")
    return IO.read_published(i.spark, root, "orders", extension="parquet", exact_match=True)


@register("src_partitioned_sink", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def _partitioned(i: Inputs):
    """SRC-4: a partitioned sink, read with the partition pruned."""
    path = _folder(i)
    IO.write_table(i.t.orders.select("o_orderkey", "o_orderstatus"), path, ["o_orderstatus"])
    return IO.read_table(i.spark, path).where(F.col("o_orderstatus") == "O").select("o_orderkey", F.col("o_orderstatus").cast("string").alias("o_orderstatus"))


# ------------------------------------------------------------------ recipe steps that a planted column exercises


@register("ml_zero_variance_planted", O.with_base(O.snap_select(
    "SELECT landing_id, mesh_size FROM gn_clustered", ["mesh_size"], ["landing_id"]), _profile_sql(True)))
def _zero_variance(i: Inputs):
    """ML-7: a constant and an empty column go, a varying one stays."""
    x = _clustered(i, True).select("landing_id", "mesh_size").withColumns({"constant": F.lit(3.0), "empty": F.lit(None).cast("double")})
    return M.drop_zero_variance(x, ["mesh_size", "constant", "empty"])
