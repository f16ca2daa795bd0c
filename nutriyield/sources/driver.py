"""Domain inputs derived from the driver's TPC-H-style tables.

The study's own inputs (regional catch estimates, species nutrient predictions,
census counts, nested trip records) are not public, so each is derived here from
the driver tables by a fixed rule.  Every derivation is a plain Spark plan over
whole tables; the matching DuckDB text lives in ``nutriyield.plans.oracle``.

Scale notes: lineitem is the only large table.  Dimension joins (nation, the
25-row brand map) are literal or bounded; part/supplier/orders joins are left to
AQE, which only broadcasts a side after measuring it at runtime.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nutriyield.sources import literals as L

REGIONS = ["NATION_0", "NATION_1", "NATION_2", "NATION_3", "NATION_4"]
# stand-in years: 2000 for 2022, 1998-2000 for 2020-2022, 2001-01-01 for 2024-01-01
SUMMARY_YEAR = 2000
SUPPLY_YEARS = [1998, 1999, 2000]
ADJUST_BEFORE = "2001-01-01"
TRIP_START, TRIP_END = "1995-01-01", "2001-12-31"


class Tables:
    """Lazy access to the driver parquet files of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        # one read (one footer/schema job) per table; later accesses reuse the plan
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        setattr(self, name, df)
        return df


def _brand_no(c="p_brand"):
    return F.substring(F.col(c), 7, 3).cast("int")


def part_taxa(t: Tables) -> DataFrame:
    """part -> (p_partkey, p_name, grouped_taxa) through the 25-row brand map."""
    return (t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
            .join(F.broadcast(L.brand_taxa_df(t.spark)), "p_brand"))


def region_parts(t: Tables, ship_from: str | None = None, ship_to: str | None = None) -> DataFrame:
    """Regional monthly catch estimate per taxon: (region, date_bin_start, grouped_taxa, catch).

    ``ship_from`` / ``ship_to`` (month starts, end exclusive) restrict the raw
    ship date at the scan, where Parquet can prune; a filter on the month bin
    after the aggregate could not be pushed there.
    """
    li = t.lineitem.select("l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    if ship_from:
        li = li.where(F.col("l_shipdate") >= F.lit(ship_from).cast("timestamp_ntz"))
    if ship_to:
        li = li.where(F.col("l_shipdate") < F.lit(ship_to).cast("timestamp_ntz"))
    sup = t.supplier.select("s_suppkey", "s_nationkey")
    nat = F.broadcast(t.nation.select("n_nationkey", "n_name"))  # 25 rows by TPC-H definition
    return (li.join(sup, li.l_suppkey == sup.s_suppkey)
            .join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(part_taxa(t).select("p_partkey", "grouped_taxa"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("n_name").alias("region"),
                     F.trunc(F.to_date("l_shipdate"), "MM").alias("date_bin_start"),
                     "grouped_taxa")
            .agg(F.sum("l_quantity").alias("catch")))


def species(t: Tables) -> DataFrame:
    """Species list: (Species, SpecCode, interagency_code)."""
    return part_taxa(t).select(F.col("p_name").alias("Species"),
                               F.col("p_partkey").cast("int").alias("SpecCode"),
                               F.col("grouped_taxa").alias("interagency_code"))


def predictions(t: Tables) -> DataFrame:
    """Species nutrient predictions per 100 g; one in ten species has none."""
    p = t.part.where(F.col("p_partkey") % 10 != 0)
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    return p.select(
        F.col("p_partkey").cast("int").alias("SpecCode"),
        (size * 10.0).alias("Calcium"),
        (price / 2000.0).alias("Iron"),
        (price / 5000.0).alias("Omega3"),
        (size / 5.0 + 15.0).alias("Protein"),
        (size * 0.9 + 20.0).alias("Selenium"),
        F.when(F.col("p_partkey") % 7 != 0, size * 3.0).alias("VitaminA"),
        (price / 1000.0).alias("Zinc"),
    )


def fao_raw(t: Tables) -> DataFrame:
    """Food-composition table (raw and cooked rows) derived from supplier."""
    codes = F.array(*[F.lit(c) for c in L.FAO_RAW_CODES])
    a = F.abs(F.col("s_acctbal"))
    return t.supplier.select(
        F.element_at(codes, (F.col("s_suppkey") % len(L.FAO_RAW_CODES) + 1).cast("int")).alias("integragency_code"),
        F.when(F.col("s_suppkey") % 4 == 0, F.lit("c")).otherwise(F.lit("r")).alias("food_state"),
        (a / 1000.0 + 10.0).alias("protein(g)"),
        (a / 20.0 + 50.0).alias("calcium(mg)"),
        (a / 5000.0 + 1.0).alias("iron(mg)"),
        (a / 4000.0 + 1.0).alias("zinc(mg)"),
        (a / 300.0 + 30.0).alias("selenium(mcg)"),
        F.when(F.col("s_suppkey") % 5 != 0, a / 100.0).alias("vitaminA(mcg)"),
        (a / 20000.0 + 0.1).alias("omega3(g)"),
    )


def edible_portions(t: Tables) -> DataFrame:
    """Edible share per taxon; brands with number divisible by 6 have none."""
    b = t.part.select("p_brand").distinct()
    return (b.where(_brand_no() % 6 != 0)
            .join(F.broadcast(L.brand_taxa_df(t.spark)), "p_brand")
            .select("grouped_taxa", (F.lit(0.5) + (_brand_no() % 5) / 10.0).alias("ep_coeff")))


def census(t: Tables) -> DataFrame:
    """Census counts: (region, gender, age, count)."""
    nat = F.broadcast(t.nation.select("n_nationkey", "n_name"))
    k = F.col("c_custkey")
    return (t.customer.join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("n_name").alias("region"),
                    F.when(k % 2 == 0, F.lit("Female")).otherwise(F.lit("Male")).alias("gender"),
                    (k % 80).cast("int").alias("age"),
                    (k % 5 + 1).cast("int").alias("count")))


def _nutrient_struct_fields():
    q = F.col("l_quantity")
    tax, disc = F.col("l_tax"), F.col("l_discount")
    return [
        F.when((F.col("l_orderkey") % 11 == 0) & (F.col("l_linenumber") == 1), F.lit(None).cast("double"))
        .otherwise(q).alias("catch"),
        (q * (F.lit(1.0) - disc)).alias("weight"),
        (q * 3.0e-7 * (tax + 1.0)).alias("Selenium_mu"),
        (q * 2.0e-5 * (disc + 1.0)).alias("Zinc_mu"),
        (q * 0.18 * (tax * 0.5 + 1.0)).alias("Protein_mu"),
        (q * 0.003 * (disc * 5.0 + 1.0)).alias("Omega_3_mu"),
        (q * 5.0e-4 * (tax * 3.0 + 1.0)).alias("Calcium_mu"),
        (q * 1.0e-5 * (disc + 1.0)).alias("Iron_mu"),
        F.when((F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") == 3), F.lit(None).cast("double"))
        .otherwise(q * 4.0e-7 * (tax + 1.0)).alias("Vitamin_A_mu"),
    ]


def trip_catch(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """Nested catch per order: (l_orderkey, landing_catch array of taxa, each with a
    ``length_frequency`` array of catch rows).

    lineitem is hash-partitioned once by order key; both nesting aggregates
    reuse that partitioning (one lineitem shuffle, no per-line sort).  With
    ``orders`` (a frame with ``order_key``), only the lines of those orders are
    nested: a semi join on the same key, so it shares that shuffle.
    """
    taxa = part_taxa(t).select("p_partkey", "grouped_taxa")
    lines = t.lineitem.join(taxa, F.col("l_partkey") == F.col("p_partkey"))
    if orders is not None:
        lines = lines.join(orders.select("order_key"), F.col("l_orderkey") == F.col("order_key"), "left_semi")
    lines = (lines.select("l_orderkey", "l_partkey", "grouped_taxa",
                          F.struct(*_nutrient_struct_fields()).alias("lf"))
             .repartition("l_orderkey"))
    per_part = (lines.groupBy("l_orderkey", "l_partkey", "grouped_taxa")
                .agg(F.array_sort(F.collect_list("lf")).alias("length_frequency")))
    return (per_part.groupBy("l_orderkey")
            .agg(F.array_sort(F.collect_list(
                F.struct(F.col("grouped_taxa").alias("catch_taxon"), "length_frequency"))).alias("landing_catch")))


def trip_heads(t: Tables) -> DataFrame:
    """Trip-level attributes, one row per order (no catch arrays)."""
    cust_nat = F.broadcast(t.nation.select("n_nationkey", F.col("n_name").alias("cust_nation")))
    cust = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment").join(
        cust_nat, F.col("c_nationkey") == F.col("n_nationkey"))
    hab = F.broadcast(L.pairs_df(t.spark, L.HABITATS, "o_orderpriority", "habitat"))
    gear = F.broadcast(L.pairs_df(t.spark, L.GEARS, "c_mktsegment", "gear"))
    ves = F.broadcast(L.pairs_df(t.spark, L.VESSELS, "o_orderstatus", "propulsion_gear"))
    ok = F.col("o_orderkey")
    o = (t.orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
         .join(hab, "o_orderpriority").join(gear, "c_mktsegment").join(ves, "o_orderstatus"))
    return o.select(
        ok.cast("string").alias("landing_id"), ok.alias("order_key"),
        F.to_date("o_orderdate").alias("landing_date"),
        (ok % 12 + 1).cast("double").alias("trip_length"),
        (F.col("o_custkey") % 4).cast("int").alias("fisher_number_man"),
        (ok % 3).cast("int").alias("fisher_number_woman"),
        F.when(ok % 13 != 0, (ok % 2).cast("int")).alias("fisher_number_child"),
        "habitat", "gear",
        (ok % 9 * 5 + 20).cast("double").alias("mesh_size"),
        "propulsion_gear",
        F.col("o_totalprice").alias("landing_catch_price"),
        F.when(ok % 7 != 0, F.col("cust_nation")).alias("municipality"),
        F.col("o_custkey").cast("string").alias("tracker_imei"),
    )


def attach_catch(heads: DataFrame, catch: DataFrame) -> DataFrame:
    """Trip heads with their nested catch (left join: trips without lines keep a
    NULL ``landing_catch``).  Filters on head columns are pushed below the join."""
    return (heads.join(catch, F.col("order_key") == F.col("l_orderkey"), "left")
            .drop("order_key", "l_orderkey"))


def trips(t: Tables) -> DataFrame:
    """Nested trip records: one row per order with its ``landing_catch``."""
    return attach_catch(trip_heads(t), trip_catch(t))


def revenue_records(trip_frame: DataFrame) -> DataFrame:
    """Trip revenue records: (landing_id, landing_value, landing_catch)."""
    ok = F.col("landing_id").cast("long")
    return trip_frame.select("landing_id",
                             F.when(ok % 17 != 0, F.col("landing_catch_price")).alias("landing_value"),
                             "landing_catch")


def catch_data(t: Tables) -> DataFrame:
    """Revenue records of all trips."""
    return revenue_records(trips(t))


def object_listing(t: Tables) -> DataFrame:
    """Object-store listing: name ``base__version__ext`` and ``updated`` (day precision)."""
    ev = t.events
    ext = F.when(F.col("event_id") % 3 == 0, F.lit("rds")).when(F.col("event_id") % 3 == 1, F.lit("parquet"))
    name = F.concat(F.col("event_type"), F.lit("__"), F.col("event_id").cast("string"),
                    F.when(ext.isNotNull(), F.concat(F.lit("__"), ext)).otherwise(F.lit("")))
    return ev.select(name.alias("name"), F.date_trunc("day", F.col("ts")).alias("updated"))


#: event type of each class, in the order of the class labels
SCORED_TYPES = ["view", "click", "purchase", "signup", "error"]
SCORED_CLASSES = [str(i + 1) for i in range(len(SCORED_TYPES))]


def scored_events(t: Tables) -> DataFrame:
    """Classifier output stand-in: truth from the event type, class probabilities
    from md5 digits of the event id plus a signal on the truth."""
    truth = F.lit(None).cast("string")
    for c, kind in zip(SCORED_CLASSES, SCORED_TYPES):
        truth = F.when(F.col("event_type") == kind, F.lit(c)).otherwise(truth)
    h = F.md5(F.col("event_id").cast("string"))
    ev = t.events.select("event_id", truth.alias("truth"), h.alias("__h")).where(F.col("truth").isNotNull())
    raw = {}
    for i, c in enumerate(SCORED_CLASSES):
        digits = F.conv(F.substring("__h", 4 * i + 1, 4), 16, 10).cast("double")
        raw[c] = digits + F.lit(1.0) + F.when(F.col("truth") == c, F.lit(20000.0)).otherwise(F.lit(0.0))
    tot = raw["1"]
    for c in SCORED_CLASSES[1:]:
        tot = tot + raw[c]
    out = ev.select("event_id", "truth", *[(raw[c] / tot).alias(f"pred_{c}") for c in SCORED_CLASSES])
    best = F.array_max(F.array(*[F.struct(F.col(f"pred_{c}").alias("p"), F.lit(-i).alias("neg_i"),
                                          F.lit(c).alias("c")) for i, c in enumerate(SCORED_CLASSES)]))
    return out.withColumn("pred_class", best["c"])
