"""Work that must not grow with passes, permutations or scored cells beyond the input."""

import hashlib
import random

from pyspark.sql import functions as F

from nutriyield.operators import boosting as B
from nutriyield.operators import stats as ST
from tests.test_boosting import SET, _data


def test_labels_by_hash_rank_from_one_pass(spark):
    g = random.Random(4)
    rows = [(f"r{i}", g.gauss(0, 1)) for i in range(300)] + [("r7", 5.0), (None, 1.0)]
    z = spark.createDataFrame(rows, "id string, v double")
    cuts = [40, 180]
    for sigmas in (0.2, 4.0, 99.0):
        got = ST._labelled_sums(z, [1, 2, 3], ["id"], ["v"], 9, cuts, len(rows), sigmas).collect()
        again = {r["__perm"] for r in got if r["__split"]}
        for perm in {1, 2, 3} - again:
            keys = sorted((hashlib.md5(f"9|{perm}|{'NA' if i is None else i}".encode()).hexdigest(), v) for i, v in rows)
            want = {}
            for h, v in keys:
                k = sum(keys[c - 1][0] < h for c in cuts)
                want[k] = (want.get(k, (0, 0.0))[0] + 1, want.get(k, (0, 0.0))[1] + v)
            mine = {}
            for r in got:
                if r["__perm"] == perm:
                    n, s = mine.get(r["__idx"], (0, 0.0))
                    mine[r["__idx"]] = n + r["__n"], s + r["v"]
            assert {k: n for k, (n, _) in mine.items()} == {k: n for k, (n, _) in want.items()}
            assert all(abs(mine[k][1] - want[k][1]) < 1e-9 for k in want)
        assert not (sigmas == 99.0 and again)


def test_seeds_are_the_smallest_hashes(spark):
    rows = [(f"r{i}", float(i)) for i in range(200)]
    x = spark.createDataFrame(rows, "id string, v double")
    got = {(r["__r"], r["__i"]): r["v"] for r in ST._restart_seeds(x, ["id"], ["v"], 3, 20, 5).collect()}
    want = {}
    for r in range(1, 21):
        order = sorted(rows, key=lambda t: hashlib.md5(f"5|{r}|{t[0]}".encode()).hexdigest())
        want |= {(r, i + 1): order[i][1] for i in range(3)}
    assert got == want


def test_transfers_write_the_rows_once(spark, monkeypatch):
    g = random.Random(2)
    df = spark.createDataFrame([(f"r{i}", g.gauss(0, 1), g.gauss(0, 1), i % 3) for i in range(60)], "id string, a double, b double, c int")
    cuts = []
    real = ST.cut_lineage
    monkeypatch.setattr(ST, "cut_lineage", lambda d: cuts.append(1) or real(d))
    few, centers, w = ST.transfer_rows(df, ["a", "b"], ["id"], "c", batch=4)
    assert len(cuts) <= 1
    many, centers_1000, w_1000 = ST.transfer_rows(df, ["a", "b"], ["id"], "c")
    assert few.count() == 60 and w < 120 and len(centers) == 3 and w_1000 > 0


def test_scored_cells_are_not_bounded_by_the_fit(spark, monkeypatch):
    df = spark.createDataFrame(_data().assign(cluster=lambda d: d["y"], id=lambda d: d.index))
    monkeypatch.setattr(B, "MAX_CELLS", 12)
    other = spark.range(50).select(F.col("id"), F.lit("b").alias("a"), (F.col("id") * 1.5).alias("m"))
    out = {r["m"]: r for r in B.fit_predict_cells(df, other, ["a", "m"], SET, share=7).collect()}
    one = {r["m"]: r for r in B.fit_predict_cells(df, other, ["a", "m"], SET).collect()}
    assert len(out) == 50 and all(out[m]["pred_1"] == one[m]["pred_1"] for m in out)
    own = {r["m"]: r["pred_1"] for r in B.fit_predict_cells(df, df.where("a = 'b'"), ["a", "m"], SET).select("m", "pred_1").distinct().collect()}
    # a value between two levels falls on the side of the upper one
    assert out[10.5]["pred_1"] == own[20.0] and out[0.0]["pred_1"] == own[10.0] and out[73.5]["pred_1"] == own[40.0]


def test_features_of_a_k_scan_are_computed_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda v: seen.add(1) or v, "double")
    df = spark.range(40).select(F.col("id").cast("string").alias("id"), count((F.col("id") % 7).cast("double")).alias("v"))
    assert ST.k_scan(df, ["v"], ["id"], [2, 3], iters=2).count() == 2
    assert seen.value == 40


def test_neighbours_asked_in_small_steps_are_the_same(spark):
    from nutriyield.operators import oversample as OS
    g = random.Random(8)
    rows = [(("a" if i % 4 else "b"), f"r{i:03d}", g.gauss(0, 1), g.gauss(0, 1)) for i in range(160)]
    df = spark.createDataFrame(rows, "label string, id string, x double, y double")
    one = sorted(OS.smote(df, "label", ["x", "y"], "id", part_cells=4).collect())
    assert one and one == sorted(OS.smote(df, "label", ["x", "y"], "id", part_cells=4, ask_rows=3).collect())


def test_only_lines_of_wanted_landings_are_nested(spark, monkeypatch):
    from nutriyield.plans import inputs as I
    # landing 4 has two heads, of which the smaller one in struct order gives the attributes
    heads = [("1", 1, "gill net", "a"), ("2", 2, "hand line", "a"), ("3", 3, None, "a"), ("4", 4, "gill net", "b"), ("4", 4, "hand line", "a"), (None, 6, "gill net", "a"), ("7", 7, "gill net", None)]
    frame = spark.createDataFrame(heads, "landing_id string, order_key long, gear string, habitat string").selectExpr(
        "*", "'t' tracker_imei", "'NATION_1' municipality", "DATE'1997-05-02' landing_date", "1D trip_length", "1 fisher_number_man", "0 fisher_number_woman",
        "0 fisher_number_child", "20D mesh_size", "'Motor' propulsion_gear", "5D landing_catch_price")
    fields = ", ".join(f"order_key * 1D {f}" for f in ("catch", *I.TR._LF_FIELDS[1:]))
    catch = spark.range(1, 9).selectExpr("id order_key").selectExpr("order_key l_orderkey", f"array(struct('x' catch_taxon, array(struct({fields})) length_frequency)) landing_catch")
    nested = []

    def trip_catch(t, orders=None):
        nested.append({r["order_key"] for r in orders.select("order_key").collect()})
        return catch

    monkeypatch.setattr(I.D, "trip_heads", lambda t: frame)
    monkeypatch.setattr(I.D, "trip_catch", trip_catch)
    i = I.Inputs(spark, "/nowhere")
    every = i.kobo_trips.collect()
    for wanted in (F.col("gear") == "gill net", ~(F.col("gear") == "gill net")):
        mine = {r for r in i.kobo_trips_of(wanted).collect()}
        keep = "gill net" if len(nested) == 2 else "hand line"
        assert {r for r in every if r["gear_type"] == keep} == {r for r in mine if r["gear_type"] == keep} != set()
    assert nested == [{1, 2, 3, 4, 7}, {1, 4, 7}, {2, 4}]
