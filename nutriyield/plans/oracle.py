"""Independent DuckDB formulations of the registered queries.

Each query is a ``WITH`` block over the driver views.  The derivations of the
domain inputs mirror ``nutriyield.sources.driver`` rule by rule; the operator
logic is written the plain SQL way (flat joins, GROUP BY, UNION ALL) rather than
following the Spark code.  Doubles in the final SELECT are snapped to 8
significant digits, like ``snap_doubles`` on the Spark side.
"""

from __future__ import annotations

from nutriyield.sources import literals as L
from nutriyield.sources.driver import ADJUST_BEFORE, REGIONS, SUMMARY_YEAR, SUPPLY_YEARS, TRIP_END, TRIP_START

NUT_MU = L.NUTRIENTS_MU
NUT = L.NUTRIENTS
NUT6 = L.NUTRIENTS_NO_SE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join("NULL" if v is None else (q(v) if isinstance(v, str) else repr(float(v)))
                                     for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) t({', '.join(cols)}))"


def strict(x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN sum({x}) END"


def _snap_once(v: str, digits: int) -> str:
    k = f"({digits - 1} - floor(log10(abs({v}))))"
    return (f"(CASE WHEN {v} IS NULL OR isnan({v}) OR {v} = 0 OR isinf({v}) THEN {v} "
            f"WHEN {k} >= 0 THEN round_even({v} * pow(10.0, {k}), 0) / pow(10.0, {k}) "
            f"ELSE round_even({v} / pow(10.0, -{k}), 0) * pow(10.0, -{k}) END)")


def snap(x: str, digits: int = 8) -> str:
    """Same exact steps as ``functions.sig``: 12 digits first, then ``digits``."""
    v = f"CAST({x} AS DOUBLE)"
    if digits < 12:
        v = _snap_once(v, 12)
    return _snap_once(v, digits)


def dv(a: str, b: str) -> str:
    """Division with Spark's ``try_divide`` rule (x / 0 -> NULL)."""
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a}) / ({b}) END)"


def in_list(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


def title(x: str) -> str:
    """``initcap`` for one-word values."""
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


def nutrient_title(x: str) -> str:
    t = title(x)
    return f"(CASE WHEN {t} = 'Omega3' THEN 'Omega-3' WHEN {t} = 'Vitamina' THEN 'Vitamin-A' ELSE {t} END)"


def group_case(variant: str, col: str = "grouped_taxa") -> str:
    parts = [f"WHEN {col} IN {in_list(codes)} THEN {q(g)}" for g, codes in L.FISH_GROUP_VARIANTS[variant]]
    return "(CASE " + " ".join(parts) + " END)"


# --------------------------------------------------------------------------- base CTEs

_FAO_CODES = "[" + ", ".join(q(c) for c in L.FAO_RAW_CODES) + "]"
_BRAND_ROWS = [(f"Brand#{i + 1}", c) for i, c in enumerate(L.BRAND_TAXA)]

BASE = {
    "brand_taxa": values(_BRAND_ROWS, ["p_brand", "grouped_taxa"]),
    "rdi": values(L.RDI, ["nutrient", "conv_factor"]),
    "catch_groups": values(L.CATCH_GROUPS, ["catch_name", "family", "interagency_code"]),
    "part_taxa": """SELECT p.p_partkey, p.p_name, p.p_brand, p.p_size, p.p_retailprice, b.grouped_taxa
        FROM part p JOIN brand_taxa b ON p.p_brand = b.p_brand""",
    "region_parts": """SELECT n.n_name AS region, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS date_bin_start,
            pt.grouped_taxa, sum(l.l_quantity) AS catch
        FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
        JOIN nation n ON s.s_nationkey = n.n_nationkey
        JOIN part_taxa pt ON l.l_partkey = pt.p_partkey
        GROUP BY 1, 2, 3""",
    "species": """SELECT p_name AS Species, CAST(p_partkey AS INTEGER) AS SpecCode, grouped_taxa AS interagency_code
        FROM part_taxa""",
    "predictions": """SELECT CAST(p_partkey AS INTEGER) AS SpecCode,
            CAST(p_size AS DOUBLE) * 10.0 AS Calcium, p_retailprice / 2000.0 AS Iron,
            p_retailprice / 5000.0 AS Omega3, CAST(p_size AS DOUBLE) / 5.0 + 15.0 AS Protein,
            CAST(p_size AS DOUBLE) * 0.9 + 20.0 AS Selenium,
            CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE) * 3.0 END AS VitaminA,
            p_retailprice / 1000.0 AS Zinc
        FROM part WHERE p_partkey % 10 <> 0""",
    "fao_raw": f"""SELECT ({_FAO_CODES})[CAST(s_suppkey % {len(L.FAO_RAW_CODES)} + 1 AS INTEGER)] AS integragency_code,
            CASE WHEN s_suppkey % 4 = 0 THEN 'c' ELSE 'r' END AS food_state,
            abs(s_acctbal) / 1000.0 + 10.0 AS "protein(g)", abs(s_acctbal) / 20.0 + 50.0 AS "calcium(mg)",
            abs(s_acctbal) / 5000.0 + 1.0 AS "iron(mg)", abs(s_acctbal) / 4000.0 + 1.0 AS "zinc(mg)",
            abs(s_acctbal) / 300.0 + 30.0 AS "selenium(mcg)",
            CASE WHEN s_suppkey % 5 <> 0 THEN abs(s_acctbal) / 100.0 END AS "vitaminA(mcg)",
            abs(s_acctbal) / 20000.0 + 0.1 AS "omega3(g)"
        FROM supplier""",
    "fao_comp": "SELECT CASE " + " ".join(
        f"WHEN integragency_code IN {in_list(codes)} THEN {q(t)}" for t, codes in L.FAO_GROUPS)
    + " ELSE integragency_code END AS interagency_code, "
    + ", ".join(f'"{src}" AS {dst}' for src, dst in L.FAO_RENAME)
    + " FROM fao_raw WHERE food_state = 'r' AND integragency_code IN "
    + in_list([c for _, cs in L.FAO_GROUPS for c in cs]),
    "nt_tab": """SELECT sp.interagency_code, p.Selenium AS Selenium_mu, p.Zinc AS Zinc_mu, p.Protein AS Protein_mu,
            p.Omega3 AS Omega_3_mu, p.Calcium AS Calcium_mu, p.Iron AS Iron_mu, p.VitaminA AS Vitamin_A_mu
        FROM predictions p RIGHT JOIN species sp ON p.SpecCode = sp.SpecCode""",
    "nt_nofly": f"""SELECT * FROM (
            SELECT interagency_code, {', '.join(NUT_MU)} FROM nt_tab t
            WHERE NOT EXISTS (SELECT 1 FROM fao_comp f WHERE f.interagency_code = t.interagency_code)
            UNION ALL SELECT interagency_code, {', '.join(NUT_MU)} FROM fao_comp) u
        WHERE interagency_code <> 'FLY'""",
    "nt_all": f"""SELECT interagency_code, {', '.join(NUT_MU)} FROM nt_nofly
        UNION ALL SELECT 'FLY', {', '.join(f'median({c})' for c in NUT_MU)} FROM nt_nofly
        WHERE interagency_code IN {in_list(L.FLY_PROXIES)}""",
    "nt_med": "SELECT interagency_code, " + ", ".join(
        f"median({c} / {d}) AS {c}" for c, d in [
            ("Selenium_mu", "1000000.0 / 100.0"), ("Zinc_mu", "1000.0 / 100.0"), ("Protein_mu", "1.0 / 100.0"),
            ("Omega_3_mu", "1.0 / 100.0"), ("Calcium_mu", "1000.0 / 100.0"), ("Iron_mu", "1000.0 / 100.0"),
            ("Vitamin_A_mu", "1000000.0 / 100.0")]) + " FROM nt_all GROUP BY interagency_code",
    "nutrients": "SELECT n.interagency_code AS grouped_taxa, " + ", ".join(
        f"coalesce(n.{c}, m.{c}) AS {c}" for c in NUT_MU)
    + " FROM nt_med n CROSS JOIN (SELECT " + ", ".join(f"median({c}) AS {c}" for c in NUT_MU) + " FROM nt_med) m",
    "region_stats": "SELECT rp.region, rp.date_bin_start, rp.grouped_taxa, rp.catch, " + ", ".join(
        f"n.{mu} * rp.catch AS {nm}" for mu, nm in zip(NUT_MU, NUT))
    + " FROM region_parts rp LEFT JOIN nutrients n ON rp.grouped_taxa = n.grouped_taxa",
    "edible": """SELECT b.grouped_taxa, 0.5 + CAST(CAST(substr(d.p_brand, 7, 3) AS INTEGER) % 5 AS DOUBLE) / 10.0 AS ep_coeff
        FROM (SELECT DISTINCT p_brand FROM part) d JOIN brand_taxa b ON d.p_brand = b.p_brand
        WHERE CAST(substr(d.p_brand, 7, 3) AS INTEGER) % 6 <> 0""",
    "adj": "SELECT r.region, r.date_bin_start, r.grouped_taxa, " + ", ".join(
        f"r.{c} * e.ep_coeff AS {c}" for c in ["catch"] + NUT)
    + f" FROM region_stats r LEFT JOIN edible e ON r.grouped_taxa = e.grouped_taxa"
      f" WHERE r.date_bin_start < DATE '{ADJUST_BEFORE}'",
    "census": """SELECT n.n_name AS region, CASE WHEN c.c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
            CAST(c.c_custkey % 80 AS INTEGER) AS age, CAST(c.c_custkey % 5 + 1 AS INTEGER) AS "count"
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "pop_region": """SELECT region, CAST(coalesce(sum("count"), 0) AS BIGINT) AS population FROM census
        WHERE gender = 'Female' AND age > 14 AND age < 50 GROUP BY region""",
    "population": """SELECT region, population FROM pop_region
        UNION ALL SELECT 'All', CAST(sum(population) AS BIGINT) FROM pop_region""",
}

# trips: flat form (the nested arrays are unnested anyway); habitat/gear/vessel maps
BASE.update({
    "hab_map": values(L.HABITATS, ["o_orderpriority", "habitat"]),
    "gear_map": values(L.GEARS, ["c_mktsegment", "gear"]),
    "ves_map": values(L.VESSELS, ["o_orderstatus", "propulsion_gear"]),
    "trip_head": """SELECT CAST(o.o_orderkey AS VARCHAR) AS landing_id, o.o_orderkey AS ok,
            CAST(o.o_orderdate AS DATE) AS landing_date,
            CAST(o.o_orderkey % 12 + 1 AS DOUBLE) AS trip_length,
            CAST(o.o_custkey % 4 AS INTEGER) AS fisher_number_man,
            CAST(o.o_orderkey % 3 AS INTEGER) AS fisher_number_woman,
            CASE WHEN o.o_orderkey % 13 <> 0 THEN CAST(o.o_orderkey % 2 AS INTEGER) END AS fisher_number_child,
            h.habitat, g.gear, CAST(o.o_orderkey % 9 * 5 + 20 AS DOUBLE) AS mesh_size, v.propulsion_gear,
            o.o_totalprice AS landing_catch_price,
            CASE WHEN o.o_orderkey % 7 <> 0 THEN n.n_name END AS municipality,
            CAST(o.o_custkey AS VARCHAR) AS tracker_imei
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN hab_map h ON o.o_orderpriority = h.o_orderpriority
        JOIN gear_map g ON c.c_mktsegment = g.c_mktsegment
        JOIN ves_map v ON o.o_orderstatus = v.o_orderstatus""",
    "imei_counts": """SELECT tracker_imei, municipality, count(*) AS n FROM trip_head
        WHERE tracker_imei IS NOT NULL AND municipality IS NOT NULL GROUP BY 1, 2""",
    "imei_fill": """SELECT tracker_imei, municipality AS fill FROM (
            SELECT *, row_number() OVER (PARTITION BY tracker_imei ORDER BY n DESC, municipality) AS rn
            FROM imei_counts) x WHERE rn = 1""",
    "trip_head2": """SELECT t.*, coalesce(t.municipality, f.fill) AS reporting_region
        FROM trip_head t LEFT JOIN imei_fill f ON t.tracker_imei = f.tracker_imei""",
    "trip_lines": """SELECT l.l_orderkey AS ok, pt.grouped_taxa AS catch_taxon,
            CASE WHEN l.l_orderkey % 11 = 0 AND l.l_linenumber = 1 THEN NULL ELSE l.l_quantity END AS catch,
            l.l_quantity * (1.0 - l.l_discount) AS weight,
            l.l_quantity * 3.0e-7 * (l.l_tax + 1.0) AS Selenium_mu,
            l.l_quantity * 2.0e-5 * (l.l_discount + 1.0) AS Zinc_mu,
            l.l_quantity * 0.18 * (l.l_tax * 0.5 + 1.0) AS Protein_mu,
            l.l_quantity * 0.003 * (l.l_discount * 5.0 + 1.0) AS Omega_3_mu,
            l.l_quantity * 5.0e-4 * (l.l_tax * 3.0 + 1.0) AS Calcium_mu,
            l.l_quantity * 1.0e-5 * (l.l_discount + 1.0) AS Iron_mu,
            CASE WHEN l.l_orderkey % 5 = 0 AND l.l_linenumber = 3 THEN NULL
                 ELSE l.l_quantity * 4.0e-7 * (l.l_tax + 1.0) END AS Vitamin_A_mu
        FROM lineitem l JOIN part_taxa pt ON l.l_partkey = pt.p_partkey""",
    "kobo_trips": f"""SELECT h.landing_id, CAST(date_trunc('month', h.landing_date) AS DATE) AS landing_period,
            h.municipality AS reporting_region, h.landing_date, h.trip_length AS trip_duration,
            h.fisher_number_man + h.fisher_number_woman + h.fisher_number_child AS n_fishers,
            CASE WHEN h.habitat = 'Traditional FAD' THEN 'FAD' ELSE h.habitat END AS habitat,
            h.gear AS gear_type, h.mesh_size, h.propulsion_gear AS vessel_type,
            h.landing_catch_price AS landing_value,
            {', '.join(f'{strict("l." + c)} / 1000.0 AS {c}' for c in ['catch', 'weight'] + NUT_MU)}
        FROM trip_head2 h JOIN trip_lines l ON h.ok = l.ok
        WHERE l.catch IS NOT NULL
          AND CAST(date_trunc('month', h.landing_date) AS DATE) BETWEEN DATE '{TRIP_START}' AND DATE '{TRIP_END}'
          AND h.reporting_region IN {in_list(REGIONS)}
        GROUP BY ALL""",
})


def with_base(body: str, extra: dict | None = None) -> str:
    ctes = dict(BASE)
    if extra:
        ctes.update(extra)
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n" + body


def snap_select(inner: str, doubles, others) -> str:
    cols = list(others) + [f"{snap(c)} AS {c}" for c in doubles]
    return f"SELECT {', '.join(cols)} FROM ({inner}) z"
