"""Registered queries: sources (listing, parts), legacy table, outliers, scores, level order."""

from __future__ import annotations

from pyspark.sql import functions as F

from nutriyield.operators import composition as C
from nutriyield.operators import density as DN
from nutriyield.operators import stats as ST
from nutriyield.operators import supply as S
from nutriyield.operators.verbs import level_order
from nutriyield.plans import oracle as O
from nutriyield.plans.catalog import NUT_MU, _summary_sql, _summary_window, register
from nutriyield.plans.catalog_domain import ECON_SQL, _density_sql, _single
from nutriyield.plans.inputs import Inputs
from nutriyield.sources import driver as D
from nutriyield.sources import io as IO

LISTING_SQL = {
    "listing": "SELECT event_type || '__' || CAST(event_id AS VARCHAR) || CASE WHEN event_id % 3 = 0 THEN '__rds' "
               "WHEN event_id % 3 = 1 THEN '__parquet' ELSE '' END AS name, date_trunc('day', ts) AS updated "
               "FROM events",
    "lsep": "SELECT name, updated, string_split(name, '__')[1] AS base_name, string_split(name, '__')[2] AS version, "
            "string_split(name, '__')[3] AS ext FROM listing WHERE name IS NOT NULL AND updated IS NOT NULL",
}


def _latest_sql(prefix: str, extension: str, exact: bool) -> str:
    where = f"starts_with(name, '{prefix}') AND regexp_matches(ext, '{extension}$')"
    if exact:
        where += f" AND base_name = '{prefix}'"
    return (f"WITH {', '.join(f'{k} AS ({v})' for k, v in LISTING_SQL.items())}, "
            f"cand AS (SELECT * FROM lsep WHERE {where}) "
            "SELECT c.name, c.base_name, c.version, c.ext, c.updated FROM cand c JOIN "
            "(SELECT base_name, ext, max(updated) AS mx FROM cand GROUP BY 1, 2) m "
            "ON c.base_name = m.base_name AND c.ext = m.ext AND c.updated = m.mx")


@register("src_latest_version", _latest_sql("", "", False))
def _latest(i: Inputs):
    """SRC-5: latest object per (base name, extension), ties kept."""
    return IO.latest_version(D.object_listing(i.t), prefix="")


@register("src_latest_version_exact", _latest_sql("view", "parquet", True))
def _latest_exact(i: Inputs):
    """SRC-5: exact base-name match with an extension pattern."""
    return IO.latest_version(D.object_listing(i.t), prefix="view", extension="parquet", exact_match=True)


PARTS_SQL = {
    "model_parts": "SELECT region, 'taxa_estimates' AS part, date_bin_start AS landing_period, grouped_taxa, catch "
                   "FROM region_parts UNION ALL SELECT region, 'total_estimates', date_bin_start, NULL, sum(catch) "
                   "FROM region_parts GROUP BY region, date_bin_start",
}


@register("src_flatten_parts", O.with_base(O.snap_select(
    "SELECT region, landing_period AS date_bin_start, grouped_taxa, catch FROM model_parts "
    "WHERE contains(part, 'taxa')", ["catch"], ["region", "date_bin_start", "grouped_taxa"]), PARTS_SQL))
def _flatten(i: Inputs):
    """SRC-9: keep the per-taxon parts of the regional model output."""
    rp = D.region_parts(i.t)
    parts = (rp.select("region", F.lit("taxa_estimates").alias("part"), F.col("date_bin_start").alias("landing_period"),
                       "grouped_taxa", "catch")
             .unionByName(rp.groupBy("region", "date_bin_start").agg(F.sum("catch").alias("catch"))
                          .select("region", F.lit("total_estimates").alias("part"),
                                  F.col("date_bin_start").alias("landing_period"),
                                  F.lit(None).cast("string").alias("grouped_taxa"), "catch")))
    return IO.flatten_parts(parts)


LEGACY_SQL = {
    "lg_tab": "SELECT sp.interagency_code, p.Selenium AS Selenium_mu, p.Zinc AS Zinc_mu, p.Protein AS Protein_mu, "
              "p.Omega3 AS Omega_3_mu, p.Calcium AS Calcium_mu, p.Iron AS Iron_mu, p.VitaminA AS Vitamin_A_mu "
              "FROM predictions p RIGHT JOIN species sp ON p.SpecCode = sp.SpecCode",
    "lg_u": f"SELECT interagency_code, {', '.join(NUT_MU)} FROM lg_tab t WHERE NOT EXISTS "
            f"(SELECT 1 FROM fao_comp f WHERE f.interagency_code = t.interagency_code) "
            f"UNION ALL SELECT interagency_code, {', '.join(NUT_MU)} FROM fao_comp",
    "legacy": "SELECT interagency_code, " + ", ".join(
        f"median({c} / {d}) AS {c}" for c, d in [
            ("Selenium_mu", "1000000.0 / 100.0"), ("Zinc_mu", "1000.0 / 100.0"), ("Protein_mu", "1.0 / 100.0"),
            ("Omega_3_mu", "1.0 / 100.0"), ("Calcium_mu", "1000.0 / 100.0"), ("Iron_mu", "1000.0 / 100.0"),
            ("Vitamin_A_mu", "1000000.0 / 100.0")]) + " FROM lg_u GROUP BY interagency_code",
}


@register("dom_nutrients_table_legacy", O.with_base(O.snap_select("SELECT * FROM legacy", NUT_MU,
                                                                  ["interagency_code"]), LEGACY_SQL))
def _legacy(i: Inputs):
    """DOM-4: legacy per-code table (no FLY inference, no imputation, dedup by code and selenium)."""
    p = D.predictions(i.t)
    legacy = p.select("SpecCode", *[F.col(a).alias(b) for a, b in [
        ("Selenium", "Selenium_mu"), ("Zinc", "Zinc_mu"), ("Protein", "Protein_mu"), ("Omega3", "Omega_3_mu"),
        ("Calcium", "Calcium_mu"), ("Iron", "Iron_mu"), ("VitaminA", "Vitamin_A_mu")]])
    return C.nutrients_table_legacy(legacy, D.species(i.t), i.fao)


def _cooks_sql() -> dict:
    d = dict(ECON_SQL)
    d.update({
        "ck": "SELECT landing_id, catch_taxon, landing_value, weight, ln(weight / 1000.0 + 1.0) AS x, "
              "ln(landing_value + 1.0) AS y FROM single",
        "ckg": "SELECT catch_taxon, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, avg(x) AS xbar, "
               "regr_sxx(y, x) AS sxx, count(*) AS n FROM ck GROUP BY catch_taxon",
        "cke": "SELECT c.*, g.b1, g.b0, g.xbar, g.sxx, g.n, c.y - (g.b0 + g.b1 * c.x) AS e FROM ck c "
               "JOIN ckg g ON c.catch_taxon = g.catch_taxon",
        "cks": "SELECT catch_taxon, sum(e * e) AS sse FROM cke GROUP BY catch_taxon",
        "ckd": f"SELECT e.*, {O.dv('e.e * e.e', '2 * (s.sse / (e.n - 2))')} * "
               f"{O.dv('1.0 / e.n + ((e.x - e.xbar) * (e.x - e.xbar)) / e.sxx', '(1 - (1.0 / e.n + ((e.x - e.xbar) * (e.x - e.xbar)) / e.sxx)) * (1 - (1.0 / e.n + ((e.x - e.xbar) * (e.x - e.xbar)) / e.sxx))')} AS d "
               "FROM cke e JOIN cks s ON e.catch_taxon = s.catch_taxon",
        "cooks": "SELECT landing_id, catch_taxon, landing_value, weight FROM ckd "
                 "WHERE d IS NULL OR d <= 5.0 * (SELECT avg(d) FROM ckd)",
    })
    return d


@register("sta_cooks_outliers", O.with_base(O.snap_select(
    "SELECT * FROM cooks", ["landing_value", "weight"], ["landing_id", "catch_taxon"]), _cooks_sql()))
def _cooks(i: Inputs):
    """STA-3: drop rows whose Cook's distance in the per-taxon price line exceeds 5x the mean."""
    s = _single(i).select("landing_id", "catch_taxon", "landing_value", "weight").persist()  # read 4 times
    s = s.withColumn("x", F.log(F.col("weight") / 1000.0 + 1.0)).withColumn("y", F.log(F.col("landing_value") + 1.0))
    return ST.drop_cooks_outliers(s, "catch_taxon", "x", "y", 5.0).drop("x", "y")


def _minmax_sql() -> dict:
    d = _summary_sql()
    cols = ["annual_kg", "people_supplied_daily", "percent_population_supplied"]
    d["mm"] = "SELECT " + ", ".join(f"min(ln({c} + 1.0)) AS mn_{c}, max(ln({c} + 1.0)) AS mx_{c}" for c in cols) \
              + " FROM summary"
    d["minmax"] = "SELECT s.*, " + ", ".join(
        f"{O.dv(f'ln(s.{c} + 1.0) - m.mn_{c}', f'm.mx_{c} - m.mn_{c}')} AS {c}_score" for c in cols) \
        + " FROM summary s CROSS JOIN mm m"
    return d


@register("dom_log_minmax", O.with_base(O.snap_select(
    "SELECT * FROM minmax", ["annual_kg", "people_supplied_daily", "percent_population_supplied", "annual_kg_score",
                             "people_supplied_daily_score", "percent_population_supplied_score"],
    ["region", "nutrient"]), _minmax_sql()))
def _minmax(i: Inputs):
    """FN-17: log min-max colour score of the summary table columns."""
    w = _summary_window(i)
    tab = S.summary_table(w.region_stats_adj, w.population, w.rdi, D.SUMMARY_YEAR, 0.20)
    return S.log_minmax(tab, ["annual_kg", "people_supplied_daily", "percent_population_supplied"])


def _order_sql() -> dict:
    d = _density_sql("habitat", {"Deep": "Pelagic"}, False)
    d["ordered"] = ("SELECT d.*, o.habitat_order FROM density d LEFT JOIN (SELECT habitat, CAST(row_number() OVER "
                    "(ORDER BY avg(inds_kg) NULLS LAST, habitat) AS INTEGER) AS habitat_order FROM density "
                    "GROUP BY habitat) o ON d.habitat = o.habitat")
    return d


@register("dom_habitat_order", O.with_base(O.snap_select(
    "SELECT * FROM ordered", ["inds_kg"], ["habitat", "nutrient", "habitat_order"]), _order_sql()))
def _order(i: Inputs):
    """SRT-6: habitat levels ordered by mean density score (chart axis order)."""
    return level_order(DN.density_by(i.kobo_trips, "habitat", i.rdi, recode={"Deep": "Pelagic"}), "habitat", "inds_kg")
