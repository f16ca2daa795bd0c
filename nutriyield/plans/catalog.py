"""Registry of named queries: Spark plan builders and their DuckDB oracles.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the library operator over the
whole driver tables; ``ORACLE[name]`` is an independent SQL formulation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nutriyield.functions import snap_doubles
from nutriyield.operators import composition as C
from nutriyield.operators import supply as S
from nutriyield.plans import oracle as O
from nutriyield.plans.inputs import Inputs
from nutriyield.sources import driver as D
from nutriyield.sources import literals as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return snap_doubles(fn(Inputs(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


NUT_MU, NUT, NUT6 = L.NUTRIENTS_MU, L.NUTRIENTS, L.NUTRIENTS_NO_SE


def _supply_window(i: Inputs) -> Inputs:
    """Supply tables only read the supply years: push that window to the scan."""
    return i.window(f"{min(D.SUPPLY_YEARS)}-01-01", f"{max(D.SUPPLY_YEARS) + 1}-01-01")


def _summary_window(i: Inputs) -> Inputs:
    return i.window(f"{D.SUMMARY_YEAR}-01-01", f"{D.SUMMARY_YEAR + 1}-01-01")

# ============================================================ composition (DOM-1..3)


@register("dom_fao_composition", O.with_base(O.snap_select("SELECT * FROM fao_comp", NUT_MU, ["interagency_code"])))
def _fao(i: Inputs):
    """DOM-2: raw invertebrate rows of the composition table, recoded."""
    return i.fao


@register("dom_nutrients_table", O.with_base(O.snap_select("SELECT * FROM nutrients", NUT_MU, ["grouped_taxa"])))
def _nutrients(i: Inputs):
    """DOM-3: nutrient concentration per taxon code (FLY inferred, imputed)."""
    return i.nutrients


@register("dom_rename_nutrients", O.with_base(O.snap_select(
    "SELECT grouped_taxa, " + ", ".join(f"{mu} AS {nm}" for mu, nm in zip(NUT_MU, NUT)) + " FROM nutrients",
    NUT, ["grouped_taxa"])))
def _rename(i: Inputs):
    """DOM-1: nutrient column renaming rule."""
    return C.rename_nutrients(i.nutrients)


# ============================================================ supply (DOM-7..13)


@register("dom_region_stats", O.with_base(O.snap_select(
    "SELECT * FROM region_stats", ["catch"] + NUT, ["region", "date_bin_start", "grouped_taxa"])))
def _region_stats(i: Inputs):
    """DOM-7: monthly regional catch x nutrient concentration."""
    return i.region_stats


@register("dom_region_stats_adj", O.with_base(O.snap_select(
    "SELECT * FROM adj", ["catch"] + NUT, ["region", "date_bin_start", "grouped_taxa"])))
def _adj(i: Inputs):
    """DOM-8: edible-portion adjusted yields before the cut-off date."""
    return i.region_stats_adj


@register("dom_wra_population", O.with_base("SELECT region, population FROM population"))
def _pop(i: Inputs):
    """DOM-9: women of reproductive age per region plus the "All" row."""
    return i.population


def _supply_sql(src: str = "adj", p: str = "") -> dict:
    """Mean annual supply and population supplied, CTE names prefixed by ``p``."""
    ys = ", ".join(str(y) for y in D.SUPPLY_YEARS)
    lo, hi = min(D.SUPPLY_YEARS), max(D.SUPPLY_YEARS) + 1
    cols = ["catch"] + NUT
    return {
        f"{p}s_month": "SELECT region, date_bin_start, year(date_bin_start) AS year, "
                       + ", ".join(f"{O.strict(c)} AS {c}" for c in cols)
                       + f" FROM {src} WHERE date_bin_start >= DATE '{lo}-01-01' AND date_bin_start < DATE '{hi}-01-01'"
                         " GROUP BY region, date_bin_start",
        f"{p}s_year": "SELECT year, region, " + ", ".join(f"coalesce(sum({c}), 0.0) AS {c}" for c in cols)
                      + f" FROM {p}s_month WHERE year IN ({ys}) GROUP BY year, region",
        f"{p}s_mean": "SELECT region, avg(catch) / 1000.0 AS catch, " + ", ".join(f"avg({c}) AS {c}" for c in NUT)
                      + f" FROM {p}s_year GROUP BY region",
        f"{p}supply": f"SELECT * FROM {p}s_mean UNION ALL SELECT 'National', "
                      + ", ".join(f"coalesce(sum({c}), 0.0)" for c in cols) + f" FROM {p}s_mean",
        f"{p}supplied0": "SELECT s.region, "
                         + " + ".join(f"coalesce(s.{n} / (SELECT conv_factor FROM rdi WHERE nutrient = '{n}'), 0.0)"
                                      for n in NUT6)
                         + f" AS total, p.population FROM {p}supply s LEFT JOIN population p ON s.region = p.region",
        f"{p}supplied": "SELECT region, CAST(CASE WHEN region = 'National' THEN "
                        f"(SELECT sum(population) FROM {p}supplied0) ELSE population END AS BIGINT) AS population, "
                        f"total FROM {p}supplied0",
        f"{p}supplied2": f"SELECT region, population, total, {O.dv('total', 'population')} * 100.0 AS perc "
                         f"FROM {p}supplied",
        f"{p}map": f"SELECT s.region AS area, s.catch AS annual_catch, x.perc AS WRA FROM {p}supply s "
                   f"LEFT JOIN {p}supplied2 x ON s.region = x.region",
    }


@register("dom_mean_annual_supply", O.with_base(O.snap_select("SELECT * FROM supply", ["catch"] + NUT, ["region"]),
                                                _supply_sql()))
def _supply(i: Inputs):
    """DOM-10: mean annual supply per region over three years, plus National."""
    i = _supply_window(i)
    return S.mean_annual_supply(i.region_stats_adj, D.SUPPLY_YEARS)


@register("dom_population_supplied", O.with_base(O.snap_select(
    "SELECT region, population, total, population * (perc / 100.0) AS number_of_people, perc FROM supplied2",
    ["total", "number_of_people", "perc"], ["region", "population"]), _supply_sql()))
def _supplied(i: Inputs):
    """DOM-11: women supplied per region and share of the population."""
    i = _supply_window(i)
    sup = S.mean_annual_supply(i.region_stats_adj, D.SUPPLY_YEARS)
    return S.population_supplied(sup, i.rdi, i.population)


@register("dom_map_data", O.with_base(O.snap_select("SELECT * FROM map", ["annual_catch", "WRA"], ["area"]),
                                      _supply_sql()))
def _map_data(i: Inputs):
    """DOM-11 tail: (area, annual_catch, WRA %) map table."""
    i = _supply_window(i)
    sup = S.mean_annual_supply(i.region_stats_adj, D.SUPPLY_YEARS)
    return S.map_data(sup, S.population_supplied(sup, i.rdi, i.population))


def _summary_sql(share: float = 0.2) -> dict:
    y = D.SUMMARY_YEAR
    per_cols = ", ".join(f"{O.strict(c)} AS {c}" for c in NUT)
    long = " UNION ALL ".join(f"SELECT region, year, '{n}' AS nutrient, {n} AS kg FROM t_per" for n in NUT)
    return {
        "t_month": "SELECT region, date_bin_start, year(date_bin_start) AS year, " + per_cols
                   + f" FROM adj WHERE date_bin_start >= DATE '{y}-01-01' AND date_bin_start < DATE '{y + 1}-01-01'"
                     " GROUP BY region, date_bin_start",
        "t_per": f"SELECT region, year, {per_cols} FROM t_month WHERE year = {y} GROUP BY region, year",
        "t_long": long,
        "t_nut": f"SELECT region, year, nutrient, kg FROM t_long UNION ALL "
                 f"SELECT 'All', year, nutrient, {O.strict('kg')} FROM t_long GROUP BY year, nutrient",
        "t_tab": f"""SELECT n.region, n.nutrient, p.population, n.kg,
                 {O.dv('n.kg', f'(r.conv_factor * {share!r}) / 1000.0')} / 365.0 AS people
                 FROM t_nut n LEFT JOIN population p ON n.region = p.region
                 LEFT JOIN rdi r ON n.nutrient = r.nutrient""",
        "summary": f"""SELECT n.region || ' (' || coalesce(format('{{:,}}', n.population), 'NA') || ')' AS region,
                 n.nutrient, round_even(n.kg, 4) AS annual_kg, round_even(n.people, 3) AS people_supplied_daily,
                 round_even({O.dv('n.people', 'n.population')} * 100.0, 3) AS percent_population_supplied
                 FROM t_tab n""",
    }


@register("dom_summary_table", O.with_base(O.snap_select(
    "SELECT * FROM summary", ["annual_kg", "people_supplied_daily", "percent_population_supplied"],
    ["region", "nutrient"]), _summary_sql()))
def _summary(i: Inputs):
    """DOM-12: annual supply, people supplied daily and % of population (20 % RDI)."""
    i = _summary_window(i)
    return S.summary_table(i.region_stats_adj, i.population, i.rdi, D.SUMMARY_YEAR, 0.20)


def _wide_sql() -> dict:
    d = _summary_sql()
    d["w_long"] = ("SELECT region, nutrient, percent_population_supplied AS v FROM summary UNION ALL "
                   f"SELECT region, 'total', {O.strict('percent_population_supplied')} FROM summary "
                   "WHERE nutrient <> 'selenium' GROUP BY region")
    d["wide"] = ("SELECT regexp_replace(region, '\\s*\\([^)]*\\)', '') AS region, "
                 + ", ".join(f"max(CASE WHEN nutrient = '{n}' THEN v END) AS {n}" for n in NUT6 + ["total"])
                 + " FROM w_long GROUP BY region")
    return d


@register("dom_summary_wide", O.with_base(O.snap_select(
    "SELECT w.*, p.population FROM wide w LEFT JOIN population p ON w.region = p.region",
    NUT6 + ["total"], ["region", "population"]), _wide_sql()))
def _summary_wide(i: Inputs):
    """DOM-13: wide % of population per nutrient with total, region label stripped."""
    i = _summary_window(i)
    tab = S.summary_table(i.region_stats_adj, i.population, i.rdi, D.SUMMARY_YEAR, 0.20)
    return S.summary_wide(tab, i.population)


# ============================================================ trips (DOM-5, DOM-6)


@register("dom_fill_region", O.with_base(
    "SELECT landing_id, municipality, tracker_imei, reporting_region FROM trip_head2"))
def _fill(i: Inputs):
    """DOM-5: municipality filled by the tracker's most frequent municipality."""
    return i.trips.select("landing_id", "municipality", "tracker_imei", "reporting_region")


KOBO_COLS = ["landing_id", "landing_period", "reporting_region", "landing_date", "trip_duration", "n_fishers",
             "habitat", "gear_type", "mesh_size", "vessel_type", "landing_value"]


@register("dom_kobo_trips", O.with_base(O.snap_select(
    "SELECT * FROM kobo_trips", ["catch", "weight"] + NUT_MU,
    [c for c in KOBO_COLS if c not in ("trip_duration", "mesh_size", "landing_value")]
    + [f"{O.snap(c)} AS {c}" for c in ("trip_duration", "mesh_size", "landing_value")])))
def _kobo(i: Inputs):
    """DOM-6: per-trip catch and nutrient yield (two-level unnest, strict sums)."""
    return i.kobo_trips


# further registrations (density, economics, flows, profiles, statistics, models)
from nutriyield.plans import catalog_domain  # noqa: E402,F401
