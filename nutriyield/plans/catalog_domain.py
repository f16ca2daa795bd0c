"""Registered queries: functional groups, density, economics, flows, profiles, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from nutriyield.functions import sig
from nutriyield.operators import density as DN
from nutriyield.operators import economics as EC
from nutriyield.operators import flows as FL
from nutriyield.operators import profiles as PR
from nutriyield.operators import stats as ST
from nutriyield.operators import supply as S
from nutriyield.operators.verbs import sample_fraction
from nutriyield.plans import oracle as O
from nutriyield.plans.catalog import NUT, NUT6, NUT_MU, _supply_sql, _supply_window, register
from nutriyield.plans.inputs import Inputs
from nutriyield.sources import driver as D
from nutriyield.sources import literals as L

INV = O.in_list(L.INVERTEBRATE_GROUPS)
SIX_MU = NUT_MU[1:]


def conv(n: str) -> str:
    return f"(SELECT conv_factor FROM rdi WHERE nutrient = '{n}')"


def merged(expr: str, label: str) -> str:
    return f"(CASE WHEN {expr} IN {INV} THEN {O.q(label)} ELSE {expr} END)"


def title_words(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


# ============================================================ groups and density (DOM-14..18)

GROUPS_SQL = {
    "names": "SELECT interagency_code AS grouped_taxa, catch_name FROM catch_groups",
    "tc_year": f"SELECT grouped_taxa, year(date_bin_start) AS year, {O.strict('catch')} AS catch "
               "FROM region_stats GROUP BY 1, 2",
    "tot_catch": "SELECT n.catch_name, m.catch / 1000.0 AS catch FROM (SELECT grouped_taxa, "
                 "CASE WHEN count(catch) = count(*) THEN avg(catch) END AS catch FROM tc_year GROUP BY grouped_taxa) m "
                 "LEFT JOIN names n ON m.grouped_taxa = n.grouped_taxa",
    "dt_long": " UNION ALL ".join(
        f"SELECT n.catch_name, t.grouped_taxa, '{nm}' AS nutrient, t.{mu} AS concentration "
        "FROM nutrients t LEFT JOIN names n ON t.grouped_taxa = n.grouped_taxa"
        for mu, nm in zip(NUT_MU, NUT) if nm != "selenium"),
    "dt_rdi": "SELECT d.*, r.conv_factor, d.concentration * 100.0 / r.conv_factor AS rdi FROM dt_long d "
              "LEFT JOIN rdi r ON d.nutrient = r.nutrient WHERE d.catch_name IS NULL OR d.catch_name <> 'Other'",
    "dt_tot": "SELECT d.*, coalesce(sum(rdi) OVER (PARTITION BY catch_name), 0.0) AS tot FROM dt_rdi d",
    "density_taxon": f"""SELECT d.catch_name, d.grouped_taxa, {O.nutrient_title('d.nutrient')} AS nutrient,
            d.concentration, d.conv_factor, d.rdi, d.tot, coalesce(c.catch, 0.0) AS catch_t,
            {merged(O.group_case('taxon', 'd.grouped_taxa'), 'Marine invertebrates')} AS fish_group
        FROM dt_tot d LEFT JOIN tot_catch c ON d.catch_name = c.catch_name WHERE coalesce(c.catch, 0.0) > 0""",
    "tg_tot": "SELECT coalesce(sum(catch), 0.0) AS tot FROM region_stats",
    "tg_per": f"""SELECT {merged(O.group_case('yield'), 'Marine invertebrates')} AS fish_group, grouped_taxa,
            coalesce(sum(catch), 0.0) AS catch FROM region_stats GROUP BY 1, 2""",
    "tg_pct": "SELECT p.*, p.catch / t.tot * 100.0 AS catch_percent FROM tg_per p CROSS JOIN tg_tot t",
    "top_groups": """SELECT x.fish_group, c.catch_name, x.grouped_taxa AS interagency_code, x.catch_percent
        FROM tg_pct x LEFT JOIN catch_groups c ON x.grouped_taxa = c.interagency_code
        WHERE x.fish_group IS NOT NULL AND x.catch_percent IS NOT NULL
          AND x.catch_percent >= (SELECT max(catch_percent) FROM tg_pct y WHERE y.fish_group = x.fish_group)""",
}


def _yield_group_sql(src: str, variant: str, label: str, with_labels: bool) -> dict:
    d = {
        "yg_sum": f"SELECT fish_group, " + ", ".join(f"coalesce(sum({c}), 0.0) AS {c}" for c in ["catch"] + NUT)
                  + f" FROM (SELECT {O.group_case(variant)} AS fish_group, * FROM {src}) g "
                    "GROUP BY fish_group HAVING fish_group IS NOT NULL",
        "yg_long": " UNION ALL ".join(
            f"SELECT {merged('fish_group', label)} AS fish_group, {O.nutrient_title(O.q(n))} AS nutrient, "
            f"{n} AS value FROM yg_sum" for n in NUT6),
    }
    if with_labels:
        d["fish_labels"] = O.values(L.FISH_LABELS, ["fish_group", "fish_label"])
        d["yield_group"] = ("SELECT y.fish_group, y.nutrient, y.value, l.fish_label FROM yg_long y "
                            "LEFT JOIN fish_labels l ON y.fish_group = l.fish_group")
    else:
        d["yield_group"] = "SELECT * FROM yg_long"
    return d


@register("dom_fish_group", O.with_base(
    "SELECT DISTINCT r.grouped_taxa, " + ", ".join(
        f"{O.group_case(v, 'r.grouped_taxa')} AS fish_group_{v}" for v in L.FISH_GROUP_VARIANTS)
    + " FROM region_stats r"))
def _fish_group(i: Inputs):
    """DOM-14: the three classifier variants applied to every observed taxon."""
    df = i.region_stats.select("grouped_taxa").distinct()
    for v in L.FISH_GROUP_VARIANTS:
        df = DN.fish_group(df, v).withColumnRenamed("fish_group", f"fish_group_{v}")
    return df


@register("dom_mean_annual_catch", O.with_base(O.snap_select("SELECT * FROM tot_catch", ["catch"], ["catch_name"]),
                                               GROUPS_SQL))
def _mean_catch(i: Inputs):
    """DOM-15: mean annual catch per taxon (t) with its display name."""
    return DN.mean_annual_catch(i.region_stats, i.catch_groups)


@register("dom_density_by_taxon", O.with_base(O.snap_select(
    "SELECT * FROM density_taxon", ["concentration", "conv_factor", "rdi", "tot", "catch_t"],
    ["catch_name", "grouped_taxa", "nutrient", "fish_group"]), GROUPS_SQL))
def _density_taxon(i: Inputs):
    """DOM-16: RDI share per 100 g by taxon and nutrient, with catch and group."""
    return DN.density_by_taxon(i.nutrients, i.catch_groups, i.rdi,
                               DN.mean_annual_catch(i.region_stats, i.catch_groups))


@register("dom_yield_by_group", O.with_base(O.snap_select(
    "SELECT * FROM yield_group", ["value"], ["fish_group", "nutrient", "fish_label"]),
    _yield_group_sql("adj", "yield", "Marine invertebrates", True)))
def _yield_group(i: Inputs):
    """DOM-17: nutrient yield per functional group (edible-adjusted)."""
    return DN.yield_by_group(i.region_stats_adj, "yield", "Marine invertebrates", True)


@register("dom_yield_by_group_appendix", O.with_base(O.snap_select(
    "SELECT * FROM yield_group", ["value"], ["fish_group", "nutrient"]),
    _yield_group_sql("region_stats", "appendix", "Other groups", False)))
def _yield_group_app(i: Inputs):
    """DOM-17 appendix variant: unadjusted yields, third classifier, "Other groups"."""
    return DN.yield_by_group(i.region_stats, "appendix", "Other groups", False)


@register("dom_top_taxon_per_group", O.with_base(O.snap_select(
    "SELECT * FROM top_groups", ["catch_percent"], ["fish_group", "catch_name", "interagency_code"]), GROUPS_SQL))
def _top(i: Inputs):
    """DOM-18: taxon with the largest catch share per functional group, ties kept."""
    return DN.top_taxon_per_group(i.region_stats, i.catch_groups)


def _density_sql(key: str, recode: dict | None, title_key: bool) -> dict:
    k = key
    kexpr = k
    if recode:
        kexpr = "CASE " + " ".join(f"WHEN {k} = {O.q(a)} THEN {O.q(b)}" for a, b in recode.items()) + f" ELSE {k} END"
    if title_key:
        kexpr = title_words(kexpr)
    return {
        "dx": f"SELECT {k}, " + ", ".join(f"({mu} / weight) * 1000.0 / {conv(n)} AS {n}"
                                          for mu, n in zip(SIX_MU, NUT6)) + " FROM kobo_trips",
        "dmed": f"SELECT {k}, " + ", ".join(f"median({n}) AS {n}" for n in NUT6) + f" FROM dx GROUP BY {k}",
        "density": " UNION ALL ".join(
            f"SELECT {kexpr} AS {k}, {O.nutrient_title(O.q(n))} AS nutrient, {n} / 10.0 * 100.0 AS inds_kg "
            "FROM dmed" for n in NUT6),
    }


@register("dom_density_by_habitat", O.with_base(O.snap_select(
    "SELECT * FROM density", ["inds_kg"], ["habitat", "nutrient"]), _density_sql("habitat", {"Deep": "Pelagic"}, False)))
def _dens_hab(i: Inputs):
    """DOM-22: median people supplied per kg by habitat (Deep shown as Pelagic)."""
    return DN.density_by(i.kobo_trips, "habitat", i.rdi, recode={"Deep": "Pelagic"})


@register("dom_density_by_gear", O.with_base(O.snap_select(
    "SELECT * FROM density", ["inds_kg"], ["gear_type", "nutrient"]), _density_sql("gear_type", None, True)))
def _dens_gear(i: Inputs):
    """DOM-23: median people supplied per kg by gear type (title-cased)."""
    return DN.density_by(i.kobo_trips, "gear_type", i.rdi, title_key=True)


# ============================================================ economics (DOM-19..21)

ECON_SQL = dict(GROUPS_SQL)
ECON_SQL.update({
    "cd_lines": "SELECT h.landing_id, CASE WHEN h.ok % 17 <> 0 THEN h.landing_catch_price END AS landing_value, "
                f"l.catch_taxon, l.weight, {', '.join('l.' + c for c in NUT_MU)} "
                "FROM trip_head h JOIN trip_lines l ON h.ok = l.ok "
                "WHERE h.landing_id IN (SELECT landing_id FROM kobo_trips)",
    "sc0": "SELECT * FROM cd_lines WHERE weight IS NOT NULL AND landing_value IS NOT NULL",
    "sc1": "SELECT * FROM sc0 WHERE landing_id IN (SELECT landing_id FROM sc0 GROUP BY landing_id HAVING count(*) = 1)",
    "single": f"SELECT landing_id, catch_taxon, landing_value, weight, {', '.join(NUT_MU)} FROM sc1 "
              "WHERE catch_taxon IN (SELECT interagency_code FROM top_groups)",
    "sc_tot": "SELECT count(DISTINCT landing_id) AS tot FROM sc1",
    "sc_share": "SELECT catch_taxon, CAST(count(*) AS DOUBLE) / (SELECT tot FROM sc_tot) * 100.0 AS catch_percent "
                "FROM sc1 GROUP BY catch_taxon",
    "single_app": f"SELECT s.landing_id, s.catch_taxon, s.landing_value, h.catch_percent, s.weight, "
                  f"{', '.join('s.' + c for c in NUT_MU)} FROM sc1 s LEFT JOIN sc_share h ON s.catch_taxon = h.catch_taxon "
                  f"WHERE s.catch_taxon IN {O.in_list(L.APPENDIX_TAXA)}",
})


def _price_sql(src: str, at: float) -> str:
    import math
    point = math.log(math.log(at))
    return (f"SELECT catch_taxon, round_even(exp(regr_intercept(ln(landing_value), ln(weight)) + "
            f"regr_slope(ln(landing_value), ln(weight)) * {point!r}) * 10.0, 2) AS price FROM {src} GROUP BY catch_taxon")


def _aff_sql(src: str, at: float, appendix: bool) -> dict:
    inds = " + ".join(f"(({mu} / weight * 100.0) / {conv(n)} * 100.0)" for mu, n in zip(SIX_MU, NUT6))
    d = dict(ECON_SQL)
    d.update({
        "prices": _price_sql(src, at),
        "aff_per": f"SELECT landing_id, catch_taxon, {'catch_percent, ' if appendix else ''}{inds} AS inds_100 FROM {src}",
        "aff_first": f"SELECT a.catch_taxon, a.inds_100 AS inds{', a.catch_percent' if appendix else ''} FROM aff_per a "
                     "JOIN (SELECT catch_taxon, min(landing_id) AS mid FROM aff_per GROUP BY catch_taxon) m "
                     "ON a.catch_taxon = m.catch_taxon AND a.landing_id = m.mid",
    })
    if appendix:
        d["affordability"] = ("SELECT c.catch_name, f.catch_percent, p.price, f.inds FROM aff_first f "
                              "LEFT JOIN prices p ON f.catch_taxon = p.catch_taxon "
                              "LEFT JOIN catch_groups c ON f.catch_taxon = c.interagency_code")
    else:
        d["affordability"] = ("SELECT t.fish_group, c.catch_name, p.price, f.inds, t.catch_percent FROM aff_first f "
                              "LEFT JOIN prices p ON f.catch_taxon = p.catch_taxon "
                              "LEFT JOIN catch_groups c ON f.catch_taxon = c.interagency_code "
                              "LEFT JOIN top_groups t ON c.catch_name = t.catch_name")
    return d


def _single(i: Inputs):
    return EC.single_catch_trips(i.catch_data, taxa=DN.top_taxon_per_group(i.region_stats, i.catch_groups))


def _single_app(i: Inputs):
    return EC.single_catch_trips(i.catch_data, fixed_taxa=L.APPENDIX_TAXA, with_share=True)


@register("dom_single_catch_trips", O.with_base(O.snap_select(
    "SELECT * FROM single", ["landing_value", "weight"] + NUT_MU, ["landing_id", "catch_taxon"]), ECON_SQL))
def _single_q(i: Inputs):
    """DOM-19: single-row trips of the top taxa, summed per (trip, taxon)."""
    return _single(i)


@register("dom_single_catch_trips_appendix", O.with_base(O.snap_select(
    "SELECT * FROM single_app", ["landing_value", "catch_percent", "weight"] + NUT_MU, ["landing_id", "catch_taxon"]),
    ECON_SQL))
def _single_app_q(i: Inputs):
    """DOM-19 appendix: six fixed taxa with each taxon's share of single-row trips."""
    return _single_app(i)


@register("dom_price_model", O.with_base(O.snap_select("SELECT * FROM prices", ["price"], ["catch_taxon"]),
                                         _aff_sql("single", 1000.0, False)))
def _price(i: Inputs):
    """DOM-20: per-taxon log-log price line evaluated at the study's point."""
    return EC.price_model(_single(i), at=1000.0)


@register("dom_price_model_appendix", O.with_base(O.snap_select("SELECT * FROM prices", ["price"], ["catch_taxon"]),
                                                  _aff_sql("single_app", 100.0, True)))
def _price_app(i: Inputs):
    """DOM-20 appendix: price line at the smaller weight point."""
    return EC.price_model(_single_app(i), at=100.0)


@register("dom_affordability", O.with_base(O.snap_select(
    "SELECT * FROM affordability", ["price", "inds", "catch_percent"], ["fish_group", "catch_name"]),
    _aff_sql("single", 1000.0, False)))
def _aff(i: Inputs):
    """DOM-21: nutrient density of each taxon's first trip vs its modelled price."""
    single = _single(i).persist()  # read by the price model and the density aggregate
    top = DN.top_taxon_per_group(i.region_stats, i.catch_groups)
    return EC.affordability(single, EC.price_model(single, 1000.0), i.rdi, i.catch_groups, top)


@register("dom_affordability_appendix", O.with_base(O.snap_select(
    "SELECT * FROM affordability", ["price", "inds", "catch_percent"], ["catch_name"]),
    _aff_sql("single_app", 100.0, True)))
def _aff_app(i: Inputs):
    """DOM-21 appendix: six fixed taxa, share of single-row trips."""
    single = _single_app(i).persist()
    return EC.affordability(single, EC.price_model(single, 100.0), i.rdi, i.catch_groups)


# ============================================================ flows and map (DOM-24, DOM-25)

FLOW_SQL = {
    "ys_long": " UNION ALL ".join(
        f"SELECT CASE WHEN habitat = 'Deep' THEN 'Pelagic' ELSE habitat END AS habitat, gear_type, "
        f"'{nm}' AS nutrient, {mu} AS v FROM kobo_trips" for mu, nm in zip(NUT_MU, NUT)),
    "ys_per": "SELECT habitat, gear_type, nutrient, coalesce(sum(v), 0.0) AS c FROM ys_long GROUP BY 1, 2, 3",
    "shares": f"""SELECT p.habitat, p.gear_type, {O.nutrient_title('p.nutrient')} AS nutrient,
            {O.dv('p.c', 't.tot')} * 100.0 AS concentration_g
        FROM ys_per p JOIN (SELECT nutrient, sum(c) AS tot FROM ys_per GROUP BY nutrient) t ON p.nutrient = t.nutrient""",
    "fl_base": "SELECT habitat || '|' || gear_type || '|' || nutrient AS id, * FROM shares WHERE nutrient <> 'Selenium'",
    "flows": "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT id, habitat, gear_type, nutrient, concentration_g, '{x}' AS x, "
        f"CASE WHEN {col} IN {O.in_list(L.FLOW_LEVELS)} THEN {col} END AS y FROM fl_base"
        for x, col in [("Nutrient", "nutrient"), ("Habitat", "habitat"), ("Gear type", "gear_type")])
    + ") f WHERE y IS NOT NULL AND habitat IS NOT NULL AND gear_type IS NOT NULL AND concentration_g IS NOT NULL",
}


@register("dom_yield_shares", O.with_base(O.snap_select(
    "SELECT * FROM shares", ["concentration_g"], ["habitat", "gear_type", "nutrient"]), FLOW_SQL))
def _shares(i: Inputs):
    """DOM-24: share of each nutrient's yield per habitat x gear."""
    return FL.yield_shares(i.kobo_trips)


@register("dom_flow_axes", O.with_base(O.snap_select(
    "SELECT * FROM flows", ["concentration_g"], ["id", "habitat", "gear_type", "nutrient", "x", "y"]), FLOW_SQL))
def _flows(i: Inputs):
    """DOM-24: three-axis stacking of the shares (parallel-sets table)."""
    return FL.flow_axes(FL.yield_shares(i.kobo_trips))


def _map_sql() -> dict:
    d = _supply_sql("adj", "")
    d.update(_supply_sql("region_stats", "u_"))
    d["bounds"] = ("SELECT n_name AS region, 'POINT(' || CAST(n_nationkey AS VARCHAR) || ' ' || "
                   "CAST(n_regionkey AS VARCHAR) || ')' AS geometry FROM nation")
    d["map_frame"] = ("SELECT b.region, t.annual_catch AS annual_catch_tot, a.WRA, b.geometry "
                      "FROM (SELECT * FROM map WHERE area <> 'National') a RIGHT JOIN bounds b ON a.area = b.region "
                      "LEFT JOIN u_map t ON b.region = t.area")
    return d


@register("dom_map_frame", O.with_base(O.snap_select(
    "SELECT * FROM map_frame", ["annual_catch_tot", "WRA"], ["region", "geometry"]), _map_sql()))
def _map_frame(i: Inputs):
    """DOM-25: regional map frame (adjusted WRA %, unadjusted catch, geometry)."""
    i = _supply_window(i)
    adj = S.mean_annual_supply(i.region_stats_adj, D.SUPPLY_YEARS)
    tot = S.mean_annual_supply(i.region_stats, D.SUPPLY_YEARS)
    m_adj = S.map_data(adj, S.population_supplied(adj, i.rdi, i.population))
    m_tot = S.map_data(tot, S.population_supplied(tot, i.rdi, i.population))
    bounds = i.t.nation.select(F.col("n_name").alias("region"),
                               F.concat(F.lit("POINT("), F.col("n_nationkey").cast("string"), F.lit(" "),
                                        F.col("n_regionkey").cast("string"), F.lit(")")).alias("geometry"))
    return FL.map_frame(m_adj, m_tot, bounds)


# ============================================================ profiles (DOM-26..29, STA-1..2, ML-1..3)

GN_KEYS = ["landing_id", "landing_date", "quarter", "vessel_type", "habitat", "gear_type", "mesh_size"]
AG_KEYS = GN_KEYS[:-1]


def _features_sql(gill_net: bool, p: str) -> dict:
    keys = GN_KEYS if gill_net else AG_KEYS
    where = "gear_type = 'gill net'" if gill_net else "gear_type <> 'gill net'"
    sel = ", ".join(k if k != "quarter" else "CAST(quarter(landing_date) AS INTEGER) AS quarter" for k in keys)
    dbl = (["mesh_size"] if gill_net else []) + NUT6
    notnull = " AND ".join([f"{c} IS NOT NULL" for c in keys + NUT6] + [f"NOT isnan({c})" for c in dbl])
    return {
        f"{p}fx": f"SELECT {sel}, " + ", ".join(f"({mu} / weight) * 1000.0 / {conv(n)} AS {n}"
                                                 for mu, n in zip(SIX_MU, NUT6)) + f" FROM kobo_trips WHERE {where}",
        f"{p}feat": f"SELECT * FROM (SELECT {', '.join(keys)}, " + ", ".join(f"median({n}) AS {n}" for n in NUT6)
                    + f" FROM {p}fx GROUP BY {', '.join(keys)}) z WHERE {notnull}",
    }


def _lloyd_sql(p: str, k: int = 3, iters: int = 10, seed: int = 555) -> dict:
    feat = f"{p}feat"
    dist = " + ".join(f"(f.{c} - c.{c}) * (f.{c} - c.{c})" for c in NUT6)
    d = {
        f"{p}c0": f"SELECT CAST(row_number() OVER (ORDER BY h) AS INTEGER) AS cid, {', '.join(NUT6)} FROM "
                  f"(SELECT *, md5('{seed}|' || landing_id) AS h FROM {feat} ORDER BY h LIMIT {k}) s",
    }
    for it in range(1, iters + 2):
        prev = f"{p}c{it - 1}"
        d[f"{p}d{it}"] = f"SELECT f.landing_id, c.cid, {dist} AS d FROM {feat} f CROSS JOIN {prev} c"
        d[f"{p}a{it}"] = (f"SELECT landing_id, cid FROM (SELECT *, row_number() OVER (PARTITION BY landing_id "
                          f"ORDER BY d, cid) AS rn FROM {p}d{it}) x WHERE rn = 1")
        if it <= iters:
            d[f"{p}m{it}"] = (f"SELECT a.cid, " + ", ".join(f"avg(f.{c}) AS {c}" for c in NUT6)
                              + f" FROM {p}a{it} a JOIN {feat} f ON a.landing_id = f.landing_id GROUP BY a.cid")
            d[f"{p}c{it}"] = (f"SELECT o.cid, " + ", ".join(f"coalesce(m.{c}, o.{c}) AS {c}" for c in NUT6)
                              + f" FROM {prev} o LEFT JOIN {p}m{it} m ON o.cid = m.cid")
    d[f"{p}clustered"] = (f"SELECT f.*, CAST(a.cid AS VARCHAR) AS clusters FROM {feat} f "
                          f"JOIN {p}a{iters + 1} a ON f.landing_id = a.landing_id")
    return d


def _profile_sql(gill_net: bool) -> dict:
    p = "gn_" if gill_net else "ag_"
    d = _features_sql(gill_net, p)
    d.update(_lloyd_sql(p))
    return d


def _features(i: Inputs, gill_net: bool):
    mine = F.col("gear") == "gill net"
    return PR.profile_features(i.kobo_trips_of(mine if gill_net else ~mine), i.rdi, gill_net)


def _clustered(i: Inputs, gill_net: bool):
    return ST.lloyd_kmeans(_features(i, gill_net), NUT6, ["landing_id"], k=3, iters=10, seed=555)


def _feat_cols(gill_net: bool):
    keys = GN_KEYS if gill_net else AG_KEYS
    dbl = (["mesh_size"] if gill_net else []) + NUT6
    return dbl, [k for k in keys if k not in dbl]


def _ci_sql(stats_long: str, p: float = 0.99, steps: int = 16, panels: int = 1024) -> dict:
    """Mean interval; the t quantile by Newton steps on Simpson's rule for the density's integral."""
    d = {"ci_s": f"SELECT clusters, name, mean, sd, n, sd / sqrt(CAST(n AS DOUBLE)) AS se FROM ({stats_long}) m",
         "ci_q0": "SELECT DISTINCT CAST(n - 1 AS DOUBLE) AS nu, 2.3263478740408408 AS t, exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0)) / sqrt((n - 1) * pi()) AS d0 FROM ci_s WHERE n > 1"}
    for j in range(steps):
        area = (f"list_sum(list_transform(range({panels} + 1), lambda i: (CASE WHEN i = 0 OR i = {panels} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END) "
                f"* pow(1 + pow(t * i / {panels}, 2) / nu, -(nu + 1) / 2))) * t / {3 * panels}")
        d[f"ci_q{j + 1}"] = f"SELECT nu, t + ({p} - 0.5 - d0 * {area}) / (d0 * pow(1 + t * t / nu, -(nu + 1) / 2)) AS t, d0 FROM ci_q{j}"
    d["ci"] = f"SELECT s.*, mean - t * se AS ci_lower, mean + t * se AS ci_upper FROM ci_s s LEFT JOIN ci_q{steps} q ON q.nu = s.n - 1"
    return d


REPORT_SQL: dict[str, str] = {}
for _gn, _tag in ((True, "gn"), (False, "ag")):
    _dbl, _oth = _feat_cols(_gn)
    _p = f"{_tag}_"

    def _mk_feat(gn):
        def f(i: Inputs):
            return _features(i, gn)
        f.__doc__ = f"DOM-26: per-trip people-per-kg features ({'gill nets' if gn else 'other gears'})."
        return f

    def _mk_clu(gn):
        def f(i: Inputs):
            return _clustered(i, gn)
        f.__doc__ = "ML-1 (deterministic form): Lloyd k-means, k=3, hash-chosen seeds, steps until nothing moves, at most 10 (the reference's limit)."
        return f

    def _mk_frame(gn):
        def f(i: Inputs):
            return PR.model_frame(_clustered(i, gn), gn)
        f.__doc__ = "DOM-27: model frame (interaction column, factors as strings)."
        return f

    def _mk_med(gn):
        def f(i: Inputs):
            return PR.profile_medians(_clustered(i, gn))
        f.__doc__ = "DOM-28: median feature per cluster with bar labels."
        return f

    def _mk_stats(gn):
        def f(i: Inputs):
            return PR.profile_mean_ci(_clustered(i, gn)).drop("ci_lower", "ci_upper")
        f.__doc__ = "DOM-29: mean, sd, n and standard error per cluster and feature."
        return f

    def _mk_ci(gn):
        def f(i: Inputs):
            return PR.profile_mean_ci(_clustered(i, gn))
        f.__doc__ = "DOM-29: 98 % two-sided t interval per cluster and feature (t quantile via Arrow UDF)."
        return f

    def _mk_perm(gn):
        def f(i: Inputs):
            c = _clustered(i, gn)
            s = sample_fraction(c, ["landing_id"], 0.75, 555)
            return ST.permanova(s, "clusters", NUT6, ["landing_id"], permutations=999, seed=555)
        f.__doc__ = "STA-1: PERMANOVA of the six features by cluster on a 75 % sample, 999 permutations."
        return f

    sqls = _profile_sql(_gn)
    register(f"dom_profile_features_{_tag}", O.with_base(O.snap_select(f"SELECT * FROM {_p}feat", _dbl, _oth),
                                                          sqls))(_mk_feat(_gn))
    register(f"ml_lloyd_kmeans_{_tag}", O.with_base(O.snap_select(f"SELECT * FROM {_p}clustered", _dbl,
                                                                  _oth + ["clusters"]), sqls))(_mk_clu(_gn))
    if _gn:
        frame_sql = (f"SELECT CAST(quarter AS VARCHAR) AS quarter, habitat, coalesce(habitat, 'NA') || '_' || "
                     f"coalesce(CASE WHEN mesh_size = floor(mesh_size) THEN CAST(CAST(floor(mesh_size) AS BIGINT) "
                     f"AS VARCHAR) ELSE CAST(mesh_size AS VARCHAR) END, 'NA') AS habitat_mesh, mesh_size, "
                     f"vessel_type, clusters AS cluster FROM {_p}clustered")
        frame = O.snap_select(frame_sql, ["mesh_size"], ["quarter", "habitat", "habitat_mesh", "vessel_type", "cluster"])
    else:
        frame = (f"SELECT CAST(quarter AS VARCHAR) AS quarter, coalesce(habitat, 'NA') || '_' || "
                 f"coalesce(gear_type, 'NA') AS habitat_gear, habitat, gear_type, vessel_type, clusters AS cluster "
                 f"FROM {_p}clustered")
    register(f"dom_model_frame_{_tag}", O.with_base(frame, sqls))(_mk_frame(_gn))
    med_long = " UNION ALL ".join(
        f"SELECT clusters, {O.nutrient_title(O.q(n))} AS name, median({n}) AS value FROM {_p}clustered "
        "GROUP BY clusters" for n in NUT6)
    register(f"dom_profile_medians_{_tag}", O.with_base(O.snap_select(
        f"SELECT clusters, name, value, CASE WHEN value > 0.5 THEN value END AS labels FROM ({med_long}) m",
        ["value", "labels"], ["clusters", "name"]), sqls))(_mk_med(_gn))
    stats_long = " UNION ALL ".join(
        f"SELECT clusters, {O.nutrient_title(O.q(n))} AS name, avg({n}) AS mean, stddev_samp({n}) AS sd, "
        f"count(*) AS n FROM {_p}clustered GROUP BY clusters" for n in NUT6)
    register(f"dom_profile_stats_{_tag}", O.with_base(O.snap_select(
        f"SELECT clusters, name, mean, sd, n, sd / sqrt(CAST(n AS DOUBLE)) AS se FROM ({stats_long}) m",
        ["mean", "sd", "se"], ["clusters", "name", "n"]), sqls))(_mk_stats(_gn))
    register(f"dom_profile_ci_{_tag}", O.with_base(O.snap_select("SELECT * FROM ci", ["mean", "sd", "se", "ci_lower", "ci_upper"], ["clusters", "name", "n"]),
                                                   {**sqls, **_ci_sql(stats_long)}))(_mk_ci(_gn))
    pm = dict(sqls)
    pm.update({
        "pm_samp": f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('555|' || landing_id), landing_id) AS rn, "
                   f"count(*) OVER () AS nn FROM {_p}clustered) x WHERE rn <= floor(nn * 0.75)",
        "pm_mean": "SELECT " + ", ".join(f"avg({c}) AS {c}" for c in NUT6) + " FROM pm_samp",
        "pm_z": "SELECT s.landing_id, s.clusters, " + ", ".join(f"s.{c} - m.{c} AS z_{c}" for c in NUT6)
                + " FROM pm_samp s CROSS JOIN pm_mean m",
        "pm_sst": "SELECT sum(" + " + ".join(f"z_{c} * z_{c}" for c in NUT6) + ") AS ss_t FROM pm_z",
        "pm_sizes": "SELECT clusters, count(*) AS n_g, sum(count(*)) OVER (ORDER BY clusters) AS cut "
                    "FROM pm_z GROUP BY clusters",
        "pm_k": "SELECT CAST(count(*) AS DOUBLE) AS k, CAST(sum(n_g) AS DOUBLE) AS n FROM pm_sizes",
        "pm_obs": "SELECT sum((" + " + ".join(f"s_{c} * s_{c}" for c in NUT6) + ") / ng) AS ss_b FROM ("
                  "SELECT clusters, count(*) AS ng, " + ", ".join(f"sum(z_{c}) AS s_{c}" for c in NUT6)
                  + " FROM pm_z GROUP BY clusters) g",
        "pm_f": "SELECT t.ss_t, o.ss_b, ((t.ss_t - (t.ss_t - o.ss_b)) / (k.k - 1)) / ((t.ss_t - o.ss_b) / (k.n - k.k)) "
                "AS f_obs FROM pm_sst t, pm_obs o, pm_k k",
        "pm_perm": "SELECT p.perm, z.*, row_number() OVER (PARTITION BY p.perm ORDER BY "
                   "md5('555|' || CAST(p.perm AS VARCHAR) || '|' || z.landing_id), z.landing_id) AS pos "
                   "FROM pm_z z CROSS JOIN range(1, 1000) p(perm)",
        "pm_lab": "SELECT x.*, (SELECT min(clusters) FROM pm_sizes s WHERE s.cut >= x.pos) AS lab FROM pm_perm x",
        "pm_pb": "SELECT perm, sum((" + " + ".join(f"s_{c} * s_{c}" for c in NUT6) + ") / ng) AS ss_b FROM ("
                 "SELECT perm, lab, count(*) AS ng, " + ", ".join(f"sum(z_{c}) AS s_{c}" for c in NUT6)
                 + " FROM pm_lab GROUP BY perm, lab) g GROUP BY perm",
        "pm_ge": "SELECT count(*) AS ge FROM pm_pb b, pm_f f, pm_k k WHERE "
                 "((f.ss_t - (f.ss_t - b.ss_b)) / (k.k - 1)) / ((f.ss_t - b.ss_b) / (k.n - k.k)) "
                 ">= f.f_obs - 1.4901161193847656e-08",
        "permanova": "SELECT 'clusters' AS term, CAST(k.k - 1 AS INTEGER) AS df, f.ss_b AS SumOfSqs, "
                     "f.ss_b / f.ss_t AS R2, f.f_obs AS statistic, (g.ge + 1) / 1000.0 AS p_value "
                     "FROM pm_f f, pm_k k, pm_ge g UNION ALL "
                     "SELECT 'Residual', CAST(k.n - k.k AS INTEGER), f.ss_t - f.ss_b, (f.ss_t - f.ss_b) / f.ss_t, "
                     "NULL, NULL FROM pm_f f, pm_k k UNION ALL "
                     "SELECT 'Total', CAST(k.n - 1 AS INTEGER), f.ss_t, 1.0, NULL, NULL FROM pm_f f, pm_k k",
    })
    for _k, _v in pm.items():  # the same tables under names of their own, for the report
        _own = lambda x, p=_p: x.replace("pm_", f"{p}pm_").replace("permanova", f"{p}permanova")
        REPORT_SQL[_own(_k)] = _own(_v)
    register(f"sta_permanova_{_tag}", O.with_base(O.snap_select(
        "SELECT * FROM permanova", ["SumOfSqs", "R2", "statistic", "p_value"], ["term", "df"]), pm))(_mk_perm(_gn))


@register("ml_kmeans_profiles_gn")
def _kmeans_ml(i: Inputs):
    """ML-1: multi-start k-means (k=3, 500 restarts, lowest cost, then transfers), relabelled clusters."""
    out, _ = ST.cluster_profiles(_features(i, True), NUT6, ["landing_id"], k=3, restarts=500, seed=555)
    return out


@register("ml_kmeans_profiles_ag")
def _kmeans_ml_ag(i: Inputs):
    """ML-1, other gears: multi-start k-means with transfers."""
    out, _ = ST.cluster_profiles(_features(i, False), NUT6, ["landing_id"], k=3, restarts=500, seed=555)
    return out


@register("ml_cluster_projection_gn")
def _proj(i: Inputs):
    """ML-2: standardise + PCA(2) coordinates of the clustered trips."""
    return ST.project_clusters(_clustered(i, True), NUT6)


K_SCAN = (2, 3, 4, 5)


def _k_scan_sql() -> dict:
    d = _features_sql(True, "gn_")
    for k in K_SCAN:
        p = f"k{k}_"
        d[f"{p}feat"] = "SELECT landing_id, " + ", ".join(NUT6) + " FROM gn_feat"
        d.update(_lloyd_sql(p, k))
        far = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in NUT6)
        d[f"{p}pairs"] = (f"SELECT a.landing_id, a.clusters AS own, b.clusters AS other, sum({far}) AS t, count(*) AS n FROM {p}clustered a "
                          f"CROSS JOIN {p}clustered b GROUP BY 1, 2, 3")
        d[f"{p}sides"] = (f"SELECT landing_id, max(CASE WHEN own = other AND n > 1 THEN t / (n - 1) END) AS a, "
                          f"min(CASE WHEN own <> other THEN t / n END) AS b FROM {p}pairs GROUP BY 1")
        d[f"{p}wss"] = (f"SELECT sum(" + " + ".join(f"(x.{c} - m.{c}) * (x.{c} - m.{c})" for c in NUT6) + f") AS wss FROM {p}clustered x JOIN "
                        f"(SELECT clusters, " + ", ".join(f"avg({c}) AS {c}" for c in NUT6) + f" FROM {p}clustered GROUP BY 1) m USING (clusters)")
        d[f"{p}row"] = (f"SELECT CAST({k} AS INTEGER) AS k, (SELECT wss FROM {p}wss) AS wss, "
                        f"avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM {p}sides")
    return d


@register("ml_k_scan_gn", O.with_base(O.snap_select("SELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM k{k}_row" for k in K_SCAN) + ") u",
                                                    ["wss", "silhouette"], ["k"]), _k_scan_sql()))
def _kscan(i: Inputs):
    """ML-3: within-SS and silhouette for k = 2..5."""
    return ST.k_scan(_features(i, True), NUT6, ["landing_id"], K_SCAN)


@register("sta_permanova_report", O.with_base(O.snap_select(" UNION ALL ".join(
    f"SELECT '{t.upper()}' AS subset, term, df, round_even(SumOfSqs, 2) AS SumOfSqs, round_even(R2, 2) AS R2, round_even(statistic, 2) AS statistic, "
    f"CASE WHEN p_value <= 0.001 THEN '< 0.001' ELSE CAST(p_value AS VARCHAR) END AS p_value FROM {t}_permanova" for t in ("gn", "ag")),
    ["SumOfSqs", "R2", "statistic"], ["subset", "term", "df", "p_value"]), REPORT_SQL))
def _perm_report(i: Inputs):
    """STA-2: both PERMANOVA tables, tagged, rounded, p <= 0.001 as text."""
    res = {}
    for gn, tag in ((True, "GN_perm"), (False, "AG_perm")):
        c = _clustered(i, gn)
        s = sample_fraction(c, ["landing_id"], 0.75, 555)
        res[tag] = ST.permanova(s, "clusters", NUT6, ["landing_id"], permutations=999, seed=555)
    return ST.permanova_report(res)


__all__ = ["sig"]

from nutriyield.plans import catalog_models  # noqa: E402,F401
from nutriyield.plans import catalog_extra  # noqa: E402,F401
from nutriyield.plans import catalog_verbs  # noqa: E402,F401
