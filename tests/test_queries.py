"""Registered queries against their DuckDB oracles on the smallest driver tables."""

import pytest

from nutriyield.plans.catalog import ORACLE, QUERIES
from nutriyield.plans.compare import compare
from tests.conftest import SF_SMALL

ORACLE_SAMPLE = [
    "dom_summary_table", "dom_nutrients_table", "dom_region_stats_adj", "dom_population_supplied",
    "dom_kobo_trips", "dom_fill_region", "dom_density_by_habitat", "dom_density_by_gear", "dom_affordability",
    "dom_top_taxon_per_group", "dom_flow_axes", "ml_lloyd_kmeans_gn", "sta_permanova_gn", "dom_profile_medians_ag",
]


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_query_matches_oracle(spark, duck_small, name):
    r = compare(spark, duck_small, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert r["cols_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["hash_match"], r


def test_every_oracle_key_is_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_partition_invariance(spark):
    """Same result at 1 and 8 shuffle partitions (guards ties, first, sampling)."""
    from nutriyield.plans.compare import table_hash
    name = "sta_permanova_gn"
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        hashes = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = QUERIES[name](spark, SF_SMALL)
            hashes.append(table_hash(df.columns, [tuple(r) for r in df.collect()]))
        assert hashes[0] == hashes[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
