"""Registered queries against their SQL in DuckDB."""

import math

import duckdb
import pytest

from cpgspark.plans.queries import QUERIES, SQL

TABLES = "lineitem part orders supplier events customer nation region".split()
FAST = ["query_region", "query_regions", "filter_sites", "normalize_coverage", "merge_strands", "merge_pairs", "aggregate_regions", "intersect_sites", "site_lr", "site_welch", "newcombe_interval", "shrink_effects", "fdr_bh", "fdr_storey", "chain_merge", "sliding_windows", "merge_tiles", "diagnose_regions", "annotate_features", "annotate_islands", "coverage_uniformity", "sample_correlation_rank", "age_clock", "entropy", "gene_body_metaplot", "sites_bed", "site_fisher", "site_lr_p", "site_welch_p", "variance_test", "tile_calls", "fdr_two_stage", "fdr_by_chrom", "region_count_ratio", "chain_merge_strict", "chain_merge_default", "chain_merge_permissive", "chain_merge_explicit", "region_stats", "variance_regions", "allele_specific"]


def rows(cols, values):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
