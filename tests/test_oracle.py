"""Oracles at the smallest scale; the whole contract is checked by tools/check.py."""

import os

import duckdb
import pytest

from provspark.plans import load_queries
from provspark.plans.fixtures import TABLES
from tools.check import rows_of

QUERIES, ORACLES = load_queries()
# a cross-section that keeps the suite short; PROVSPARK_ALL_ORACLES=1 runs every one
SAMPLE = """
a01_source_split_table a04_macro_mean a06_threshold_group_mean a07_threshold_kth a08_auc a09_tpr_at_fpr a14_merge_weight_groups
a18_category_breakdown a20_split_medians a22_tag_lift a37_mean_vector a41_provable_age_rates j01_inherit_split j03_only_new
j05_align_features j07_recheck j09_paired_shift j10_nearest_cosine_limit j11_nearest_hamming j13_complete_coverage
j14_reconcile_blocklist m02_score_heads m09_vote m11_cache_by_content m14_equal_fpr_compare m15_leader_clusters
m16_connected_groups p01_unify_sources p04_admit p04_admit_with_quota p09_tombstone p12_policy_entities p13_policy_words
p18_augmentation_plan p19_pseudonymise s03_rewrite_manifest s05_read_chat_export u03_merge_groups w01_quota w03_chrono_holdout
w04_carry_caption w05_pair_tokens w08_systematic_sample w10_greedy_group_split x01_hash_split x04_prompt_version x09_ad_signals
x17_dhash x23_flatten_text z01_admit_stream z02_process_parts_once
""".split()
NAMES = sorted(ORACLES) if os.environ.get("PROVSPARK_ALL_ORACLES") else SAMPLE


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    mine, columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(ORACLES[name])
    theirs, wanted = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert columns == wanted
    assert mine == theirs and mine


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
