"""Registered queries against their SQL. The driver runs all of them at a larger scale; those that
only project another one's result are left to it."""

import pytest
from comparing import compare, connection

from __spark_entry__ import oracle_sql, queries

CHECKED = (
    "trigram_df overlap_pairs overlap_topk bounded_levenshtein exact_term_lookup rarest_grams fuzzy_pool intent_classify "
    "stage1_top10 empty_query_top10 file_type_popularity features_12 active_app_match class_filtered_top10 windows_rank_top10 windows_filtered_top10 fresh_results scorer_choice "
    "alias_tags tag_dedupe file_catalog catalog_merge_last catalog_replace_first root_dedupe subtree_delete apply_changes path_range_changes path_range_subtrees "
    "shortcut_catalog desktop_parse training_rows malformed_log malformed_lines change_stream_coalesced request_rows stream_changes_catalog startup_catalog rescan_overflow "
    "dirty_rebuild carry_usage windows_apply_changes stream_clicks_usage click_rejects"
).split()


@pytest.fixture(scope="module")
def duck(data):
    return connection(data)


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, data, duck, name):
    assert compare(queries()[name](spark, data), duck, oracle_sql()[name]) == []


def test_every_sql_has_its_query():
    assert set(oracle_sql()) <= set(queries())
