"""Spark queries against their DuckDB oracle on the smallest tables."""
import pytest

import __spark_entry__ as E
from concord.plans.oracle_check import compare, duck
from conftest import SF_SMALL

NAMES = ["surface", "metadata_row", "agreement_attraction", "agreement_summary", "curve_overall",
         "curve_by_group", "balanced_sample", "splits", "config_rows", "harmonize", "closest_variant", "only_main_verb",
         "format_sentences", "metric_summary", "encode", "truncate_ids", "constraint_check", "ordinal_join",
         "unknown_word_rate", "flatten_lines", "incremental_missing", "pairs_roundtrip", "results_csv_roundtrip",
         "score_files", "agreement_mixed", "allowed_by_position", "all_null_report", "batch_pad", "prepared_columns",
         "dataset_rerun", "rule_sample", "registered_metrics", "external_encode", "job_files", "lexicon_table_tags", "input_formats",
         "acceptance_accounting", "label_pad"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SF_SMALL, E.queries(), E.oracle_sql(), con, verbose=False)
    assert r["status"] == "match", r


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    # 15 checkpoints x 2 tenses; agreement is NULL for past rows, so its metric has present curves only
    assert {r.iteration for r in rows} == {520 * k for k in range(1, 16)} and {r.tense for r in rows} == {"pres", "past"}
    assert len(rows) == 15 * 9 and all(0 <= r["mean"] <= 1 and r.n > 0 for r in rows)
    assert set(df.columns) == {"iteration", "tense", "metric", "mean", "n"}
