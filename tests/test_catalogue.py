"""Every query runs on the smallest tables; those with SQL equal it (a sample of them here)."""

import os

import pytest

from scantling.plans import catalogue

SF = "/root/testdata/sf0.001"
SAMPLE = ("wide_to_long", "zscore_stats", "score_ratio_log", "auc_ties", "roc_best_mcc", "confusion", "population_sort", "wilcoxon", "fisher_bf", "beam_k2_exhaustive", "kfold_stratified", "vote_majority", "ga_crossover", "aco_construct", "report_best_model", "run_beam", "run_jury")

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(values):
    return sorted(tuple(float(f"{v:.8g}") if isinstance(v, float) else v for v in r) for r in values)


def test_every_sql_has_a_query():
    assert catalogue.oracle_sql().keys() <= catalogue.queries().keys() and catalogue.FLAGSHIP in catalogue.queries()


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = c.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert rows([r[k] for k in cols] for r in df.collect()) == rows([r[names.index(k)] for k in cols] for r in found.fetchall())


@needs_data
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


FILTERS = {"fbm_wald": 80, "fbm_wilson": 80, "remove_stillborn": 80, "remove_out_of_bounds": 80, "fdr_adaptive": 64, "select_features": 64}


@needs_data
@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_some_and_remove_some(spark, name):
    assert 0 < catalogue.queries()[name](spark, SF).count() < FILTERS[name]
