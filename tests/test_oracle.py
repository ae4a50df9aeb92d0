"""Every registered query that SQL can express equals DuckDB; model queries run and return rows."""

import pytest

from __spark_entry__ import entry
from flowguard.catalog import load_all
from tests.oracle import compare, connect

from .conftest import SF_TINY

QUERIES, SQL = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF_TINY)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, con, name):
    assert compare(spark, con, QUERIES[name], SQL[name], SF_TINY) == ""


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_only_iterative_fits_lack_sql():
    assert set(QUERIES) - set(SQL) == {
        "gbt_attack_score",
        "attack_score",
        "importance_weights",
        "shap_weights",
        "ae_training_loss",
        "hybrid_train_metrics",
        "exp_baseline_vs_fusion",
        "loao_fold_metrics",
        "loao_experiment",
        "score_batch",
        "artifact_reuse",
    }


def test_flagship(spark):
    rows = entry(spark).collect()
    assert {r.feature for r in rows} == {"f_value", "f_user", "f_hour", "f_k", "f_const"}
