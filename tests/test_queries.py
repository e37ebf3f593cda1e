"""Every registered query on the smallest tables, against its SQL twin where it has one."""

import os

import pytest

import __spark_entry__ as entry_module
from compare import connect, difference

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_entry(spark):
    assert entry_module.entry(spark).count() == 5


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", ["K5_principal_variance", "K5_keyword_components"])
def test_variance_ratios_fall(spark, name):
    ratios = [r["variance_ratio"] for r in sorted(rows(spark, name), key=lambda r: r["component"])]
    assert ratios == sorted(ratios, reverse=True) and sum(ratios) <= 1 + 1e-6


@pytest.mark.parametrize("name", ["lr", "rf", "xgboost", "adaboost", "bnb", "svm"])
def test_classifiers_find_the_signal(spark, name):
    for r in rows(spark, f"M1_fit_{name}"):
        assert r["auc"] > 0.6 and 0 <= r["ks"] <= 1 and r["acc"] > 0.6


def test_repeated_runs(spark):
    assert {(r["run"], r["split"]) for r in rows(spark, "M2_repeated_runs")} == {
        (i, s) for i in (0, 1) for s in ("train", "val", "test")}


def test_cross_validation(spark):
    found = rows(spark, "M3_cross_validation")
    assert len(found) == 100 and all(0 <= r["auc_test"] <= 1 for r in found)
    assert sum(r["auc_test"] for r in found) > 80 and sum(r["auc_train"] for r in found) > 90


def test_boosting_curve(spark):
    found = rows(spark, "M4_early_stopping")
    assert [r["rounds"] for r in found] == list(range(1, len(found) + 1)) and found[-1]["auc_train"] > 0.5
    assert {r["trained"] for r in found} == {r["trained"] for r in found[:1]} and len(found) <= found[0]["trained"] <= 40


def test_boosted_trees(spark):
    assert all(r["auc"] > 0.6 and r["acc"] > 0.6 for r in rows(spark, "M1_fit_gbc"))


@pytest.mark.parametrize("name", ["M3_cross_validation_under", "M3_cross_validation_smote"])
def test_resampled_cross_validation(spark, name):
    found = {r[0]: r for r in rows(spark, name)}
    assert len(found) == 4 and all(0 <= v <= 1.0 for r in found.values() for v in r[1:] if v is not None)


def test_probabilities_add_up(spark):
    assert all(abs(r["p0"] + r["p1"] - 1) < 1e-5 for r in rows(spark, "M5_class_probabilities"))


def test_importances(spark):
    found = rows(spark, "M5_importances")
    assert sum(r["weight"] for r in found) > 0 and all((r["gain"] > 0) == (r["weight"] > 0) for r in found)


def test_elimination_ends_with_one(spark):
    assert sorted(r["num_var"] for r in rows(spark, "M6_backward_elimination")) == list(range(1, 12))
