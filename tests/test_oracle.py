"""Queries against their SQL on the smallest tables; the rest are checked to run in other tests."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["P1_standardize_transform", "R1_split_ordered", "J3_J4_kneighbors", "A3_majority_vote", "A39_class_report", "M4_perceptron", "M6_A17_W3_W5_class_stump", "M9_J6_A24_A25_kmeans", "G1_X1_undirected", "R2_bootstrap", "M6_J8_P10_tree_predict", "M7_J8_regression_tree", "M8_A22_J9_bagging", "A23_bagging_importances", "M12_G2_G3_G4_label_propagation", "M5_A27_network_classify", "U1_U2_callable_metric", "F15_scored_grid"]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    got = con.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in got.description]
    assert sorted(cols) == sorted(df.columns)
    pick = sorted(cols)
    want = sorted(tuple(str(r[cols.index(c)]) for c in pick) for r in got.fetchall())
    assert sorted(tuple(str(r[c]) for c in pick) for r in df.collect()) == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
