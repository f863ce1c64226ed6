"""Every query that has SQL gives the rows that DuckDB gives; the others run and give rows."""

import math
import os

import duckdb
import pandas as pd
import pytest

from modelaudit.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(x):
    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    return x if isinstance(x, (bool, str)) else round(float(x), 5) + 0.0 if isinstance(x, (int, float)) else x


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(x) for x in r) for r in df[cols].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", ["e6_bootstrap_f1", "f_feature_matrix", "m2_pca_project", "m6_random_forest", "m11_permutation_importance"])
def test_gives_rows(spark, name):
    assert len(QUERIES[name](spark, SF).limit(5).collect()) > 0


def test_entry(spark):
    import __spark_entry__

    assert set(ORACLE) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 3


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print('listed', len(e.queries()))"
    assert "listed" in subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=200).stdout


def test_occlusion_maps_are_of_every_image(spark, monkeypatch):
    """What the query hands to the operator; the maps themselves take minutes."""
    from modelaudit.operators import ml
    from modelaudit.plans import views

    monkeypatch.setattr(ml, "random_forest", lambda *_: None)
    monkeypatch.setattr(ml, "occlusion_map", lambda model, images, *_, **__: images)
    assert QUERIES["m12_occlusion_map"](spark, SF).select("item_id").distinct().count() == views.items(spark, SF).count()
