"""Every query runs; those with SQL match DuckDB on the same tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from orrery.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query of each kind; the driver compares all.
CHECKED = ["flagship_effective_dim", "hop_windows", "eng_levels", "eng_transition_matrix", "typology_windows", "sig_mad_departure", "gauss_similarity", "break_spikes", "cohort_spectrum3", "velocity_field", "csd", "transfer_entropy", "kendall_spearman", "traj_match", "curve_features", "pivot_wide", "validate_observations"]


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return c


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = pd.to_numeric(df[c]).astype(float) if pd.api.types.is_numeric_dtype(df[c]) or pd.api.types.is_bool_dtype(df[c]) else df[c].map(lambda v: None if v is None or isinstance(v, float) and np.isnan(v) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, data, db, name):
    a, b = canonical(QUERIES[name](spark, data).toPandas()), canonical(db.execute(SQL[name]).fetchdf())
    assert list(a.columns) == list(b.columns)
    for c in a.columns:
        if a[c].dtype == float or b[c].dtype == float:
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), atol=2e-6, equal_nan=True, err_msg=c)
        else:
            assert a[c].tolist() == b[c].tolist(), c


def test_same_result_whatever_the_partitioning(spark, data):
    want = canonical(QUERIES["cohort_geometry_core"](spark, data).toPandas())
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        pd.testing.assert_frame_equal(canonical(QUERIES["cohort_geometry_core"](spark, data).toPandas()), want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_scans_read_only_what_they_need(spark, data):
    plan = QUERIES["flagship_effective_dim"](spark, data)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "props" not in schema
    assert "Python" not in plan and "Arrow" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_breaks_by_kernel_equal_those_by_plan(spark, data):
    data = data.replace("0.001", "0.01")
    pd.testing.assert_frame_equal(canonical(QUERIES["breaks_full"](spark, data).toPandas()), canonical(QUERIES["breaks_plan"](spark, data).toPandas()), check_dtype=False, atol=2e-6)
