"""What showed only on tables of many copies."""

import os
import sys

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orrery.functions import arrays as A
from orrery.functions import kernels as K
from orrery.functions import windows as W
from orrery.operators import breaks as B
from orrery.operators import geometry as G
from orrery.operators import kernel_ops as KO
from orrery.operators import pairs as P
from orrery.plans import QUERIES
from orrery.plans import fleet_queries as Q
from orrery.sources import observations as O


def test_feature_matrix_keeps_its_columns_where_cohorts_agree(spark, data, tmp_path):
    one = spark.read.parquet(f"{data}/events.parquet").filter("event_type = 'click'")
    alike = one.unionByName(one.withColumn("event_type", F.lit("view")))
    alike.write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["feature_matrix"](spark, str(tmp_path)).columns == ["cohort", "top", "low"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def line(spark, values, cohort="a", signal="s"):
    rows = [(cohort, signal, float(i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cohort string, signal_id string, signal_0 double, value double")


def test_gaps_are_filled_without_frames_to_the_end(spark):
    df = W.fill_linear(line(spark, [None, 1, None, None, 4, None]), "value", ("cohort", "signal_id"), "signal_0")
    assert "unboundedfollowing" not in plan(df).lower()
    assert [r.value for r in df.orderBy("signal_0").collect()] == [1, 1, 2, 3, 4, 4]


def test_cross_correlation_copies_no_row_once_a_shift(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(300)
    y = np.roll(x, 7) + 0.1 * rng.standard_normal(300)
    pairs = P.aligned(line(spark, x, signal="p").unionByName(line(spark, y, signal="q")).unionByName(line(spark, [0.1] * 300, signal="r")))
    df = P.cross_correlation(pairs)
    assert "Generate" not in plan(df)
    got = {(r.signal_a, r.signal_b): r for r in df.collect()}
    zx, zy = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
    assert got["p", "q"].lag_at_max == 7 and abs(got["p", "q"].max_xcorr - zx[:-7] @ zy[7:] / 300) < 1e-12
    assert got["p", "r"].max_xcorr is None


def test_alarm_sums_keep_no_growing_array(spark):
    y = np.tile([0.0, 50.0, 0.0, -50.0], 200)
    rows = line(spark, y).withColumn("r", F.col("signal_0").cast("long")).withColumn("noise", F.lit(1.0))
    df = B.cusum_alarms(rows)
    assert "aggregate(" not in plan(df)
    assert [(r.r, r.score) for r in df.orderBy("r").collect()] == K.alarm_sums(y, np.ones(len(y)))


def test_merging_folds_runs_and_not_whole_series(spark):
    rng = np.random.default_rng(5)
    at = np.flatnonzero(rng.random(4000) < 0.3)
    score = rng.random(len(at))
    kept = []
    for r, s in zip(at.tolist(), score.tolist(), strict=True):
        if not kept or r - kept[-1][0] >= 10:
            kept.append((r, s))
        elif s > kept[-1][1]:
            kept[-1] = (r, s)
    df = B.merged(spark.createDataFrame([("a", "s", r, s) for r, s in zip(at.tolist(), score.tolist(), strict=True)], "cohort string, signal_id string, r long, score double"))
    assert "run#" in plan(df)
    assert [(r.r, r.score) for r in df.orderBy("r").collect()] == kept


def test_medians_sort_without_a_comparing_lambda(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0, 10.0],)], "x array<double>").select(A.median(F.col("x")).alias("m"), A.mad(F.col("x")).alias("d"))
    assert "array_sort" not in plan(df)
    assert df.first() == (2.5, 1.0)


def test_long_series_find_their_neighbours_in_a_tree(monkeypatch):
    x = K.embed(np.exp(np.random.default_rng(1).standard_normal(9000)), 3, 1)
    seen = []
    tree = K._tree_neighbours
    monkeypatch.setattr(K, "_tree_neighbours", lambda *a: seen.append(1) or tree(*a))
    for apart in (1, 25):
        d, j = K._neighbours(x, apart)
        at = np.arange(0, len(x), 300)
        full = np.sqrt(((x[at, None] - x[None]) ** 2).sum(2))
        full[np.abs(at[:, None] - np.arange(len(x))) < apart] = np.inf
        assert np.abs(d[at] - full.min(1)).max() < 1e-3 and (np.abs(j - np.arange(len(x))) >= apart).all()
    assert len(seen) == 2


def test_nearest_points_equal_a_full_sort():
    rng = np.random.default_rng(2)
    for x in (rng.exponential(size=(3000, 3)), np.round(rng.exponential(size=(3000, 2)), 1), rng.standard_normal((5, 2)), np.zeros((300, 2))):
        d, j = K.nearest(x, 7)
        of = rng.standard_normal((40, x.shape[1]))
        e, i = K.nearest(x, 3, of)
        for r in range(0, len(x), 11):
            full = ((x - x[r]) ** 2).sum(1)
            full[r] = np.inf
            o = np.argsort(full, kind="stable")[: min(7, len(x) - 1)]
            assert (j[r] == o).all() and (d[r] == full[o]).all()
        for r in range(40):
            full = ((x - of[r]) ** 2).sum(1)
            assert (i[r] == np.argsort(full, kind="stable")[:3]).all() and (e[r] == np.sort(full)[:3]).all()


def test_saddles_sort_no_whole_path_once_a_point(monkeypatch):
    x = K.embed(np.random.default_rng(4).exponential(size=3000), 3, 1)
    sizes, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda v, *a, **k: sizes.append(np.size(v)) or sort(v, *a, **k))
    real, _ = K.jacobians(x)
    assert len(sizes) < 200
    v = np.gradient(x, axis=0)
    for i in range(0, len(x), 101):
        j = sort(((x - x[i]) ** 2).sum(1), kind="stable")[1:8]
        m = np.linalg.lstsq(x[j] - x[i], v[j] - v[i], rcond=None)[0]
        assert np.abs(real[i] - np.sort(np.linalg.eigvals(m).real)).max() < 1e-9


def test_long_series_have_parts_that_are_not_merged(spark):
    rows = line(spark, range(5))
    for df in (KO.ftle(rows, "backward"), KO.saddles(rows)):
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_boxes_without_a_nearer_point_are_left_out(monkeypatch):
    z = K.embed(np.random.default_rng(6).exponential(size=20000), 6, 1).astype(np.float32)
    seen, apart = [], K._apart
    monkeypatch.setattr(K, "_apart", lambda x, lo, hi: seen.append(len(x)) or apart(x, lo, hi))
    d, j = K._tree_neighbours(z, 1)
    assert max(seen) > 1  # points, not only boxes, against boxes
    for r in range(0, len(z), 499):
        full = ((z - z[r]) ** 2).sum(1)
        full[r] = np.inf
        assert j[r] != r and abs(full[j[r]] - full.min()) < 1e-3


def test_spikes_copy_no_frame_into_each_row(spark):
    rng = np.random.default_rng(7)
    y = [None if i % 40 == 7 else float(v) for i, v in enumerate(np.round(rng.exponential(size=400), 1))]
    y[100:160], y[200] = [1.0] * 60, float("nan")
    df = B.spikes(line(spark, y).withColumn("r", F.col("signal_0").cast("long")), 4.0)
    assert "collect_list" not in plan(df) and df.columns[-2:] == ["r", "score_s"]
    for row in df.collect():
        i = row.r
        around = np.array([v for v in y[max(0, i - 25) : i] + y[i + 1 : i + 26] if v is not None])
        want = None
        if y[i] is not None:
            s = np.sort(around)  # NaN last, as in Spark
            mid = lambda s: s[len(s) // 2] if len(s) % 2 else (s[len(s) // 2 - 1] + s[len(s) // 2]) / 2
            spread = mid(np.sort(np.abs(s - mid(s))))
            score = abs(y[i] - mid(s)) / (spread * 1.4826) if spread else np.nan
            want = score if spread >= 1e-10 and not score <= 1.25 else None
        assert (row.score_s is None) == (want is None) and (want is None or np.isnan(want) == np.isnan(row.score_s))
        assert want is None or np.isnan(want) or abs(row.score_s - want) < 1e-12


def test_warping_by_bands_equals_the_whole_matrix():
    rng = np.random.default_rng(8)
    for n, m in ((1, 1), (1, 6), (6, 1), (40, 23), (23, 40), (64, 64)):
        a, b = rng.standard_normal(n), rng.standard_normal(m)
        full = np.full((n + 1, m + 1), np.inf)
        full[0, 0] = 0
        for i in range(n):
            for j in range(m):
                full[i + 1, j + 1] = abs(a[i] - b[j]) + min(full[i, j], full[i, j + 1], full[i + 1, j])
        for band in (1, 7, 64):
            assert K.dtw(a, b, band) == full[n, m]


def test_lines_of_suppliers_are_shuffled_once(spark, data):
    df = Q.states(spark, data)
    shuffles = [s for s in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in s]
    assert len(shuffles) == 1 and "Join" not in plan(df) and "Expand" not in plan(df)


def test_pairs_of_large_groups_are_dealt_over_pairs_of_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(k, f"s{i}", *map(float, rng.standard_normal(3))) for k in (0, 1) for i in range(40)]
    states = spark.createDataFrame(rows, "k int, cohort string, a double, b double, c double")
    whole, dealt = (G.pairwise(states, ["a", "b", "c"], keys=("k",), member="cohort", blocks=n) for n in (1, 4))
    assert "RepartitionByExpression" in plan(dealt)
    got = sorted(map(tuple, dealt.collect()))
    assert len(got) == 2 * 40 * 39 // 2 and got == sorted(map(tuple, whole.collect()))


def test_lines_of_suppliers_travel_without_a_name_and_are_sorted_once(spark, data):
    p = Q.states(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert sum("+- Sort [" in s for s in p.splitlines()) == 1
    below = p[p.index("Exchange hashpartitioning") :].splitlines()[1]
    assert "l_suppkey" in below and "cohort" not in below


def test_places_of_samples_are_counted_on_lines(spark, data, tmp_path):
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    gap = F.when(F.col("l_linenumber") == 2, None).when(F.col("l_linenumber") == 3, float("nan"))
    lines.withColumn("l_tax", F.when(F.col("l_linenumber").isin(2, 3), gap).otherwise(F.col("l_tax"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = O.obs_supplier(spark, str(tmp_path))
    want = W.indexed(got.drop("r", "n"))
    assert got.filter("signal_id = 'l_tax' and r <> signal_0").count() > 0
    assert got.select(want.columns).exceptAll(want).isEmpty() and want.exceptAll(got.select(want.columns)).isEmpty()


def test_no_pair_of_blocks_is_made_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(k, f"s{i}" if i else None, *map(float, rng.standard_normal(3))) for k in (0, 1) for i in range(41)]
    states = spark.createDataFrame(rows, "k int, cohort string, a double, b double, c double")
    dealt, deal = [], G.spread
    monkeypatch.setattr(G, "spread", lambda df, keys: dealt.append(df) or deal(df, keys))
    pairs = G.pairwise(states, ["a", "b", "c"], keys=("k",), member="cohort", blocks=4)
    assert sum(df.count() for df in dealt) == 80 + 5 * 80
    assert pairs.filter("cohort_a < cohort_b").count() == pairs.count() == 2 * 40 * 39 // 2
