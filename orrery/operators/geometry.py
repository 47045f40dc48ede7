"""Shape of a cohort's feature cloud, window by window: centroids, covariance, spread, pairs, and how they move.

Clouds enter as rows (cohort, k, signal_id, features...). Whatever depends on the cloud through first and second
moments is one aggregation; only general spectra need the numeric kernels.
"""

from __future__ import annotations

import functools
import itertools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import windows as W
from .kernel_ops import spread

CLOUD = ("cohort", "k")
#: The usual groups of features, and what stands in where none of them is there.
GROUPS = {
    "shape": ("kurtosis", "skewness", "crest_factor"),
    "complexity": ("permutation_entropy", "hurst", "acf_lag1"),
    "spectral": ("spectral_entropy", "spectral_centroid", "band_low_rel", "band_mid_rel", "band_high_rel"),
}
FALLBACK = ("kurtosis", "skewness", "crest_factor")
SMALL = 1e-10


def add(cols) -> Column:
    return functools.reduce(operator.add, cols)


def squared(c: Column) -> Column:
    return c * c


def feature_groups(columns, groups: dict | None = None, least: int = 2) -> dict[str, list[str]]:
    """Groups of which at least `least` features are among the columns; if there is none, one group `full` of the fallback
    features or else of the first three columns. Decided when the plan is built."""
    columns = list(columns)
    found = {name: have for name, fs in (groups or GROUPS).items() if len(have := [f for f in fs if f in columns]) >= least}
    if not found:
        some = [f for f in FALLBACK if f in columns]
        some = some if len(some) >= least else columns[:3]
        found = {"full": some} if len(some) >= least else {}
    return found


def group_vector(cloud: DataFrame, groups: dict[str, list[str]], keys: tuple[str, ...] = CLOUD) -> DataFrame:
    """Spread of the whole cloud, and the centroid of each group of features: state_<group>_<feature>."""
    every = list(dict.fromkeys(f for fs in groups.values() for f in fs))
    c = centroid(cloud, every, keys)
    return c.select(*keys, "n_signals", "mean_distance", "max_distance", "std_distance", *(F.col(f"state_{f}").alias(f"state_{g}_{f}") for g, fs in groups.items() for f in fs))


def centroid(cloud: DataFrame, features: list[str], keys: tuple[str, ...] = CLOUD, weight: str | None = None) -> DataFrame:
    """Mean of each feature over rows where it is there (weighted if asked), and mean, greatest and population deviation of
    the distances of complete rows."""
    w = Window.partitionBy(*keys)
    mean = lambda f: (F.sum(F.col(weight) * F.col(f)).over(w) / F.sum(F.when(F.col(f).isNotNull(), F.col(weight))).over(w)) if weight else F.avg(f).over(w)
    c = cloud.withColumns({f"c_{f}": mean(f) for f in features})
    d = F.sqrt(add(squared(F.col(f) - F.col(f"c_{f}")) for f in features))
    return c.withColumn("d", d).groupBy(*keys).agg(
        F.count("*").alias("n_signals"), *(F.first(f"c_{f}").alias(f"state_{f}") for f in features), F.avg("d").alias("mean_distance"), F.max("d").alias("max_distance"), F.stddev_pop("d").alias("std_distance")
    )


def correlations(cloud: DataFrame, features: list[str], keys: tuple[str, ...] = CLOUD) -> DataFrame:
    """r_<a>_<b> of the z-scored cloud (0 where a feature is flat, whose own entry is 0 too), and n_signals."""
    flat = {f: F.stddev_pop(f) < SMALL for f in features}
    out = [F.when(flat[f], 0.0).otherwise(1.0).alias(f"r_{f}_{f}") for f in features]
    for a, b in itertools.combinations(features, 2):
        r = F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
        out.append(F.when(flat[a] | flat[b], 0.0).otherwise(r).alias(f"r_{a}_{b}"))
    return cloud.groupBy(*keys).agg(F.count("*").alias("n_signals"), *out)


def effective_dim(cloud: DataFrame, features: list[str], keys: tuple[str, ...] = CLOUD) -> DataFrame:
    """Participation ratio (tr C)^2 / |C|^2 and total variance of the z-scored cloud, from its moments alone."""
    c = correlations(cloud, features, keys)
    trace = add(F.col(f"r_{f}_{f}") for f in features)
    norm = add(squared(F.col(f"r_{a}_{a}")) for a in features) + 2 * add(squared(F.col(f"r_{a}_{b}")) for a, b in itertools.combinations(features, 2))
    n = F.col("n_signals")
    return c.filter(n >= 2).select(*keys, "n_signals", F.lit(len(features)).alias("n_features"), (trace * trace / F.nullif(norm, F.lit(0.0))).alias("effective_dim"), (trace * n / (n - 1)).alias("total_variance"))


def eigen3(cloud: DataFrame, features: list[str], keys: tuple[str, ...] = CLOUD) -> DataFrame:
    """Spectrum and leading axis of three z-scored features in closed form: eigenvalue_1..3, explained_1, entropy (log2),
    condition number, ratios, and pc_1..3, its largest component positive."""
    x, y, z = features
    c = correlations(cloud, features, keys).filter("n_signals >= 3")
    a, b, g = F.col(f"r_{x}_{y}"), F.col(f"r_{x}_{z}"), F.col(f"r_{y}_{z}")
    # cyclic by construction: the matrix is I plus a zero-diagonal part
    c = c.withColumns({"a": a, "b": b, "g": g}).withColumn("p", F.sqrt((F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("g") * F.col("g")) / 3))
    cosine = F.when(F.col("p") < 1e-12, 1.0).otherwise(F.least(F.greatest(F.col("a") * F.col("b") * F.col("g") / F.nullif(F.col("p") * F.col("p") * F.col("p"), F.lit(0.0)), F.lit(-1.0)), F.lit(1.0)))
    c = c.withColumn("phi", F.acos(cosine) / 3)
    c = c.withColumn("l1", 1 + 2 * F.col("p") * F.cos("phi")).withColumn("l3", 1 + 2 * F.col("p") * F.cos(F.col("phi") + 2.0943951023931953)).withColumn("l2", 3 - F.col("l1") - F.col("l3"))
    d = 1 - F.col("l1")
    a, b, g = F.col("a"), F.col("b"), F.col("g")
    # the axis is orthogonal to two rows of C - l1 I
    c = c.withColumns({"v1": a * g - b * d, "v2": b * a - d * g, "v3": d * d - a * a})
    size = F.sqrt(F.col("v1") * F.col("v1") + F.col("v2") * F.col("v2") + F.col("v3") * F.col("v3"))
    top = F.greatest(F.abs("v1"), F.abs("v2"), F.abs("v3"))
    sign = F.signum(F.when(F.abs("v1") == top, F.col("v1")).when(F.abs("v2") == top, F.col("v2")).otherwise(F.col("v3")))
    share = [F.greatest(F.col(f"l{i}"), F.lit(0.0)) / 3 for i in (1, 2, 3)]
    entropy = add(F.when(s > 1e-12, -s * F.log2(s)).otherwise(0.0) for s in share)
    n = F.col("n_signals")
    scale = n / (n - 1)
    return c.select(
        *keys, "n_signals", *((F.col(f"l{i}") * scale).alias(f"eigenvalue_{i}") for i in (1, 2, 3)), share[0].alias("explained_1"), entropy.alias("eigenvalue_entropy"), (entropy / F.log2(F.lit(3.0))).alias("eigenvalue_entropy_norm"),
        F.when(F.col("l3") > 1e-10, F.col("l1") / F.col("l3")).alias("condition_number"), (F.col("l2") / F.col("l1")).alias("ratio_2_1"), (F.col("l3") / F.col("l1")).alias("ratio_3_1"),
        *((sign * F.col(f"v{i}") / F.nullif(size, F.lit(0.0))).alias(f"pc_{i}") for i in (1, 2, 3)),
    )


def positions(cloud: DataFrame, spectrum: DataFrame, features: list[str], keys: tuple[str, ...] = CLOUD) -> DataFrame:
    """pc1_loading of every row: its z-scores along the leading axis."""
    w = Window.partitionBy(*keys)
    z = lambda f: (F.col(f) - F.avg(f).over(w)) / F.when(F.stddev_pop(f).over(w) < SMALL, 1.0).otherwise(F.stddev_pop(f).over(w))
    c = cloud.withColumns({f"z_{f}": z(f) for f in features}).join(spectrum.select(*keys, "pc_1", "pc_2", "pc_3"), list(keys))
    return c.select(*keys, "signal_id", add(F.col(f"z_{f}") * F.col(f"pc_{i + 1}") for i, f in enumerate(features)).alias("pc1_loading"))


def signal_geometry(cloud: DataFrame, features: list[str], keys: tuple[str, ...] = CLOUD) -> DataFrame:
    """Each row against its centroid: distance, length, part along the centroid's direction and the part across it.
    A missing feature counts as the centroid's."""
    w = Window.partitionBy(*keys)
    c = cloud.withColumns({f"c_{f}": F.avg(f).over(w) for f in features}).withColumns({f: F.coalesce(f, f"c_{f}") for f in features})
    dot = add(F.col(f) * F.col(f"c_{f}") for f in features)
    length = F.sqrt(add(squared(F.col(f"c_{f}")) for f in features))
    magnitude = F.sqrt(add(squared(F.col(f)) for f in features))
    along = dot / F.nullif(length, F.lit(0.0))
    return c.select(
        *keys, "signal_id", F.sqrt(add(squared(F.col(f) - F.col(f"c_{f}")) for f in features)).alias("distance"), along.alias("contribution"),
        F.sqrt(F.greatest(magnitude * magnitude - along * along, F.lit(0.0))).alias("residual"), magnitude.alias("magnitude"),
    )


def pairwise(cloud: DataFrame, features: list[str], keys: tuple[str, ...] = CLOUD, member: str = "signal_id", loading: str | None = None, gate: float = 0.1, blocks: int = 1) -> DataFrame:
    """Distance, cosine and Pearson across features of every unordered pair in a group; with a loading column also the
    pair's product and whether it passes the gate for the costly pair operators. (The work is in pairs of members of one
    window's cohort, a few dozen; the join is on the group. Where groups are large, each is dealt into blocks of members
    and every unordered pair of blocks is a group of its own: the cloud is worked out once, a row travels once a block and
    once more, and no pair is made twice.)"""
    cols = [*keys, member, *features, *([loading] if loading and loading not in features else [])]
    if blocks > 1:
        cloud = spread(cloud.select(*cols).filter(F.col(member).isNotNull()), (*keys, member))
    a = cloud.select(*keys, *(F.col(c).alias(f"a_{c}") for c in cols if c not in keys))
    b = cloud.select(*keys, *(F.col(c).alias(f"b_{c}") for c in cols if c not in keys))
    on = list(keys)
    if blocks > 1:
        block, some = lambda side: F.pmod(F.hash(f"{side}_{member}"), F.lit(blocks)), lambda lo, hi: F.explode(F.sequence(lo, hi))
        on += ["__a", "__b"]
        a = spread(a.withColumn("__a", block("a")).withColumn("__b", some(F.col("__a"), F.lit(blocks - 1))), tuple(on))
        b = spread(b.withColumn("__b", block("b")).withColumn("__a", some(F.lit(0), F.col("__b"))), tuple(on))
    less, one, two = F.col(f"a_{member}") < F.col(f"b_{member}"), F.col(f"a_{member}"), F.col(f"b_{member}")
    if blocks > 1:  # in two blocks either name may be the first; every column beside the names is the same both ways
        less, one, two = (F.col("__a") < F.col("__b")) | less, F.least(one, two), F.greatest(one, two)
    j = a.join(b, on).filter(less)
    x, y, n = [F.coalesce(f"a_{f}", F.lit(0.0)) for f in features], [F.coalesce(f"b_{f}", F.lit(0.0)) for f in features], len(features)
    dot = add(p * q for p, q in zip(x, y, strict=True))
    xx, yy, sx, sy = add(p * p for p in x), add(q * q for q in y), add(x), add(y)
    cosine = dot / F.nullif(F.sqrt(xx * yy), F.lit(0.0))
    r = (dot - sx * sy / n) / F.nullif(F.sqrt(F.greatest((xx - sx * sx / n) * (yy - sy * sy / n), F.lit(0.0))), F.lit(0.0))
    out = [F.sqrt(add((p - q) * (p - q) for p, q in zip(x, y, strict=True))).alias("distance"), cosine.alias("cosine_similarity"), r.alias("correlation")]
    if loading:
        both = F.col(f"a_{loading}") * F.col(f"b_{loading}")
        out += [both.alias("pc1_coloading"), F.coalesce(F.abs(both) > gate, F.lit(True)).alias("needs_granger"), (F.signum(f"a_{loading}") == F.signum(f"b_{loading}")).alias("same_side")]
    short = member.removesuffix("_id")
    return j.select(*keys, one.alias(f"{short}_a"), two.alias(f"{short}_b"), *out)


def dominance(loadings: DataFrame, order: str = "k") -> DataFrame:
    """Per engine and over all: mean and last |loading| of each signal, its sign, windows, and rank (ties by signal)."""
    per = loadings.groupBy("engine", "signal_id").agg(
        F.avg(F.abs("pc1_loading")).alias("mean_abs_pc1_loading"), F.max_by(F.abs("pc1_loading"), F.struct(order, "cohort")).alias("final_abs_pc1_loading"),
        F.signum(F.avg("pc1_loading")).cast("byte").alias("pc1_loading_sign"), F.count("pc1_loading").cast("int").alias("n_windows"),
    )
    whole = per.groupBy("signal_id").agg(
        F.lit("aggregate").alias("engine"), F.avg("mean_abs_pc1_loading").alias("mean_abs_pc1_loading"), F.max_by("final_abs_pc1_loading", F.struct("n_windows", "engine")).alias("final_abs_pc1_loading"),
        F.max_by("pc1_loading_sign", F.struct("n_windows", "engine")).alias("pc1_loading_sign"), F.sum("n_windows").cast("int").alias("n_windows"),
    )
    rank = F.row_number().over(Window.partitionBy("engine").orderBy(F.desc("mean_abs_pc1_loading"), "signal_id"))
    return per.unionByName(whole).withColumn("dominance_rank", rank)


def jackknife_dim(cloud: DataFrame, features: list[str], keys: tuple[str, ...] = CLOUD) -> DataFrame:
    """Mean, jackknife error and 95 % interval (Student's t) of the effective dimension over leave-one-out clouds of raw
    rows, from the group's sums less each row's share; four rows at least."""
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    c = cloud.withColumn("n", n)
    pairs = list(itertools.combinations_with_replacement(features, 2))
    c = c.withColumns({f"s_{f}": F.sum(f).over(w) - F.col(f) for f in features} | {f"p_{a}_{b}": F.sum(F.col(a) * F.col(b)).over(w) - F.col(a) * F.col(b) for a, b in pairs})
    m = F.col("n") - 1
    c = c.filter("n >= 4").withColumns({f"v_{a}_{b}": (F.col(f"p_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / m) / (m - 1) for a, b in pairs})
    trace = add(F.col(f"v_{f}_{f}") for f in features)
    norm = add((1 if a == b else 2) * squared(F.col(f"v_{a}_{b}")) for a, b in pairs)
    c = c.withColumn("dim", trace * trace / F.nullif(norm, F.lit(0.0)))
    r = c.groupBy(*keys).agg(F.avg("dim").alias("eff_dim_mean"), F.sqrt((F.count("*") - 1) * F.var_pop("dim")).alias("eff_dim_std"), F.count("*").alias("n"))
    half = F.col("eff_dim_std") * student(F.col("n") - 1)
    return r.select(*keys, "eff_dim_mean", "eff_dim_std", (F.col("eff_dim_mean") - half).alias("eff_dim_lower"), (F.col("eff_dim_mean") + half).alias("eff_dim_upper"))


def student(df: Column, p: float = 0.975, exact: int = 60) -> Column:
    """Quantile of Student's t: computed for up to `exact` degrees of freedom, beyond by the usual expansion."""
    z = K.student_quantile(p, 10**7)
    table = F.array(*(F.lit(K.student_quantile(p, n)) for n in range(1, exact + 1)))
    df = df.cast("double")
    far = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df * df * df)
    return F.when(df <= exact, F.try_element_at(table, df.cast("int"))).otherwise(far)


def continuous_axes(spectrum: DataFrame, axes: tuple[str, ...] = ("pc_1", "pc_2", "pc_3"), key: str = "cohort", order: str = "k") -> DataFrame:
    """The leading axis of each window turned so that it does not reverse against the window before: its sign is the
    running product of the signs of successive products. Adds turned (whether it was)."""
    w = Window.partitionBy(key).orderBy(order)
    dot = add(F.col(a) * F.lag(a).over(w) for a in axes)
    s = spectrum.withColumn("__n", F.coalesce((dot < 0).cast("int"), F.lit(0))).withColumn("__s", 1 - 2 * (F.sum("__n").over(w) % 2))
    return s.withColumns({a: F.col(a) * F.col("__s") for a in axes} | {"turned": F.col("__s") < 0}).drop("__n", "__s")


def phase_space(series: DataFrame, value: str, dim: int = 3, tau: int = 1, keys: tuple[str, ...] = ("cohort",), order: str = "k") -> DataFrame:
    """Delay coordinates: x_0 .. x_<dim-1>, the value 0, tau, 2 tau ... rows on; points without all of them are left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    p = series.select(*keys, order, *((F.lead(value, j * tau).over(w) if j else F.col(value)).alias(f"x_{j}") for j in range(dim)))
    return p.filter(F.col(f"x_{dim - 1}").isNotNull())


def dynamics(series: DataFrame, value: str = "effective_dim", keys: tuple[str, ...] = ("cohort",), coord: str = "signal_0_end", smooth: bool = False) -> DataFrame:
    """Velocity, acceleration, jerk (gradients on the coordinate), curvature and speed of a windowed value; smooth: of its
    three-point mean, what lies beyond the ends counting as 0."""
    if smooth:
        w = Window.partitionBy(*keys).orderBy(coord)
        side = lambda f: F.coalesce(f(value).over(w), F.lit(0.0))
        series = series.withColumn(value, (side(F.lag) + F.col(value) + side(F.lead)) / 3)
    s = series.withColumn("velocity", W.gradient(value, coord, keys))
    s = s.withColumn("acceleration", W.gradient("velocity", coord, keys))
    s = s.withColumn("jerk", W.gradient("acceleration", coord, keys))
    curve = F.abs("acceleration") / F.pow(1 + F.col("velocity") * F.col("velocity"), 1.5)
    return s.withColumn("curvature", curve).withColumn("speed", F.abs("velocity"))


def collapse(moved: DataFrame, keys: tuple[str, ...] = ("cohort",), coord: str = "signal_0_end", threshold: float = -0.05, least: int = 3) -> DataFrame:
    """Start of the longest run of at least `least` windows whose velocity is under the threshold (the earliest of equals);
    -1 if there is none."""
    w = Window.partitionBy(*keys).orderBy(coord)
    m = moved.withColumn("low", F.coalesce(F.col("velocity") < threshold, F.lit(False))).withColumn("at", F.row_number().over(w) - 1)
    m = W.runs(m, F.col("low"), keys, coord)
    n = m.groupBy(*keys).agg(F.count("*").alias("n"))
    r = m.filter("low").groupBy(*keys, "run").agg(F.count("*").alias("len"), F.min("at").alias("onset")).filter(F.col("len") >= least)
    best = r.groupBy(*keys).agg(F.max_by("onset", F.struct("len", -F.col("onset"))).alias("onset"))
    return n.join(best, list(keys), "left").select(*keys, F.coalesce("onset", F.lit(-1)).cast("int").alias("collapse_onset_idx"), F.coalesce(F.col("onset") / F.col("n"), F.lit(-1.0)).alias("collapse_onset_fraction"))


def thermodynamics(series: DataFrame, keys: tuple[str, ...] = ("cohort",)) -> DataFrame:
    """Entropy of the mean spectrum (nats), energy (mean effective dimension), temperature (variance of its velocity) and
    free energy. series: effective_dim, velocity, eigenvalue_1..3."""
    p = [F.avg(f"eigenvalue_{i}") for i in (1, 2, 3)]
    s = series.groupBy(*keys).agg(*(x.alias(f"l{i + 1}") for i, x in enumerate(p)), F.avg("effective_dim").alias("energy"), F.stddev_pop("effective_dim").alias("energy_std"), F.var_pop("velocity").alias("temperature"), F.count("*").alias("n_samples"))
    total = F.col("l1") + F.col("l2") + F.col("l3")
    entropy = add(F.when(F.col(f"l{i}") > 0, -(F.col(f"l{i}") / total) * F.ln(F.col(f"l{i}") / total + 1e-10)).otherwise(0.0) for i in (1, 2, 3))
    return s.withColumn("entropy", entropy).select(*keys, "entropy", "energy", "energy_std", "temperature", (F.col("energy") - F.col("entropy") * F.col("temperature")).alias("free_energy"), "n_samples")
