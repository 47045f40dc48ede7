"""Units of the stages' columns, kept with the columns as metadata, and a table of all outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import observations as O

#: Units by output and column; {u} is the unit of the coordinate. Sigma: deviations of a normalised signal.
UNITS = {
    "velocity_field": {
        "speed": "σ/{u}", "acceleration_magnitude": "σ/{u}²", "acceleration_parallel": "σ/{u}²", "acceleration_perpendicular": "σ/{u}²",
        "curvature": "1/σ", "dominant_motion_fraction": "dimensionless", "motion_dimensionality": "dimensionless",
    },
    "geometry_dynamics": {
        "effective_dim": "dimensionless", "velocity": "1/{u}", "acceleration": "1/{u}²", "jerk": "1/{u}³", "curvature": "dimensionless",
        "total_variance": "σ²", "eigenvalue_1": "σ²", "collapse_onset_idx": "index", "collapse_onset_fraction": "dimensionless",
    },
    "cohort_geometry": {
        "eigenvalue_1": "σ²", "eigenvalue_2": "σ²", "eigenvalue_3": "σ²", "eigenvalue_4": "σ²", "eigenvalue_5": "σ²", "total_variance": "σ²",
        "explained_1": "dimensionless", "explained_2": "dimensionless", "explained_3": "dimensionless", "explained_4": "dimensionless", "explained_5": "dimensionless",
        "effective_dim": "dimensionless", "eigenvalue_entropy": "bits", "eigenvalue_entropy_norm": "dimensionless", "condition_number": "dimensionless",
        "ratio_2_1": "dimensionless", "ratio_3_1": "dimensionless", "n_signals": "count",
    },
}

#: Folder of each group of outputs, and names that were used before.
FOLDERS = {
    "signals": ("typology_windows", "typology_vector", "breaks", "break_summary", "signal_statistics", "signal_vector", "signal_stability", "signal_dominance", "signal_geometry"),
    "cohorts": ("cohort_vector", "cohort_geometry", "cohort_signal_positions", "cohort_pairwise", "geometry_dynamics", "collapse", "thermodynamics", "persistent_homology", "information_flow"),
    "dynamics": ("ftle", "ftle_backward", "ftle_rolling", "lyapunov", "velocity_field", "ridge_proximity", "ftle_field", "saddles"),
    "fleet": ("system_vector", "system_geometry", "system_pairwise", "system_velocity_field", "system_information_flow", "system_ftle", "trajectory_signatures", "trajectory_match", "trajectory_library"),
}
RENAMED = {"state_vector": "cohort_vector", "state_geometry": "cohort_geometry", "cohort_information_flow": "information_flow", "cohort_ftle": "system_ftle"}


def units_of(output: str, unit: str = "") -> dict[str, dict]:
    """Column metadata of an output: {column: {"unit": ...}}; unit: of the coordinate, `step` if it has none."""
    return {c: {"unit": u.format(u=unit or "step")} for c, u in UNITS.get(output, {}).items()}


def output_name(name: str) -> str:
    return RENAMED.get(name, name)


def output_path(root: str, name: str, nested: bool = False) -> str:
    """Where an output lies: below the root, or below its group's folder."""
    name = output_name(name)
    folder = next((f for f, names in FOLDERS.items() if name in names), None) if nested else None
    return f"{root}/{folder}/{name}" if folder else f"{root}/{name}"


def describe(spark: SparkSession, root: str, names: list[str], nested: bool = False) -> DataFrame:
    """output, column, type, unit of all outputs written: what a reader of the folder needs to know."""
    rows = []
    for n in names:
        for f in spark.read.parquet(output_path(root, n, nested)).schema.fields:
            rows.append((n, f.name, f.dataType.simpleString(), (f.metadata or {}).get("unit")))
    return spark.createDataFrame(rows, "output string, column string, type string, unit string")


def write_description(spark: SparkSession, root: str, names: list[str], nested: bool = False) -> None:
    """The description as a table, `_description`, and as lines of text, `_readme`."""
    d = describe(spark, root, names, nested).coalesce(1)
    O.write_output(d, root, "_description")
    d.selectExpr("concat_ws(' | ', output, column, type, coalesce(unit, '-')) AS value").write.mode("overwrite").text(f"{root}/_readme")
