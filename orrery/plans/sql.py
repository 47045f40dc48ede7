"""Building blocks of the SQL that restates each query for another engine."""

from __future__ import annotations

OBS = {
    "events": "obs AS (SELECT event_type AS cohort, 'u' || (user_id % 8) AS signal_id, (row_number() OVER (PARTITION BY event_type, user_id % 8 ORDER BY ts, event_id) - 1)::DOUBLE AS signal_0, value FROM events)",
    "events_ts": "obs AS (SELECT event_type AS cohort, 'u' || (user_id % 8) AS signal_id, epoch_us(ts) / 1000000.0 AS signal_0, value FROM events)",
}
_LINES = (
    "li AS (SELECT {cohort} AS cohort, (row_number() OVER (PARTITION BY {cohort} ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1)::DOUBLE AS signal_0,"
    " l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM lineitem),"
    " obs AS (SELECT cohort, signal_id, signal_0, value FROM (UNPIVOT li ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME signal_id VALUE value))"
)
OBS["lineitem"] = _LINES.format(cohort="l_returnflag || '_' || l_linestatus")
OBS["supplier"] = _LINES.format(cohort="'s' || l_suppkey")


def obs(view: str = "events") -> str:
    return "WITH " + OBS[view]


def indexed(view: str = "events") -> str:
    return obs(view) + ", r AS (SELECT *, row_number() OVER (PARTITION BY cohort, signal_id ORDER BY signal_0) - 1 AS r, count(*) OVER (PARTITION BY cohort, signal_id) AS n FROM obs)"


def hops(window: int, stride: int, look: int | None = None, view: str = "events") -> str:
    """w: every sample of every window, with i, its place in it."""
    look = look or window
    return (
        indexed(view)
        + f", g AS (SELECT cohort, signal_id, unnest(range(0, (n - {window}) // {stride} + 1)) AS k FROM (SELECT DISTINCT cohort, signal_id, n FROM r WHERE n >= {window}))"
        + f", w AS (SELECT r.cohort, r.signal_id, g.k, {window} - 1 + g.k * {stride} AS window_end, r.r - greatest({window} - 1 + g.k * {stride} - {look} + 1, 0) AS i, r.signal_0, r.value"
        + f" FROM g JOIN r ON r.cohort = g.cohort AND r.signal_id = g.signal_id AND r.r BETWEEN {window} - 1 + g.k * {stride} - {look} + 1 AND {window} - 1 + g.k * {stride})"
        + ", c AS (SELECT *, value - avg(value) OVER (PARTITION BY cohort, signal_id, k) AS d, lag(value) OVER (PARTITION BY cohort, signal_id, k ORDER BY i) AS p,"
        + " count(*) OVER (PARTITION BY cohort, signal_id, k) AS m FROM w)"
    )


def levels(window: int, stride: int, bins: int = 10) -> str:
    return (
        hops(window, stride)
        + f", lv AS (SELECT *, CASE WHEN nv > {bins} THEN least(ceil((value - lo) / nullif((hi - lo) / {bins}, 0)), {bins}) ELSE rk END::BIGINT AS lev FROM (SELECT w.*, lo, hi, nv,"
        + " dense_rank() OVER (PARTITION BY w.cohort, w.signal_id, w.k ORDER BY value) - 1 AS rk FROM w JOIN (SELECT cohort, signal_id, k, min(value) AS lo, max(value) AS hi, count(DISTINCT value) AS nv FROM w GROUP BY ALL) s USING (cohort, signal_id, k)))"
    )


def rounded(body: str, numbers: dict[str, int] | list[str], keys: str = "cohort, signal_id, k", digits: int = 6) -> str:
    """A final SELECT that rounds columns of q."""
    cols = ", ".join(f"round({c}::DOUBLE, {digits}) AS {c}" for c in numbers)
    return f"{body} SELECT {keys}, {cols} FROM q"
