"""Neighbour joins and what is counted with them, stationarity, imputation by likeness, corrected intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import fill, neighbours, robust, stationarity
from ..sources import tables as tb
from ..sources.tables import by_time
from .indicators import B, rs
from .registry import W, query, r6, rounded
from .series import G, gapped


def _delays(m: int) -> str:
    """Vectors of m closes in the key's deviations, as v."""
    cols = ", ".join(f"lead(close, {j}) OVER ({W}) AS x{j}" for j in range(m))
    return f"""dl AS (SELECT k, row_number() OVER ({W}) AS i, {cols}, stddev_pop(close) OVER (PARTITION BY k) AS s, count(*) OVER (PARTITION BY k) - {m - 1} AS n FROM bars),
  v AS (SELECT k, i, n, {', '.join(f'x{j} / s AS x{j}' for j in range(m))} FROM dl WHERE s > 0 AND x{m - 1} IS NOT NULL)"""


def _pairs(m: int, metric: str) -> str:
    gaps = [f"a.x{j} - b.x{j}" for j in range(m)]
    dist = f"greatest({', '.join(f'abs({g})' for g in gaps)})" if metric == "max" else f"sqrt({' + '.join(f'({g}) * ({g})' for g in gaps)})"
    return f"p AS (SELECT a.k, a.i AS a, b.i AS b, {dist} AS distance FROM v a JOIN v b ON a.k = b.k AND a.i < b.i)"


@query("neighbour_pairs", B + f""", {_delays(3)}, {_pairs(3, 'max')} SELECT k, a, b, {rs('distance')} AS distance FROM p WHERE distance < 0.3""")
def neighbour_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of three closes that are nowhere 0.3 deviations apart."""
    v = neighbours.delay_vectors(tb.hourly(spark, d), "close", by_time(), 3)
    return rounded(neighbours.neighbour_pairs(v, "i", "v", 3, 0.3, ["k"], "max"))


@query("recurrence", B + f""", {_delays(3)}, {_pairs(3, 'euclid')}, l AS (SELECT k, count(*) AS l FROM (SELECT k, b - a AS o, a - row_number() OVER (PARTITION BY k, b - a ORDER BY a) AS g FROM p WHERE distance < 0.2) GROUP BY k, o, g),
  s AS (SELECT k, sum(l) AS p, coalesce(sum(l) FILTER (l >= 2), 0) AS inl, count(*) FILTER (l >= 2) AS lines, max(l) AS m FROM l GROUP BY 1), n AS (SELECT k, max(n) AS n FROM v GROUP BY 1), j AS (SELECT k, n, coalesce(p, 0) AS p, coalesce(inl, 0) AS inl, coalesce(lines, 0) AS lines, coalesce(m, 0) AS m FROM n LEFT JOIN s USING (k))
SELECT k, n, {rs('(n + 2 * p) / (n * n)')} AS recurrence_rate, {rs('(n + 2 * inl) / (n + 2 * p)')} AS determinism, {rs('(n + 2 * inl) / (1 + 2 * lines)')} AS average_diagonal, m AS longest_diagonal FROM j""")
def recurrence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(neighbours.recurrence(tb.hourly(spark, d), "close", by_time(), 3, 0.2))


_RADII = [0.2, 0.3, 0.4, 0.5, 0.6]


@query("chaos_measures", B + f""", {_delays(5)}, {_pairs(5, 'max')}, c AS (SELECT k, r, count(*) AS c FROM p, (SELECT unnest({_RADII}) AS r) WHERE distance < r GROUP BY 1, 2), n AS (SELECT k, max(n) AS n FROM v GROUP BY 1),
  dim AS (SELECT k, regr_slope(ln(c / (n * (n - 1) / 2)), ln(r)) AS dimension FROM c JOIN n USING (k) GROUP BY 1),
  two AS (SELECT k, i, x0, x1, max(i) OVER (PARTITION BY k) AS n FROM v), all2 AS (SELECT k, row_number() OVER ({W}) AS i, close, lead(close) OVER ({W}) AS nx, stddev_pop(close) OVER (PARTITION BY k) AS s, count(*) OVER (PARTITION BY k) - 1 AS n FROM bars),
  near2 AS (SELECT a.k, a.n, count(*) FILTER (greatest(abs(a.close - b.close) / a.s, abs(a.nx - b.nx) / a.s) < 0.5) / (a.n * (a.n - 1) / 2) AS c FROM all2 a JOIN all2 b ON a.k = b.k AND a.i < b.i WHERE a.nx IS NOT NULL AND b.nx IS NOT NULL AND a.s > 0 GROUP BY 1, 2),
  dd AS (SELECT k, t, close - lag(close) OVER ({W}) AS d FROM bars), le AS (SELECT k, t, abs(d) AS d, abs(lag(d) OVER ({W})) AS e FROM dd), ly AS (SELECT k, avg(ln(d / e)) FILTER (d > 1e-10 AND e > 1e-10) AS lyapunov FROM le GROUP BY 1),
  z AS (SELECT k, t, close - avg(close) OVER (PARTITION BY k) AS d, row_number() OVER ({W}) * 1.7 AS a, count(*) OVER (PARTITION BY k) AS n FROM bars), zm AS (SELECT k, (power(sum(d * cos(a)) OVER ({W}), 2) + power(sum(d * sin(a)) OVER ({W}), 2)) / n AS m FROM z), zo AS (SELECT k, least(greatest(avg(m), 0), 1) AS zero_one FROM zm GROUP BY 1)
SELECT ly.k, {rs('dimension')} AS dimension, {rs('sqrt(near2.n * (near2.n - 1) / 2) * abs(c - c * c)')} AS bds, {rs('lyapunov')} AS lyapunov, {rs('zero_one')} AS zero_one FROM ly LEFT JOIN dim USING (k) LEFT JOIN near2 USING (k) LEFT JOIN zo USING (k)""")
def chaos_measures(spark: SparkSession, d: str) -> DataFrame:
    """Correlation dimension, BDS, the log growth of changes and the 0-1 test."""
    df, o = tb.hourly(spark, d), by_time()
    dimension = neighbours.correlation_dimension(df, "close", o, 5, _RADII)
    found = neighbours.lyapunov_proxy(df, "close", o).join(dimension, "k", "left").join(neighbours.bds(df, "close", o), "k", "left").join(neighbours.zero_one(df, "close", o), "k", "left")
    return rounded(found.select("k", "dimension", "bds", "lyapunov", "zero_one"))


@query("unit_root", B + f""", y AS (SELECT k, t, close AS x, close - lag(close) OVER ({W}) AS d, lag(close) OVER ({W}) AS y FROM bars), r AS (SELECT k, d AS w, y AS u, lag(d) OVER ({W}) AS v FROM y), c AS (SELECT * FROM r WHERE v IS NOT NULL),
  s AS (SELECT k, count(*) AS n, var_pop(u) * count(*) AS uu, var_pop(v) * count(*) AS vv, covar_pop(u, v) * count(*) AS uv, covar_pop(u, w) * count(*) AS uw, covar_pop(v, w) * count(*) AS vw, var_pop(w) * count(*) AS ww FROM c GROUP BY 1),
  b AS (SELECT *, uu * vv - uv * uv AS det, (uw * vv - vw * uv) / (uu * vv - uv * uv) AS b, (vw * uu - uw * uv) / (uu * vv - uv * uv) AS g FROM s),
  a AS (SELECT k, n, b / sqrt((ww - b * uw - g * vw) / (n - 3) * vv / det) AS adf FROM b)
SELECT k, n, {rs('adf')} AS adf, {rs('-3.43035 - 6.5393 / n - 16.786 / (n * n) - 79.433 / (n * n * n)')} AS critical_1, {rs('-2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.040 / (n * n * n)')} AS critical_5, {rs('-2.56677 - 1.5384 / n - 2.809 / (n * n)')} AS critical_10,
  adf < -2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.040 / (n * n * n) AS is_stationary FROM a""")
def unit_root(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stationarity.unit_root(tb.hourly(spark, d), "close", by_time(), ["k"], lags=1))


@query("kpss", B + f""", e AS (SELECT k, t, close - avg(close) OVER (PARTITION BY k) AS e, row_number() OVER ({W}) AS i FROM bars), s AS (SELECT k, e, i, sum(e) OVER (PARTITION BY k ORDER BY i) AS s FROM e), v AS (SELECT k, count(*) AS n, sum(s * s) AS q, sum(e * e) AS v FROM s GROUP BY 1),
  g AS (SELECT a.k, sum(2 * (1 - (b.i - a.i) / 13.0) * a.e * b.e) AS g FROM e a JOIN e b ON a.k = b.k AND b.i - a.i BETWEEN 1 AND 12 GROUP BY 1), f AS (SELECT k, n, q / (n * (v + g)) AS f FROM v JOIN g USING (k)),
  p AS (SELECT *, CASE WHEN f <= 0.347 THEN 0.1 WHEN f <= 0.463 THEN 0.1 - (f - 0.347) * 0.05 / 0.116 WHEN f <= 0.574 THEN 0.05 - (f - 0.463) * 0.025 / 0.111 WHEN f <= 0.739 THEN 0.025 - (f - 0.574) * 0.015 / 0.165 ELSE 0.01 END AS p FROM f)
SELECT k, n, {rs('f')} AS kpss, {rs('p::DOUBLE')} AS p, p > 0.05 AS is_stationary FROM p""")
def kpss(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stationarity.kpss(tb.hourly(spark, d), "close", by_time(), ["k"]))


@query("knn_impute", G + f""", h AS (SELECT k, t, x, list(x) OVER ({W} ROWS 47 PRECEDING) AS v FROM g), e AS (SELECT * FROM h WHERE len(v) = 48), w AS (SELECT * FROM e WHERE x IS NULL), dn AS (SELECT * FROM e WHERE x IS NOT NULL),
  q AS (SELECT w.k, w.t, dn.t AS dt, dn.x, list_filter(list_transform(range(1, 49), lambda j: (w.v[j] - dn.v[j]) ** 2), lambda z: z IS NOT NULL) AS z FROM w JOIN dn USING (k)),
  r AS (SELECT k, t, x, row_number() OVER (PARTITION BY k, t ORDER BY round(list_sum(z) * 48 / len(z), 9), dt) AS rn FROM q WHERE len(z) > 0), f AS (SELECT k, t, avg(x) AS f FROM r WHERE rn <= 5 GROUP BY 1, 2), m AS (SELECT k, avg(x) AS m FROM dn GROUP BY 1)
SELECT g.k, g.t, {rs('CASE WHEN w.t IS NULL THEN g.x ELSE coalesce(f, m) END')} AS filled FROM g LEFT JOIN w ON w.k = g.k AND w.t = g.t LEFT JOIN f ON f.k = g.k AND f.t = g.t LEFT JOIN m ON m.k = g.k""")
def knn_impute(spark: SparkSession, d: str) -> DataFrame:
    df = fill.knn_windows(gapped(spark, d), "x", by_time())
    return df.select("k", "t", r6("filled").alias("filled"))


@query("bootstrap_bca")
def bootstrap_bca(spark: SparkSession, d: str) -> DataFrame:
    return robust.bca_means(tb.events(spark, d), "value", "event_type", "event_id")
