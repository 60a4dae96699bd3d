"""DuckDB oracles for the M4 queries (``laggard.plans.m4``)."""

from __future__ import annotations

from laggard.functions.normal import POS_INF_SQL, pdf_sql, phi_inv_sql, phi_sql
from laggard.oracle.m1_sql import PRE, h, u

_Q = "(CAST(nr AS DOUBLE) / (nr + 1)) * (le{j} / CAST(no{j} AS DOUBLE))"


def _latent(src: str, cols: list[str]) -> str:
    les = ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL ELSE count({c}) OVER (PARTITION BY stream_id ORDER BY {c} "
        f"RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS le{j}, "
        f"count({c}) OVER (PARTITION BY stream_id) AS no{j}" for j, c in enumerate(cols))
    zs = ", ".join(f"{phi_inv_sql(_Q.format(j=j))} AS z{j}" for j in range(len(cols)))
    return (f"lz AS (SELECT stream_id, t, count(*) OVER (PARTITION BY stream_id) AS nr, {les} FROM {src}), "
            f"z AS (SELECT stream_id, t, {zs} FROM lz)")


PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]

ORACLES: dict[str, str] = {}
ORACLES["a09_a10_latent_corr"] = PRE + ", " + _latent("f2", ["c0", "c1", "c2", "c3", "c4"]) + """,
cv AS (SELECT stream_id, """ + ", ".join(f"covar_samp(z{i}, z{j}) AS cov_{i}_{j}" for i, j in PAIRS) + """
       FROM z GROUP BY stream_id)
""" + " UNION ALL ".join(
    f"SELECT stream_id, {i} AS i, {j} AS j, round(cov_{i}_{j}, 6) AS cov, "
    f"round(cov_{i}_{j} / sqrt(cov_{i}_{i} * cov_{j}_{j}), 6) AS corr FROM cv" for i, j in PAIRS)

K3 = PRE + f""",
k3 AS (SELECT stream_id, t,
         CASE WHEN 0 IN ({h(5, 'stream_id', 't', 0)} % 5, {h(5, 'stream_id', 't', 1)} % 5) THEN NULL ELSE c0 END AS c0,
         CASE WHEN 1 IN ({h(5, 'stream_id', 't', 0)} % 5, {h(5, 'stream_id', 't', 1)} % 5) THEN NULL ELSE c1 END AS c1
       FROM f2), """ + _latent("k3", ["c0", "c1"])
ORACLES["b01_estep_p2"] = K3 + """,
rh AS (SELECT stream_id, corr(z0, z1) AS rho FROM z GROUP BY stream_id)
SELECT z.stream_id, z.t,
  round(CASE WHEN z0 IS NOT NULL THEN z0 WHEN z1 IS NOT NULL THEN rho * z1 ELSE 0.0 END, 6) AS z_imp0,
  round(CASE WHEN z1 IS NOT NULL THEN z1 WHEN z0 IS NOT NULL THEN rho * z0 ELSE 0.0 END, 6) AS z_imp1,
  round(CASE WHEN z0 IS NULL AND z1 IS NOT NULL THEN 1 - rho * rho WHEN z0 IS NULL THEN 1.0 ELSE 0.0 END, 6) AS c00,
  round(CASE WHEN z1 IS NULL AND z0 IS NOT NULL THEN 1 - rho * rho WHEN z1 IS NULL THEN 1.0 ELSE 0.0 END, 6) AS c11
FROM z JOIN rh USING (stream_id)"""


def _truncated(src: str, a: str, b: str) -> str:
    """``src`` and mean, var of N(0, 1) on [a, b]."""
    edge = " - ".join(f"(CASE WHEN abs({k}) = {POS_INF_SQL} THEN 0.0 ELSE {k} * {pdf_sql(k)} END)" for k in ("ta", "tb"))
    mass = f"CASE WHEN ta > 0 THEN {phi_sql('(-ta)')} - {phi_sql('(-tb)')} ELSE {phi_sql('tb')} - {phi_sql('ta')} END"
    return f"""SELECT *, 1.0 + edge / mass - mean * mean AS var FROM (SELECT *, CASE WHEN mass > 0 THEN ({pdf_sql('ta')} - {pdf_sql('tb')}) / mass END AS mean,
  {edge} AS edge FROM (SELECT *, {mass} AS mass FROM (SELECT *, {a} AS ta, {b} AS tb FROM {src})))"""


_START = phi_sql("lo"), phi_sql("hi"), u(3, "stream_id", "t", 1)
MIXED = PRE + f""",
e AS (SELECT stream_id, t, c0, c2, count(*) OVER g AS nr, count(c0) OVER g AS no0, count(c2) OVER g AS no2,
        count(c0) OVER (PARTITION BY stream_id ORDER BY c0 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS le0,
        count(c2) OVER (PARTITION BY stream_id ORDER BY c2 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS le2,
        count(*) OVER (PARTITION BY stream_id, c2) AS eq2
      FROM f2m WINDOW g AS (PARTITION BY stream_id)),
iv AS (SELECT stream_id, t, CASE WHEN c0 IS NOT NULL THEN {phi_inv_sql(_Q.format(j=0))} END AS z0,
         CASE WHEN c2 IS NOT NULL THEN {phi_inv_sql('((le2 - eq2) / CAST(no2 AS DOUBLE))')} END AS lo,
         CASE WHEN c2 IS NOT NULL THEN {phi_inv_sql('(le2 / CAST(no2 AS DOUBLE))')} END AS hi FROM e),
q AS (SELECT *, {_START[0]} + {_START[2]} * ({_START[1]} - {_START[0]}) AS q1 FROM iv),
st AS (SELECT stream_id, t, z0, lo, hi, {phi_inv_sql('q1')} AS z1 FROM q),
r0 AS (SELECT stream_id, CASE WHEN sqrt(v0 * v1) > 0 THEN c / sqrt(v0 * v1) ELSE 0.0 END AS rho
       FROM (SELECT stream_id, covar_samp(coalesce(z0, 0), coalesce(z1, 0)) AS c, var_samp(coalesce(z0, 0)) AS v0, var_samp(coalesce(z1, 0)) AS v1
             FROM st GROUP BY stream_id)),
j AS (SELECT st.*, rho, 1 - rho * rho AS s FROM st JOIN r0 USING (stream_id)),
ex AS (SELECT stream_id, t, rho,
         CASE WHEN z0 IS NOT NULL THEN z0 WHEN z1 IS NOT NULL THEN rho * z1 ELSE 0.0 END AS z0,
         CASE WHEN z0 IS NULL AND z1 IS NULL THEN 0.0 WHEN z1 IS NULL THEN rho * z0 WHEN z0 IS NULL THEN z1 ELSE coalesce(rho * z0 + sqrt(s) * mean, z1) END AS z1,
         CASE WHEN z0 IS NOT NULL THEN 0.0 WHEN z1 IS NOT NULL THEN s ELSE 1.0 END AS c0,
         CASE WHEN z0 IS NULL AND z1 IS NULL THEN 1.0 WHEN z1 IS NULL THEN s WHEN z0 IS NULL THEN 0.0 ELSE coalesce(s * var, 0.0) END AS c1,
         CASE WHEN z0 IS NULL AND z1 IS NULL THEN rho ELSE 0.0 END AS c01
       FROM ({_truncated('j', '((lo - rho * z0) / sqrt(s))', '((hi - rho * z0) / sqrt(s))')})),
cn AS (SELECT stream_id, any_value(rho) AS rho, avg(c0) AS c00, avg(c01) AS c01, avg(c1) AS c11,
         covar_samp(z0, z1) + avg(c01) AS s01, var_samp(z0) + avg(c0) AS s00, var_samp(z1) + avg(c1) AS s11 FROM ex GROUP BY stream_id),
rd AS (SELECT *, s01 / sqrt(s00 * s11) AS rho1 FROM cn)
"""

ORACLES["b02_initial_latent"] = MIXED + "SELECT stream_id, t, round(z0, 6) + 0.0 AS z0, round(z1, 6) + 0.0 AS z1 FROM st"
ORACLES["f20_truncated_moments"] = MIXED + f"""SELECT stream_id, t, round(mean, 6) + 0.0 AS mean, round(var, 6) + 0.0 AS var
FROM ({_truncated('(SELECT * FROM st WHERE lo IS NOT NULL)', 'lo', 'hi')})"""
ORACLES["b01_ordinal_refresh"] = MIXED + """SELECT stream_id, t, round(z0, 6) + 0.0 AS z0, round(z1, 6) + 0.0 AS z1, round(c0, 6) + 0.0 AS c0,
  round(c1, 6) + 0.0 AS c1 FROM ex"""
ORACLES["a20_b03_one_round"] = MIXED + """SELECT stream_id, round(c00, 6) + 0.0 AS c00, round(c01, 6) + 0.0 AS c01, round(c11, 6) + 0.0 AS c11,
  round(rho, 6) + 0.0 AS rho0, round(rho1, 6) + 0.0 AS rho1, round(sqrt(2.0) * abs(rho1 - rho) / sqrt(2 + 2 * rho * rho), 6) + 0.0 AS change FROM rd"""
# two columns: both matrices have the same axes, (1, 1) and (1, -1)
ORACLES["a21_a22_one_round"] = MIXED + """,
ch AS (SELECT *, (1 + rho1) / (1 + rho) - 1 AS e1, (1 - rho1) / (1 - rho) - 1 AS e2 FROM rd)
SELECT stream_id, round(sqrt(e1 * e1 + e2 * e2), 6) + 0.0 AS frob, round(greatest(abs(e1), abs(e2)), 6) + 0.0 AS spec,
  round(abs(e1) + abs(e2), 6) + 0.0 AS nuc, CAST(0 AS DOUBLE) AS grass, round(sqrt(2.0) * abs(abs(rho1) - abs(rho)), 6) + 0.0 AS sv_dist FROM ch"""

ORACLES["b15_change_statistic"] = K3 + """,
r0 AS (SELECT stream_id, covar_samp(coalesce(z0, 0), coalesce(z1, 0)) / sqrt(var_samp(coalesce(z0, 0)) * var_samp(coalesce(z1, 0))) AS rho
       FROM z GROUP BY stream_id),
la AS (SELECT stream_id, max(t) AS last FROM z GROUP BY stream_id),
en AS (SELECT stream_id, t AS win FROM z JOIN la USING (stream_id) WHERE (t + 1) % 50 = 0 OR t = last),
im AS (SELECT e.stream_id, win, rho,
         CASE WHEN z0 IS NOT NULL THEN z0 WHEN z1 IS NOT NULL THEN rho * z1 ELSE 0.0 END AS z0,
         CASE WHEN z1 IS NOT NULL THEN z1 WHEN z0 IS NOT NULL THEN rho * z0 ELSE 0.0 END AS z1,
         CASE WHEN z0 IS NOT NULL THEN 0.0 WHEN z1 IS NOT NULL THEN 1 - rho * rho ELSE 1.0 END AS c0,
         CASE WHEN z1 IS NOT NULL THEN 0.0 WHEN z0 IS NOT NULL THEN 1 - rho * rho ELSE 1.0 END AS c1,
         CASE WHEN z0 IS NULL AND z1 IS NULL THEN rho ELSE 0.0 END AS c01
       FROM en e JOIN z ON z.stream_id = e.stream_id AND z.t BETWEEN e.win - 49 AND e.win JOIN r0 ON r0.stream_id = e.stream_id),
sg AS (SELECT stream_id, win, any_value(rho) AS rho, count(*) AS n,
         (covar_samp(z0, z1) + avg(c01)) / sqrt((var_samp(z0) + avg(c0)) * (var_samp(z1) + avg(c1))) AS rho1 FROM im GROUP BY stream_id, win),
ch AS (SELECT *, (1 + rho1) / (1 + rho) - 1 AS e1, (1 - rho1) / (1 - rho) - 1 AS e2 FROM sg)
SELECT stream_id, win, CASE WHEN n = 1 THEN 'NaN'::DOUBLE ELSE round(sqrt(e1 * e1 + e2 * e2), 6) + 0.0 END AS "stat_F",
  CASE WHEN n = 1 THEN 'NaN'::DOUBLE ELSE round(greatest(abs(e1), abs(e2)), 6) + 0.0 END AS "stat_S",
  CASE WHEN n = 1 THEN 'NaN'::DOUBLE ELSE round(abs(e1) + abs(e2), 6) + 0.0 END AS "stat_N" FROM ch"""
