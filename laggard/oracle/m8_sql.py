"""DuckDB oracles for ``laggard.plans.m8``."""

from __future__ import annotations


from laggard.functions.normal import phi_inv_sql
from laggard.operators.learner import FtrlParams
from laggard.oracle.m1_sql import PRE, u
from laggard.oracle.m2_sql import _IMPV, SCORE
from laggard.oracle.m3_sql import R, _Z
from laggard.oracle.m6_sql import ensemble_sql
from laggard.oracle.sql import F4_SQL, ftrl_recursive_sql, sigmoid_sql
from laggard.plans import m2, m8

ORACLES: dict[str, str] = {}


def _labels(src: str, rows: str, out: str) -> str:
    """``rows`` beside hidden and filled labels of ``src``."""
    return f"""{out} AS (SELECT r.*, CASE WHEN {u(m8.SEED, 'r.stream_id', 'r.t')} > {m8.MISSING} THEN s.y END AS y_obs, b.y AS pseudo,
  CAST(coalesce(CASE WHEN {u(m8.SEED, 'r.stream_id', 'r.t')} > {m8.MISSING} THEN s.y END, b.y) AS DOUBLE) AS y_fill,
  CASE WHEN {u(m8.SEED, 'r.stream_id', 'r.t')} > {m8.MISSING} THEN 'real' WHEN b.y IS NOT NULL THEN 'pseudo' ELSE 'none' END AS label_source
  FROM {rows} r JOIN {src} s USING (stream_id, t) LEFT JOIN {src} b ON b.stream_id = r.stream_id AND b.t = r.t - {m8.DELAY})"""


_SCALE = ("100000", "50", "1", "1", "7")
_LATENT = ", ".join(f"{phi_inv_sql(f'(CAST(nr AS DOUBLE) / (nr + 1)) * (le{j} / CAST(nr AS DOUBLE))')} AS z{j}" for j in range(5))


def _view(cells: list[str], out: str) -> str:
    return (f"{out} AS (SELECT stream_id, t, y, CAST(1 AS DOUBLE) AS x0, "
            + ", ".join(f"CASE WHEN nv > {j} THEN {c} ELSE 0.0 END AS x{j + 1}" for j, c in enumerate(cells)) + " FROM tv)")


# a feature that is not there yet has value and weight 0
GROWING = R + f""",
lz AS (SELECT f2.*, count(*) OVER (PARTITION BY stream_id) AS nr, {", ".join(
    f"count(*) OVER (PARTITION BY stream_id ORDER BY c{j} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS le{j}" for j in range(5))} FROM f2),
tv AS (SELECT lz.*, {_LATENT}, CAST(least(5, floor(t / ceil(nr / 5)) + 1) AS INTEGER) AS nv FROM lz),
{_view([f'c{j} / CAST({s} AS DOUBLE)' for j, s in enumerate(_SCALE)], 'gx')}, {_view([f'z{j}' for j in range(5)], 'gz')},
{_labels('f2', 'gx', 'rx')}, {_labels('f2', 'gz', 'rz')}"""

ORACLES["st08_growing_ensemble"] = ensemble_sql(GROWING, 6, "y", m8.DELAY)
ORACLES["st10_growing_hidden_ensemble"] = ensemble_sql(GROWING, 6, "y_obs", None)
ORACLES["st12_growing_filled_ensemble"] = ensemble_sql(GROWING, 6, "y_fill", None)
ORACLES["st09_growing_hidden_labels"] = GROWING + ", " + ftrl_recursive_sql("rx", 6, FtrlParams(), None, label_col="y_obs", name="sg") + """
SELECT stream_id, t, round(prob, 6) AS prob, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred FROM sg WHERE t >= 0"""


def _filled(head: str, p: int, rows: str) -> str:
    return head + ", " + ftrl_recursive_sql(rows, p, FtrlParams(), None, label_col="y_fill", name="sf") + f"""
SELECT sf.stream_id, sf.t, label_source, round(prob, 6) AS prob, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred,
  round(avg(pow(prob - y, 2)) OVER (PARTITION BY sf.stream_id ORDER BY sf.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS mse
FROM sf JOIN {rows} USING (stream_id, t)"""


ORACLES["st11_growing_filled_labels"] = _filled(GROWING, 6, "rx")
ORACLES["st11_z_view"] = _filled(R + f", {_Z}, {_labels('f1', 'r_z', 'zl')}", 4, "zl")

ORACLES["a03_mae_all_cells"] = _IMPV + "SELECT stream_id, col, round(avg(abs(x_imp - v_true)), 6) AS mae FROM iv GROUP BY stream_id, col"
ORACLES["a05_smae_pooled_median"] = _IMPV + """,
mk AS (SELECT stream_id, kind, median(v_true) AS med FROM iv WHERE NOT hidden GROUP BY stream_id, kind)
SELECT stream_id, kind, round(sum(abs(x_imp - v_true)) / NULLIF(sum(abs(med - v_true)), 0), 6) AS smae
FROM iv JOIN mk USING (stream_id, kind) WHERE hidden GROUP BY stream_id, kind"""

ORACLES["w03_short_series"] = PRE + f"""
SELECT stream_id, t, CASE WHEN count(*) OVER (PARTITION BY stream_id) < {m8.LONG_MA} THEN CAST(y AS DOUBLE)
  WHEN t >= {m8.LONG_MA - 1} THEN round(avg(y) OVER (PARTITION BY stream_id ORDER BY t ROWS BETWEEN {m8.LONG_MA - 1} PRECEDING AND CURRENT ROW), 6) END AS ma
FROM f1"""

ORACLES["s07_summary_report"] = SCORE + f"""
SELECT stream_id, 'events' AS dataset, {m2.DRIFT_START} AS drift_start, {m2.SC_DELAY} AS delay, {m2.SC_WIN} AS "window", method, round(cer, 6) AS cer,
  round(dpaa, 6) AS dpaa, round(max_drop, 6) AS max_drop, CAST(recovery AS BIGINT) AS recovery,
  row_number() OVER (PARTITION BY stream_id ORDER BY dpaa DESC, method) AS rank_dpaa,
  row_number() OVER (PARTITION BY stream_id ORDER BY recovery ASC NULLS LAST, method) AS rank_recovery FROM card"""
ORACLES["s08_rows_per_method"] = SCORE + "\nSELECT method, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in m8.METRICS) + \
    ", true AS same FROM card GROUP BY method"

ORACLES["j07_fuse_views"] = PRE + f""",
a AS (SELECT stream_id, t, {sigmoid_sql('((x0 - 0.5) * 8)')} AS p FROM f1 WHERE {u(61, 'stream_id', 't')} > 0.25),
b AS (SELECT stream_id, t, {sigmoid_sql('((x1 - 0.5) * 6)')} AS q FROM f1 WHERE {u(62, 'stream_id', 't')} > 0.25),
j AS (SELECT coalesce(a.stream_id, b.stream_id) AS stream_id, coalesce(a.t, b.t) AS t, p, q, greatest(p, 1 - p) AS c, greatest(q, 1 - q) AS d
      FROM a FULL JOIN b ON a.stream_id = b.stream_id AND a.t = b.t)
SELECT stream_id, t, round(CASE WHEN p IS NULL THEN q WHEN q IS NULL THEN p ELSE (c * p + d * q) / (c + d) END, 6) AS confidence,
  round(CASE WHEN p IS NULL THEN q WHEN q IS NULL THEN p WHEN (p > 1 - p) = (q > 1 - q) THEN 0.5 * p + 0.5 * q WHEN c > d THEN p ELSE q END, 6) AS agreement FROM j"""

ORACLES["j10_sparse_kernels"] = f"""
WITH e AS (SELECT l_orderkey AS id, l_partkey AS k, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2),
n AS (SELECT id, sum(v * v) AS sq FROM e GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, sum(a.v * b.v) AS dot FROM e a JOIN e b ON a.k = b.k AND a.id <> b.id GROUP BY a.id, b.id),
r AS (SELECT p.*, exp(-greatest(x.sq + y.sq - 2 * dot, 0) / {2 * m8.SIGMA ** 2!r}) AS rbf FROM p JOIN n x ON x.id = p.a JOIN n y ON y.id = p.b),
s AS (SELECT a AS id, sum(dot) AS lin_sum FROM p GROUP BY a),
t AS (SELECT a AS id, max(dot) AS lin_max, count(*) AS n_near, sum(rbf) AS rbf_near FROM r WHERE rbf >= {m8.LEAST!r} GROUP BY a)
SELECT n.id, round(coalesce(lin_sum, 0), 6) + 0.0 AS lin_sum, round(lin_max, 6) AS lin_max, coalesce(n_near, 0) AS n_near, round(coalesce(rbf_near, 0), 6) + 0.0 AS rbf_near
FROM n LEFT JOIN s USING (id) LEFT JOIN t USING (id)"""

ORACLES["st09_document_quality"] = f"""WITH RECURSIVE f4 AS ({F4_SQL}),
r_d AS (SELECT stream_id, t, y, CAST(1 AS DOUBLE) AS x0, x0 / CAST(10000 AS DOUBLE) AS x1, x1 / CAST(2000 AS DOUBLE) AS x2, CAST(coalesce(x2, 0) AS DOUBLE) AS x3
        FROM f4 WHERE stream_id IS NOT NULL), """ + ftrl_recursive_sql("r_d", 4, FtrlParams(), None, name="sd") + """
SELECT stream_id, t, round(prob, 6) AS prob, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred FROM sd WHERE t >= 0"""

ORACLES["t04_first_best"] = PRE + f""",
h AS (SELECT stream_id, x0, y, t, count(*) OVER (PARTITION BY stream_id) AS n FROM f1),
a AS (SELECT stream_id, c.cut, avg(CASE WHEN (x0 > c.cut) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy
      FROM h, (SELECT unnest([{", ".join(f"CAST({c!r} AS DOUBLE)" for c in m8.CUTS)}]) AS cut) c WHERE t >= floor(n * 0.7) GROUP BY stream_id, c.cut)
SELECT stream_id, cut, round(accuracy, 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY accuracy DESC, cut) AS r FROM a) WHERE r = 1"""
