"""DuckDB oracles for the M3 queries (``laggard.plans.m3``)."""

from __future__ import annotations

from laggard.functions.logistic import decay_sql
from laggard.functions.normal import phi_inv_sql
from laggard.operators.learner import FtrlParams
from laggard.oracle.m1_sql import PRE, u
from laggard.oracle.sql import ftrl_recursive_sql, sigmoid_sql

R = PRE.replace("WITH f1 AS", "WITH RECURSIVE f1 AS", 1)
RIN = """r_in AS (SELECT stream_id, t, CAST(1 AS DOUBLE) AS x0, x0 AS x1, x1 AS x2, x2 AS x3, y,
                 CASE WHEN y = 1 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS y1,
                 1.0 + x0 AS w, CASE WHEN """ + u(2000, 'stream_id', 't') + """ > 0.3 THEN y END AS y_obs
          FROM f1)"""


def _learner(prm=FtrlParams(), label="y", soft=False, weight=None) -> str:
    return R + f", {RIN}, " + ftrl_recursive_sql("r_in", 4, prm, None, label_col=label, soft=soft,
                                                  weight_col=weight, name="si") + """
SELECT stream_id, t, round(prob, 6) AS prob, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred,
       round(floss, 6) AS loss, round(dec, 6) AS decay FROM si WHERE t >= 0"""


ORACLES: dict[str, str] = {}
ORACLES["st01_st13_immediate_learner"] = _learner()
ORACLES["st02_soft_labels"] = _learner(label="y1", soft=True)
ORACLES["st03_weighted_learner"] = _learner(weight="w")
ORACLES["st04_st09_hidden_labels"] = _learner(label="y_obs")
ORACLES["st05_non_adaptive"] = _learner(prm=FtrlParams(adaptive=False))

ORACLES["st16_drift_levels"] = R + """,
e AS (SELECT a.stream_id, a.t, CASE WHEN coalesce(b.y, 0) <> a.y THEN 1 ELSE 0 END AS err
      FROM f1 a LEFT JOIN f1 b ON b.stream_id = a.stream_id AND b.t = a.t - 1),
dd AS (
  SELECT stream_id, CAST(-1 AS BIGINT) AS t, 0 AS level, 0 AS times, 0 AS fails, 0 AS tw, 0 AS fw,
         CAST(1 AS DOUBLE) AS pmin, CAST(10 AS DOUBLE) AS smin FROM e GROUP BY stream_id
  UNION ALL
  SELECT stream_id, t,
    CASE WHEN drift THEN 2 WHEN warn THEN 1 ELSE 0 END,
    CASE WHEN drift THEN tw1 ELSE times1 END, CASE WHEN drift THEN fw1 ELSE fails1 END, tw1, fw1,
    CASE WHEN drift THEN CAST(1 AS DOUBLE) ELSE pmin1 END, CASE WHEN drift THEN CAST(10 AS DOUBLE) ELSE smin1 END
  FROM (SELECT *, CASE WHEN warn THEN tw + 1 WHEN act THEN 0 ELSE tw END AS tw1,
               CASE WHEN warn THEN fw + err WHEN act THEN 0 ELSE fw END AS fw1,
               warn AND ps > pmin1 + 3 * smin1 AS drift
        FROM (SELECT *, act AND NOT (ps < pmin1 + 2 * smin1) AS warn
              FROM (SELECT *, CASE WHEN act AND ps < pmin + smin THEN pi ELSE pmin END AS pmin1,
                           CASE WHEN act AND ps < pmin + smin THEN si ELSE smin END AS smin1
                    FROM (SELECT *, pi + si AS ps
                          FROM (SELECT *, sqrt(pi * (1 - pi) / times1) AS si, times1 > 30 AS act
                                FROM (SELECT *, CAST(fails1 AS DOUBLE) / times1 AS pi
                                      FROM (SELECT d.stream_id, e.t, d.times, d.fails, d.tw, d.fw, d.pmin,
                                                   d.smin, e.err, d.times + 1 AS times1, d.fails + e.err AS fails1
                                            FROM dd d JOIN e ON e.stream_id = d.stream_id AND e.t = d.t + 1)))))))
)
SELECT stream_id, t, level, round(pmin, 6) AS p_min, round(smin, 6) AS s_min FROM dd WHERE t >= 0"""

_Z = ("zz AS (SELECT f1.*, count(*) OVER (PARTITION BY stream_id) AS nr, "
      + ", ".join(f"count(*) OVER (PARTITION BY stream_id ORDER BY x{j} RANGE BETWEEN UNBOUNDED PRECEDING "
                  f"AND CURRENT ROW) AS le{j}" for j in range(3)) + " FROM f1), "
      "r_z AS (SELECT stream_id, t, CAST(1 AS DOUBLE) AS x0, "
      + ", ".join(f"{phi_inv_sql(f'(CAST(nr AS DOUBLE) / (nr + 1)) * (le{j} / CAST(nr AS DOUBLE))')} AS x{j + 1}"
                  for j in range(3)) + ", y FROM zz)")

ORACLES["st06_w13_hedge_ensemble"] = R + f", {RIN}, {_Z}, " + ftrl_recursive_sql(
    "r_in", 4, FtrlParams(), None, name="sx") + ", " + ftrl_recursive_sql(
    "r_z", 4, FtrlParams(), None, name="sz") + f""",
j AS (SELECT a.stream_id, a.t, a.fm AS mx, b.fm AS mz, a.floss AS lx, b.floss AS lz
      FROM sx a JOIN sz b ON a.stream_id = b.stream_id AND a.t = b.t WHERE a.t >= 0),
c AS (SELECT *, coalesce(sum(lz) OVER w, 0) - coalesce(sum(lx) OVER w, 0) AS gap FROM j
      WINDOW w AS (PARTITION BY stream_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, 1.0 / (1.0 + exp(-0.001 * gap)) AS lam FROM c),
pp AS (SELECT *, {sigmoid_sql('(lam * mx + (1 - lam) * mz)')} AS prob FROM l)
SELECT stream_id, t, round(lam, 6) AS lam, round(prob, 6) AS prob,
       CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred FROM pp"""

ORACLES["st11_j02_filled_labels"] = R + f""", r0 AS (SELECT a.stream_id, a.t, CAST(1 AS DOUBLE) AS x0,
       a.x0 AS x1, a.x1 AS x2, a.x2 AS x3, a.y,
       CASE WHEN {u(2000, 'a.stream_id', 'a.t')} > 0.3 THEN a.y END AS y_obs, b.y AS pseudo
  FROM f1 a LEFT JOIN f1 b ON b.stream_id = a.stream_id AND b.t = a.t - 5),
r_in AS (SELECT *, CAST(coalesce(y_obs, pseudo) AS DOUBLE) AS y_fill,
         CASE WHEN y_obs IS NOT NULL THEN 'real' WHEN pseudo IS NOT NULL THEN 'pseudo' ELSE 'none' END
         AS label_source FROM r0), """ + ftrl_recursive_sql(
    "r_in", 4, FtrlParams(), None, label_col="y_fill", name="si") + """
SELECT si.stream_id, si.t, r_in.label_source, round(si.prob, 6) AS prob,
       CASE WHEN si.prob > 0.5 THEN 1 ELSE 0 END AS pred,
       round(avg(pow(si.prob - r_in.y, 2)) OVER (PARTITION BY si.stream_id ORDER BY si.t
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS mse
FROM si JOIN r_in ON r_in.stream_id = si.stream_id AND r_in.t = si.t WHERE si.t >= 0"""

ORACLES["j03_hidden_visible"] = PRE + f"""
SELECT stream_id, CAST(sum(CASE WHEN {u(2000, 'stream_id', 't')} > 0.3 THEN 1 ELSE 0 END) AS BIGINT) AS n_visible,
       CAST(sum(CASE WHEN {u(2000, 'stream_id', 't')} > 0.3 THEN 0 ELSE 1 END) AS BIGINT) AS n_hidden
FROM f1 GROUP BY stream_id"""

_m = "((x0 - 0.5) * 8)"
_n = "CAST(t + 1 AS DOUBLE)"
ORACLES["f03_f21_scalar_functions"] = PRE + f"""
SELECT stream_id, t, round({sigmoid_sql(_m)}, 6) AS sigmoid,
  round(greatest({_m}, 0) - y * {_m} + ln(1 + exp(-abs({_m}))), 6) AS logloss,
  round((1 - x2) * greatest({_m}, 0) + x2 * greatest(-{_m}, 0) + ln(1 + exp(-abs({_m}))), 6) AS soft_ce,
  round(-(y * log2({sigmoid_sql(_m)}) + (1 - y) * log2(1 - {sigmoid_sql(_m)})), 6) AS log2loss,
  {", ".join(f"round({decay_sql(_n, c)}, 6) AS decay{c}" for c in range(5))},
  round(CASE WHEN abs({_m}) > 0.5 THEN -({_m} - 0.5 * sign({_m})) / (0.1 + 1.0 * (x1 + 1)) ELSE 0.0 END, 6) AS w0,
  round(sqrt(x2 * (1 - x2) / {_n}), 6) AS stderr,
  CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS onehot1,
  CASE WHEN {sigmoid_sql(_m)} > 0.3 THEN 1 ELSE 0 END AS pred03
FROM f1"""

ORACLES["st09_st13_growing_width"] = R + """,
sc AS (SELECT stream_id, t, y, c0 / CAST(100000 AS DOUBLE) AS c0, c1 / CAST(50 AS DOUBLE) AS c1, c2, c3,
              c4 / CAST(7 AS DOUBLE) AS c4 FROM f2),
tv AS (SELECT sc.*, CAST(least(5, floor(sc.t / ceil(n.n_rows / 5)) + 1) AS INTEGER) AS nv
       FROM sc JOIN nrows n USING (stream_id)),
r_g AS (SELECT stream_id, t, y, CAST(1 AS DOUBLE) AS x0, c0 AS x1,
               CASE WHEN nv > 1 THEN c1 ELSE 0.0 END AS x2, CASE WHEN nv > 2 THEN c2 ELSE 0.0 END AS x3,
               CASE WHEN nv > 3 THEN c3 ELSE 0.0 END AS x4, CASE WHEN nv > 4 THEN c4 ELSE 0.0 END AS x5 FROM tv), """ + \
    ftrl_recursive_sql("r_g", 6, FtrlParams(), None, name="sg") + """
SELECT stream_id, t, round(prob, 6) AS prob, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred,
       round(floss, 6) AS loss FROM sg WHERE t >= 0"""
