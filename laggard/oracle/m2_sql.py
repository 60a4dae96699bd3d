"""DuckDB oracles for the M2 queries (``laggard.plans.m2``)."""

from __future__ import annotations

from laggard.operators.learner import FtrlParams
from laggard.oracle.m1_sql import IMP_CTES, IMP_SELECT, PRE
from laggard.oracle.sql import ftrl_recursive_sql
from laggard.plans import m2

DLY = m2.DELAY
PRED = (PRE.replace("WITH f1 AS", "WITH RECURSIVE f1 AS", 1) + f""",
r_in AS (SELECT stream_id, t, CAST(1 AS DOUBLE) AS x0, x0 AS x1, x1 AS x2, x2 AS x3, y FROM f1),
{ftrl_recursive_sql('r_in', 4, FtrlParams(), DLY, name='sd')},
{ftrl_recursive_sql('r_in', 4, FtrlParams(), None, name='si')},
pr AS (SELECT stream_id, 'ftrl_delayed' AS method, t, prob FROM sd WHERE t >= 0
       UNION ALL SELECT stream_id, 'ftrl_immediate', t, prob FROM si WHERE t >= 0),
pr2 AS (SELECT stream_id, method, t, prob, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred FROM pr
        UNION ALL
        SELECT a.stream_id, 'last_label', a.t, CAST(coalesce(b.y, 0) AS DOUBLE), coalesce(b.y, 0)
        FROM f1 a LEFT JOIN f1 b ON b.stream_id = a.stream_id AND b.t = a.t - {DLY}),
p AS (SELECT pr2.*, f1.y, CASE WHEN abs(f1.y - pr2.pred) > 0.5 THEN 1 ELSE 0 END AS err
      FROM pr2 JOIN f1 USING (stream_id, t))""")

ORACLES: dict[str, str] = {}

ORACLES["w01_w03_a08_prequential"] = PRED + f"""
SELECT stream_id, method, t,
  round(avg(err) OVER (PARTITION BY stream_id, method ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cer,
  round(avg(1 - err) OVER (PARTITION BY stream_id, method ORDER BY t ROWS BETWEEN {m2.SLIDE - 1} PRECEDING AND CURRENT ROW), 6) AS acc,
  round(CASE WHEN t >= {m2.MA_W - 1} THEN avg(err) OVER (PARTITION BY stream_id, method ORDER BY t
        ROWS BETWEEN {m2.MA_W - 1} PRECEDING AND CURRENT ROW) END, 6) AS ma,
  round(avg(pow(prob - y, 2)) OVER (PARTITION BY stream_id, method ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS mse
FROM p"""

ORACLES["a01_a02_a27_method_metrics"] = PRED + """,
c AS (SELECT stream_id, method, count(*) AS n,
        CAST(sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
        CAST(sum(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(sum(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, avg(err) AS cer
      FROM p GROUP BY stream_id, method),
m AS (SELECT *, tp / (tp + fn + 1e-10) AS recall, tp / (tp + fp + 1e-10) AS precision FROM c),
v AS (SELECT stream_id, method, prob, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS neg FROM p GROUP BY stream_id, method, prob),
v2 AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY stream_id, method ORDER BY prob
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM v),
au AS (SELECT stream_id, method, sum(pos * (lower + CAST(0.5 AS DOUBLE) * neg)) AS u,
              sum(pos) AS np, sum(neg) AS nn FROM v2 GROUP BY stream_id, method)
SELECT m.stream_id, m.method, n, tp, fp, fn, round(recall, 6) AS recall, round(precision, 6) AS precision,
  round(2 * (precision * recall) / (precision + recall + 1e-10), 6) AS f1,
  round(CASE WHEN np > 0 AND nn > 0 THEN u / (np * nn) END, 6) AS auc, round(cer, 6) AS cer,
  split_part(m.method, '_', 1) AS family, contains(m.method, 'missing') AS is_missing
FROM m JOIN au USING (stream_id, method)"""

s, D, w = m2.DRIFT_START, m2.SC_DELAY, m2.SC_WIN
SCORE = PRED + f""",
a AS (SELECT *, avg(CAST(1 - err AS DOUBLE)) OVER (PARTITION BY stream_id, method ORDER BY t
                ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS acc FROM p),
b AS (SELECT *, min(acc) OVER (PARTITION BY stream_id, method ORDER BY t
                ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS fmin FROM a),
g1 AS (SELECT stream_id, method, count(*) AS n, avg(err) AS cer,
         {'0.5' if s <= 0 else f'coalesce(avg(CASE WHEN t >= {max(0, s - w)} AND t < {s} THEN CAST(1 - err AS DOUBLE) END), 0.5)'} AS baseline,
         coalesce(avg(CASE WHEN t >= {s} AND t < {s + D} THEN CAST(1 - err AS DOUBLE) END), 0.0) AS dpaa,
         min(CASE WHEN t >= {s} AND t < {s + D + w} THEN acc END) AS minacc
       FROM b GROUP BY stream_id, method),
g2 AS (SELECT g1.*, greatest(0.0, baseline - coalesce(minacc, 0.0)) AS max_drop,
              baseline * 0.95 AS target, n - 10 AS lim FROM g1),
i0 AS (SELECT b.stream_id, b.method,
              min(CASE WHEN b.t >= {s} AND b.t < g2.lim AND b.acc < g2.target THEN b.t END) AS i0
       FROM b JOIN g2 USING (stream_id, method) GROUP BY b.stream_id, b.method),
rc AS (SELECT b.stream_id, b.method,
              min(CASE WHEN i0.i0 IS NOT NULL AND b.t > i0.i0 AND b.t < g2.lim AND b.fmin >= g2.target
                       THEN b.t END) AS rec
       FROM b JOIN g2 USING (stream_id, method) JOIN i0 USING (stream_id, method)
       GROUP BY b.stream_id, b.method),
card AS (SELECT g2.*, CASE WHEN i0.i0 IS NULL OR i0.i0 > {s + w + 1}
                      THEN (CASE WHEN {s + w + 1} < g2.lim THEN 0 END) ELSE rc.rec - {s} END AS recovery
         FROM g2 JOIN i0 USING (stream_id, method) JOIN rc USING (stream_id, method))"""

ORACLES["a23_a25_w11_scorecard"] = SCORE + """
SELECT stream_id, method, n, round(cer, 6) AS cer, round(baseline, 6) AS baseline, round(dpaa, 6) AS dpaa,
       round(max_drop, 6) AS max_drop, CAST(recovery AS BIGINT) AS recovery FROM card"""

ORACLES["t01_rank_methods"] = SCORE + """
SELECT stream_id, method,
  row_number() OVER (PARTITION BY stream_id ORDER BY dpaa DESC, method) AS rank_dpaa,
  row_number() OVER (PARTITION BY stream_id ORDER BY recovery ASC NULLS LAST, method) AS rank_recovery
FROM card"""

REGION = (f"CASE WHEN t < {s} THEN 'pre_drift' WHEN t < {s + D} THEN 'delay_period' "
          f"ELSE 'post_drift' END")

ORACLES["w12_region"] = PRED + f"""
SELECT stream_id, method, t, {REGION} AS region FROM p"""

ORACLES["w14_align"] = PRED + f"""
SELECT f1.stream_id, f1.t, round(q.prob, 6) AS prob FROM f1
LEFT JOIN (SELECT * FROM p WHERE method = 'ftrl_delayed' AND t >= {DLY}) q USING (stream_id, t)"""

_piv = ", ".join(
    f"max(CASE WHEN method = '{m}' THEN err END) AS {m}_error, "
    f"max(CASE WHEN method = '{m}' THEN pred END) AS {m}_pred, "
    f"round(max(CASE WHEN method = '{m}' THEN prob END), 6) AS {m}_prob" for m in m2.METHODS)
ORACLES["s06_step_results"] = PRED + f"""
SELECT stream_id, t, {_piv}, max(CASE WHEN method = '{m2.METHODS[0]}' THEN y END) AS y_true,
       {REGION} AS region FROM p GROUP BY stream_id, t"""

ORACLES["s09_output_names"] = PRE + f"""
SELECT DISTINCT stream_id,
  concat_ws('_', translate('events/user\\' || CAST(stream_id AS VARCHAR), '/\\', '__'),
            'Drift{s}', 'Delay{D}', 'Win{w}') AS file_stem FROM f1"""

_IMPV = PRE + IMP_CTES + f""",
imp AS ({IMP_SELECT}),
iv AS (SELECT imp.*, wu.v AS v_true, wc.v IS NULL AS hidden,
              CASE WHEN imp.col < 2 THEN 'cont' ELSE 'ord' END AS kind
       FROM imp JOIN wu USING (stream_id, t, col) JOIN wc USING (stream_id, t, col)),
med AS (SELECT stream_id, col, median(v_true) AS med FROM iv WHERE NOT hidden GROUP BY stream_id, col),
ivm AS (SELECT iv.*, med.med FROM iv JOIN med USING (stream_id, col))"""

ORACLES["a03_a07_imputation_errors"] = _IMPV + """
SELECT stream_id, col, kind,
  round(avg(CASE WHEN hidden THEN abs(x_imp - v_true) END), 6) AS mae,
  round(sum(CASE WHEN hidden THEN abs(x_imp - v_true) END)
        / NULLIF(sum(CASE WHEN hidden THEN abs(med - v_true) END), 0), 6) AS smae,
  round(sqrt(avg(pow(x_imp - v_true, 2))), 6) AS rmse,
  round(sqrt(avg(pow(x_imp - v_true, 2))) / NULLIF(sqrt(avg(pow(v_true, 2))), 0), 6) AS rmse_rel,
  round(sqrt(sum(CASE WHEN hidden THEN pow(x_imp - v_true, 2) END))
        / NULLIF(sqrt(sum(CASE WHEN hidden THEN pow(v_true, 2) END)), 0), 6) AS rel_rmse_hidden
FROM ivm GROUP BY stream_id, col, kind"""

ORACLES["a05_smae_by_kind"] = _IMPV + """
SELECT stream_id, kind,
  round(sum(CASE WHEN hidden THEN abs(x_imp - v_true) END)
        / NULLIF(sum(CASE WHEN hidden THEN abs(med - v_true) END), 0), 6) AS smae
FROM ivm GROUP BY stream_id, kind"""
