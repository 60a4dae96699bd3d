"""DuckDB oracles for ``laggard.plans.m7``."""

from __future__ import annotations

from laggard.operators.learner import FtrlParams
from laggard.oracle.m1_sql import PRE, u
from laggard.oracle.m3_sql import R
from laggard.oracle.m5_sql import _graph
from laggard.oracle.sql import ftrl_recursive_sql, sigmoid_sql, speculation_sql
from laggard.plans import m7, pipeline
from laggard.sources.params import FIELDS, PROFILES

ORACLES: dict[str, str] = {}

ORACLES["st14_st15_speculative"] = R + ", r_in AS (SELECT stream_id, t, CAST(1 AS DOUBLE) AS x0, x0 AS x1, x1 AS x2, x2 AS x3, y, " \
    + sigmoid_sql("(4 * x0 - 2)") + " AS soft FROM f1), " + ftrl_recursive_sql("r_in", 4, FtrlParams(), 5, name="sd") + """
SELECT stream_id, t, round(prob, 6) AS prob, round(prob_spec, 6) AS prob_spec, round(prob_blend, 6) AS prob_blend
FROM (""" + speculation_sql("r_in", 4, FtrlParams(), 4, "soft", "sd") + ")"

ORACLES["j08_compare_maps"] = PRE + """,
ev AS (SELECT f1.stream_id, f1.t, e.event_type, count(*) OVER (PARTITION BY f1.stream_id) AS n
       FROM f1 JOIN events e ON e.user_id = f1.stream_id AND e.ts = f1.ts),
c AS (SELECT stream_id, CASE WHEN t >= n / 2 THEN 1 ELSE 0 END AS half, event_type, CAST(count(*) AS DOUBLE) AS c
      FROM ev GROUP BY 1, 2, 3),
wx AS (SELECT coalesce(a.stream_id, b.stream_id) AS stream_id, coalesce(a.event_type, b.event_type) AS k,
              a.c AS wv, b.c AS xv
       FROM (SELECT * FROM c WHERE half = 0) a FULL JOIN (SELECT * FROM c WHERE half = 1) b
       ON a.stream_id = b.stream_id AND a.event_type = b.event_type),
both_ AS (SELECT DISTINCT stream_id FROM c GROUP BY stream_id HAVING count(DISTINCT half) = 2)
SELECT w.stream_id,
  coalesce(string_agg(CASE WHEN wv IS NOT NULL AND xv IS NOT NULL THEN k END, ',' ORDER BY k), '') AS shared_keys,
  round(0.0 + coalesce(sum(CASE WHEN wv IS NOT NULL AND xv IS NOT NULL THEN wv * xv END), 0), 6) AS shared_dot,
  coalesce(string_agg(CASE WHEN wv IS NOT NULL AND xv IS NULL THEN k END, ',' ORDER BY k), '') AS w_only_keys,
  round(0.0 + coalesce(sum(CASE WHEN wv IS NOT NULL AND xv IS NULL THEN wv END), 0), 6) AS w_only_sum
FROM wx w JOIN both_ USING (stream_id) GROUP BY w.stream_id"""

ORACLES["j09_remap_cells"] = PRE + """
SELECT w.stream_id, w.t, w.col,
  round(CASE WHEN f2.y = 1 THEN (CASE WHEN w.col < 3 THEN CAST(floor(w.v) AS DOUBLE) END) ELSE w.v END, 6) AS v
FROM wu w JOIN f2 USING (stream_id, t)"""

ORACLES["j10_kernel_summaries"] = _graph(None).split(",\npr AS")[0] + """,
k AS (SELECT a.stream_id, a.win, a.t, list_inner_product(a.x, b.x) AS lin,
             exp(-pow(list_distance(a.x, b.x), 2) / 2.0) AS rbf
      FROM wm a JOIN wm b ON a.stream_id = b.stream_id AND a.win = b.win AND a.t <> b.t)
SELECT stream_id, win, t, round(sum(lin), 6) AS lin_sum, round(max(lin), 6) AS lin_max,
       round(sum(rbf), 6) AS rbf_sum, round(max(rbf), 6) AS rbf_max FROM k GROUP BY stream_id, win, t"""

ORACLES["u01_u04_set_ops"] = _graph(None) + """,
lab AS (SELECT stream_id, win, t FROM wm WHERE y_obs IS NOT NULL),
pa AS (SELECT DISTINCT g.stream_id, g.win, g.parent_t AS t FROM g JOIN lab USING (stream_id, win, t)),
fr AS (SELECT * FROM pa EXCEPT SELECT * FROM lab),
un AS (SELECT * FROM lab UNION SELECT * FROM fr),
ul AS (SELECT stream_id, win, t FROM wm EXCEPT SELECT * FROM lab),
base AS (SELECT DISTINCT stream_id, win FROM wm)
SELECT b.stream_id, b.win,
  coalesce((SELECT count(*) FROM lab x WHERE x.stream_id = b.stream_id AND x.win = b.win), 0) AS n_labelled,
  coalesce((SELECT count(*) FROM fr x WHERE x.stream_id = b.stream_id AND x.win = b.win), 0) AS n_frontier,
  coalesce((SELECT count(*) FROM un x WHERE x.stream_id = b.stream_id AND x.win = b.win), 0) AS n_union,
  coalesce((SELECT count(*) FROM ul x WHERE x.stream_id = b.stream_id AND x.win = b.win), 0) AS n_unlabelled
FROM base b"""

_W = m7.W_PREFIX
ORACLES["p14_p15_reorder_prefix"] = PRE + f""",
v AS (SELECT f2.*, CAST(least(5, floor(f2.t / ceil(n.n_rows / 5)) + 1) AS INTEGER) AS nv
      FROM f2 JOIN nrows n USING (stream_id))
SELECT stream_id, t, round(CASE WHEN nv > 2 THEN c2 ELSE 0.0 END, 6) AS first_ord, true AS roundtrip_ok,
  round(0.0 + {_W[0]!r} * c0 + CASE WHEN nv > 1 THEN {_W[1]!r} * c1 ELSE 0 END
        + CASE WHEN nv > 2 THEN {_W[2]!r} * c2 ELSE 0 END + CASE WHEN nv > 3 THEN {_W[3]!r} * c3 ELSE 0 END
        + CASE WHEN nv > 4 THEN {_W[4]!r} * c4 ELSE 0 END, 6) AS prefix_dot
FROM v"""

ORACLES["s10_hyper_params"] = PRE + """,
n AS (SELECT stream_id, count(*) AS n FROM f1 GROUP BY stream_id),
prof AS (SELECT * FROM (VALUES ('RandomRBF_10_5k_abrupt_2500drift', 4, CAST(0.01 AS DOUBLE), 10, 20),
                               ('wbc', 2, CAST(0.05 AS DOUBLE), 8, 10))
         AS p(dataset, decay_choice, contribute_error_rate, window_den, batch_den))
SELECT stream_id, dataset, n, decay_choice, contribute_error_rate,
       CAST(ceil(n / batch_den) AS BIGINT) AS batch_size, CAST(ceil(n / window_den) AS BIGINT) AS window_size
FROM n, prof"""

ORACLES["a18_neighbour_summary"] = _graph(None) + """,
soft AS (SELECT stream_id, win, t, coalesce(CAST(y_obs AS DOUBLE), 0.5) AS s1 FROM wm),
pa AS (SELECT g.stream_id, g.win, g.t, s.s1 AS ps1 FROM g JOIN soft s
       ON s.stream_id = g.stream_id AND s.win = g.win AND s.t = g.parent_t WHERE NOT g.is_root),
ch AS (SELECT g.stream_id, g.win, g.parent_t AS t, sum(exp(-g.delta) * s.s1) / sum(exp(-g.delta)) AS cs1
       FROM g JOIN soft s USING (stream_id, win, t) WHERE NOT g.is_root GROUP BY 1, 2, 3)
SELECT g.stream_id, g.win, g.t, round(pa.ps1, 6) AS parent_p1, round(ch.cs1, 6) AS child_p1
FROM g LEFT JOIN pa USING (stream_id, win, t) LEFT JOIN ch USING (stream_id, win, t)"""

_DEN = dict(zip(FIELDS, PROFILES[pipeline.PROFILE], strict=True))["batch_den"]
COHORT = PRE + """,
co AS (SELECT stream_id % 5 AS stream_id, x0, x1, x2, y,
              row_number() OVER (PARTITION BY stream_id % 5 ORDER BY ts, stream_id, x0, x1, x2, y) - 1 AS t FROM f1)"""

ORACLES["st19_window_labels"] = COHORT + f""",
n AS (SELECT stream_id, CAST(ceil(count(*) / {_DEN}) AS BIGINT) AS size, max(t) AS last FROM co GROUP BY stream_id),
l AS (SELECT co.stream_id, t, CASE WHEN {u(pipeline.SEED, 'co.stream_id', 't')} > {pipeline.MISSING} AND t + {pipeline.D} <= last THEN y END AS y
      FROM co JOIN n USING (stream_id)),
w AS (SELECT co.stream_id, t AS win, greatest(t - size + 1, 0) AS lo FROM co JOIN n USING (stream_id))
SELECT w.stream_id, win, lo, win - lo + 1 AS n_rows, count(l.y) AS n_known, CAST(coalesce(sum(l.y), 0) AS BIGINT) AS n_pos,
  win - lo + 1 > 2 AND count(DISTINCT l.y) = 2 AS ok
FROM w LEFT JOIN l ON l.stream_id = w.stream_id AND l.t BETWEEN w.lo AND w.win - {pipeline.D} GROUP BY w.stream_id, win, lo"""
