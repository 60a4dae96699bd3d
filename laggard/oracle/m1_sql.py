"""DuckDB oracles for the M1 queries (``laggard.plans.m1``)."""

from __future__ import annotations

from laggard.functions.hashing import hash32_sql
from laggard.functions.normal import phi_inv_sql, phi_sql
from laggard.oracle.sql import F1_SQL, F2_SQL
from laggard.plans import m1


def h(*parts) -> str:
    return hash32_sql(*[str(p) for p in parts], engine="duckdb")


def u(*parts) -> str:
    return f"({h(*parts)} / CAST(4294967296 AS DOUBLE))"


D = "CAST({} AS DOUBLE)".format
S = m1.MASK_SEED

PRE = f"""WITH f1 AS ({F1_SQL}), f2 AS ({F2_SQL}),
f2h AS (SELECT *, {h(S, 'stream_id', 't', 0)} % 2 AS hb0, {h(S, 'stream_id', 't', 1)} % 2 AS hb1 FROM f2),
f2m AS (SELECT stream_id, t, y,
          CASE WHEN hb0 = 0 THEN NULL ELSE c0 END AS c0, CASE WHEN hb0 = 1 THEN NULL ELSE c1 END AS c1,
          CASE WHEN hb1 = 0 THEN NULL ELSE c2 END AS c2, CASE WHEN hb1 = 1 THEN NULL ELSE c3 END AS c3,
          c4 FROM f2h),
wc AS (SELECT stream_id, t, 0 AS col, c0 AS v FROM f2m UNION ALL SELECT stream_id, t, 1, c1 FROM f2m
       UNION ALL SELECT stream_id, t, 2, c2 FROM f2m UNION ALL SELECT stream_id, t, 3, c3 FROM f2m
       UNION ALL SELECT stream_id, t, 4, c4 FROM f2m),
mc AS (SELECT * FROM wc WHERE v IS NOT NULL),
wu AS (SELECT stream_id, t, 0 AS col, c0 AS v FROM f2 UNION ALL SELECT stream_id, t, 1, c1 FROM f2
       UNION ALL SELECT stream_id, t, 2, c2 FROM f2 UNION ALL SELECT stream_id, t, 3, c3 FROM f2
       UNION ALL SELECT stream_id, t, 4, c4 FROM f2),
nrows AS (SELECT stream_id, count(*) AS n_rows FROM f2 GROUP BY stream_id)
"""


def edge_bins(v: str, mn: str, mx: str, k: int) -> str:
    lab = " + ".join(f"(CASE WHEN {v} > {mn} + {D(i)} * (({mx} - {mn}) / {k}) THEN 1 ELSE 0 END)"
                     for i in range(1, k))
    return f"(CASE WHEN {mx} = {mn} THEN {-(-k // 2) - 1} ELSE {lab} END)"


def ordinalise(v: str, mn: str, mx: str, k: int) -> str:
    return "(" + " + ".join(f"(CASE WHEN {v} > {mn} + {D(i)} * (({mx} - {mn}) / {k}) THEN 1 ELSE 0 END)"
                            for i in range(1, k + 1)) + ")"


def _lerp_quantile(pos_cte: str, group: str, queries: str, q: str, out: str) -> str:
    """numpy-linear quantile at per-row q, via equi-joins on sorted positions."""
    return f"""
SELECT qq.*, CASE WHEN (qq._h - qq._lo) >= 0.5 THEN b.v - (b.v - a.v) * (1 - (qq._h - qq._lo))
                  ELSE a.v + (b.v - a.v) * (qq._h - qq._lo) END AS {out}
FROM (SELECT qn.*, floor(qn._h) AS _lo, ceil(qn._h) AS _hi FROM
        (SELECT x.*, x.{q} * (n._n - 1) AS _h FROM {queries} x
         JOIN (SELECT {group}, count(*) AS _n FROM {pos_cte} GROUP BY {group}) n USING ({group})) qn) qq
LEFT JOIN {pos_cte} a ON a.stream_id = qq.stream_id AND a.col = qq.col AND a.pos = qq._lo
LEFT JOIN {pos_cte} b ON b.stream_id = qq.stream_id AND b.col = qq.col AND b.pos = qq._hi"""


POS = "pos_c AS (SELECT stream_id, col, v, row_number() OVER (PARTITION BY stream_id, col ORDER BY v, t) - 1 AS pos FROM {src})"

ORACLES: dict[str, str] = {}

ORACLES["p01_col_kinds"] = PRE + """
SELECT stream_id, col, count(DISTINCT v) AS n_distinct,
       CASE WHEN count(DISTINCT v) > 14 THEN 'cont' ELSE 'ord' END AS kind
FROM wu GROUP BY stream_id, col"""

ORACLES["p02_mixed_table"] = PRE + """,
c AS (SELECT stream_id, col, (max(CASE WHEN v IS NULL OR v % 1 <> 0 THEN 1 ELSE 0 END) = 1)
             OR count(DISTINCT v) >= 14 AS is_cont FROM wu GROUP BY stream_id, col)
SELECT stream_id, CAST(sum(CAST(is_cont AS INTEGER)) AS BIGINT) AS n_cont, count(*) AS n_cols,
       bool_or(is_cont) AND NOT bool_and(is_cont) AS is_mixed FROM c GROUP BY stream_id"""

_DISC = """disc AS (SELECT stream_id, col, (count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END))
                 / count(*) AS score FROM wc GROUP BY stream_id, col),
plan AS (SELECT *, CASE WHEN r < floor(p / 3) THEN 2 WHEN r < floor(p * 2 / 3) THEN 5 ELSE 0 END AS bins
         FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY score, col) - 1 AS r,
                      count(*) OVER (PARTITION BY stream_id) AS p FROM disc))"""

ORACLES["p03_discreteness"] = PRE + ", " + _DISC + """
SELECT stream_id, col, round(score, 6) AS score FROM disc"""

ORACLES["p04_auto_bin_plan"] = PRE + ", " + _DISC + """
SELECT stream_id, col, round(score, 6) AS score, bins FROM plan"""


def _apply_bins(src: str, bins_expr: str, plan_join: str) -> str:
    return f"""
mm AS (SELECT stream_id, col, min(v) AS mn, max(v) AS mx FROM {src} GROUP BY stream_id, col)
SELECT w.stream_id, w.t, w.col, {bins_expr} AS bins,
  round(CASE WHEN w.v IS NULL THEN NULL
             WHEN {bins_expr} = 2 THEN CAST({edge_bins('w.v', 'mm.mn', 'mm.mx', 2)} AS DOUBLE)
             WHEN {bins_expr} = 5 THEN CAST({edge_bins('w.v', 'mm.mn', 'mm.mx', 5)} AS DOUBLE)
             ELSE w.v END, 6) AS v_bin
FROM {src} w JOIN mm ON mm.stream_id = w.stream_id AND mm.col = w.col {plan_join}"""


ORACLES["p05_apply_bins"] = PRE + ", " + _DISC + ", " + _apply_bins(
    "wc", "pl.bins", "JOIN plan pl ON pl.stream_id = w.stream_id AND pl.col = w.col")

ORACLES["p06_positional_bins"] = PRE + ", " + _apply_bins(
    "wu", "(CASE WHEN w.col = 1 THEN 2 WHEN w.col >= 2 THEN 5 ELSE 0 END)", "")

ORACLES["p07_ordinalise"] = PRE + f""",
mm AS (SELECT stream_id, col, min(v) AS mn, max(v) AS mx FROM wu GROUP BY stream_id, col)
SELECT w.stream_id, w.t, w.col, {ordinalise('w.v', 'mm.mn', 'mm.mx', 4)} AS v_ord
FROM wu w JOIN mm USING (stream_id, col)"""

ORACLES["p08_binarise_random"] = PRE + f""",
vc AS (SELECT stream_id, col, v, count(*) AS c FROM wu WHERE v IS NOT NULL GROUP BY stream_id, col, v),
r AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY stream_id, col ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_below,
             sum(c) OVER (PARTITION BY stream_id, col) AS n FROM vc),
e AS (SELECT w.stream_id, w.col, w.v, CAST({h(11, 'w.stream_id', 'w.col', 'w.t')} AS BIGINT) * 2147483648 + w.t AS k
      FROM wu w JOIN r USING (stream_id, col, v) WHERE n_below > 0.1 * n AND n_below < 0.9 * n),
cut AS (SELECT stream_id, col, arg_min(v, k) AS cutoff FROM e GROUP BY stream_id, col)
SELECT w.stream_id, w.t, w.col, round(cut.cutoff, 6) AS cutoff,
       CAST(w.v > cut.cutoff AS INTEGER) AS v_bin
FROM wu w LEFT JOIN cut USING (stream_id, col)"""

_Q = """c2c AS (SELECT * FROM wu WHERE col < 2),
st AS (SELECT stream_id, col, min(v) AS mn, max(v) AS mx, stddev_pop(v) AS sd,
              quantile_cont(v, 0.05) AS q05, quantile_cont(v, 0.95) AS q95 FROM c2c GROUP BY stream_id, col),
cand AS (SELECT c.*, row_number() OVER (PARTITION BY c.stream_id, c.col ORDER BY {hh}, c.t) AS rr
         FROM c2c c JOIN st USING (stream_id, col) WHERE c.v > st.q05 AND c.v < st.q95)"""

ORACLES["p09_quantile_cutoffs"] = PRE + ", " + _Q.format(hh=h(13, 'c.stream_id', 'c.col', 'c.t')) + """,
cut AS (SELECT stream_id, col, first(v ORDER BY rr) AS cutoff FROM cand GROUP BY stream_id, col)
SELECT w.stream_id, w.t, w.col, round(cut.cutoff, 6) AS cutoff, CAST(w.v >= cut.cutoff AS INTEGER) AS v_bin
FROM c2c w LEFT JOIN cut USING (stream_id, col)"""

ORACLES["p09_quantile_digitise"] = PRE + ", " + _Q.format(hh=h(13, 'c.stream_id', 'c.col', 'c.t')) + """,
dv AS (SELECT stream_id, col, v, min(rr) AS mr FROM cand GROUP BY stream_id, col, v),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, col ORDER BY mr) AS k FROM dv)
        WHERE k <= 3)
SELECT w.stream_id, w.t, w.col,
  CAST(CASE WHEN st.mn - 0.1 * st.sd <= w.v THEN 1 ELSE 0 END
     + CASE WHEN st.mx + 0.1 * st.sd <= w.v THEN 1 ELSE 0 END
     + (SELECT count(*) FROM top WHERE top.stream_id = w.stream_id AND top.col = w.col AND top.v <= w.v)
     AS INTEGER) AS v_bin
FROM c2c w JOIN st USING (stream_id, col)"""

ORACLES["p10_p11_design_row"] = PRE + """
SELECT stream_id, t, 6 AS width, 1.0::DOUBLE AS x0, round(coalesce(c0, 0), 6) AS x1,
       round(coalesce(c1, 0), 6) AS x2, round(coalesce(c2, 0), 6) AS x3,
       round(coalesce(c3, 0), 6) AS x4, round(coalesce(c4, 0), 6) AS x5 FROM f2m"""

ORACLES["p12_p16_split"] = PRE + """,
n AS (SELECT stream_id, count(*) AS n_rows FROM f1 GROUP BY stream_id)
SELECT f1.stream_id, f1.t, CASE WHEN f1.t < floor(n.n_rows * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS part
FROM f1 JOIN n USING (stream_id) WHERE f1.t < n.n_rows - 5 AND f1.t >= 5"""

ORACLES["p13_p17_observed_threshold"] = PRE + f"""
SELECT stream_id, t,
  (CASE WHEN c0 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN c1 IS NULL THEN 0 ELSE 1 END)
  + (CASE WHEN c2 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN c3 IS NULL THEN 0 ELSE 1 END)
  + (CASE WHEN c4 IS NULL THEN 0 ELSE 1 END) AS n_observed,
  CASE WHEN {phi_sql('(c2 * 10 - 0.4)')} > 0.5 THEN 1 ELSE 0 END AS pred_05,
  CASE WHEN {phi_sql('(c2 * 10 - 0.4)')} > 0.3 THEN 1 ELSE 0 END AS pred_03
FROM f2m"""

ORACLES["f01_f02_normal"] = PRE + f"""
SELECT stream_id, t, round({phi_sql('((x0 - 0.5) * 6)')}, 6) AS cdf,
       round({phi_inv_sql('x2')}, 6) AS quantile,
       round({phi_inv_sql('p1')}, 6) AS roundtrip
FROM (SELECT *, {phi_sql('((x1 - 0.5) * 4)')} AS p1 FROM f1)"""

ORACLES["k01_pair_mask"] = PRE + """
SELECT stream_id, t, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2,
       round(c3, 6) AS c3, round(c4, 6) AS c4 FROM f2m"""

ORACLES["k02_mask_cells"] = PRE + f""",
cu AS (SELECT * FROM wu WHERE v IS NOT NULL),
seeds AS (SELECT range AS s FROM range(100, 151)),
kk AS (SELECT stream_id, floor(count(*) * 0.2::DOUBLE) AS k FROM cu GROUP BY stream_id),
m AS (SELECT c.stream_id, c.t, c.col, s.s AS seed,
             row_number() OVER (PARTITION BY c.stream_id, s.s ORDER BY {h('s.s', 'c.stream_id', 'c.t', 'c.col')}, c.t, c.col) AS rk
      FROM cu c CROSS JOIN seeds s),
mm AS (SELECT m.*, m.rk <= kk.k AS masked FROM m JOIN kk USING (stream_id)),
bad AS (SELECT DISTINCT stream_id, seed FROM (SELECT stream_id, seed, t, bool_and(masked) AS a
        FROM mm GROUP BY stream_id, seed, t) WHERE a),
pick AS (SELECT stream_id, min(seed) AS seed FROM (SELECT DISTINCT stream_id, seed FROM mm) x
         WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.stream_id = x.stream_id AND b.seed = x.seed)
         GROUP BY stream_id)
SELECT mm.stream_id, mm.t, mm.col, mm.masked, mm.seed FROM mm JOIN pick USING (stream_id, seed)"""

ORACLES["k03_mask_per_row"] = PRE + f""",
d AS (SELECT *, {h(5, 'stream_id', 't', 0)} % 5 AS d0, {h(5, 'stream_id', 't', 1)} % 5 AS d1 FROM f2)
SELECT stream_id, t,
  round(CASE WHEN 0 IN (d0, d1) THEN NULL ELSE c0 END, 6) AS c0,
  round(CASE WHEN 1 IN (d0, d1) THEN NULL ELSE c1 END, 6) AS c1,
  round(CASE WHEN 2 IN (d0, d1) THEN NULL ELSE c2 END, 6) AS c2,
  round(CASE WHEN 3 IN (d0, d1) THEN NULL ELSE c3 END, 6) AS c3,
  round(CASE WHEN 4 IN (d0, d1) THEN NULL ELSE c4 END, 6) AS c4 FROM d"""

ORACLES["k04_trapezoid"] = PRE + """,
v AS (SELECT f2.*, CAST(least(5, (floor(f2.t / ceil(n.n_rows / 5)) + 1) * 1) AS INTEGER) AS n_visible
      FROM f2 JOIN nrows n USING (stream_id)),
p AS (SELECT stream_id, t, n_visible,
        CASE WHEN 0 < n_visible THEN c0 END AS p0, CASE WHEN 1 < n_visible THEN c1 END AS p1,
        CASE WHEN 2 < n_visible THEN c2 END AS p2, CASE WHEN 3 < n_visible THEN c3 END AS p3,
        CASE WHEN 4 < n_visible THEN c4 END AS p4 FROM v)
SELECT stream_id, t, n_visible, n_visible AS jag_len, round(p0, 6) AS pad0, round(p1, 6) AS pad1,
       round(p2, 6) AS pad2, round(p3, 6) AS pad3, round(p4, 6) AS pad4,
       round(0.0::DOUBLE + coalesce(p0, 0) + coalesce(p1, 0) + coalesce(p2, 0) + coalesce(p3, 0)
             + coalesce(p4, 0), 6) AS zero_sum FROM p"""

ORACLES["k05_missing_labels"] = PRE + f"""
SELECT stream_id, t, y, CASE WHEN {u(2000, 'stream_id', 't')} > 0.3 THEN y END AS y_obs FROM f1"""

ORACLES["k06_delayed_labels"] = PRE + """
SELECT stream_id, t, lag(y, 7) OVER (PARTITION BY stream_id ORDER BY t) AS y_delayed FROM f1"""

ORACLES["k07_delayed_missing"] = PRE + f"""
SELECT a.stream_id, a.t, CASE WHEN {u(2000, 'b.stream_id', 'b.t')} > 0.3 THEN b.y END AS y_delayed
FROM f1 a LEFT JOIN f1 b ON b.stream_id = a.stream_id AND b.t = a.t - 7"""

ORACLES["k08_shuffle_rows"] = PRE + f"""
SELECT stream_id, t, row_number() OVER (PARTITION BY stream_id ORDER BY {h(42, 'stream_id', 't')}, t) - 1 AS t_new
FROM f1"""

ORACLES["k09_interleave_classes"] = PRE + """,
r AS (SELECT stream_id, t, y, row_number() OVER (PARTITION BY stream_id, y ORDER BY t) - 1 AS rk FROM f1),
n1 AS (SELECT stream_id, count(*) AS n1 FROM f1 WHERE y = 1 GROUP BY stream_id),
p AS (SELECT r.*, CASE WHEN y = 1 THEN rk + floor((rk + 2) / 3)
                       WHEN rk < ceil(coalesce(n1, 0) / 3) THEN 4 * rk + 1
                       ELSE coalesce(n1, 0) + rk END AS pos
      FROM r LEFT JOIN n1 USING (stream_id))
SELECT stream_id, t, y, row_number() OVER (PARTITION BY stream_id ORDER BY pos) - 1 AS t_new FROM p"""

ORACLES["a11_col_stats"] = PRE + """
SELECT stream_id, col, count(v) AS n_obs, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd,
       round(min(v), 6) AS min, round(max(v), 6) AS max FROM mc GROUP BY stream_id, col"""

ORACLES["a12_ord_gap"] = PRE + """
SELECT stream_id, col, round(min(g) / 2.0, 6) AS gap FROM (
  SELECT stream_id, col, v - lag(v) OVER (PARTITION BY stream_id, col ORDER BY v) AS g
  FROM (SELECT DISTINCT stream_id, col, v FROM mc WHERE col >= 2)) GROUP BY stream_id, col"""

_ECDF = """e AS (SELECT *, count(*) OVER (PARTITION BY stream_id, col ORDER BY v
                  RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_le,
             rank() OVER (PARTITION BY stream_id, col ORDER BY v) - 1 AS n_below,
             count(*) OVER (PARTITION BY stream_id, col) AS n FROM mc WHERE {cond})"""

ORACLES["w04_cont_latent"] = PRE + ", " + _ECDF.format(cond="col < 2") + f"""
SELECT e.stream_id, e.t, e.col,
  round({phi_inv_sql('(CAST(n_rows AS DOUBLE) / (n_rows + 1)) * (n_le / CAST(n AS DOUBLE))')}, 6) AS z
FROM e JOIN nrows USING (stream_id)"""

ORACLES["w05_ord_interval"] = PRE + ", " + _ECDF.format(cond="col >= 2") + f"""
SELECT stream_id, t, col, round({phi_inv_sql('(n_below / CAST(n AS DOUBLE))')}, 6) AS lo,
       round({phi_inv_sql('(n_le / CAST(n AS DOUBLE))')}, 6) AS hi FROM e"""

_WK = """k AS (SELECT *, row_number() OVER (PARTITION BY stream_id, col ORDER BY t) - 1 AS kk FROM mc WHERE {cond}),
pw AS (SELECT a.stream_id, a.t, a.col, a.v, count(*) AS l,
              sum(CASE WHEN b.v <= a.v THEN 1 ELSE 0 END) AS n_le,
              sum(CASE WHEN b.v < a.v THEN 1 ELSE 0 END) AS n_lt,
              count(DISTINCT b.v) AS nd
       FROM k a JOIN k b ON b.stream_id = a.stream_id AND b.col = a.col
                        AND b.kk BETWEEN a.kk - {w1} AND a.kk
       GROUP BY a.stream_id, a.t, a.col, a.v)"""

ORACLES["w10_window_values"] = PRE + f"""
SELECT stream_id, t, col,
  count(*) OVER w AS win_n, round(sum(v) OVER w, 6) AS win_sum,
  round(min(v) OVER w, 6) AS win_min, round(max(v) OVER w, 6) AS win_max
FROM mc WINDOW w AS (PARTITION BY stream_id, col ORDER BY t ROWS BETWEEN {m1.WIN - 1} PRECEDING AND CURRENT ROW)"""



def _w06(w: int) -> str:
    return PRE + ", " + _WK.format(cond="col < 2", w1=w - 1) + f""",
q AS (SELECT *, (CAST(l AS DOUBLE) / (l + 1)) * (n_le / CAST(l AS DOUBLE)) AS q0 FROM pw)
SELECT stream_id, t, col,
  round({phi_inv_sql('(CASE WHEN q0 = 0 THEN CAST(l AS DOUBLE) / (l + 1) / 2 ELSE q0 END)')}, 6) AS z FROM q"""


def _w07(w: int) -> str:
    return PRE + ", " + _WK.format(cond="col >= 2", w1=w - 1) + f"""
SELECT stream_id, t, col,
  round(CASE WHEN nd > 1 THEN {phi_inv_sql('(n_lt / CAST(l AS DOUBLE))')} ELSE CAST('-Infinity' AS DOUBLE) END, 6) AS lo,
  round(CASE WHEN nd > 1 THEN {phi_inv_sql('(n_le / CAST(l AS DOUBLE))')} ELSE CAST('Infinity' AS DOUBLE) END, 6) AS hi
FROM pw"""


ORACLES["w06_window_cont_latent"], ORACLES["w06_long_window"] = _w06(m1.WIN), _w06(m1.LONG_WIN)
ORACLES["w07_window_ord_interval"], ORACLES["w07_long_window"] = _w07(m1.WIN), _w07(m1.LONG_WIN)

_MQ = f"""mq AS (SELECT *, {u(31, 'stream_id', 't', 'col')} AS q FROM wc WHERE v IS NULL)"""

ORACLES["a14_quantile_lookup"] = PRE + ", " + _MQ + ", " + POS.format(src="mc WHERE col < 2") + """
SELECT stream_id, t, col, round(x_imp, 6) AS x_imp FROM (""" + _lerp_quantile(
    "pos_c", "stream_id, col", "(SELECT * FROM mq WHERE col < 2)", "q", "x_imp") + ")"

_INV = """
SELECT x.stream_id, x.t, x.col, round(p.v, 6) AS x_imp FROM
  (SELECT m.*, least(greatest(ceil(round_even((n._n + 1) * m.q - 1, 3)), 0), n._n - 1) AS _i
   FROM (SELECT * FROM mq WHERE col >= 2) m
   JOIN (SELECT stream_id, col, count(*) AS _n FROM pos_c GROUP BY stream_id, col) n USING (stream_id, col)) x
LEFT JOIN pos_c p ON p.stream_id = x.stream_id AND p.col = x.col AND p.pos = x._i"""

ORACLES["a13_inverse_ecdf"] = PRE + ", " + _MQ + ", " + POS.format(src="mc WHERE col >= 2") + _INV

IMP_SELECT = ("""
SELECT stream_id, t, col, v AS x_imp FROM mc UNION ALL
SELECT stream_id, t, col, x_imp FROM (""" + _lerp_quantile(
    "pos_c", "stream_id, col", "(SELECT * FROM mq WHERE col < 2)", "q", "x_imp") + ") UNION ALL "
    + _INV.replace("round(p.v, 6) AS x_imp", "p.v AS x_imp"))
IMP_CTES = ", " + _MQ + ", " + POS.format(src="mc")

ORACLES["w08_impute_missing"] = (PRE + IMP_CTES + f"""
SELECT stream_id, t, col, round(x_imp, 6) AS x_imp FROM ({IMP_SELECT})""")
