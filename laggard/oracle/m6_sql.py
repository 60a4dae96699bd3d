"""DuckDB oracles for the M6 queries (``laggard.plans.m6``)."""

from __future__ import annotations

from laggard.operators.learner import FtrlParams
from laggard.oracle.m1_sql import PRE, u
from laggard.oracle.m2_sql import SCORE
from laggard.oracle.m3_sql import R, _Z
from laggard.oracle.sql import ftrl_recursive_sql, minibatch_recursive_sql, sigmoid_sql
from laggard.plans import m2, m6

D = 5
ORACLES: dict[str, str] = {}

ORACLES["s01_s02_text_roundtrip"] = PRE + """
SELECT stream_id, t, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3,
       round(c4, 6) AS c4, y FROM f2"""

ORACLES["s03_s04_jagged_roundtrip"] = PRE + """,
v AS (SELECT f2.*, CAST(least(5, floor(f2.t / ceil(n.n_rows / 5)) + 1) AS INTEGER) AS nv
      FROM f2 JOIN nrows n USING (stream_id))
SELECT stream_id, t, nv AS jag_len,
  round(0.0::DOUBLE + c0 + CASE WHEN nv > 1 THEN c1 ELSE 0 END + CASE WHEN nv > 2 THEN c2 ELSE 0 END
        + CASE WHEN nv > 3 THEN c3 ELSE 0 END + CASE WHEN nv > 4 THEN c4 ELSE 0 END, 6) AS jag_sum,
  round(c0, 6) AS p0, round(CASE WHEN nv > 1 THEN c1 ELSE 0 END, 6) AS p1, round(CASE WHEN nv > 2 THEN c2 ELSE 0 END, 6) AS p2,
  round(CASE WHEN nv > 3 THEN c3 ELSE 0 END, 6) AS p3, round(CASE WHEN nv > 4 THEN c4 ELSE 0 END, 6) AS p4, true AS same FROM v"""

ORACLES["s05_s07_s08_reports"] = SCORE + f"""
SELECT stream_id, method, n, round(cer, 6) AS cer, round(baseline, 6) AS baseline, round(dpaa, 6) AS dpaa,
       round(max_drop, 6) AS max_drop, CAST(recovery AS BIGINT) AS recovery, 'events' AS dataset,
       {m2.DRIFT_START} AS drift_start, {m2.SC_DELAY} AS delay, {m2.SC_WIN} AS "window" FROM card"""

RIN = """r_in AS (SELECT stream_id, t, CAST(1 AS DOUBLE) AS x0, x0 AS x1, x1 AS x2, x2 AS x3, y FROM f1)"""

ORACLES["st07_live_replay"] = R + f", {RIN}, " + ftrl_recursive_sql(
    "r_in", 4, FtrlParams(), D, name="sd") + """
SELECT stream_id, t, round(prob, 6) AS prob FROM sd WHERE t >= 0"""

ORACLES["st07_live_dropped_labels"] = PRE + f""",
a AS (SELECT stream_id, t, t + 1 + CAST(floor({u(m6.SLOW_SEED, 'stream_id', 't')} * {m6.SLOWEST}) AS BIGINT) AS t_arrive,
             max(t) OVER (PARTITION BY stream_id) AS last FROM f1)
SELECT stream_id, t, t_arrive FROM a WHERE t_arrive <= last AND t_arrive - 1 - t > {D}"""

ORACLES["st21_minibatch_ftrl"] = R + f", {RIN}, " + minibatch_recursive_sql("r_in", 4, FtrlParams(), m6.MINIBATCH) + """
SELECT stream_id, q.t AS t, CAST(b AS INTEGER) AS batch, round(p, 6) AS prob
FROM (SELECT stream_id, b, unnest(rs) AS q, unnest(ps) AS p FROM mb WHERE b >= 0)"""

ORACLES["st03_delay_compensation"] = R + f", {RIN}, rw AS (SELECT *, 1.5 AS w FROM r_in), " + ftrl_recursive_sql(
    "rw", 4, FtrlParams(), D, name="sd", weight_col="w") + """
SELECT stream_id, t, round(prob, 6) AS prob FROM sd WHERE t >= 0"""

_LAB = f"""lab AS (SELECT a.stream_id, a.t, CASE WHEN {u(2000, 'a.stream_id', 'a.t')} > 0.3 THEN a.y END AS y_obs,
                b.y AS pseudo FROM f1 a LEFT JOIN f1 b ON b.stream_id = a.stream_id AND b.t = a.t - {D}),
labf AS (SELECT *, CAST(coalesce(y_obs, pseudo) AS DOUBLE) AS y_fill FROM lab),
rx AS (SELECT r.*, l.y_obs, l.y_fill FROM r_in r JOIN labf l USING (stream_id, t)),
rz AS (SELECT r.*, l.y_obs, l.y_fill FROM r_z r JOIN labf l USING (stream_id, t))"""


def ensemble_sql(head: str, p: int, label: str, delay: int | None) -> str:
    """The hedge ensemble over the relations rx and rz of ``head`` (stream_id, t, x0..x{p-1}, labels)."""
    sx = ftrl_recursive_sql("rx", p, FtrlParams(), delay, label_col=label, name="sx")
    sz = ftrl_recursive_sql("rz", p, FtrlParams(), delay, label_col=label, name="sz")
    if delay is None:
        gap = ("coalesce(sum(coalesce(lz, 0)) OVER w, 0) - coalesce(sum(coalesce(lx, 0)) OVER w, 0)",
               "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
        mx, mz = "CASE WHEN a.did_fit THEN a.fm ELSE a.pm END", "CASE WHEN b.did_fit THEN b.fm ELSE b.pm END"
    else:
        gap = ("sum(coalesce(lz, 0)) OVER w - sum(coalesce(lx, 0)) OVER w",
               "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
        mx, mz = "a.pm", "b.pm"
    return (f"{head}, {sx}, {sz}" + f""",
j AS (SELECT a.stream_id, a.t, {mx} AS mx, {mz} AS mz, a.floss AS lx, b.floss AS lz
      FROM sx a JOIN sz b ON a.stream_id = b.stream_id AND a.t = b.t WHERE a.t >= 0),
c AS (SELECT *, {gap[0]} AS gap FROM j WINDOW w AS (PARTITION BY stream_id ORDER BY t {gap[1]})),
l AS (SELECT *, 1.0 / (1.0 + exp(-0.001 * gap)) AS lam FROM c),
pp AS (SELECT *, {sigmoid_sql('(lam * mx + (1 - lam) * mz)')} AS prob FROM l)
SELECT stream_id, t, round(lam, 6) AS lam, round(prob, 6) AS prob,
       CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred FROM pp""")


def _ens(label: str, delay: int | None) -> str:
    return ensemble_sql(R + f", {RIN}, {_Z}, {_LAB}", 4, label, delay)


ORACLES["st08_delayed_ensemble"] = _ens("y", D)
ORACLES["st10_hidden_ensemble"] = _ens("y_obs", None)
ORACLES["st12_filled_ensemble"] = _ens("y_fill", None)
