"""DuckDB oracles for the M5 queries (``laggard.plans.m5``)."""

from __future__ import annotations

import math

from laggard.oracle.m1_sql import PRE, u
from laggard.oracle.sql import sigmoid_sql
from laggard.plans import m5

SZ, HP, PCT, DL = m5.SIZE, m5.HOP, m5.PCT, m5.DELAY


def _graph(time_decay: float | None, x: str = "embedding") -> str:
    dist = "list_distance(a.x, b.x)"
    if time_decay is not None:
        dist = (f"{dist} * exp(({time_decay!r} / CAST(a.n AS DOUBLE)) * abs(a.idx - b.idx))")
    return f"""WITH RECURSIVE
pts AS (SELECT vec_id % 10 AS stream_id, vec_id AS t, CAST({x} AS DOUBLE[]) AS x,
               CASE WHEN label < 5 THEN 1 ELSE 0 END AS y,
               row_number() OVER (PARTITION BY vec_id % 10 ORDER BY vec_id) - 1 AS pos FROM embeddings),
pl AS (SELECT *, CASE WHEN {u(77, 'stream_id', 't')} > 0.6 THEN y END AS y_obs FROM pts),
ends AS (SELECT stream_id, pos AS win FROM pts p WHERE (pos + 1) % {HP} = 0
         OR pos = (SELECT max(pos) FROM pts l WHERE l.stream_id = p.stream_id)),
wm0 AS (SELECT e.win, p.* REPLACE (CASE WHEN p.pos <= e.win - {DL} THEN y_obs END AS y_obs) FROM pl p JOIN ends e ON e.stream_id = p.stream_id
        AND p.pos BETWEEN e.win - {SZ - 1} AND e.win),
wm AS (SELECT *, row_number() OVER (PARTITION BY stream_id, win ORDER BY t) - 1 AS idx,
              count(*) OVER (PARTITION BY stream_id, win) AS n FROM wm0),
pr AS (SELECT a.stream_id, a.win, a.t AS ti, b.t AS tj, {dist} AS d
       FROM wm a JOIN wm b ON a.stream_id = b.stream_id AND a.win = b.win AND a.t <> b.t),
up AS (SELECT *, row_number() OVER (PARTITION BY stream_id, win ORDER BY d) - 1 AS rk,
              count(*) OVER (PARTITION BY stream_id, win) AS np FROM pr WHERE ti < tj),
dc0 AS (SELECT stream_id, win,
          max(CASE WHEN rk = least(greatest(CAST(round_even(np * {PCT!r} / 100, 0) AS BIGINT), 0), np - 1)
              THEN d END) AS dc0,
          min(CASE WHEN d > 0 THEN d END) AS minpos, max(d) AS maxd FROM up GROUP BY stream_id, win),
dc AS (SELECT stream_id, win, maxd, CASE WHEN dc0 = 0 THEN coalesce(minpos, 1.0) ELSE dc0 END AS dc FROM dc0),
rho AS (SELECT pr.stream_id, pr.win, pr.ti AS t, sum(exp(-pow(pr.d / dc.dc, 2))) AS rho
        FROM pr JOIN dc USING (stream_id, win) GROUP BY pr.stream_id, pr.win, pr.ti),
ordr AS (SELECT *, row_number() OVER (PARTITION BY stream_id, win ORDER BY rho DESC, t) AS rnk FROM rho),
par AS (SELECT a.stream_id, a.win, a.t, first(b.t ORDER BY p.d, b.t) AS parent_t,
               min(p.d) AS delta
        FROM ordr a JOIN ordr b ON a.stream_id = b.stream_id AND a.win = b.win AND b.rnk < a.rnk
        JOIN pr p ON p.stream_id = a.stream_id AND p.win = a.win AND p.ti = a.t AND p.tj = b.t
        GROUP BY a.stream_id, a.win, a.t),
g AS (SELECT o.stream_id, o.win, o.t, o.rho, coalesce(par.parent_t, o.t) AS parent_t,
             coalesce(par.delta, dc.maxd) AS delta, dc.dc, par.parent_t IS NULL AS is_root
      FROM ordr o LEFT JOIN par USING (stream_id, win, t) JOIN dc USING (stream_id, win))"""


GRAPH_OUT = """
SELECT stream_id, win, t, round(rho, 6) AS rho, parent_t, round(delta, 6) AS delta, round(dc, 6) AS dc,
       is_root FROM g"""

ORACLES: dict[str, str] = {}
ORACLES["b04_density_peaks"] = _graph(None) + GRAPH_OUT
ORACLES["b05_time_weighted_peaks"] = _graph(1.0) + GRAPH_OUT



def _one_window(time_decay: float | None) -> str:
    """The graph over all points as one window."""
    q = _graph(time_decay).replace("vec_id % 10", "vec_id % 1").replace(f"AND p.pos BETWEEN e.win - {SZ - 1} AND e.win", "")
    a, b = q.index("ends AS ("), q.index("wm0 AS (")
    return q[:a] + "ends AS (SELECT DISTINCT stream_id, CAST(0 AS BIGINT) AS win FROM pts),\n" + q[b:]


ORACLES["b04_long_window"] = _one_window(None) + GRAPH_OUT
ORACLES["b05_long_window"] = _one_window(1.0) + GRAPH_OUT

_ROUNDS = """,
lab AS (SELECT stream_id, win, t FROM wm WHERE y_obs IS NOT NULL),
fw AS (SELECT stream_id, win, t AS node, 0 AS depth FROM lab
       UNION ALL
       SELECT f.stream_id, f.win, g.parent_t, f.depth + 1 FROM fw f
       JOIN g ON g.stream_id = f.stream_id AND g.win = f.win AND g.t = f.node WHERE g.parent_t <> f.node),
fr AS (SELECT stream_id, win, node, min(depth) AS r FROM fw GROUP BY stream_id, win, node),
rf AS (SELECT stream_id, win, max(r) AS rmax FROM fr GROUP BY stream_id, win),
cl AS (SELECT g.stream_id, g.win, g.t AS start, g.parent_t AS node, 1 AS k FROM g
       WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.stream_id = g.stream_id AND fr.win = g.win AND fr.node = g.t)
       UNION ALL
       SELECT c.stream_id, c.win, c.start, g.parent_t, c.k + 1 FROM cl c
       JOIN g ON g.stream_id = c.stream_id AND g.win = c.win AND g.t = c.node
       WHERE g.parent_t <> c.node AND NOT EXISTS
         (SELECT 1 FROM fr WHERE fr.stream_id = c.stream_id AND fr.win = c.win AND fr.node = c.node)),
bk AS (SELECT c.stream_id, c.win, c.start AS t, min(c.k) AS k FROM cl c
       JOIN fr ON fr.stream_id = c.stream_id AND fr.win = c.win AND fr.node = c.node
       GROUP BY c.stream_id, c.win, c.start)
SELECT g.stream_id, g.win, g.t, g.parent_t,
       CAST(CASE WHEN fr.r IS NOT NULL THEN fr.r WHEN bk.k IS NOT NULL THEN rf.rmax + bk.k ELSE -1 END AS INTEGER)
       AS round
FROM g LEFT JOIN fr ON fr.stream_id = g.stream_id AND fr.win = g.win AND fr.node = g.t
LEFT JOIN bk ON bk.stream_id = g.stream_id AND bk.win = g.win AND bk.t = g.t
LEFT JOIN rf ON rf.stream_id = g.stream_id AND rf.win = g.win"""
ORACLES["b06_propagation_rounds"] = _graph(None) + _ROUNDS
ORACLES["b06_long_window"] = _one_window(None).replace("> 0.6 THEN y END", f"> {m5.LONG_MISSING} THEN y END") \
    .replace(f"CASE WHEN p.pos <= e.win - {DL} THEN y_obs END AS y_obs", "y_obs AS y_obs") + _ROUNDS
_a, _b = _ROUNDS.rsplit("SELECT g.stream_id", 1)
# per window and round the rows known so far, with their labels; a row of the next round is voted on by its three nearest of them
_VOTE = """list_transform([list_transform(list_slice(list_sort(list_filter(x.dl, lambda e: list_contains(ts, e.t))), 1, 3), lambda e: {{'d': e.d, 'l': map_extract(lm, e.t)[1]}})], lambda nn:
  CASE WHEN list_contains(list_transform(nn, lambda e: e.d = 0), true)
    THEN list_sum(list_transform(nn, lambda e: CASE WHEN e.d = 0 THEN e.l ELSE 0.0 END)) / list_sum(list_transform(nn, lambda e: CASE WHEN e.d = 0 THEN 1.0 ELSE 0.0 END))
    ELSE list_sum(list_transform(nn, lambda e: e.l / e.d)) / list_sum(list_transform(nn, lambda e: 1.0 / e.d)) END)[1]""".replace("{{", "{").replace("}}", "}")
ORACLES["b07_ssc_knn"] = _graph(None) + _a + ", rs AS (SELECT g.stream_id" + _b + f"""),
dl AS (SELECT stream_id, win, ti AS t, list({{'d': d, 't': tj}}) AS dl FROM pr GROUP BY stream_id, win, ti),
rr AS (SELECT stream_id, win, round, list({{'t': t, 'dl': dl}} ORDER BY t) AS xs FROM rs JOIN dl USING (stream_id, win, t) GROUP BY stream_id, win, round),
kn AS (SELECT stream_id, win, 0 AS r, list(t ORDER BY t) AS ts, list(CAST(y_obs AS DOUBLE) ORDER BY t) AS ls, list(CAST(y_obs AS DOUBLE) ORDER BY t) AS ps
       FROM wm WHERE y_obs IS NOT NULL GROUP BY stream_id, win
  UNION ALL SELECT stream_id, win, r, ts || list_transform(xs, lambda x: x.t), ls || list_transform(vs, lambda p: CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END), ps || vs
  FROM (SELECT *, list_transform(xs, lambda x: {_VOTE}) AS vs
        FROM (SELECT k.stream_id, k.win, k.r + 1 AS r, ts, ls, ps, map(ts, ls) AS lm, xs FROM kn k JOIN rr ON rr.stream_id = k.stream_id AND rr.win = k.win AND rr.round = k.r + 1))),
la AS (SELECT stream_id, win, arg_max(ts, r) AS ts, arg_max(ls, r) AS ls, arg_max(ps, r) AS ps FROM kn GROUP BY stream_id, win),
un AS (SELECT l.stream_id, l.win, unnest(ts) AS t, unnest(ls) AS lab, unnest(ps) AS p FROM la l),
fi AS (SELECT stream_id, win, t, {_VOTE} AS p FROM (SELECT rs.stream_id, rs.win, rs.t, {{'t': rs.t, 'dl': dl}} AS x, ts, map(ts, ls) AS lm
       FROM rs JOIN dl USING (stream_id, win, t) JOIN la USING (stream_id, win) WHERE rs.round < 0))
SELECT rs.stream_id, rs.win, rs.t, rs.round, un.lab AS pseudo, round(un.p, 6) AS p1,
  CASE WHEN rs.round >= 0 THEN un.lab WHEN fi.p > 0.5 THEN 1.0 WHEN fi.p IS NOT NULL THEN 0.0 END::DOUBLE AS final, round(coalesce(un.p, fi.p), 6) AS p_final
FROM rs LEFT JOIN un USING (stream_id, win, t) LEFT JOIN fi USING (stream_id, win, t)"""
ORACLES["u01_u02_all_rounds"] = _graph(None) + _a + ", rs AS (SELECT g.stream_id" + _b + """)
SELECT stream_id, win, round, n_frontier, CAST(sum(n_frontier) OVER (PARTITION BY stream_id, win ORDER BY round) AS BIGINT) AS n_union
FROM (SELECT stream_id, win, round, count(*) AS n_frontier FROM rs WHERE round >= 0 GROUP BY stream_id, win, round)"""

ORACLES["a26_t05_window_guard"] = _graph(None).split(",\npr AS")[0] + """
SELECT stream_id, win, count(*) AS n, count(DISTINCT y_obs) AS n_classes,
       count(DISTINCT y_obs) = 2 AND count(*) > 2 AS ok FROM wm GROUP BY stream_id, win"""

A = sigmoid_sql("((x0 - 0.5) * 8)")
B = sigmoid_sql("((x1 - 0.5) * 6)")
EPS = 1e-10
LN2 = repr(math.log(2))


def _ent(p: str) -> str:
    return f"(-((0.0 + (1 - {p}) * ln((1 - {p}) + {EPS!r})) + {p} * ln({p} + {EPS!r})))"


def _cent(p0: str, p1: str) -> str:
    c0 = f"least(greatest({p0}, {EPS!r}), 1.0)"
    c1 = f"least(greatest({p1}, {EPS!r}), 1.0)"
    return f"(-((0.0 + {c0} * ln({c0})) + {c1} * ln({c1})))"


VIEWS = PRE + f""",
v AS (SELECT stream_id, t, x0, x1, x2, y, {A} AS a, {B} AS b FROM f1),
va AS (SELECT *, CASE WHEN {u(2000, 'stream_id', 't')} > 0.3 AND t + {m5.LABEL_DELAY} <= max(t) OVER (PARTITION BY stream_id) THEN y END AS y_in FROM v),
vq AS (SELECT stream_id, coalesce(avg(CASE WHEN y_in IS NULL THEN NULL WHEN (CASE WHEN a > 1 - a THEN 1 ELSE 0 END) = y_in THEN 1.0 ELSE 0.0 END), 0.5) AS q1,
              coalesce(avg(CASE WHEN y_in IS NULL THEN NULL WHEN (CASE WHEN b > 1 - b THEN 1 ELSE 0 END) = y_in THEN 1.0 ELSE 0.0 END), 0.5) AS q2
       FROM va GROUP BY stream_id)"""

ORACLES["a19_view_quality"] = VIEWS + """
SELECT stream_id, round(q1, 6) AS q1, round(q2, 6) AS q2 FROM vq"""

ORACLES["f10_f19_fusion"] = VIEWS + f""",
w AS (SELECT v.*, vq.q1, vq.q2, greatest(a, 1 - a) AS c1, greatest(b, 1 - b) AS c2,
             {_ent('a')} AS h1, {_ent('b')} AS h2,
             exp(-{_cent('(1 - a)', 'a')} * 2.0) AS r1, exp(-{_cent('(1 - b)', 'b')} * 2.0) AS r2,
             exp(-{_cent('0.3', '0.7')} * 2.0) AS r3
      FROM v JOIN vq USING (stream_id)),
w2 AS (SELECT *, h1 + h2 AS ht, (1 - h1 / (h1 + h2)) AS ea, (1 - h2 / (h1 + h2)) AS eb,
              r1 / (r1 + r2) AS t1, r2 / (r1 + r2) AS t2, r1 / (r1 + r2 + r3) AS u1,
              r2 / (r1 + r2 + r3) AS u2, r3 / (r1 + r2 + r3) AS u3,
              CASE WHEN greatest(a, 1 - a) < 0.7 THEN 0.7 ELSE 0.3 END AS al,
              least(greatest(0.7 * exp(-x2 / 2.0) + 0.3 * least(greatest(b, 1 - b), 0.8), 0.2), 0.8) AS gf,
              least(greatest(0.5 * exp(-x2 / 2.0) + 0.5 * least(greatest(b, 1 - b), 0.8), 0.2), 0.8) AS gb
       FROM w),
w3 AS (SELECT *, ea + eb AS es,
         t1 * (1 - a) + t2 * (1 - b) AS f20, t1 * a + t2 * b AS f21,
         (u1 * (1 - a) + u2 * (1 - b)) + u3 * 0.3 AS f30, (u1 * a + u2 * b) + u3 * 0.7 AS f31,
         al * 0.3 + (1 - al) * (1 - a) AS k0, al * 0.7 + (1 - al) * a AS k1,
         gf * (1 - a) + (1 - gf) * (1 - b) AS g0, gf * a + (1 - gf) * b AS g1,
         gb * (1 - a) + (1 - gb) * (1 - b) AS b0, gb * a + (1 - gb) * b AS b1,
         CASE WHEN (a > 1 - a) = (b > 1 - b) THEN 0.2 ELSE -0.1 END AS bonus FROM w2),
w4 AS (SELECT *,
         least(greatest(0.6 * c1 / (c1 + c2) + 0.3 * (CASE WHEN ht > 0 AND es > 0 THEN ea / es ELSE 0.5 END) + 0.1 * (0.5 + bonus), 0.1), 0.9) AS w1,
         least(greatest(0.6 * c2 / (c1 + c2) + 0.3 * (CASE WHEN ht > 0 AND es > 0 THEN eb / es ELSE 0.5 END) + 0.1 * (0.5 - bonus), 0.1), 0.9) AS w2
       FROM w3)
SELECT stream_id, t,
  round(0.6 * a + 0.4 * b, 6) AS fixed,
  round(CASE WHEN c1 + c2 > 0 THEN c1 / (c1 + c2) ELSE 0.5 END * a
        + CASE WHEN c1 + c2 > 0 THEN c2 / (c1 + c2) ELSE 0.5 END * b, 6) AS confidence,
  round((w1 * a + w2 * b) / (w1 + w2), 6) AS weighted,
  round(CASE WHEN ht > 0 AND es > 0 THEN ea / es ELSE 0.5 END * a
        + CASE WHEN ht > 0 AND es > 0 THEN eb / es ELSE 0.5 END * b, 6) AS entropy,
  round(CASE WHEN (CASE WHEN a > 1 - a THEN 1 ELSE 0 END) = (CASE WHEN b > 1 - b THEN 1 ELSE 0 END)
             THEN 0.5 * a + 0.5 * b WHEN c1 > c2 THEN a ELSE b END, 6) AS agreement,
  round(CASE WHEN q1 + q2 > 0 THEN q1 / (q1 + q2) ELSE 0.5 END * a
        + CASE WHEN q1 + q2 > 0 THEN q2 / (q1 + q2) ELSE 0.5 END * b, 6) AS view_quality,
  round(f21 / ((0.0 + f20) + f21), 6) AS three2,
  round(f31 / ((0.0 + f30) + f31), 6) AS three3,
  round(k1 / ((0.0 + k0) + k1), 6) AS calibrated,
  round(g1 / ((0.0 + g0) + g1), 6) AS geo_fwd,
  round(b1 / ((0.0 + b0) + b1), 6) AS geo_bwd,
  round(least(1.0, 0.7 * c1 + 0.3 * (1.0 - h1 / {LN2})), 6) AS parent_quality,
  CASE WHEN b > 1 - b THEN 1 ELSE 0 END AS argmax2,
  round(x0 * exp((1.0 / 20) * abs(t - 5)), 6) AS time_dist
FROM w4"""

ORACLES["a17_class_soft_matrix"] = VIEWS + """,
ok AS (SELECT stream_id, y, sum(1 - a) AS s0, sum(a) AS s1 FROM v
       WHERE (CASE WHEN a > 1 - a THEN 1 ELSE 0 END) = y GROUP BY stream_id, y),
cls AS (SELECT DISTINCT stream_id, c.y FROM v, (SELECT 0 AS y UNION ALL SELECT 1) c),
m AS (SELECT cls.stream_id, cls.y, 0.5 + coalesce(ok.s0, 0.0) AS m0, 0.5 + coalesce(ok.s1, 0.0) AS m1
      FROM cls LEFT JOIN ok USING (stream_id, y))
SELECT stream_id, y AS class, round(m0 / (m0 + m1), 6) AS p0, round(m1 / (m0 + m1), 6) AS p1 FROM m"""

ORACLES["u05_list_groups"] = _graph(None).split(",\npr AS")[0] + """
SELECT stream_id, win, CAST((idx) // 4 AS INTEGER) AS chunk, count(*) AS size, min(t) AS first_t, max(t) AS last_t
FROM wm GROUP BY stream_id, win, idx // 4"""

ORACLES["u03_nodes_of_views"] = " UNION ".join(
    f"SELECT * FROM ({_graph(None, x)} SELECT stream_id, win, parent_t AS node FROM g) v{i}"
    for i, x in enumerate(("embedding[1:32]", "embedding[33:64]")))

_DIMS = range(1, 5)
_D = {k: " + ".join(f"pow(w.x[{i}] - c.a{k}_{i}, 2)" for i in _DIMS) for k in (0, 1)}
#: Per window the class centroids of the arrived labels, their probabilities, the sums of the rows
#: that are right, and the fold over a stream's windows.
ORACLES["st22_carried_class_matrix"] = _graph(None).split(",\npr AS")[0] + f""",
c AS (SELECT stream_id, win, count(DISTINCT y_obs) = 2 AND count(*) > 2 AS ok,
        {', '.join(f'avg(CASE WHEN y_obs = {k} THEN x[{i}] END) AS a{k}_{i}' for k in (0, 1) for i in _DIMS)}
      FROM wm GROUP BY stream_id, win),
q AS (SELECT w.stream_id, w.win, w.y_obs AS y, 1 / (1 + exp(-least(greatest(({_D[0]}) - ({_D[1]}), -35), 35))) AS p
      FROM wm w JOIN c USING (stream_id, win) WHERE c.ok AND w.y_obs IS NOT NULL),
s AS (SELECT stream_id, win, count(*) AS n_ok, {', '.join(f"coalesce(sum(CASE WHEN y = {k} THEN {'p' if j else '1 - p'} END), 0) AS s{k}{j}" for k in (0, 1) for j in (0, 1))}
      FROM q WHERE (p > 0.5) = (y = 1) GROUP BY stream_id, win),
o AS (SELECT c.stream_id, c.win, coalesce(n_ok, 0) AS n_ok, {', '.join(f'coalesce(s{k}{j}, 0) AS s{k}{j}' for k in (0, 1) for j in (0, 1))},
        row_number() OVER (PARTITION BY c.stream_id ORDER BY c.win) AS k FROM c LEFT JOIN s USING (stream_id, win)),
f AS (SELECT stream_id, CAST(NULL AS BIGINT) AS win, CAST(0 AS BIGINT) AS k, 0.5::DOUBLE AS m0, 0.5::DOUBLE AS m1, 0.5::DOUBLE AS m2, 0.5::DOUBLE AS m3
      FROM o WHERE k = 1
      UNION ALL
      SELECT o.stream_id, o.win, o.k,
        CASE WHEN n_ok > 0 THEN (m0 + s00) / (m0 + s00 + m1 + s01) ELSE m0 END, CASE WHEN n_ok > 0 THEN (m1 + s01) / (m0 + s00 + m1 + s01) ELSE m1 END,
        CASE WHEN n_ok > 0 THEN (m2 + s10) / (m2 + s10 + m3 + s11) ELSE m2 END, CASE WHEN n_ok > 0 THEN (m3 + s11) / (m2 + s10 + m3 + s11) ELSE m3 END
      FROM f JOIN o ON o.stream_id = f.stream_id AND o.k = f.k + 1)
SELECT stream_id, win, round(m0, 6) AS m0, round(m1, 6) AS m1, round(m2, 6) AS m2, round(m3, 6) AS m3 FROM f WHERE k > 0"""
