"""DuckDB SQL twins of the fixtures and of the sequential learners.

These texts are the *independent* side of the correctness gate: the Spark
operators are DataFrame code, the oracles are plain SQL (windows, joins and
``WITH RECURSIVE`` for the order-dependent folds) over the same parquet views.
"""

from __future__ import annotations

from laggard.functions.logistic import decay_sql
from laggard.operators.learner import FtrlParams

F1_SQL = """
SELECT user_id AS stream_id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
       ts, value / CAST(100 AS DOUBLE) AS x0, hour(ts) / CAST(24 AS DOUBLE) AS x1,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) / CAST(100 AS DOUBLE) AS x2,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS y
FROM events
"""

F2_SQL = """
SELECT l_suppkey AS stream_id,
       row_number() OVER (PARTITION BY l_suppkey
                          ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS t,
       CAST(l_extendedprice AS DOUBLE) AS c0, CAST(l_quantity AS DOUBLE) AS c1,
       CAST(l_discount AS DOUBLE) AS c2, CAST(l_tax AS DOUBLE) AS c3,
       CAST(l_linenumber AS DOUBLE) AS c4,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y
FROM lineitem
"""

F3_SQL = """
SELECT vec_id % 10 AS stream_id, vec_id AS t, CAST(embedding AS DOUBLE[]) AS x,
       CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, label
FROM embeddings
"""

F4_SQL = """
SELECT d.lang AS stream_id,
       row_number() OVER (PARTITION BY d.lang ORDER BY d.doc_id) - 1 AS t, d.doc_id,
       CAST(d.n_chars AS DOUBLE) AS x0,
       CAST(len(string_split_regex(trim(d.text), '\\s+')) AS DOUBLE) AS x1,
       length(regexp_replace(d.text, '[^0-9]', '', 'g')) / NULLIF(length(d.text), 0) AS x2,
       l.quality AS y
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

F5_SQL = """
SELECT stream_id, t, col, v FROM (
  SELECT stream_id, t, 0 AS col, c0 AS v FROM f2 UNION ALL
  SELECT stream_id, t, 1, c1 FROM f2 UNION ALL
  SELECT stream_id, t, 2, c2 FROM f2 UNION ALL
  SELECT stream_id, t, 3, c3 FROM f2 UNION ALL
  SELECT stream_id, t, 4, c4 FROM f2) WHERE v IS NOT NULL
"""


def sigmoid_sql(m: str) -> str:
    return f"(CASE WHEN {m} >= 0 THEN 1.0 / (1.0 + exp(-{m})) ELSE exp({m}) / (1.0 + exp({m})) END)"


def _w(i: int, prm: FtrlParams, z: str = "z", r: str = "r") -> str:
    zi = f"{z}{i}"
    return (f"(CASE WHEN abs({zi}) > {prm.l1!r} THEN -({zi} - {prm.l1!r} * sign({zi})) / "
            f"({prm.l2!r} + {prm.lp!r} * {r}) ELSE 0.0 END)")


def state_names(p: int) -> list[str]:
    return [f"{k}{i}" for k in "vhz" for i in range(p)] + ["r", "dec", "times", "fails", "tw", "fw", "pmin", "smin"]


def fit_sql(s1: str, p: int, prm: FtrlParams, soft: bool) -> tuple[str, dict[str, str]]:
    """(relation, new state by column) of one learner step over ``s1``: the state's columns and fx0.., fy, fw8 (the row's weight)."""
    c, xs = prm.contribute_error_rate, range(p)
    s2 = f"SELECT *, " + ", ".join(f"{_w(i, prm)} AS w{i}" for i in xs) + f" FROM ({s1})"
    s3 = f"SELECT *, ({' + '.join(f'w{i} * fx{i}' for i in xs)}) AS m FROM ({s2})"
    s4 = (f"SELECT *, {sigmoid_sql('m')} AS fp, times + 1 AS times1 FROM ({s3})")
    errx = ("CASE WHEN (CASE WHEN fy >= 0.5 THEN 1 ELSE 0 END) <> (CASE WHEN fp >= 0.5 THEN 1 ELSE 0 END) "
            "THEN 1 ELSE 0 END" if soft else "CASE WHEN abs(fy - fp) > 0.5 THEN 1 ELSE 0 END")
    dec1 = decay_sql('CAST(times1 AS DOUBLE)', prm.decay_choice) if prm.adaptive else "dec"
    s5 = (f"SELECT *, {errx} AS ferr, {dec1} AS dec1 FROM ({s4})")
    s6 = (f"SELECT *, fails + ferr AS fails1, CAST(fails + ferr AS DOUBLE) / times1 AS pi FROM ({s5})")
    s7 = (f"SELECT *, sqrt(pi * (1 - pi) / times1) AS si, "
          f"{'times1 > ' + str(prm.warmup) if prm.adaptive else 'false'} AS act FROM ({s6})")
    s8 = (f"SELECT *, pi + si AS ps, CASE WHEN act THEN dec1 * (1.0 - {c!r}) + {c!r} * pi ELSE dec1 END AS dec2 "
          f"FROM ({s7})")
    s9 = (f"SELECT *, CASE WHEN act AND ps < pmin + smin THEN pi ELSE pmin END AS pmin1, "
          f"CASE WHEN act AND ps < pmin + smin THEN si ELSE smin END AS smin1 FROM ({s8})")
    s10 = f"SELECT *, act AND NOT (ps < pmin1 + 2 * smin1) AS warn FROM ({s9})"
    s11 = (f"SELECT *, CASE WHEN warn THEN tw + 1 WHEN act THEN 0 ELSE tw END AS tw1, "
           f"CASE WHEN warn THEN fw + ferr WHEN act THEN 0 ELSE fw END AS fw1, "
           f"warn AND ps > pmin1 + 3 * smin1 AS drift FROM ({s10})")
    new = {
        **{f"v{i}": f"v{i} + (fw8 * (fp - fy)) * fx{i}" for i in xs},
        **{f"h{i}": f"dec2 * h{i} + w{i}" for i in xs},
        **{f"z{i}": f"(v{i} + (fw8 * (fp - fy)) * fx{i}) - {prm.lp!r} * (dec2 * h{i} + w{i})" for i in xs},
        "r": "1.0 + dec2 * r", "dec": "dec2",
        "times": ("CASE WHEN drift THEN tw1 ELSE times1 END" if prm.adaptive else "times"),
        "fails": ("CASE WHEN drift THEN fw1 ELSE fails1 END" if prm.adaptive else "fails"),
        "tw": "tw1", "fw": "fw1",
        "pmin": "CASE WHEN drift THEN CAST(1 AS DOUBLE) ELSE pmin1 END",
        "smin": "CASE WHEN drift THEN CAST(10 AS DOUBLE) ELSE smin1 END",
    }
    return s11, new


def ftrl_recursive_sql(rows: str, p: int, prm: FtrlParams, delay: int | None,
                       label_col: str = "y", name: str = "st", soft: bool = False,
                       weight_col: str | None = None) -> str:
    """Recursive CTE ``ftrl(stream_id, t, prob, ...)`` reproducing the learner fold.

    ``rows`` is a relation with ``stream_id, t (dense from 0), x0..x{p-1}, <label_col>``.
    ``delay`` = D: at step t fit the row t-D with its label (when present) and then
    predict row t (ST07).  ``delay`` = None: predict row t, then fit it with its own
    label (ST01/ST13); a NULL label means predict only (ST04).
    """
    xs = range(p)
    state_cols = state_names(p)
    fit_x = "d" if delay is not None else "c"
    join_fit = (f"LEFT JOIN {rows} d ON d.stream_id = st.stream_id AND d.t = st.t + 1 - {delay}"
                if delay is not None else "")
    wsql = f"CAST({fit_x}.{weight_col} AS DOUBLE)" if weight_col else "CAST(1 AS DOUBLE)"
    s1 = (f"SELECT st.*, c.t AS nt, " + ", ".join(f"c.x{i} AS cx{i}" for i in xs) + ", "
          + ", ".join(f"{fit_x}.x{i} AS fx{i}" for i in xs)
          + f", CAST({fit_x}.{label_col} AS DOUBLE) AS fy, {wsql} AS fw8 "
          f"FROM st JOIN {rows} c ON c.stream_id = st.stream_id AND c.t = st.t + 1 {join_fit}")
    s11, new = fit_sql(s1, p, prm, soft)
    upd = "fy IS NOT NULL"
    loss = ("(fy0 * greatest(m, 0) + fy * greatest(-m, 0) + ln(1 + exp(-abs(m))))".replace("fy0", "(1 - fy)")
            if soft else "(greatest(m, 0) - fy * m + ln(1 + exp(-abs(m))))")
    s12 = (f"SELECT stream_id, nt AS t, fp, m AS fm, {loss} AS floss, {upd} AS did_fit, "
           + ", ".join(f"cx{i}" for i in xs) + ", "
           + ", ".join(f"CASE WHEN {upd} THEN {new[k]} ELSE {k} END AS {k}" for k in state_cols)
           + f" FROM ({s11})")
    pred_w = " + ".join(f"{_w(i, prm)} * cx{i}" for i in xs)
    if delay is not None:
        prob = sigmoid_sql(f"({pred_w})")
        s13 = (f"SELECT stream_id, t, {prob} AS prob, ({pred_w}) AS pm, fm, floss, did_fit, "
               + ", ".join(state_cols) + f" FROM ({s12})")
    else:
        # predict-then-fit: the emitted probability is the one computed before the update
        s13 = (f"SELECT stream_id, t, CASE WHEN did_fit THEN fp ELSE "
               f"{sigmoid_sql('(' + pred_w + ')')} END AS prob, ({pred_w}) AS pm, fm, floss, did_fit, "
               + ", ".join(state_cols) + f" FROM ({s12})")
    z0 = "CAST(0 AS DOUBLE)"
    base = (f"SELECT stream_id, CAST(-1 AS BIGINT) AS t, CAST(NULL AS DOUBLE) AS prob, "
            f"CAST(NULL AS DOUBLE) AS pm, CAST(NULL AS DOUBLE) AS fm, CAST(NULL AS DOUBLE) AS floss, "
            f"false AS did_fit, "
            f"{', '.join(f'{z0} AS v{i}' for i in xs)}, {', '.join(f'{z0} AS h{i}' for i in xs)}, "
            f"{', '.join(f'{z0} AS z{i}' for i in xs)}, CAST(1 AS DOUBLE) AS r, "
            f"CAST({prm.init_decay!r} AS DOUBLE) AS dec, "
            f"0 AS times, 0 AS fails, 0 AS tw, 0 AS fw, CAST(1 AS DOUBLE) AS pmin, "
            f"CAST(10 AS DOUBLE) AS smin FROM {rows} GROUP BY stream_id")
    return f"{name} AS ({base} UNION ALL {s13})".replace("FROM st ", f"FROM {name} st ").replace(
        "JOIN st ", f"JOIN {name} st ")


def minibatch_recursive_sql(rows: str, p: int, prm: FtrlParams, batch_rows: int, name: str = "mb") -> str:
    """Recursive CTE of ST21: one step a batch t // batch_rows of ``rows`` (stream_id, t, x0..x{p-1}, y), from the batch's list of
    rows.  ``name`` has stream_id, b, rs (the rows) and ps (their probabilities by the weights before the batch)."""
    xs, c = range(p), prm.contribute_error_rate
    lists = (f"{name}_in AS (SELECT stream_id, t // {batch_rows} AS b, list({{'t': t, 'y': CAST(y AS DOUBLE), "
             + ", ".join(f"'x{i}': x{i}" for i in xs) + f"}} ORDER BY t) AS rs FROM {rows} GROUP BY stream_id, b)")
    margin = " + ".join(f"w{i} * q.x{i}" for i in xs)
    known = "list_filter(list_zip(ps, rs), lambda a: a[2].y IS NOT NULL)"
    s1 = (f"SELECT s.* EXCLUDE (rs, ps, b), i.b, i.rs, " + ", ".join(f"{_w(i, prm)} AS w{i}" for i in xs)
          + f" FROM {name} s JOIN {name}_in i ON i.stream_id = s.stream_id AND i.b = s.b + 1")
    s2 = f"SELECT *, list_transform(rs, lambda q: {sigmoid_sql(f'({margin})')}) AS ps FROM ({s1})"
    s3 = (f"SELECT *, len({known}) AS nn, len(list_filter({known}, lambda a: abs(a[1] - a[2].y) > 0.5)) AS ee, "
          + ", ".join(f"coalesce(list_sum(list_transform({known}, lambda a: (a[1] - a[2].y) * a[2].x{i})), 0.0) AS g{i}" for i in xs) + f" FROM ({s2})")
    s4 = (f"SELECT *, c0 + nn AS n1, c1 + ee AS e1, CAST(c1 + ee AS DOUBLE) / greatest(c0 + nn, 1) AS rate, "
          f"c0 + nn > {prm.warmup} AS act, {decay_sql('CAST(greatest(c0 + nn, 1) AS DOUBLE)', prm.decay_choice)} AS dec0 FROM ({s3})")
    s5 = (f"SELECT *, sqrt(rate * (1 - rate) / greatest(n1, 1)) AS spread, "
          f"CASE WHEN act THEN dec0 * (1.0 - {c!r}) + {c!r} * rate ELSE dec0 END AS dec FROM ({s4})")
    s6 = (f"SELECT *, CASE WHEN act AND rate + spread < b0 + b1 THEN rate ELSE b0 END AS p0, "
          f"CASE WHEN act AND rate + spread < b0 + b1 THEN spread ELSE b1 END AS p1 FROM ({s5})")
    s7 = (f"SELECT *, CASE WHEN act AND rate + spread >= p0 + 2 * p1 THEN 1 ELSE 0 END + "
          f"CASE WHEN act AND rate + spread > p0 + 3 * p1 THEN 1 ELSE 0 END AS level FROM ({s6})")
    s8 = (f"SELECT *, CASE WHEN NOT act THEN wa ELSE CASE WHEN level > 0 THEN wa + nn ELSE 0 END END AS wa1, "
          f"CASE WHEN NOT act THEN wb ELSE CASE WHEN level > 0 THEN wb + ee ELSE 0 END END AS wb1 FROM ({s7})")
    new = {**{f"v{i}": f"v{i} + g{i}" for i in xs}, **{f"h{i}": f"dec * h{i} + w{i}" for i in xs},
           **{f"z{i}": f"v{i} + g{i} - {prm.lp!r} * (dec * h{i} + w{i})" for i in xs}, "r": "1.0 + dec * r",
           "c0": "CASE WHEN level = 2 THEN wa1 ELSE n1 END", "c1": "CASE WHEN level = 2 THEN wb1 ELSE e1 END", "wa": "wa1", "wb": "wb1",
           "b0": "CASE WHEN level = 2 THEN 1.0 ELSE p0 END", "b1": "CASE WHEN level = 2 THEN 10.0 ELSE p1 END"}
    step = "SELECT stream_id, b, rs, ps, " + ", ".join(f"CASE WHEN nn > 0 THEN {e} ELSE {k} END AS {k}" for k, e in new.items()) + f" FROM ({s8})"
    zero = {k: "CAST(0 AS DOUBLE)" for k in new} | {k: "CAST(0 AS BIGINT)" for k in ("c0", "c1", "wa", "wb")} | {
        "r": "CAST(1 AS DOUBLE)", "b0": "CAST(1 AS DOUBLE)", "b1": "CAST(10 AS DOUBLE)"}
    base = (f"SELECT stream_id, CAST(-1 AS BIGINT) AS b, list_filter(any_value(rs), lambda q: false) AS rs, CAST([] AS DOUBLE[]) AS ps, "
            + ", ".join(f"{e} AS {k}" for k, e in zero.items()) + f" FROM {name}_in GROUP BY stream_id")
    return f"{lists}, {name} AS ({base} UNION ALL {step})"


def speculation_sql(rows: str, p: int, prm: FtrlParams, steps: int, soft_col: str, state: str = "st") -> str:
    """ST14/ST15: per row of the recursive ``state`` relation, ``steps`` soft-label steps on the rows before it, oldest first, from a
    copy of its state; stream_id, t, prob, prob_spec, prob_blend."""
    xs = range(p)
    head = [*(f"cx{i}" for i in xs), *(f"cw{i}" for i in xs)]
    cur = (f"SELECT s.*, " + ", ".join(f"c.x{i} AS cx{i}" for i in xs) + ", " + ", ".join(f"{_w(i, prm, 's.z', 's.r')} AS cw{i}" for i in xs)
           + f" FROM {state} s JOIN {rows} c ON c.stream_id = s.stream_id AND c.t = s.t")
    for k in range(steps, 0, -1):
        src = (f"SELECT a.*, " + ", ".join(f"d.x{i} AS fx{i}" for i in xs) + f", CAST(d.{soft_col} AS DOUBLE) AS fy, CAST(1 AS DOUBLE) AS fw8 "
               f"FROM ({cur}) a LEFT JOIN {rows} d ON d.stream_id = a.stream_id AND d.t = a.t - {k}")
        s11, new = fit_sql(src, p, prm, soft=True)
        cur = (f"SELECT stream_id, t, {', '.join(head)}, "
               + ", ".join(f"CASE WHEN fy IS NOT NULL THEN {new[c]} ELSE {c} END AS {c}" for c in state_names(p)) + f" FROM ({s11})")
    by = lambda w: sigmoid_sql("(" + " + ".join(f"{w(i)} * cx{i}" for i in xs) + ")")
    return (f"SELECT stream_id, t, {by(lambda i: f'cw{i}')} AS prob, {by(lambda i: _w(i, prm))} AS prob_spec, "
            f"{by(lambda i: f'(0.5 * cw{i} + 0.5 * ' + _w(i, prm) + ')')} AS prob_blend FROM ({cur})")
