"""Oracle SQL (DuckDB) for every registered query, keyed like ``plans.registry``."""

from __future__ import annotations

from laggard.operators.learner import FtrlParams
from laggard.oracle.sql import F1_SQL, F2_SQL, F3_SQL, F4_SQL, F5_SQL, ftrl_recursive_sql
from laggard.plans import m0

ORACLES: dict[str, str] = {}


def _f1_rows_with_intercept() -> str:
    return (f"f1 AS ({F1_SQL}), "
            "r_in AS (SELECT stream_id, t, CAST(1 AS DOUBLE) AS x0, x0 AS x1, x1 AS x2, x2 AS x3, y FROM f1)")


def _m0_preds(delay: int) -> str:
    return (f"WITH RECURSIVE {_f1_rows_with_intercept()}, "
            f"{ftrl_recursive_sql('r_in', 4, FtrlParams(), delay)}, "
            "p AS (SELECT s.stream_id, s.t, s.prob, CASE WHEN s.prob > 0.5 THEN 1 ELSE 0 END AS pred, r.y "
            "      FROM st s JOIN r_in r ON r.stream_id = s.stream_id AND r.t = s.t WHERE s.t >= 0), "
            "e AS (SELECT *, CASE WHEN abs(y - pred) > 0.5 THEN 1 ELSE 0 END AS err FROM p) ")


ORACLES["m0_delayed_errors"] = _m0_preds(m0.M0_DELAY) + f"""
SELECT stream_id, t, round(prob, 6) AS prob, pred, y, err,
  round(avg(err) OVER (PARTITION BY stream_id ORDER BY t
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cer,
  round(avg(1 - err) OVER (PARTITION BY stream_id ORDER BY t
                           ROWS BETWEEN {m0.M0_WINDOW - 1} PRECEDING AND CURRENT ROW), 6) AS acc
FROM e"""

ORACLES["m0_delayed_summary"] = _m0_preds(m0.M0_DELAY) + """,
c AS (SELECT stream_id, count(*) AS n,
        CAST(sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
        CAST(sum(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(sum(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM e GROUP BY stream_id),
m AS (SELECT *, tp / (tp + fn + 1e-10) AS recall, tp / (tp + fp + 1e-10) AS precision FROM c)
SELECT stream_id, n, tp, fp, fn, round(recall, 6) AS recall, round(precision, 6) AS precision,
       round(2 * (precision * recall) / (precision + recall + 1e-10), 6) AS f1 FROM m"""

_ = (F2_SQL, F3_SQL, F4_SQL, F5_SQL)

from laggard.oracle import m1_sql  # noqa: E402

ORACLES.update(m1_sql.ORACLES)

from laggard.oracle import m2_sql  # noqa: E402

ORACLES.update(m2_sql.ORACLES)

from laggard.oracle import m3_sql  # noqa: E402

ORACLES.update(m3_sql.ORACLES)

from laggard.oracle import m5_sql  # noqa: E402

ORACLES.update(m5_sql.ORACLES)

from laggard.oracle import m4_sql  # noqa: E402

ORACLES.update(m4_sql.ORACLES)

from laggard.oracle import m6_sql  # noqa: E402

ORACLES.update(m6_sql.ORACLES)

from laggard.oracle import m7_sql  # noqa: E402

ORACLES.update(m7_sql.ORACLES)


def _fix_neg_zero(sql: str) -> str:
    """Wrap every ``round(expr, 6)`` as ``(round(expr, 6) + 0)``: DuckDB keeps -0.0 for tiny
    negatives, Spark's decimal rounding does not."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k = 0, j + len(key) - 1
        while True:
            ch = sql[k]
            depth += ch == "("
            depth -= ch == ")"
            if depth == 0:
                break
            k += 1
        inner = _fix_neg_zero(sql[j + len(key):k])
        out.append(sql[i:j] + "(round(" + inner + ") + CAST(0 AS DOUBLE))")
        i = k + 1


ORACLES = {k: _fix_neg_zero(v) for k, v in ORACLES.items()}

from laggard.oracle import m8_sql  # noqa: E402

ORACLES.update(m8_sql.ORACLES)
