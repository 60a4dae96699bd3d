"""Standard normal CDF / quantile / truncated-normal moments as column expressions.

Neither Spark SQL nor DuckDB ships ``erf``, so both functions are generated as
one SQL text that runs unchanged in both engines (Spark through ``F.expr``,
DuckDB inside the oracle queries).  Everything stays JVM-side and inside
whole-stage codegen; no Python touches a row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Published coefficients.
#
# Phi(x): W. J. Cody / J. F. Hart double-precision rational form as written
# out by G. West, "Better approximations to cumulative normal functions"
# (Wilmott, 2005).  Absolute error below 1e-15 on [-10, 10] (checked against
# math.erfc in tests/test_functions.py).
PHI_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165,
           33.912866078383, 112.079291497871, 221.213596169931,
           220.206867912376]
PHI_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207,
           86.7807322029461, 296.564248779674, 637.333633378831,
           793.826512519948, 440.413735824752]
PHI_SPLIT = 7.07106781186547
PHI_SQRT_2PI = 2.506628274631
#
# Phi^-1(p): M. J. Wichura, Algorithm AS241 PPND16 (Applied Statistics 37,
# 1988), highest-power coefficient first.
AS241_A = [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853,
           45921.953931549871457, 13731.693765509461125, 1971.5909503065514427,
           133.14166789178437745, 3.387132872796366608]
AS241_B = [5226.495278852854561, 28729.085735721942674, 39307.89580009271061,
           21213.794301586595867, 5394.1960214247511077, 687.1870074920579083,
           42.313330701600911252, 1.0]
AS241_C = [7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177,
           1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055,
           4.6303378461565452959, 1.42343711074968357734]
AS241_D = [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966,
           0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494,
           2.05319162663775882187, 1.0]
AS241_E = [2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
           0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
           5.4637849111641143699, 6.6579046435011037772]
AS241_F = [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5,
           7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531,
           0.59983220655588793769, 1.0]
# ---------------------------------------------------------------------------

POS_INF_SQL = "CAST('Infinity' AS DOUBLE)"
NEG_INF_SQL = "CAST('-Infinity' AS DOUBLE)"


def _horner(coefs: list[float], var: str) -> str:
    """Horner form ``((c0*v + c1)*v + c2)...`` as SQL text."""
    out = repr(float(coefs[0]))
    for c in coefs[1:]:
        out = f"({out} * {var} + {float(c)!r})"
    return out


def phi_sql(x: str) -> str:
    """SQL text for the standard normal CDF of the SQL expression ``x``."""
    a = f"abs({x})"
    tail = (f"(exp(-{a}*{a}/2) * {_horner(PHI_NUM, a)} / {_horner(PHI_DEN, a)})")
    far = (f"(exp(-{a}*{a}/2) / ({a} + 1.0/({a} + 2.0/({a} + 3.0/({a} + 4.0/({a} + 0.65))))) "
           f"/ {PHI_SQRT_2PI!r})")
    lower = (f"(CASE WHEN {a} > 37.0 THEN 0.0 WHEN {a} < {PHI_SPLIT!r} THEN {tail} "
             f"ELSE {far} END)")
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0 THEN 1.0 - {lower} "
            f"ELSE {lower} END)")


def phi_inv_sql(p: str) -> str:
    """SQL text for the standard normal quantile; 0 -> -inf, 1 -> +inf, outside -> NULL."""
    q = f"({p} - 0.5)"
    r0 = f"(0.180625 - {q}*{q})"
    central = f"({q} * {_horner(AS241_A, r0)} / {_horner(AS241_B, r0)} + 0.0)"  # -0.0 -> 0.0
    rr = f"sqrt(-ln(CASE WHEN {q} < 0 THEN {p} ELSE 1.0 - {p} END))"
    mid = f"({_horner(AS241_C, f'({rr} - 1.6)')} / {_horner(AS241_D, f'({rr} - 1.6)')})"
    far = f"({_horner(AS241_E, f'({rr} - 5.0)')} / {_horner(AS241_F, f'({rr} - 5.0)')})"
    tails = f"(CASE WHEN {rr} <= 5.0 THEN {mid} ELSE {far} END)"
    return (f"(CASE WHEN {p} IS NULL OR {p} < 0 OR {p} > 1 THEN NULL "
            f"WHEN {p} = 0 THEN {NEG_INF_SQL} WHEN {p} = 1 THEN {POS_INF_SQL} "
            f"WHEN abs({q}) <= 0.425 THEN {central} "
            f"WHEN {q} < 0 THEN -{tails} ELSE {tails} END)")


def pdf_sql(x: str) -> str:
    """Standard normal density; 0 at +-inf."""
    return (f"(CASE WHEN abs({x}) = {POS_INF_SQL} THEN 0.0 "
            f"ELSE exp(-({x})*({x})/2) / {PHI_SQRT_2PI!r} END)")


def _sql_of(c: Column | str) -> str:
    if isinstance(c, str):
        return f"`{c}`" if c.isidentifier() else c
    raise TypeError("pass a column name or SQL text; Column objects have no SQL text")


def phi(x: str) -> Column:
    """standard normal CDF of a column name or SQL expression."""
    return F.expr(phi_sql(_sql_of(x)))


def phi_inv(p: str) -> Column:
    """standard normal quantile of a column name or SQL expression."""
    return F.expr(phi_inv_sql(_sql_of(p)))


def truncnorm_moments_sql(a: str, b: str) -> tuple[str, str]:
    """(mean, variance) of N(0,1) truncated to [a, b], either bound may be infinite.

    mean = (phi(a) - phi(b)) / Z,   var = 1 + (a phi(a) - b phi(b)) / Z - mean^2,
    with x*phi(x) = 0 at +-inf.  Z = Phi(b) - Phi(a); Z = 0 gives NULL (the
    reference ignores non-finite moments).
    """
    z = f"({phi_sql(b)} - {phi_sql(a)})"
    xa = f"(CASE WHEN abs({a}) = {POS_INF_SQL} THEN 0.0 ELSE {a} * {pdf_sql(a)} END)"
    xb = f"(CASE WHEN abs({b}) = {POS_INF_SQL} THEN 0.0 ELSE {b} * {pdf_sql(b)} END)"
    mean = f"(({pdf_sql(a)} - {pdf_sql(b)}) / NULLIF({z}, 0))"
    var = f"(1.0 + ({xa} - {xb}) / NULLIF({z}, 0) - {mean} * {mean})"
    return mean, var
