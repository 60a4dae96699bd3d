"""Order-independent pseudo-randomness.

Every random choice of the reference (masks, label loss, shuffles, cut-offs)
becomes a pure function of (seed, key, t, col): the same inputs give the same
draw under any partitioning, on retry after an executor loss, and in the
DuckDB oracle.  ``md5`` is used because both engines compute it identically
(Spark ``xxhash64`` has no DuckDB twin).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def hash32_sql(*parts: str, engine: str = "spark") -> str:
    """First 32 bits of md5('#'-joined parts) as a BIGINT, SQL text for one engine."""
    joined = "concat_ws('#', " + ", ".join(f"CAST({p} AS VARCHAR)" if engine == "duckdb"
                                          else f"CAST({p} AS STRING)" for p in parts) + ")"
    if engine == "duckdb":
        return f"(('0x' || substr(md5({joined}), 1, 8))::BIGINT)"
    return f"CAST(conv(substr(md5({joined}), 1, 8), 16, 10) AS BIGINT)"


def uniform_sql(*parts: str, engine: str = "spark") -> str:
    """Uniform draw in [0, 1) from the hash of the parts."""
    return f"({hash32_sql(*parts, engine=engine)} / CAST({int(TWO_32)} AS DOUBLE))"


def hash32(*parts: str) -> Column:
    return F.expr(hash32_sql(*parts))


def uniform(*parts: str) -> Column:
    return F.expr(uniform_sql(*parts))
