"""SQL-text builders for wide aggregations.

Statistical kernels put dozens to hundreds of aggregate expressions into one
pass. Building them as PySpark ``Column`` trees costs one driver<->JVM call
per node; emitting SQL text and handing the whole SELECT to ``spark.sql``
costs one call per pass, and Catalyst sees exactly the same plan.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame


def q(name: str) -> str:
    """Quoted identifier for the SQL texts here, whose braces ``format`` reads."""
    return "`" + name.replace("`", "``").replace("{", "{{").replace("}", "}}") + "`"


def plain(name: str) -> str:
    """Quoted identifier for the DataFrame API."""
    return "`" + name.replace("`", "``") + "`"


def lit(x: float) -> str:
    """Exact DOUBLE literal (``repr`` round-trips; the D suffix keeps Spark
    from reading it as a DECIMAL)."""
    x = float(x)
    if math.isnan(x):
        return "CAST('NaN' AS DOUBLE)"
    if math.isinf(x):
        return "CAST('Infinity' AS DOUBLE)" if x > 0 else "CAST('-Infinity' AS DOUBLE)"
    r = repr(x)
    return f"({r}D)" if not r.startswith("-") else f"(-{r[1:]}D)"


def ok_cond(cols: list[str], dtypes: dict[str, str]) -> str:
    """Complete-case condition: not NULL, and not NaN for doubles."""
    parts = []
    for c in cols:
        parts.append(f"{q(c)} IS NOT NULL")
        if dtypes.get(c) in ("double", "float"):
            parts.append(f"NOT isnan({q(c)})")
    return "(" + " AND ".join(parts) + ")" if parts else "TRUE"


def when(cond: str, expr: str) -> str:
    return f"CASE WHEN {cond} THEN {expr} END"


def linear(const: float, coefs, cols: list[str]) -> str:
    """``const + sum(b_j * x_j)`` as text."""
    out = lit(const)
    for b, c in zip(coefs, cols):
        out += f" + {lit(b)} * {c}"
    return f"({out})"


def quad(M, v: list[str]) -> str:
    """Quadratic form ``v' M v`` for a symmetric matrix of literals."""
    terms = []
    k = len(v)
    for i in range(k):
        terms.append(f"{lit(M[i][i])} * {v[i]} * {v[i]}")
        for j in range(i + 1, k):
            terms.append(f"{lit(2.0 * M[i][j])} * {v[i]} * {v[j]}")
    return "(" + " + ".join(terms) + ")"


def select_agg(df: DataFrame, exprs: list[str]) -> dict:
    """Run ``SELECT <exprs> FROM df`` as one job and return the single row
    as a dict (aggregates only: one row, O(#exprs) numbers)."""
    spark = df.sparkSession
    return spark.sql("SELECT " + ",\n".join(exprs) + " FROM {t}", t=df).first().asDict()


def sql_df(df: DataFrame, select: str, tail: str = "") -> DataFrame:
    return df.sparkSession.sql("SELECT " + select + " FROM {t} " + tail, t=df)


def select_agg_staged(df: DataFrame, stages: list[list[str]], exprs: list[str]) -> dict:
    """Like :func:`select_agg`, with per-row quantities computed once in
    nested projections (``stages``: lists of ``expr AS name`` added on top
    of all columns, innermost first). Catalyst does not inline a
    non-trivial projection that a consumer uses more than once, so e.g. a
    fitted mean feeding five sums is evaluated once per row."""
    return df.sparkSession.sql("SELECT " + ",\n".join(exprs) + " FROM " + staged_from(stages), t=df).first().asDict()


def staged_from(stages: list[list[str]]) -> str:
    """FROM clause text: nested projections over the ``{t}`` placeholder."""
    sql = "{t}"
    for st in stages:
        sql = f"(SELECT *, {', '.join(st)} FROM {sql})"
    return sql
