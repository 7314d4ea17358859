"""Column-level helpers (projections and scalar functions, SURVEY §2.2).

Everything here returns a ``Column`` or a projected ``DataFrame``; no Python
runs per row.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The cluster-file column names of the source release and the
# names the integrated dataset uses for them. The plain ``collab_*`` names are
# the same columns as they appear in the test-table mapping.
COLLAB_RENAMES = {
    "collaboration:directive_ratio": "cluster_directive",
    "collaboration:feedback loop_ratio": "cluster_feedback_loop",
    "collaboration:task iteration_ratio": "cluster_task_iteration",
    "collaboration:learning_ratio": "cluster_learning",
    "collaboration:validation_ratio": "cluster_validation",
    "collaboration:none_ratio": "cluster_none",
    "has_thinking_ratio": "cluster_thinking_fraction",
    "collab_directive_ratio": "cluster_directive",
    "collab_feedback_loop_ratio": "cluster_feedback_loop",
    "collab_task_iteration_ratio": "cluster_task_iteration",
    "collab_learning_ratio": "cluster_learning",
    "collab_validation_ratio": "cluster_validation",
    "collab_none_ratio": "cluster_none",
}

# Keywords whose presence (as a substring of the lower-cased
# cluster names) marks a technical-domain cluster.
TECH_KEYWORDS = ("software", "code", "coding", "debug", "program", "script",
                 "data", "technical", "computer", "algorithm", "web", "app")

# Python's str.isspace() set (what pandas' str.strip removes) = Unicode
# White_Space plus the four ASCII separators \x1c-\x1f.
_EDGE_WS = "".join(map(chr, [*range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
                             0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))


def normalize_key(c: Column | str) -> Column:
    """B1: lower-case and strip leading/trailing whitespace exactly as
    Python's ``str.strip()`` does (tabs, Unicode blanks and the ASCII
    separators included; Spark's ``trim`` only strips spaces). Only the edges
    are looked at, where a pattern would be tried at every character."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(F.lower(c), F.lit(_EDGE_WS))


def present(df: DataFrame, cols: Iterable[str]) -> list[str]:
    """The subset of ``cols`` that exists in ``df`` (order kept)."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def rename_present(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Bulk rename; names absent from ``df`` are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_present(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop columns that exist; absent names are ignored."""
    return df.drop(*present(df, cols))


def nan_to_null(c: Column | str) -> Column:
    """NaN means 'suppressed' and becomes NULL once, at ingest."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def coerce_numeric(c: Column | str) -> Column:
    """To double; unparseable text -> NULL, NaN -> NULL (never 0)."""
    c = F.col(c) if isinstance(c, str) else c
    return nan_to_null(c.try_cast("double"))


def composite(cols: Sequence[str | Column]) -> Column:
    """Null-strict sum -- NULL as soon as one part is NULL.

    Plain ``+`` already is null-strict; an aggregate or ``coalesce`` would
    silently turn a suppressed part into 0, which is exactly what must not
    happen."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def concat_names(cols: Sequence[str]) -> Column:
    """NULL -> '' then join with single blanks, lower-cased. Separators
    stay even for empty parts (as ``fillna('') + ' ' + ...`` does)."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols]))


def keyword_flag(text: Column, keywords: Iterable[str] = TECH_KEYWORDS) -> Column:
    """1 if any keyword is a substring of ``text``, else 0 (int)."""
    cond = None
    for k in keywords:
        t = F.coalesce(text.contains(F.lit(k)), F.lit(False))
        cond = t if cond is None else (cond | t)
    return cond.cast("int")


def log_strict(c: Column | str) -> Column:
    """Natural log. Spark's ``ln`` yields NULL for x <= 0 (numpy: -inf /
    NaN); callers that must not lose rows check positivity first
    (``operators.linear`` raises unless ``nonpositive='drop'``)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.ln(c)


def status_label(actual: Column, expected: Column) -> Column:
    """B18: 'PASS' or 'CHECK - expected <n>'."""
    return F.when(actual == expected, F.lit("PASS")).otherwise(
        F.concat(F.lit("CHECK - expected "), expected.cast("string")))
