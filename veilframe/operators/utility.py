"""How much a release keeps: distinct values, rows, columns and noise in one score."""

from __future__ import annotations

from pyspark.sql import DataFrame

from veilframe.operators.distinct import counted

#: What a column that still joins, and one that is noised without known bounds, is worth.
JOINABLE = 0.3
UNKNOWN = 0.5
GENERALISED = ("mask", "numeric_bin", "date_truncate", "string_truncate")


def distinct_counts(df: DataFrame, columns: list[str], exact: bool = True) -> dict[str, int]:
    """Distinct values of each column, null counted, in one pass."""
    return {c: n.distinct for c, n in counted(df, columns, exact).items()}


def noise_fidelity(params: dict | None) -> float:
    """1 / (1 + scale / range) from what was declared, which says nothing of the data."""
    try:
        epsilon, lower, upper = (float(params[k]) for k in ("epsilon", "lower", "upper"))
    except (KeyError, TypeError, ValueError):
        return UNKNOWN
    return 1 / (1 + 1 / epsilon) if upper > lower and epsilon > 0 else 0.0


def fidelity(action: str, before: int | None, after: int | None, params: dict | None) -> tuple[str, float]:
    """(what became of the column, its worth in [0, 1])."""
    left = min(1.0, max(0.0, after / before)) if before and after is not None else UNKNOWN
    return {
        "retain": ("retained", 1.0),
        "hash": ("pseudonymized", JOINABLE),
        "tokenize": ("pseudonymized", JOINABLE),
        "redact": ("redacted", 0.0),
        "dp_laplace": ("noised", noise_fidelity(params)),
    }.get(action) or (("generalized", left) if action in GENERALISED else ("transformed", left))


def utility(before: dict[str, int], after: dict[str, int], rows_before: int, rows_after: int, actions: dict[str, str], noise: dict[str, dict] | None = None) -> dict:
    """Score and its parts. before, after: distinct values of all and of released columns."""
    columns, worth = [], []
    for name, n in before.items():
        if name not in after:
            columns.append({"column": name, "action": actions.get(name, "drop"), "disposition": "dropped", "fidelity": 0.0, "distinct_before": n, "distinct_after": None})
            continue
        action = actions.get(name, "retain")
        what, value = fidelity(action, n, after[name], (noise or {}).get(name))
        worth.append(round(value, 4))
        columns.append({"column": name, "action": action, "disposition": what, "fidelity": worth[-1], "distinct_before": n, "distinct_after": after[name]})
    rows = rows_after / rows_before if rows_before else 0.0
    kept = len(worth) / len(before) if before else 0.0
    mean = sum(worth) / len(worth) if worth else 0.0
    return {
        "overall_score": round(100 * rows * kept * mean, 1),
        "row_retention": round(rows, 4),
        "rows_before": rows_before,
        "rows_after": rows_after,
        "column_retention": round(kept, 4),
        "columns_total": len(before),
        "columns_kept": len(worth),
        "columns_dropped": [c["column"] for c in columns if c["disposition"] == "dropped"],
        "mean_column_fidelity": round(mean, 4),
        "columns": columns,
    }
