"""A release from request to report: transform, noise, suppress, measure.

Noise is a barrier. The noised table is written once to the folder that the cluster
shares and everything after reads that; a plan that was run again would
draw anew. The budget is reserved before anything is drawn, and settled by the caller once
the release is written. Nothing is written if a guardrail refuses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from veilframe.config import Settings, load
from veilframe.errors import PolicyError, RiskError
from veilframe.functions.ledger import Ledger
from veilframe.kept import keep
from veilframe.operators.kanon import Suppressed, cardinalities, enforce
from veilframe.operators.preflight import preflight as search
from veilframe.operators.profile import category, column_counts, detect, detection_sample, schema_profile, summary
from veilframe.operators.utility import utility
from veilframe.columns import is_numeric
from veilframe.plans.policy import Request, derived_key, fold, new_key, noise_params, quasi_identifiers, sensitive_columns, with_noise
from veilframe.plans.report import build


@dataclass
class Released:
    """The rows to write, the report to share, and epsilon spent so far."""

    df: DataFrame
    report: dict
    spent: dict[str, float]
    suppressed: Suppressed
    token: str | None = None  # what is reserved in the ledger


def barrier(df: DataFrame) -> DataFrame:
    """df written once; every later action reads the same rows, and only the columns it needs."""
    return keep(df, "barrier")


def guard(found: Suppressed, soft_cap: float, hard_cap: float, accept_weaker: bool) -> None:
    """Refuses an empty release, too much suppression, or much without an override."""
    if found.rows_total - found.rows_suppressed <= 0:
        raise RiskError("no rows would be left")
    worst = ", ".join(f"{c} ({n})" for c, n in cardinalities(found.df, found.quasi_identifiers)[:3]) if found.ratio > soft_cap else ""
    if found.ratio > hard_cap:
        raise RiskError(f"{found.ratio:.1%} of rows would be suppressed, above the hard cap of {hard_cap:.0%}; distinct values: {worst}")
    if found.ratio > soft_cap and not accept_weaker:
        raise RiskError(f"{found.ratio:.1%} of rows would be suppressed, above the soft cap of {soft_cap:.0%}; distinct values: {worst}")


def _key(request: Request, settings: Settings, key: bytes | None) -> bytes:
    return derived_key(settings, request.key_name, request.policies) if request.key_name else key or new_key()


def release(df: DataFrame, request: Request, settings: Settings | None = None, key: bytes | None = None, spent: dict[str, float] | None = None, public: bool = False, name: str = "release", ledger: Ledger | None = None, profile: list[dict] | None = None, pii: dict | None = None) -> Released:
    """Everything that a request asks for; errors before anything is written.

    ledger: where the costs are reserved before noise is drawn; the caller settles them once
    the files are whole. profile, pii: of df, where they are known.
    """
    settings = settings or load()
    key = _key(request, settings, key)
    plain = fold(df, request.policies, key, public)
    noise = noise_params(plain, request.policies, request.dp, settings)
    costs = {c: n.epsilon for c, n in noise.items()}
    ledger = ledger if ledger is not None else Ledger(settings.epsilon_budget, spent)
    token = ledger.reserve(costs) if costs else None
    try:
        return _released(df, request, settings, plain, noise, ledger.spent, name, profile, pii, token)
    except BaseException:
        if token is not None:
            ledger.abort(token)
        raise


def _released(df: DataFrame, request: Request, settings: Settings, plain: DataFrame, noise: dict, after: dict[str, float], name: str, profile: list[dict] | None, pii: dict | None, token: str | None) -> Released:
    out = barrier(with_noise(plain, noise)) if noise else plain
    qis = quasi_identifiers(out, request.policies)
    sensitive = sensitive_columns(out, request.policies, qis, request.sensitive)
    found = enforce(out, qis, request.k, [c for c in sensitive if out.schema[c].dataType.typeName() not in ("map",)], request.l)
    guard(found, settings.soft_cap, settings.hard_cap, request.accept_weaker)
    # Counts, statistics and the write read the released rows: they are made once.
    found.df = barrier(found.df)
    found.done()
    exact = settings.exact_distinct
    profile = schema_profile(df, exact) if profile is None else profile
    pii = detect(detection_sample(df, settings.sample_rows)) if pii is None else pii
    actions = {p.column: p.action for p in request.policies}
    rows_after = found.rows_total - found.rows_suppressed
    counts = column_counts(found.df, found.df.columns, exact)
    worth = utility({e["name"]: e["n_unique"] for e in profile}, {c: n[0] for c, n in counts.items()}, found.rows_total, rows_after, actions, request.dp)
    warnings = list(found.warnings)
    if request.l < 2 and (leaks := sorted(c for c, n in found.homogeneous.items() if n)):
        warnings.append(f"Some released classes hold a single value of {', '.join(leaks)}: whoever knows that a person is in such a class learns it. Ask for l of 2 or more, or coarsen or drop these columns.")
    report = build(name, profile, pii, request, noise, after, settings, found, worth, compare(found.df, profile, counts), warnings)
    return Released(found.df, report, after, found, token)


def described(df: DataFrame, counts: dict[str, tuple[int, int, int]] | None = None) -> dict:
    """Statistics of each column, by its kind: numbers, or number of values and share of nulls."""
    numbers = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    counts = counts or column_counts(df, [c for c in df.columns if c not in numbers])
    out: dict = {"columns": {c: {"kind": "categorical"} | category(*n) for c, n in counts.items() if c not in numbers}, "correlation": []}
    if numbers:
        stats, pairs, bars = summary(df, numbers)
        for r in stats:
            out["columns"][r.column_name] = {"kind": "numeric"} | {k: r[k] for k in ("mean", "std", "minimum", "maximum", "null_ratio")} | {"histogram": bars.get(r.column_name, [])}
        out["correlation"] = [[r.a, r.b, r.r] for r in pairs]
    return {"columns": {c: out["columns"][c] for c in df.columns}, "correlation": out["correlation"]}


def compare(after: DataFrame, before: list[dict], counts: dict[str, tuple[int, int, int]] | None = None) -> dict:
    """What a report may show of the released columns; of the columns before, kinds alone.

    before: a schema profile. Columns that are gone are marked as dropped, and numbers that
    became text have the kind that they have now beside the one that they had.
    """
    now = described(after, counts)
    had = {e["name"]: "numeric" if e["kind"] == "numeric" else "categorical" for e in before}
    columns = {}
    for name, kind in had.items():
        found = now["columns"].get(name)
        if found is None:
            columns[name] = {"kind": kind, "dropped": True}
        elif found["kind"] != kind:
            columns[name] = found | {"kind": kind, "after_kind": found["kind"]}
        else:
            columns[name] = found
    return {"columns": columns, "correlation": now["correlation"]}


def validation(before: DataFrame, after: DataFrame) -> dict:
    """Statistics of both tables side by side: for whoever may see the table itself, never for a report.

    If no row is left, what is said of the columns after is their kind alone.
    """
    one = described(before)
    empty = after.isEmpty()
    two = {"columns": {c: {} for c in after.columns}, "correlation": []} if empty else described(after)
    columns = {}
    for name, old in one["columns"].items():
        new = two["columns"].get(name)
        entry = {"kind": old["kind"], "before": old, "after": new or None}
        if new is None:
            entry["dropped"] = True
        elif new and new["kind"] != old["kind"]:
            entry["after_kind"] = new["kind"]
        columns[name] = entry
    return {"columns": columns, "correlation_before": one["correlation"], "correlation_after": two["correlation"], "rows_before": before.count(), "rows_after": 0 if empty else after.count()}


def preflight(df: DataFrame, request: Request, settings: Settings | None = None, key: bytes | None = None) -> dict:
    """What a release would suppress, from the quasi-identifiers alone; no noise is drawn.

    A quasi-identifier that would be noised is refused: its noise would have to be
    released, or drawn for nothing.
    """
    settings = settings or load()
    key = _key(request, settings, key)
    marked = {p.column for p in request.policies if p.is_quasi_identifier}
    if noisy := sorted(p.column for p in request.policies if p.action == "dp_laplace" and p.column in marked):
        raise PolicyError(f"noised columns cannot be searched: {', '.join(noisy)}")
    wanted = [p for p in request.policies if p.column in marked or request.l > 1]
    plain = fold(df, wanted, key)
    qis = quasi_identifiers(plain, request.policies)
    sensitive = sensitive_columns(plain, request.policies, qis, request.sensitive) if request.l > 1 else []
    return search(plain, qis, request.k, sensitive, request.l, settings.soft_cap, settings.hard_cap)


def preview(df: DataFrame, request: Request, settings: Settings | None = None, key: bytes | None = None, rows: int = 5) -> list[dict]:
    """The first rows through the same expressions; noised columns show no value."""
    settings = settings or load()
    noisy = {p.column for p in request.policies if p.action == "dp_laplace"}
    found = fold(df.limit(rows), request.policies, _key(request, settings, key)).collect()
    return [{c: "(noised)" if c in noisy and v is not None else shown(v) for c, v in r.asDict().items()} for r in found]


def shown(v):
    """A cell of a preview: short numbers and short text."""
    if v is None:
        return None
    if isinstance(v, float):
        return f"{v:.6g}"
    s = str(v)
    return s if len(s) <= 80 else s[:77] + "…"
