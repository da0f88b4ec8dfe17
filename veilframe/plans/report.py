"""The report of a release: what may be shared, as JSON and as Markdown."""

from __future__ import annotations

import json
import math

CLAIM = "Columns were transformed as listed, rows in small groups of equal quasi-identifiers were left out, and noised columns carry local differential privacy each by itself. None of this is a guarantee for the whole table."
NOTE = "Epsilon holds for a column by itself and adds up over releases of a session; it is not a bound for the table."


def _finite(x):
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, dict):
        return {k: _finite(v) for k, v in x.items()}
    return [_finite(v) for v in x] if isinstance(x, (list, tuple)) else x


def build(name, profile, pii, request, noise, after, settings, found, worth, measured, warnings) -> dict:
    """A dict that holds no value of the input and no exact count of its distinct values."""
    shared = {k: v for k, v in worth.items() if k != "columns"}
    shared["columns"] = [{k: v for k, v in c.items() if k not in ("distinct_before", "fidelity")} | {"fidelity": round(c["fidelity"], 1)} for c in worth["columns"]]
    report = {
        "name": name,
        "claim": CLAIM,
        "warnings": warnings,
        "schema": [{k: e[k] for k in ("name", "dtype", "kind")} for e in profile],
        "pii": {c: [{"kind": s.kind, "confidence": round(s.confidence, 2), "reason": s.reason} for s in all_] for c, all_ in pii.items()},
        "policies": [{"column": p.column, "action": p.action, "params": p.params, "is_quasi_identifier": p.is_quasi_identifier, "present": any(e["name"] == p.column for e in profile)} for p in request.policies],
        "privacy": {"epsilon_per_column": {c: n.epsilon for c, n in noise.items()}, "max_epsilon": max((n.epsilon for n in noise.values()), default=0.0), "cumulative_epsilon": after, "budget": settings.epsilon_budget, "delta": None, "note": NOTE},
        "k_anonymity": {
            "k_target": request.k,
            "k_achieved": found.k_achieved,
            "quasi_identifiers": found.quasi_identifiers,
            "rows_total": found.rows_total,
            "rows_suppressed": found.rows_suppressed,
            "suppression_ratio": found.ratio,
            "classes_total": found.classes_total,
            "classes_below_k": found.classes_below_k,
            "l_diversity": {"l_target": request.l, "enforced": request.l > 1 and bool(found.quasi_identifiers), "sensitive_columns": found.sensitive, "l_achieved": found.l_achieved, "homogeneous_classes": found.homogeneous, "classes_below_l": found.classes_below_l},
        },
        "utility": shared,
        "validation": {"rows_before": found.rows_total, "rows_after": found.rows_total - found.rows_suppressed, **measured},
    }
    if request.key_name:
        report["named_key"] = {"name": request.key_name, "warning": "Releases under this name link with each other, and guessed inputs can be tried against them."}
    return _finite(report)


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False, allow_nan=False, default=str)


def escape(s) -> str:
    """Text that Markdown shows as it is."""
    return "".join("\\" + c if c in "\\`*_[]()#|<>" else c for c in str(s))


def to_markdown(report: dict) -> str:
    k, p, u, v = (report[x] for x in ("k_anonymity", "privacy", "utility", "validation"))
    code = lambda c: f"`{escape(c)}`"
    parts = [("Claim", [report["claim"]])]
    if report["warnings"]:
        parts.append(("Warnings", [f"- {escape(w)}" for w in report["warnings"]]))
    parts.append(("Suppression", [
        f"- k: {k['k_target']} wanted, {k['k_achieved']} reached",
        f"- rows left out: {k['rows_suppressed']} of {k['rows_total']} ({k['suppression_ratio']:.2%})",
        f"- risk of re-identification in a class: {1 / max(k['k_achieved'], 1):.4f} at most",
    ]))
    d = k["l_diversity"]
    if d["sensitive_columns"]:
        rows = [f"- l: {d['l_target']} ({'enforced' if d['enforced'] else 'measured'})"]
        rows += [f"- {code(c)}: {n} distinct values in a class at least, {d['homogeneous_classes'].get(c, 0)} classes with one" for c, n in d["l_achieved"].items()]
        parts.append(("Diversity", rows))
    parts.append(("Noise", [f"- {code(c)}: epsilon {e:g}" for c, e in p["epsilon_per_column"].items()] or ["- none"]))
    parts[-1][1].append(f"- {p['note']}")
    parts.append(("Policies", [f"- {code(x['column'])}: {x['action']}{' (quasi-identifier)' if x['is_quasi_identifier'] else ''}" for x in report["policies"]]))
    if "named_key" in report:
        parts.append(("Named key", [f"- {code(report['named_key']['name'])}", f"- {report['named_key']['warning']}"]))
    if u["columns_total"]:
        rows = [f"- score: {u['overall_score']} of 100", f"- rows kept: {u['rows_after']} of {u['rows_before']}", f"- columns kept: {u['columns_kept']} of {u['columns_total']}", "", "| column | action | became | distinct values | worth |", "|-|-|-|-|-|"]
        rows += [f"| {code(c['column'])} | {c['action']} | {c['disposition']} | {'' if c['distinct_after'] is None else c['distinct_after']} | {c['fidelity']} |" for c in u["columns"]]
        parts.append(("Utility", rows))
    parts.append(("Validation", [f"- rows: {v['rows_before']} before, {v['rows_after']} after", f"- columns: {len(v['columns'])}"]))
    return "\n".join([f"# Release {code(report['name'])}", *[line for title, rows in parts for line in ("", f"## {title}", "", *rows)], ""])
