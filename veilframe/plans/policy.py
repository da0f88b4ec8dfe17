"""Policies for columns, requests, and the projection that they fold into."""

from __future__ import annotations

import hashlib
import hmac
import json
import secrets
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from veilframe.columns import is_numeric, qcol
from veilframe.config import Settings
from veilframe.errors import PolicyError, VeilError
from veilframe.functions.laplace import Noise, noised
from veilframe.functions.transforms import apply_action

ACTIONS = ("retain", "mask", "hash", "tokenize", "redact", "numeric_bin", "date_truncate", "string_truncate", "dp_laplace", "drop")
#: Actions that a user interface offers for each kind of column.
OFFERED = {
    "numeric": ("retain", "dp_laplace", "numeric_bin", "drop"),
    "datetime": ("retain", "date_truncate", "drop"),
    "categorical": ("retain", "redact", "drop"),
    "boolean": ("retain", "redact", "drop"),
    "string": ("retain", "mask", "hash", "tokenize", "redact", "string_truncate", "drop"),
}
_DERIVE = b"veilframe key 1\0"
MOST_POLICIES = 500


@dataclass(frozen=True)
class Policy:
    """What happens to one column, and whether it is a quasi-identifier."""

    column: str
    action: str = "retain"
    params: dict = field(default_factory=dict)
    is_quasi_identifier: bool = False

    def __post_init__(self) -> None:
        if not 1 <= len(self.column) <= 200 or set(self.column) & set("\r\n\0"):
            raise PolicyError("a column name has 1 to 200 characters and no line breaks")
        if self.action not in ACTIONS:
            raise PolicyError(f"there is no action {self.action!r}")


@dataclass(frozen=True)
class Request:
    """A whole release."""

    policies: tuple[Policy, ...] = ()
    k: int = 5
    l: int = 1
    dp: dict[str, dict] = field(default_factory=dict)
    key_name: str | None = None
    accept_weaker: bool = False
    sensitive: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if len(self.policies) > MOST_POLICIES or len(self.sensitive or ()) > MOST_POLICIES:
            raise PolicyError(f"more than {MOST_POLICIES} policies or sensitive columns")
        if not 2 <= self.k <= 1000 or not 1 <= self.l <= 1000:
            raise PolicyError("k must be in 2..1000 and l in 1..1000")
        if self.key_name is not None and not 1 <= len(self.key_name) <= 256:
            raise PolicyError("a key name has 1 to 256 characters")

    @classmethod
    def from_dict(cls, d: dict) -> Request:
        try:
            policies = tuple(Policy(p["column"], p.get("action", "retain"), dict(p.get("params") or {}), bool(p.get("is_quasi_identifier", False))) for p in d.get("policies", []))
            sensitive = d.get("sensitive_columns")
            return cls(policies, int(d.get("k", 5)), int(d.get("l", 1)), dict(d.get("dp_params") or {}), d.get("deterministic_key_name"), bool(d.get("accept_weaker_guarantee", False)), tuple(sensitive) if sensitive else None)
        except (KeyError, TypeError, ValueError, AttributeError):
            raise PolicyError("the request is not well formed") from None


def new_key() -> bytes:
    return secrets.token_bytes(32)


def derived_key(settings: Settings, name: str, policies: tuple[Policy, ...]) -> bytes:
    """A key that recurs for a name; refused without a lasting salt and beside noise."""
    if not settings.salt_is_lasting:
        raise PolicyError("a named key needs a lasting salt")
    if any(p.action == "dp_laplace" for p in policies):
        raise PolicyError("a named key and noise exclude each other")
    return hmac.new(settings.salt, _DERIVE + name.encode(), hashlib.sha256).digest()


def fold(df: DataFrame, policies: tuple[Policy, ...] | list[Policy], key: bytes, public: bool = False) -> DataFrame:
    """All policies but noise, in their order, as one projection.

    Several policies of a column follow each other; columns without one stay, and a
    policy for a column that is not there does nothing.
    """
    now: dict[str, tuple[Column, T.DataType]] = {f.name: (qcol(f.name), f.dataType) for f in df.schema.fields}
    for p in policies:
        if p.column not in now or p.action == "dp_laplace":
            continue
        if p.action == "drop":
            del now[p.column]
            continue
        try:
            now[p.column] = apply_action(p.action, *now[p.column], p.params, key, public)
        except PolicyError as e:
            raise PolicyError(f"{p.action} on {p.column}: {e}") from None
    return df.select(*[c.alias(name) for name, (c, _) in now.items()])


def noise_params(df: DataFrame, policies: tuple[Policy, ...], dp: dict[str, dict], settings: Settings) -> dict[str, Noise]:
    """Checked noise of each column of df that a policy wants noised."""
    out = {}
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for p in policies:
        if p.action != "dp_laplace" or p.column not in kinds:
            continue
        given = dp.get(p.column) or {}
        try:
            noise = Noise(*(float(given[k]) for k in ("epsilon", "lower", "upper")))
        except (KeyError, TypeError, ValueError):
            raise PolicyError(f"noise on {p.column} needs epsilon, lower and upper") from None
        if not settings.epsilon_min <= noise.epsilon <= settings.epsilon_max:
            raise PolicyError(f"epsilon of {p.column} is not within {settings.epsilon_min:g} and {settings.epsilon_max:g}")
        if not is_numeric(kinds[p.column]):
            raise PolicyError(f"{p.column} holds no numbers to noise")
        out[p.column] = noise
    return out


def with_noise(df: DataFrame, noise: dict[str, Noise]) -> DataFrame:
    return df.select(*[(noised(qcol(c), noise[c]) if c in noise else qcol(c)).alias(c) for c in df.columns])


def quasi_identifiers(df: DataFrame, policies: tuple[Policy, ...]) -> list[str]:
    return list(dict.fromkeys(p.column for p in policies if p.is_quasi_identifier and p.column in df.columns))


def sensitive_columns(df: DataFrame, policies: tuple[Policy, ...], qis: list[str], declared: tuple[str, ...] | None) -> list[str]:
    """Columns in clear text that are no quasi-identifier: the declared ones, or all."""
    last = {p.column: p.action for p in policies}
    clear = [c for c in df.columns if c not in qis and last.get(c, "retain") == "retain"]
    return [c for c in dict.fromkeys(declared) if c in clear] if declared else clear


# --- suggestions -------------------------------------------------------------------------

#: What is suggested for each kind of personal data.
CATALOG = {
    "defaults": {
        "by_pii_kind": {
            "email": {"action": "hash"},
            "phone": {"action": "mask", "params": {"keep_prefix": 1, "keep_suffix": 1}},
            "credit_card": {"action": "mask", "params": {"keep_prefix": 0, "keep_suffix": 4}},
            "government_id": {"action": "hash"},
            "name": {"action": "redact"},
            "address": {"action": "redact"},
            "date_of_birth": {"action": "date_truncate", "params": {"granularity": "month"}},
            "identifier": {"action": "tokenize"},
        },
        "by_kind": {k: {"action": "retain"} for k in ("numeric", "datetime", "categorical", "boolean", "string")},
    },
    "fields": {},
}


def merged(base: dict, over: dict) -> dict:
    """base with over laid upon it, objects within objects too."""
    both = lambda k: isinstance(base.get(k), dict) and isinstance(over.get(k), dict)
    return {k: merged(base[k], over[k]) if both(k) else over.get(k, base.get(k)) for k in {**base, **over}}


def checked_catalog(found: dict) -> dict:
    """found, or an error if its rules are not well formed."""
    defaults = found.get("defaults", {})
    if not isinstance(defaults, dict):
        raise VeilError("the defaults of the policy file must be an object")
    for group in (found.get("fields", {}), defaults.get("by_pii_kind", {}), defaults.get("by_kind", {})):
        if not isinstance(group, dict) or not all(isinstance(rule, dict) for rule in group.values()):
            raise VeilError("the rules of the policy file must be objects")
        for rule in group.values():
            if rule.get("action", "retain") not in ACTIONS:
                raise VeilError(f"the policy file has no action {rule.get('action')!r}")
            if not all(isinstance(rule.get(k) or {}, dict) for k in ("params", "dp_params")):
                raise VeilError("the parameters of the policy file must be objects")
    return found


#: Parameters that a user interface starts from.
OFFERED_PARAMS = {"mask": {"keep_prefix": 1, "keep_suffix": 1}, "string_truncate": {"keep": 3}, "date_truncate": {"granularity": "month"}}
_OFFERED_NAMES = {"mask": ("mask_char",), "string_truncate": ("pad_char",), "redact": ("replacement",), "tokenize": ("prefix",)}


def offered_params(action: str, suggested: dict | None = None, lower: float | None = None, upper: float | None = None) -> dict:
    """Parameters that a user interface sends for an action: what is suggested, or else defaults.

    Without a suggestion a bin is a tenth of the range, or 1 wide if there is no range.
    """
    given = {k: v for k, v in (suggested or {}).items() if v is not None}
    if action == "numeric_bin":
        wide = lower is not None and upper is not None and upper > lower
        return {"bin_width": given.get("bin_width", (upper - lower) / 10 if wide else 1)}
    start = OFFERED_PARAMS.get(action, {})
    named = {k: given[k] for k in _OFFERED_NAMES.get(action, ()) if given.get(k)}
    return {k: given.get(k, v) for k, v in start.items()} | named


def catalog(path: str | None = None) -> dict:
    """The catalog with a file of one's own laid over it."""
    if not path:
        return CATALOG
    try:
        over = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        raise VeilError("the policy file cannot be read") from None
    if not isinstance(over, dict):
        raise VeilError("the policy file must hold an object")
    return checked_catalog(merged(CATALOG, over))


def suggest(entry: dict, pii_kind: str, k: int, rules: dict | None = None, epsilon: float = Settings.epsilon) -> dict:
    """Action, parameters, quasi-identifier flag and source for a column of a schema profile."""
    rules = rules or CATALOG
    name, fields, defaults = entry["name"], rules.get("fields", {}), rules.get("defaults", {})
    low = {f.lower(): v for f, v in fields.items()}
    rule, source = None, "default"
    for found, tag in ((fields.get(name), "field"), (low.get(name.lower()), "field"), (defaults.get("by_pii_kind", {}).get(pii_kind), "pii_kind"), (defaults.get("by_kind", {}).get(entry["kind"]), "kind")):
        if found:
            rule, source = found, tag
            break
    rule = rule or {"action": "retain"}
    flag = rule.get("is_quasi_identifier")
    if flag is None:
        flag = pii_kind == "none" and entry["kind"] in ("numeric", "datetime", "categorical") and 0 < entry["n_unique"] * k <= entry["row_count"]
    out = {"column": name, "action": rule.get("action", "retain"), "params": dict(rule.get("params") or {}), "is_quasi_identifier": bool(flag), "source": source}
    if out["action"] == "dp_laplace":
        given = rule.get("dp_params") or {}
        # Bounds that come from the data say something about it: the report names them.
        out["dp_params"] = {"epsilon": given.get("epsilon", epsilon), "lower": given.get("lower", entry.get("min")), "upper": given.get("upper", entry.get("max"))}
        out["bounds_from_data"] = "lower" not in given or "upper" not in given
    return out


def suggested_request(profile: list[dict], pii: dict, k: int, rules: dict | None = None, epsilon: float = Settings.epsilon) -> Request:
    """A request made of all suggestions."""
    all_ = [suggest(e, pii[e["name"]][0].kind, k, rules, epsilon) for e in profile]
    return Request(tuple(Policy(s["column"], s["action"], s["params"], s["is_quasi_identifier"]) for s in all_), k=k, dp={s["column"]: s["dp_params"] for s in all_ if "dp_params" in s})
