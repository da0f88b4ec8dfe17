"""Settings from the environment."""

from __future__ import annotations

import os
import secrets
from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import urlparse

from veilframe.errors import VeilError

PREFIX = "VEILFRAME_"


@dataclass(frozen=True)
class Settings:
    """Limits and defaults; ``salt_is_lasting`` says whether derived keys can recur.

    exact_distinct: whether reported numbers of distinct values are exact; ledger: a folder in
    which spent epsilon lasts over restarts.
    """

    max_bytes: int = 300 * 1024 * 1024
    session_seconds: int = 1800
    sample_rows: int = 10_000
    k: int = 5
    epsilon: float = 1.0
    epsilon_min: float = 0.1
    epsilon_max: float = 10.0
    epsilon_budget: float = 10.0
    soft_cap: float = 0.10
    hard_cap: float = 0.50
    exact_distinct: bool = True
    ledger: str | None = None
    origins: tuple[str, ...] = ()
    salt: bytes = b""
    salt_is_lasting: bool = False


def load(env: Mapping[str, str] | None = None) -> Settings:
    """Settings from variables that begin with ``VEILFRAME_``; wrong ones are errors."""
    env = os.environ if env is None else env

    def number(name: str, kind: type, default):
        text = env.get(PREFIX + name, "").strip()
        if not text:
            return default
        try:
            return kind(text)
        except ValueError:
            raise VeilError(f"{PREFIX}{name} is not a number") from None

    d = Settings()
    most = number("EPSILON_MAX", float, d.epsilon_max)
    salt = env.get(PREFIX + "SALT", "").strip()
    try:
        raw = bytes.fromhex(salt)
    except ValueError:
        raise VeilError(f"{PREFIX}SALT is not hexadecimal") from None
    out = Settings(
        max_bytes=number("MAX_BYTES", int, d.max_bytes),
        session_seconds=number("SESSION_SECONDS", int, d.session_seconds),
        sample_rows=number("SAMPLE_ROWS", int, d.sample_rows),
        k=number("K", int, d.k),
        epsilon=number("EPSILON", float, d.epsilon),
        epsilon_min=number("EPSILON_MIN", float, d.epsilon_min),
        epsilon_max=most,
        epsilon_budget=number("EPSILON_BUDGET", float, most),
        soft_cap=number("SOFT_CAP", float, d.soft_cap),
        hard_cap=number("HARD_CAP", float, d.hard_cap),
        exact_distinct=env.get(PREFIX + "EXACT_DISTINCT", "1").strip().lower() not in ("0", "false", "no"),
        ledger=env.get(PREFIX + "LEDGER", "").strip() or None,
        origins=tuple(o.strip() for o in env.get(PREFIX + "ORIGINS", "").split(",") if o.strip()),
        salt=raw or secrets.token_bytes(32),
        salt_is_lasting=bool(raw),
    )
    if out.k < 2:
        raise VeilError("k must be 2 at least")
    if not out.epsilon_min < out.epsilon_max:
        raise VeilError("the least epsilon must be below the greatest")
    if out.epsilon_budget <= 0:
        raise VeilError("the epsilon budget must be above 0")
    if not out.soft_cap < out.hard_cap:
        raise VeilError("the soft cap must be below the hard cap")
    for o in out.origins:
        at = urlparse(o)
        if at.scheme not in ("http", "https") or not at.netloc:
            raise VeilError("an origin must be an http or https address")
    return out
