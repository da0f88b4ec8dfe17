"""``python -m veilframe process FILE``: a release without a service."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import replace
from pathlib import Path

from veilframe.config import load
from veilframe.errors import VeilError
from veilframe.operators.profile import detect, detection_sample, schema_profile
from veilframe.plans.engine import preflight, release
from veilframe.plans.policy import Request, catalog, suggested_request
from veilframe.session import session
from veilframe.sinks import write_release
from veilframe.sources.tables import read_table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilframe", description="Sanitise a table for sharing.")
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("process", "write a release"), ("preflight", "show what a release would suppress"), ("profile", "show columns and suggestions")):
        c = sub.add_parser(name, help=what)
        c.add_argument("file")
        c.add_argument("--policy", help="a request as JSON; without it, suggestions are used")
        c.add_argument("--catalog", default=os.environ.get("VEILFRAME_POLICY_FILE"), help="rules laid over the built-in suggestions")
        c.add_argument("-k", type=int)
        c.add_argument("-l", type=int)
        c.add_argument("--key-name")
        c.add_argument("--accept-weaker", action="store_true")
        c.add_argument("--output", default=".")
        c.add_argument("--parquet", action="store_true", help="write Parquet in parallel instead of one CSV file")
        c.add_argument("--master", help="Spark's master")
    return p


def _request(args, df, settings) -> tuple[Request, list[dict], dict]:
    profile, pii = schema_profile(df, settings.exact_distinct), detect(detection_sample(df, settings.sample_rows))
    if args.policy:
        try:
            request = Request.from_dict(json.loads(Path(args.policy).read_text(encoding="utf-8")))
        except (OSError, ValueError):
            raise VeilError("the policy cannot be read") from None
    else:
        request = suggested_request(profile, pii, args.k or settings.k, catalog(args.catalog), settings.epsilon)
    more = {"k": args.k, "l": args.l, "key_name": args.key_name, "accept_weaker": args.accept_weaker or None}
    return replace(request, **{n: v for n, v in more.items() if v is not None}), profile, pii


def run(argv: list[str] | None = None) -> dict:
    """What the command found; errors are VeilError."""
    args = parser().parse_args(argv)
    settings = load()
    spark = session(args.master)
    df = read_table(spark, args.file, settings.max_bytes)
    request, profile, pii = _request(args, df, settings)
    if args.command == "profile":
        return {"schema": profile, "pii": {c: [s.__dict__ for s in x] for c, x in pii.items()}, "policies": [p.__dict__ for p in request.policies]}
    if args.command == "preflight":
        return preflight(df, request, settings)
    stem = Path(args.file.rstrip("/")).stem
    found = release(df, request, settings, name=stem, profile=profile, pii=pii)
    return {"files": write_release(found, args.output, stem, args.parquet), "rows": found.report["validation"]["rows_after"], "suppressed": found.suppressed.rows_suppressed}


def main(argv: list[str] | None = None) -> int:
    try:
        print(json.dumps(run(argv), indent=2, ensure_ascii=False, default=lambda x: getattr(x, "__dict__", str(x))))
    except VeilError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
