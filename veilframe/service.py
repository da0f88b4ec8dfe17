"""The verbs of a service over sessions: what a web layer would call, without the web.

upload -> preview / preflight -> process -> downloads -> delete. Outputs are files in a
folder of the caller's; epsilon is reserved before noise is drawn, and given back if they are not whole.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession

from veilframe.config import Settings, load
from veilframe.errors import VeilError
from veilframe.operators.profile import detect, detection_sample, schema_profile
from veilframe.plans import engine
from veilframe.plans.policy import Request, catalog, suggest
from veilframe.plans.report import to_json, to_markdown
from veilframe.sinks import write_csv, write_parquet
from veilframe.sources.tables import read_table
from veilframe.store import Store


class Service:
    """All sessions of one process."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None, rules: str | None = None) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.settings = settings or load()
        self.store = Store(self.settings.session_seconds, self.settings.epsilon_budget, folder=self.settings.ledger)
        self.rules = catalog(rules)

    def upload(self, path: str) -> dict:
        """A session for a file: schema, personal data found, and a suggestion for each column."""
        df = read_table(self.spark, path, self.settings.max_bytes)
        return self.open(df)

    def open(self, df: DataFrame, dataset: str | None = None) -> dict:
        """The same for a table; what is spent on a named ``dataset`` adds up over sessions and restarts."""
        profile = schema_profile(df, self.settings.exact_distinct)
        found = detect(detection_sample(df, self.settings.sample_rows))
        name = self.store.create(df, dataset)
        return {
            "session": name,
            "rows": profile[0]["row_count"] if profile else 0,
            "schema": profile,
            "pii": {c: [s.__dict__ for s in x] for c, x in found.items()},
            "policies": [suggest(e, found[e["name"]][0].kind, self.settings.k, self.rules, self.settings.epsilon) for e in profile],
        }

    def preview(self, name: str, request: dict) -> list[dict]:
        entry = self.store.get(name)
        return engine.preview(entry.df, Request.from_dict(request), self.settings, bytes(entry.key))

    def preflight(self, name: str, request: dict) -> dict:
        entry = self.store.get(name)
        return engine.preflight(entry.df, Request.from_dict(request), self.settings, bytes(entry.key))

    def process(self, name: str, request: dict, parquet: bool = False) -> dict:
        """A release; the session's earlier output goes, whether this one succeeds or not."""
        wanted = Request.from_dict(request)
        entry = self.store.begin(name)
        output = report = token = None
        try:
            found = engine.release(entry.df, wanted, self.settings, bytes(entry.key), name=name, ledger=entry.ledger)
            token = found.token
            write = write_parquet if parquet else write_csv
            output = write(found.df, f"{self.folder}/{name}.{'parquet' if parquet else 'csv'}")
            report = found.report
        finally:
            self.store.finish(name, output, report, token=token)
        return report

    def download(self, name: str, what: str = "table") -> str:
        """The path of the table, or the report as ``json`` or ``markdown``."""
        entry = self.store.get(name)
        if entry.report is None:
            raise VeilError("there is no output")
        if what == "table":
            return entry.output
        if what not in ("json", "markdown"):
            raise VeilError("table, json and markdown can be downloaded")
        return (to_json if what == "json" else to_markdown)(entry.report)

    def delete(self, name: str) -> bool:
        with contextlib.suppress(VeilError):
            output = self.store.get(name).output
            if output:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(output)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return self.store.delete(name)

    def health(self) -> dict:
        return {"ok": not self.spark.sparkContext._jsc.sc().isStopped(), "sessions": len(self.store)}
