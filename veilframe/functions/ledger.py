"""Epsilon spent on each column, in a log that several processes can share.

The log is a folder of numbered entries, each put there as a whole if no other has its number: who
comes second reads what the first wrote and tries again. A release *reserves* what it costs before
any noise is drawn, and *settles* or *aborts* once its files are whole or given up. What is reserved
counts as spent: a process that dies in between has spent it.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from veilframe.errors import BudgetError


class _Local:
    """Entries in a folder of the driver's machine."""

    def __init__(self, folder: str) -> None:
        self.folder = Path(folder.removeprefix("file://"))

    def read(self, n: int) -> str | None:
        try:
            return (self.folder / f"{n:012d}.json").read_text(encoding="utf-8")
        except FileNotFoundError:
            return None

    def put(self, n: int, text: str) -> bool:
        self.folder.mkdir(parents=True, exist_ok=True)
        with tempfile.NamedTemporaryFile("w", dir=self.folder, suffix=".new", delete=False, encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(f.name, self.folder / f"{n:012d}.json")  # fails if the entry is there
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(f.name)


class _Shared:
    """Entries on a file system that Spark reaches, whose rename does not replace."""

    def __init__(self, folder: str, spark: SparkSession) -> None:
        self.folder, self.jvm, self.gateway = folder.rstrip("/"), spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def read(self, n: int) -> str | None:
        path = self._path(f"{n:012d}.json")
        fs = path.getFileSystem(self.conf)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, n: int, text: str) -> bool:
        temp, target = self._path(f"{uuid.uuid4().hex}.new"), self._path(f"{n:012d}.json")
        fs = temp.getFileSystem(self.conf)
        out = fs.create(temp, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self.conf).rename(temp, target, options)
            return True
        except Exception:  # noqa: BLE001  Java's exception for a target that is there is not told apart by py4j
            if self.read(n) is None:
                raise
            return False
        finally:
            fs.delete(temp, False)


def _log(path: str):
    """The log in a folder: on this machine, or where the cluster's files are."""
    spark = SparkSession.getActiveSession()
    local = path.startswith("file:") or ("://" not in path and (spark is None or spark.sparkContext.master.startswith("local")))
    if local:
        return _Local(path.removeprefix("file://"))
    if spark is None:
        raise BudgetError("a ledger on a cluster's files needs a session")
    return _Shared(path, spark)


class Ledger:
    """Epsilon spent on each column, over all releases of a session, or, with a ``path``, of all processes.

    ``spent`` is what was there before; with a path the log counts, and the greater of both.
    """

    def __init__(self, budget: float, spent: dict[str, float] | None = None, path: str | None = None) -> None:
        self.budget, self._base, self._read = budget, dict(spent or {}), 0
        self._held: dict[str, dict[str, float]] = {}
        self._log = _log(f"{path}.log") if path else None
        if path and (old := Path(path.removeprefix("file://"))).is_file():  # one file with all that was spent
            self._base = self._greater(self._costs(old.read_text(encoding="utf-8")))
        self.refresh()

    def _greater(self, kept: dict[str, float]) -> dict[str, float]:
        return kept | {c: max(e, kept.get(c, 0.0)) for c, e in self._base.items()}

    @staticmethod
    def _costs(text: str) -> dict[str, float]:
        try:
            return {str(c): float(e) for c, e in json.loads(text).items()}
        except (ValueError, TypeError, AttributeError):
            raise BudgetError("the ledger of spent epsilon cannot be read") from None

    def refresh(self) -> None:
        """Reads entries that others have put there."""
        while self._log is not None and (text := self._log.read(self._read)) is not None:
            try:
                entry = json.loads(text)
                self._apply(entry["id"], entry["what"], entry["costs"])
            except (ValueError, TypeError, KeyError):
                raise BudgetError("the ledger of spent epsilon cannot be read") from None
            self._read += 1

    def _apply(self, token: str, what: str, costs: dict[str, float]) -> None:
        if what == "reserve":
            self._held[token] = {str(c): float(e) for c, e in costs.items()}
        elif what == "abort":
            self._held.pop(token, None)

    @property
    def spent(self) -> dict[str, float]:
        """What is spent, reserved amounts among it."""
        out = dict(self._base)
        for costs in self._held.values():
            for c, e in costs.items():
                out[c] = out.get(c, 0.0) + e
        return out

    def after(self, more: dict[str, float]) -> dict[str, float]:
        """What would be spent; an error if a column goes beyond the budget."""
        self.refresh()
        spent = self.spent
        out = {c: spent.get(c, 0.0) + more.get(c, 0.0) for c in {*spent, *more}}
        over = sorted(c for c in more if out[c] > self.budget + 1e-9)
        if over:
            raise BudgetError(f"the epsilon budget is used up for: {', '.join(over)}")
        return out

    def _append(self, token: str, what: str, costs: dict[str, float], checked: bool) -> None:
        while True:
            if checked:
                self.after(costs)
            if self._log is None:
                self._apply(token, what, costs)
                return
            if self._log.put(self._read, json.dumps({"id": token, "what": what, "costs": costs})):
                self.refresh()
                return
            self.refresh()  # another process was first

    def reserve(self, costs: dict[str, float]) -> str:
        """Sets costs aside before noise is drawn; an error if a column goes beyond the budget."""
        token = uuid.uuid4().hex
        self._append(token, "reserve", costs, True)
        return token

    def settle(self, token: str) -> None:
        """What was reserved is spent for good."""
        self._append(token, "settle", {}, False)

    def abort(self, token: str) -> None:
        """What was reserved is given back: nothing of it was released."""
        self._append(token, "abort", {}, False)

    def commit(self, more: dict[str, float]) -> None:
        """Reserves and settles at once."""
        self.settle(self.reserve(more))

    @property
    def greatest(self) -> float:
        return max(self.spent.values(), default=0.0)
