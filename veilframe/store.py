"""Sessions of a service: a table, a key, an output and what was spent on it."""

from __future__ import annotations

import hashlib
import secrets
import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from veilframe.errors import VeilError
from veilframe.functions.ledger import Ledger
from veilframe.plans.policy import new_key


@dataclass
class Entry:
    """One session; ``expires`` counts from its creation and is not put off."""

    df: DataFrame
    expires: float
    ledger: Ledger
    key: bytearray = field(default_factory=lambda: bytearray(new_key()))
    output: object = None
    report: dict | None = None
    busy: bool = False


class Store:
    """Sessions by id, safe for threads; one run at a time in each.

    folder: where what is spent on named datasets lasts.
    """

    def __init__(self, seconds: int, budget: float, clock=time.monotonic, folder: str | None = None) -> None:
        self._entries: dict[str, Entry] = {}
        self._ledgers: dict[str, Ledger] = {}
        self._folder = folder
        self._lock = threading.Lock()
        self._seconds, self._budget, self._clock = seconds, budget, clock

    def create(self, df: DataFrame, dataset: str | None = None) -> str:
        """A session's id; sessions of one named dataset share what is spent on it."""
        self.sweep()
        name = secrets.token_urlsafe(24)
        with self._lock:
            self._entries[name] = Entry(df, self._clock() + self._seconds, self._ledger(dataset))
        return name

    def _ledger(self, dataset: str | None) -> Ledger:
        if dataset is None:
            return Ledger(self._budget)
        if dataset not in self._ledgers:
            file = hashlib.sha256(dataset.encode()).hexdigest()[:32]
            self._ledgers[dataset] = Ledger(self._budget, path=f"{self._folder}/{file}.json" if self._folder else None)
        return self._ledgers[dataset]

    def get(self, name: str) -> Entry:
        with self._lock:
            found = self._entries.get(name)
            if found is None or found.expires <= self._clock():
                raise VeilError("there is no such session")
            return found

    def begin(self, name: str) -> Entry:
        """Starts a run: an earlier output goes, and a second run is refused meanwhile."""
        found = self.get(name)
        with self._lock:
            if found.busy:
                raise VeilError("a run of this session is going on")
            found.busy, found.output, found.report = True, None, None
        return found

    def finish(self, name: str, output=None, report: dict | None = None, costs: dict[str, float] | None = None, token: str | None = None) -> None:
        """Ends a run; output and what it spent are stored together or not at all.

        token: what the run has reserved, settled with a report and given back without one.
        """
        with self._lock:
            found = self._entries.get(name)
            if found is not None:
                found.busy = False
                if report is not None:
                    if costs:
                        found.ledger.commit(costs)
                    found.output, found.report = output, report
                if token is not None:
                    (found.ledger.abort if report is None else found.ledger.settle)(token)

    def delete(self, name: str) -> bool:
        with self._lock:
            found = self._entries.pop(name, None)
        if found is None:
            return False
        found.key[:] = bytes(len(found.key))
        found.df.unpersist()
        found.output = found.report = None
        return True

    def sweep(self) -> int:
        """Deletes what has expired."""
        now = self._clock()
        with self._lock:
            old = [k for k, e in self._entries.items() if e.expires <= now and not e.busy]
        return sum(self.delete(k) for k in old)

    def __len__(self) -> int:
        return len(self._entries)
