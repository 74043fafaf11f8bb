"""Counters of a run while it goes on: figures that its own pass gathers, without a second one.

A batch's rows are observed as they go to their sink; a stream's batch by batch, which a listener adds up.
The observation stands right before the sink, in the stage that writes, where each partition counts once however
often its task is tried.
"""

from __future__ import annotations

import threading
from collections import Counter
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Kinds of events that the counters tell apart (fixed values).
KINDS = {"started": ("phase_start",), "ended": ("phase_end",), "scored": ("item_scored",), "errors": ("item_error", "error"), "degradations": ("degradation",)}


def figures(phases: tuple[str, ...]) -> list[Column]:
    """Aggregates over events (t, e, p, rest) for each of the phases: one of each kind, and tokens.  A null or other phase, or kind, counts in none."""
    number = lambda k: F.coalesce(F.try_element_at("rest", F.lit(k)).try_cast("long"), F.lit(0))
    out = [F.count(F.lit(1)).alias("events")]
    for i, p in enumerate(phases):
        here = F.coalesce(F.col("p") == p, F.lit(False))
        out += [F.count_if(here & F.coalesce(F.col("e").isin(*kinds), F.lit(False))).alias(f"{k}_{i}") for k, kinds in KINDS.items()]
        out.append(F.coalesce(F.sum(F.when(here, number("tokens_in") + number("tokens_out"))), F.lit(0)).alias(f"tokens_{i}"))
    return out


def status(done: int, errors: int, started: int) -> str:
    if done:
        return "done_with_errors" if errors else "done"
    return "running" if started else "pending"


@dataclass
class Progress:
    """What has gone through so far, by phase; ``phases`` are a run's, a dimension of a few."""

    phases: tuple[str, ...]
    name: str = "progress"
    _sums: Counter = field(default_factory=Counter)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def watched(self, events: DataFrame) -> DataFrame:
        """A stream's events, which ``Listener`` counts as they pass."""
        return events.observe(self.name, *figures(self.phases))

    def write(self, events: DataFrame, path: str) -> None:
        """A batch's events written as Parquet and counted by the same pass; a write that fails counts nothing."""
        seen = Observation(f"{self.name}-batch")
        events.observe(seen, *figures(self.phases)).write.mode("append").parquet(path)
        self.add(seen.get)

    def add(self, found: dict[str, Any]) -> None:
        with self._lock:
            self._sums.update({k: int(v or 0) for k, v in found.items()})

    @property
    def events(self) -> int:
        return self._sums["events"]

    def report(self) -> list[dict[str, Any]]:
        """A record a phase: how many of each kind, tokens, and where it stands."""
        with self._lock:
            rows = [{"p": p, **{k: self._sums[f"{k}_{i}"] for k in (*KINDS, "tokens")}} for i, p in enumerate(self.phases)]
        return [{**r, "status": status(r["ended"], r["errors"], r["started"])} for r in rows]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.report()], "p string, started long, ended long, scored long, errors long, degradations long, tokens long, status string")


class Listener(StreamingQueryListener):
    """Adds up what batches of the streams observed under a ``Progress``'s name; a batch that a stream runs again counts once."""

    def __init__(self, progress: Progress):
        self.progress, self._batches, self._ended = progress, set(), threading.Condition()
        self._over: set[str] = set()

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        row = p.observedMetrics.get(self.progress.name)
        if row is not None and (p.id, p.batchId) not in self._batches:
            self._batches.add((p.id, p.batchId))
            self.progress.add(row.asDict())

    def onQueryTerminated(self, event: Any) -> None:
        with self._ended:
            self._over.add(str(event.runId))
            self._ended.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Until the stream has ended and all its batches are counted."""
        query.awaitTermination()
        with self._ended:
            if not self._ended.wait_for(lambda: str(query.runId) in self._over, seconds):
                raise TimeoutError(f"the end of {query.runId} was not reported")
