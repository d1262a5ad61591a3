"""Events of operations: what ran, how it ended and how much it was, never content.

``operation_events`` gives the events of each row as rows. An ``Observer`` calls back on the driver,
once for each watched operation, kind and batch, from counters that the tasks add up.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..config import LIMIT, Engine
from .metrics import status_texts

SUCCESS, FAILURE, RESOURCE = 1, 2, 4
KINDS = {SUCCESS: "success", FAILURE: "failure", RESOURCE: "resource"}
ALL_KINDS = SUCCESS | FAILURE | RESOURCE


def event_kind(status: Column) -> Column:
    """1 for a success, 4 for what a limit rejected, 2 for any other failure; null where nothing ran."""
    return F.when(status == 0, SUCCESS).when(status == LIMIT, RESOURCE).when(status.isNotNull(), FAILURE)


def operation_events(df: DataFrame, keys: list[str], steps: list[tuple[str, Column, Column, Column]], mask: int = ALL_KINDS) -> DataFrame:
    """(keys, sequence, operation, kind, status, status_text, input_units, output_units) of each row's operations.

    steps: (operation, status, input units, output units) in the order in which they ran. An
    operation whose status is null didn't run. Only events of the mask's kinds are numbered, from 1
    on within the row, so that the numbers have no gaps. Map-only.
    """
    made = [
        F.struct(F.lit(name).alias("operation"), event_kind(status).alias("kind"), status.cast("int").alias("status"), taken.cast("bigint").alias("input_units"), given.cast("bigint").alias("output_units"))
        for name, status, taken, given in steps
    ]
    wanted = F.filter(F.array(*made), lambda e: F.coalesce(e["kind"].bitwiseAND(mask) > 0, F.lit(False)))
    rows = df.select(*keys, F.posexplode(wanted).alias("__at", "__event"))
    names = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("__event.kind"))
    return rows.select(*keys, (F.col("__at") + 1).alias("sequence"), "__event.operation", names.alias("kind"), "__event.status", status_texts(F.col("__event.status")).alias("status_text"), "__event.input_units", "__event.output_units")


@dataclass(frozen=True)
class Event:
    sequence: int
    kind: int
    operation: str
    operations: int
    input_units: int
    output_units: int
    resource_limit: int
    fingerprint: bytes
    batch: int | None = None


class Observer:
    """Calls ``callback(event)`` for operations that are watched.

    Events have one sequence without gaps, whatever threads they come from. A callback that uses
    the observer itself gets no events of that: they are left out and not numbered.
    """

    def __init__(self, callback: Callable[[Event], None], engine: Engine | None = None, mask: int = ALL_KINDS):
        self.callback, self.mask = callback, mask
        self.fingerprint = engine.fingerprint() if engine else b""
        self.limit = engine.limits.max_input_bytes if engine else 0
        self.sequence = 0
        self._watched: dict[str, str] = {}
        self._pending: list[tuple[str, Observation]] = []
        self._lock, self._inside = threading.RLock(), threading.local()

    def watch(self, df: DataFrame, operation: str, status: Column, taken: Column, given: Column) -> DataFrame:
        """df whose rows are counted as events of an operation (status, input and output units) when an action runs.

        Of a batch, ``deliver`` hands them over; of a stream, the listener does after each micro-batch.
        """
        counters = []
        for kind, name in KINDS.items():
            mine = event_kind(status) == kind
            counters.append(F.count_if(mine).alias(f"{name}_n"))
            counters += [F.coalesce(F.sum(F.when(mine, x.cast("bigint"))), F.lit(0)).alias(f"{name}_{what}") for what, x in (("in", taken), ("out", given))]
        with self._lock:
            name = f"{id(self):x}-{len(self._watched)}"
            self._watched[name] = operation
        if df.isStreaming:
            return df.observe(name, *counters)
        seen = Observation(name)
        self._pending.append((operation, seen))
        return df.observe(seen, *counters)

    def deliver(self) -> None:
        """The events of watched batches, in the order in which they were watched. Call it after the action."""
        pending, self._pending = self._pending, []
        for operation, seen in pending:
            self._emit(operation, seen.get, None)

    def listener(self) -> StreamingQueryListener:
        """For ``spark.streams.addListener``: events of the watched streams, batch by batch."""
        observer = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                pass

            def onQueryProgress(self, event):
                found = event.progress.observedMetrics
                for name, operation in list(observer._watched.items()):  # in the order of watching
                    if name in found:
                        observer._emit(operation, found[name].asDict(), event.progress.batchId)

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                pass

        return Listener()

    def _emit(self, operation: str, counters: dict, batch: int | None) -> None:
        if getattr(self._inside, "callback", False):
            return
        for kind, name in KINDS.items():
            n = int(counters[f"{name}_n"])
            if not n or not kind & self.mask:
                continue
            with self._lock:
                self.sequence += 1
                event = Event(self.sequence, kind, operation, n, int(counters[f"{name}_in"]), int(counters[f"{name}_out"]), self.limit if kind == RESOURCE else 0, self.fingerprint, batch)
                self._inside.callback = True
                try:
                    self.callback(event)
                finally:
                    self._inside.callback = False
