"""Copies of a query's rows to a destination, as tasks that can be watched."""

from __future__ import annotations

import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from deltaloom.contract import Resource, Transfer
from deltaloom.operators.projection import adapt_case, omit_empty
from deltaloom.sources.loaders import load, save, write_change
from deltaloom.sources.staging import stage, unstage


@dataclass
class Task:
    id: str
    status: str = "running"
    error: str = ""
    rows: int = 0
    attempts: int = 0
    started: float = field(default_factory=time.time)
    ended: float | None = None


class Transfers:
    """Runs transfers; of more than ten tasks, those that ended over a minute ago are forgotten."""

    KEPT, KEPT_S = 10, 60

    def __init__(self, spark: SparkSession, threads: int = 2):
        self.spark, self._tasks, self._lock = spark, {}, threading.Lock()
        self._pool = ThreadPoolExecutor(threads)

    def run(
        self,
        source: Resource,
        dest: Resource,
        mode: str = "append",
        writers: int = 0,
        batch: int = 2048,
        retries: int = 2,
        omit: bool = False,
        like: list[str] | None = None,
        async_: bool = False,
    ) -> Task:
        """Copies ``source`` to ``dest``: ``writers`` partitions write in parallel, in batches.

        ``omit`` stores zeros and empty strings as null; ``like`` gives names whose case to adapt.
        With ``async_`` the task is returned at once, to be looked at again by its id. The source is
        read once; what a failed attempt wrote is not there when the next begins.
        """
        if not (dest.table or dest.path):
            raise ValueError("a transfer needs a destination table or path")
        if mode not in ("append", "overwrite"):
            raise ValueError("a transfer appends or overwrites")
        task = Task(uuid.uuid4().hex)
        with self._lock:
            self._evict()
            self._tasks[task.id] = task
        work = (task, source, dest, mode, writers, batch, retries, omit, like or [])
        if async_:
            self._pool.submit(self._attempts, *work)
        else:
            self._attempts(*work)
        return task

    def _attempts(self, task, source, dest, mode, writers, batch, retries, omit, like) -> None:
        for k in range(retries + 1):
            task.attempts = k + 1
            try:
                task.rows, task.status = self._copy(source, dest, mode, writers, batch, omit, like), "done"
                task.error = ""
                break
            except Exception as error:  # noqa: BLE001 - kept with the task
                task.error = str(error)
                if k == retries:
                    task.status = "error"
        task.ended = time.time()

    def _copy(self, source, dest, mode, writers, batch, omit, like) -> int:
        """The number of rows copied. Rows are counted as they pass, not read again.

        An append to a JDBC table goes through a table of its own and one transaction, since its
        partitions commit one by one; files appear only when all are written.
        """
        df = load(self.spark, source)
        df = adapt_case(omit_empty(df) if omit else df, like)
        seen = Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
        if dest.format == "jdbc" and mode == "append" and self._exists(dest):
            from deltaloom.plans.engine import Change

            held = stage(counted, "transfer")
            write_change(load(self.spark, dest), Change(add=held), dest, Transfer(writers=writers, batch_size=batch))
            unstage(held)
        else:
            save(counted, dest, mode, writers, batch)
        return int(seen.get["n"])

    def _exists(self, dest: Resource) -> bool:
        try:
            load(self.spark, dest)
        except Exception:  # noqa: BLE001 - the driver's own error for a missing table
            return False
        return True

    def get(self, id_: str) -> Task:
        return self._tasks[id_]

    def list(self) -> list[Task]:
        """Newest first."""
        return sorted(self._tasks.values(), key=lambda t: -t.started)

    def _evict(self) -> None:
        if len(self._tasks) > self.KEPT:
            now = time.time()
            for k in [k for k, t in self._tasks.items() if t.ended and now - t.ended > self.KEPT_S]:
                del self._tasks[k]
