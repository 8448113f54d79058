"""Runs of jobs: a lock with a lease, retries, checkpoints of model answers, and runs in the background that can be cancelled."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable
from typing import Any, TypeVar

from py4j.protocol import Py4JJavaError
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.tables import Conflict, Table

X = TypeVar("X")
LEASE_S = 300.0


class Lock:
    """A numbered file in a folder that only one driver can create; `with Lock(...)` raises BlockingIOError where another driver
    holds it. The holder writes its file anew three times a lease; a file older than a lease is a dead driver's, and the
    next number takes over from it. Files are created only if there is none of their name (see sources.tables)."""

    def __init__(self, spark: SparkSession, path: str, owner: str, lease: float = LEASE_S):
        self.spark, self.path, self.owner, self.lease = spark, path.rstrip("/"), owner, lease
        self.number, self.stop = 0, threading.Event()

    def _place(self, number: int | None = None):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path if number is None else f"{self.path}/{number:012d}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> dict[int, float]:
        """Number and age in seconds of the files."""
        folder, fs = self._place()
        found = fs.listStatus(folder) if fs.exists(folder) else []
        return {int(f.getPath().getName()): time.time() - f.getModificationTime() / 1000 for f in found if f.getPath().getName().isdigit()}

    def _write(self, again: bool) -> None:
        path, fs = self._place(self.number)
        out = fs.create(path, again)
        out.write(bytearray(self.owner.encode()))
        out.close()

    def held(self) -> bool:
        """Whether this lock still counts; a driver that slept through its lease finds that it doesn't."""
        return self.number > 0 and max(self._numbers(), default=0) == self.number

    def _keep(self) -> None:
        while not self.stop.wait(self.lease / 3):
            if not self.held():
                return
            self._write(True)

    def __enter__(self) -> Lock:
        ages = self._numbers()
        last = max(ages, default=0)
        if last and ages[last] < self.lease:
            raise BlockingIOError(f"{self.path} is held by another run")
        self.number = last + 1
        try:
            self._write(False)
        except Py4JJavaError as e:
            self.number = 0
            raise BlockingIOError(f"{self.path} is held by another run") from e
        for old in ages:
            path, fs = self._place(old)
            fs.delete(path, False)
        self.stop.clear()
        threading.Thread(target=self._keep, daemon=True).start()
        return self

    def __exit__(self, *_: object) -> None:
        self.stop.set()
        if self.held():
            path, fs = self._place(self.number)
            fs.delete(path, False)
        self.number = 0


def retried(work: Callable[[], X], retries: int = 2, base: float = 2.0, cap: float = 60.0, limit: float | None = 600.0, sleep: Callable[[float], None] = time.sleep) -> X:
    """work(), again after an error with waits that double up to a cap; TimeoutError if an answer took too long."""
    for attempt in range(retries + 1):
        start = time.monotonic()
        try:
            out = work()
        except Exception:
            if attempt == retries:
                raise
            sleep(min(cap, base * 2**attempt))
            continue
        if limit is not None and time.monotonic() - start > limit:
            raise TimeoutError(f"took more than {limit} s")
        return out
    raise AssertionError


def checkpoint_key(*parts: Any) -> str:
    """The same key for the same parts, whatever the order of a dictionary's entries."""
    return hashlib.sha256(json.dumps(parts, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def with_checkpoints(asked: DataFrame, table: Table, key: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """asked: rows with a key. Their answers (key, payload): those in the table, and new ones, which are added to it."""
    known = table.read()
    new = asked if known is None else asked.join(known.select(key), key, "left_anti")
    if not new.isEmpty():
        table.merge(answer(new).select(key, "payload"))
    now = table.read()
    return asked.join(now, key) if now is not None else asked.limit(0).withColumn("payload", F.lit(None).cast("string"))


class Cancelled(Exception):
    pass


RUN_DDL = "run_id string, status string, nodes long, edges long, started double, seconds double, message string"


class Run:
    """A run in a table of runs; check() at the border of a source raises Cancelled once someone asked for it."""

    def __init__(self, spark: SparkSession, table: Table, run_id: str):
        self.spark, self.table, self.run_id, self.started = spark, table, run_id, time.time()

    def set(self, status: str, message: str = "", **counts: int) -> None:
        """Write the state; another driver's write in between is no error."""
        row = (self.run_id, status, counts.get("nodes"), counts.get("edges"), self.started, round(time.time() - self.started, 3), message)
        rows = self.spark.createDataFrame([row], RUN_DDL)
        for attempt in range(10):
            try:
                self.table.merge(rows)
                return
            except Conflict:
                if attempt == 9:
                    raise
                time.sleep(0.1 * 2**attempt)

    def status(self) -> str | None:
        rows = self.table.read()
        found = rows.where(F.col("run_id") == self.run_id).first() if rows is not None else None
        return found.status if found else None

    def _sign(self, name: str):
        """The place of a small file about this run; requests don't wait for Spark's tasks, which a run may keep busy."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.table.path}/{name}-{self.run_id}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        path, fs = self._sign(name)
        return fs.exists(path)

    def _put(self, name: str, there: bool) -> None:
        path, fs = self._sign(name)
        if there:
            fs.create(path, True).close()
        else:
            fs.delete(path, False)

    def asked_to_stop(self) -> bool:
        return self._there("cancel")

    def cancel(self) -> bool:
        """Ask the run to stop, from any driver; False if it isn't running."""
        if not self._there("running"):
            return False
        self._put("cancel", True)
        return True

    def check(self) -> None:
        if self.asked_to_stop() or self.status() == "cancel_requested":
            self.set("cancelled")
            raise Cancelled(self.run_id)

    def start(self, work: Callable[[Run], dict[str, int]], poll: float = 1.0) -> InheritableThread:
        """work(self) in a thread whose Spark jobs are a group. Its counts go into the table when it is done. A request to
        cancel, from any driver, is seen within `poll` seconds and stops the jobs that run."""
        over = threading.Event()
        self.set("running")
        self._put("running", True)
        context = self.spark.sparkContext

        def body() -> None:
            context.setJobGroup(self.run_id, f"run {self.run_id}", interruptOnCancel=True)
            try:
                status, message, counts = "completed", "", work(self)
            except BaseException as e:
                asked = isinstance(e, Cancelled) or self.asked_to_stop()
                status, message, counts = ("cancelled", "", {}) if asked else ("failed", f"{type(e).__name__}: {e}"[:500], {})
            over.set()
            context._jsc.clearJobGroup()  # what follows isn't to be cancelled
            self.set(status, message, **counts)
            self._put("running", False)
            self._put("cancel", False)

        def watch() -> None:
            while not over.wait(poll):
                if self.asked_to_stop():
                    context.cancelJobGroup(self.run_id)

        thread = InheritableThread(target=body, daemon=True)
        thread.start()
        threading.Thread(target=watch, daemon=True).start()
        return thread


def new_run(spark: SparkSession, table: Table) -> Run:
    return Run(spark, table, uuid.uuid4().hex)
