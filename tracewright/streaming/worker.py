"""The task store at work: uploads as a stream of files, states as a stream of events, and a worker that drains the queue.

All timing is processing time. There are no event-time windows or watermarks here, because tasks have none.
"""

from __future__ import annotations

import datetime as dt
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewright import schemas
from tracewright.functions import misc
from tracewright.shipping import ship
from tracewright.sources import files
from tracewright.streaming.tasks import TaskLog, utc

EVENT = "id string, seq long, status string"


def now() -> dt.datetime:
    return dt.datetime.now(dt.UTC)


def accepted(status: str | None, wanted: str) -> bool:
    """T-1: whether a task may go from a status (None: unknown yet) to another: it begins queued, and ends once."""
    if wanted not in schemas.TASK_STATUSES:
        return False
    if status is None:
        return wanted == "queued"
    return status not in schemas.TERMINAL_STATUSES and wanted != status


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, seq = state.get if state.exists else (None, -1)
    taken = []
    for row in sorted((r for f in frames for r in f[["seq", "status"]].itertuples(index=False)), key=lambda r: r[0]):
        if row[0] > seq and accepted(status, row[1]):  # an older event that comes late changes nothing (T-13)
            taken.append((key[0], row[0], status, row[1]))
            status, seq = row[1], row[0]
    if status is not None:
        state.update((status, int(seq)))
    yield pd.DataFrame(taken, columns=["id", "seq", "from_status", "status"])


def state_stream(events: DataFrame) -> DataFrame:
    """T-1: a stream of EVENT -> the transitions that took place, with the state kept by task."""
    ship(events.sparkSession)
    return events.groupBy("id").applyInPandasWithState(_fold, "id string, seq long, from_status string, status string", "status string, seq long", "append", GroupStateTimeout.NoTimeout)


def upload_stream(spark: SparkSession, folder: str, checkpoint: str, log: TaskLog, owner: str, retention_hours: int = 72, clock: Callable[[], dt.datetime] = now) -> StreamingQuery:
    """Every new PDF of a folder becomes a queued task; files that are no PDFs or too large are left out."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pdf").load(folder)

    def take(batch: DataFrame, _: int) -> None:
        good = batch.filter(files.pdf_bytes_ok(F.col("content"), F.col("length"))).select("path", "length", misc.safe_file_name(F.col("path")).alias("name")).filter("name is not null")
        have = log.tasks.rows().select(F.col("pdf_path").alias("path")).filter("path is not null")
        at = clock()
        for r in good.join(have, "path", "left_anti").orderBy("path").toLocalIterator():  # names and sizes only; a repeated batch finds its tasks there
            log.create(id=str(uuid.uuid4()), owner_email=owner, file_name=r["name"], file_size=r["length"], file_type="application/pdf", pdf_path=r["path"], pdf_expires_at=utc(at + dt.timedelta(hours=retention_hours)), now=utc(at))

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Worker:
    """T-11: drains the queue with a few slots. process(task, progress) returns the audit (outcome, report, report_text, summary), or raises TaskFailed."""

    def __init__(self, log: TaskLog, process: Callable[[dict, Callable], dict], slots: int | None = None, poll_ms: int | None = None, clock: Callable[[], dt.datetime] = now):
        self.log, self.process, self.clock = log, process, clock
        self.slots, self.poll = misc.worker_slots(slots), misc.poll_milliseconds(poll_ms) / 1000
        self.stopping = threading.Event()

    def stop(self) -> None:
        """No further claims; tasks under way are given back when they notice."""
        self.stopping.set()

    def _one(self, task: dict) -> None:
        def progress(status: str, percent: int, pages: int, total: int) -> None:
            if self.stopping.is_set():
                raise Stopped
            self.log.progress(task["id"], status, percent, pages, total, utc(self.clock()))

        try:
            self.log.complete(task["id"], self.process(task, progress), utc(self.clock()))
        except Stopped:
            self.log.requeue(task["id"], utc(self.clock()))
        except TaskFailed as e:
            self.log.fail(task["id"], e.code, utc(self.clock()))
        except Exception:
            self.log.fail(task["id"], "INTERNAL_ERROR", utc(self.clock()))

    def run(self, until_idle: bool = False) -> int:
        """Recover what a crash left, then work until stopped (or until nothing is queued); the number of tasks handled."""
        self.log.recover(utc(self.clock()))
        handled, running = 0, set()
        with ThreadPoolExecutor(self.slots) as pool:
            while True:
                while len(running) < self.slots and not self.stopping.is_set() and (task := self.log.claim(utc(self.clock()))):
                    running.add(pool.submit(self._one, task))
                    handled += 1
                if running:
                    done, running = wait(running, timeout=self.poll, return_when=FIRST_COMPLETED)
                    for f in done:
                        f.result()
                elif until_idle or self.stopping.is_set():
                    return handled
                else:
                    self.stopping.wait(self.poll)


class Stopped(Exception):
    """The worker is asked to stop."""


class TaskFailed(Exception):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code
