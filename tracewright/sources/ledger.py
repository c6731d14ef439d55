"""A ledger of the model's answers, so that a call that was paid for is never repeated.

An answer is known by the hash of who is asked, about which document in which version, and the request. Requests without an answer are written down once, dealt to rounds, and
asked round by round; each round is one map-only job that appends its answers. A task that ends has its answers in the shared folder, whatever happens to its executor
later; a task that is lost asks its own batch again, and a run that breaks off leaves all rounds before in the ledger. Failures are rows as well, but only for their run: the next
one asks again. Within a task several calls are under way at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.shipping import ship
from tracewright.sources.gateway import OUTPUTS, ask

KEPT = "key string, stage string, run string, output string, error string"


class Cancelled(Exception):
    """The run was asked to stop."""


def settled(items: list, slots: int, call: Callable) -> list[tuple[object, Exception | None]]:
    """call(item) of each, at most `slots` at a time, in the items' order: (result, None), or (None, what it raised)."""

    def one(item):
        try:
            return call(item), None
        except Exception as e:  # a settled failure; the others go on
            return None, e

    if slots <= 1 or len(items) <= 1:
        return [one(i) for i in items]
    with ThreadPoolExecutor(min(slots, len(items))) as pool:
        return list(pool.map(one, items))


class AnswerLedger:
    """The answers under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = f"{self.folder}/answers"
        if not self._exists(self.path):
            spark.createDataFrame([], KEPT).write.mode("append").parquet(self.path)

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(KEPT).parquet(self.path)

    def answers(self, stage: str, run: str) -> DataFrame:
        """key, output, error: an answer of any run, else this run's failure."""
        told = self.rows().filter((F.col("stage") == stage) & (F.col("error").isNull() | (F.col("run") == run)))
        best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "output", "error")).alias("a")
        return told.groupBy("key").agg(best).select("key", "a.output", "a.error")

    def fill(self, stage: str, run: str, requests: DataFrame, answer: Callable[[str], tuple[str | None, str | None]], *, tasks: int, calls: int, batch: int, check: Callable[[], None]) -> int:
        """Ask what no run has answered; requests(key, request). The number of requests asked."""
        known = self.rows().filter((F.col("stage") == stage) & F.col("error").isNull()).select("key")
        new = requests.dropDuplicates(["key"]).join(known, "key", "left_anti")
        new = new.withColumn("place", F.xxhash64("key"))
        path = f"{self.folder}/asked/{run}-{stage}"
        new.write.parquet(path)
        asked = self.spark.read.schema(new.schema).parquet(path)
        n = asked.count()
        rounds = -(-n // (tasks * batch))
        if rounds > 1:  # a round reads its own files
            asked.withColumn("round", F.pmod("place", F.lit(rounds)).cast("int")).repartition("round").write.partitionBy("round").parquet(f"{path}-rounds")

        def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                got = settled(frame["request"].tolist(), calls, answer)
                told = [a if e is None else (None, "INTERNAL_ERROR") for a, e in got]
                yield pd.DataFrame({"key": frame["key"], "stage": stage, "run": run, "output": [t[0] for t in told], "error": [t[1] for t in told]})

        for r in range(rounds):
            check()
            part = asked if rounds == 1 else self.spark.read.parquet(f"{path}-rounds").filter(F.col("round") == r)
            part.select("key", "request").repartition(tasks).mapInPandas(call, KEPT).write.mode("append").parquet(self.path)
        return n


class LedgerProvider:
    """A provider that calls send(stage, request, correction), through a ledger.

    `name` tells the model and its settings: another name asks again. versions(doc_id, fingerprint) tells the documents' contents, which requests don't hold.
    At most tasks x calls calls are under way; a task asks `batch` requests before its answers are kept. check() is called before each round and may raise Cancelled."""

    def __init__(self, send: Callable[[str, str, str | None], str], ledger: AnswerLedger, name: str, *, versions: DataFrame | None = None, tasks: int = 3, calls: int = 1, batch: int = 16, measure: Callable[[str, DataFrame], DataFrame] | None = None, check: Callable[[], None] = lambda: None):
        self.send, self.ledger, self.name, self.versions, self.measure, self.check = send, ledger, name, versions, measure, check
        self.tasks, self.calls, self.batch = tasks, calls, batch
        self.run = uuid.uuid4().hex
        self.asked: dict[str, int] = {}

    def _key(self, stage: str) -> Column:
        part = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)  # noqa: E731  no two lists of parts are one text
        return F.sha2(F.concat(*[part(c) for c in (F.lit(self.name), F.lit(stage), F.col("doc_id"), F.coalesce("fingerprint", F.lit("")), F.col("request"))]), 256)

    def answers(self, stage: str, requests: DataFrame) -> DataFrame:
        ship(requests.sparkSession)
        send, spec = self.send, OUTPUTS[stage]
        known = requests.select("doc_id", "batch", "part", "request")
        known = known.join(self.versions.select("doc_id", "fingerprint"), "doc_id", "left") if self.versions is not None else known.withColumn("fingerprint", F.lit(""))
        known = known.withColumn("key", self._key(stage))
        answer = lambda request: ask(lambda r, c: send(stage, r, c), request, spec)
        n = self.ledger.fill(stage, self.run, known.select("key", "request"), answer, tasks=self.tasks, calls=self.calls, batch=self.batch, check=self.check)
        self.asked[stage] = self.asked.get(stage, 0) + n
        told = self.ledger.answers(stage, self.run)
        return known.select("doc_id", "batch", "part", "key").join(told, "key", "left").select("doc_id", "batch", "part", "output", F.when(F.col("output").isNull(), F.coalesce("error", F.lit("MODEL_UNAVAILABLE"))).alias("error"))

    def sizes(self, kind: str, items: DataFrame) -> DataFrame:
        return self.measure(kind, items) if self.measure else items.withColumn("bytes", F.lit(0).cast("long"))
