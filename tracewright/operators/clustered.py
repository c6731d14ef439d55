"""The history as files ordered by owner and time, with an index of the files, so that a page reads a few of them.

Tasks are dealt to files by ranges of (owner, time descending, id descending). The index has a row for each owner in each file: the first and the last task's place and the figures of the
dashboard. A page asks the index for the first files that may hold rows behind the cursor and within the times, reads one of them, then two, four and so on until the page is full; it never
lists more of the index than that. Figures of an owner, and of all, come from the index alone.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.streaming import tasks as store

#: Tasks of a file, about.
FILE_ROWS = 200_000
#: Files that one task writes, one after the other, about: what the driver hears of a layout (samples of ranges, results of tasks) grows with the tasks.
TASK_FILES = 100


def _order():
    return F.col("owner_email"), F.col("created_at").desc(), F.col("id").desc()


@dataclass
class Page:
    """Rows in their order (at most the limit), the cursor of the next page or None, and how many files were read."""

    rows: list
    cursor: tuple[str, str] | None
    files_read: int


class ClusteredHistory:
    """Tasks(id, owner_email, created_at, status, outcome, issue_count, ...) under a folder. A layout is written whole; readers see it once its index is there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, tasks: DataFrame, file_rows: int = FILE_ROWS) -> None:
        """The layout of these tasks; null owners or times have no history and are left out."""
        rows = tasks.filter("owner_email is not null and created_at is not null and id is not null")
        files = max(1, -(-rows.count() // file_rows))
        data = f"{self.folder}/data-{uuid.uuid4().hex}"
        tasks = min(files, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-files // TASK_FILES)))
        rows.repartitionByRange(tasks, *_order()).sortWithinPartitions(*_order()).write.option("maxRecordsPerFile", file_rows).parquet(data)
        kept = self.spark.read.schema(rows.schema).parquet(data)
        place = F.struct("created_at", "id")
        index = kept.groupBy("owner_email", F.col("_metadata.file_path").alias("file")).agg(
            F.count(F.lit(1)).alias("n"), F.max(place).alias("newest"), F.min(place).alias("oldest"),
            F.count_if(~store.terminal()).alias("active"), F.count_if(F.col("outcome") == "needs_review").alias("needs_review"), F.sum(F.coalesce("issue_count", F.lit(0))).alias("issues"),
        )
        index.repartitionByRange(max(1, files // 1000), "owner_email").sortWithinPartitions("owner_email").write.mode("overwrite").parquet(f"{self.folder}/index")

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/index")

    def kpis(self, owner: str | None = None) -> DataFrame:
        """Active, needs_review, issues, of an owner or of all, without a read of the tasks."""
        rows = self.index() if owner is None else self.index().filter(F.col("owner_email") == owner)
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
        return rows.agg(total("active"), total("needs_review"), total("issues"))

    def cursor(self, owner: str, task: str) -> tuple[str, str] | None:
        """The place of the owner's task; None where there is none."""
        found = self._rows().filter((F.col("owner_email") == owner) & (F.col("id") == task)).select("created_at", "id").first()  # other owners' row groups are skipped by their statistics
        return None if found is None else tuple(found)

    def _rows(self, files: list[str] | None = None) -> DataFrame:
        if files is None:
            first = self.index().select("file").first()
            return self.spark.read.parquet(first["file"].rsplit("/", 1)[0])
        return self.spark.read.parquet(*files)

    def page(self, owner: str, *, query: str | None = None, created_from: str | None = None, created_to: str | None = None, after: tuple[str, str] | None = None, limit: int = store.DEFAULT_LIMIT) -> Page:
        """The owner's tasks, newest first, that match and lie behind `after` (time and id of the last one seen)."""
        found: list = []
        at, read, step = after, 0, 1
        while True:
            # Files whose rows lie behind the place that has been read; ranges of files don't overlap, so they come in order.
            near = self.index().filter(F.col("owner_email") == owner)
            if created_from:
                near = near.filter(F.col("newest.created_at") >= created_from)
            if created_to:
                near = near.filter(F.col("oldest.created_at") <= created_to)
            if at:
                near = near.filter(F.col("oldest") < F.struct(F.lit(at[0]).alias("created_at"), F.lit(at[1]).alias("id")))
            files = near.orderBy(F.desc("newest")).limit(step).select("file", "oldest").collect()
            if not files:
                return Page(found[:limit], None if len(found) <= limit else (found[limit - 1]["created_at"], found[limit - 1]["id"]), read)
            read += len(files)
            rows = store.history(self._rows([r["file"] for r in files]), owner, query=query, created_from=created_from, created_to=created_to, after=at)
            found += rows.limit(limit + 1 - len(found)).collect()  # at most a page
            if len(found) > limit:
                return Page(found[:limit], (found[limit - 1]["created_at"], found[limit - 1]["id"]), read)
            at, step = tuple(files[-1]["oldest"]), 2 * step

