"""The durable task store as an append-only log of task snapshots.

Every change is one commit: a Parquet file set with the changed tasks' new rows under the next `seq`. A task's current row is its
last snapshot (or none, if that is a tombstone). Rules are pure functions from the current rows to changed rows, so that they
run over any number of tasks; TaskLog applies them one at a time under a lock, which is what keeps claims single,
terminal states final and batch deletes whole. One process writes a log.

Times are canonical UTC texts (YYYY-MM-DDTHH:MM:SS.mmmZ) and compare as texts.
"""

from __future__ import annotations

import datetime as dt
import json
import threading
import uuid
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright import schemas
from tracewright.functions.text import like_ascii
from tracewright.shipping import materialize

TASK = """id string, owner_email string, file_name string, file_size long, file_type string, pdf_path string, pdf_expires_at string, pdf_deleted_at string, status string,
progress int, processed_pages int, total_pages int, outcome string, model string, issue_count int, summary_json string, report_json string, report_text string,
error_code string, error_message string, attempt_count int, created_at string, updated_at string, started_at string, completed_at string"""
TASK_COLUMNS = [c.split()[0] for c in TASK.replace("\n", " ").split(", ")]

# Messages of failures.
FAILURES = {
    "INVALID_PDF_UPLOAD": "The uploaded PDF is invalid.",
    "PDF_TOO_LARGE": "The PDF exceeds the supported size limit.",
    "PDF_ENCRYPTED": "The PDF is encrypted and cannot be processed.",
    "PDF_INVALID": "The PDF could not be processed.",
    "PDF_RENDER_FAILED": "The PDF could not be rendered.",
    "TASK_NOT_FOUND": "The task was not found.",
    "TASK_ACTIVE": "The task is still being processed.",
    "MODEL_UNAVAILABLE": "The audit service is temporarily unavailable.",
    "INVALID_MODEL_OUTPUT": "The audit result could not be validated.",
    "WORKER_RETRY_EXHAUSTED": "The task could not be completed after repeated attempts.",
    "INTERNAL_ERROR": "The audit could not be completed.",
}
DEFAULT_LIMIT, MAX_LIMIT, MAX_BATCH_DELETE = 80, 200, 100
ORPHAN_CLAIM_MINUTES, STALE_FILE_HOURS = 30, 1
#: A log of more commits is compacted; a cleaning pass takes so many files at a time.
MOST_COMMITS, CLEAN_BATCH = 64, 500


def utc(at: dt.datetime) -> str:
    """A time as canonical text."""
    return at.astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def canonical_time(c: Column) -> Column:
    """An ISO time as canonical text; null when it isn't one."""
    return F.date_format(F.to_utc_timestamp(F.try_to_timestamp(c), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def active() -> Column:
    return F.col("status").isin(*schemas.ACTIVE_STATUSES)


def terminal() -> Column:
    return F.col("status").isin(*schemas.TERMINAL_STATUSES)


def safe_failure(code: Column) -> tuple[Column, Column]:
    """The code, or INTERNAL_ERROR for an unknown one, and its message."""
    known = F.when(code.isin(*FAILURES), code).otherwise("INTERNAL_ERROR")
    message = F.lit(FAILURES["INTERNAL_ERROR"])
    for k, v in FAILURES.items():
        message = F.when(known == k, v).otherwise(message)
    return known, message


# What errors of the renderer mean.
_PDF_ERRORS = {"PDF_ENCRYPTED": "PDF_ENCRYPTED", "PDF_INVALID": "PDF_INVALID", "PDF_RENDER_FAILED": "PDF_RENDER_FAILED", "PDF_UNSUPPORTED": "PDF_INVALID", "PDF_IMAGE_TOO_LARGE": "PDF_RENDER_FAILED"}


def classify_error(source: Column, code: Column) -> Column:
    """The failure code of an error of the worker itself (its own code), the renderer (pdf), the model, or anything else."""
    pdf = F.lit("INTERNAL_ERROR")
    for k, v in _PDF_ERRORS.items():
        pdf = F.when(code == k, v).otherwise(pdf)
    model = F.when(code == "INVALID_MODEL_OUTPUT", code).otherwise("MODEL_UNAVAILABLE")
    return F.when(source == "worker", safe_failure(code)[0]).when(source == "pdf", pdf).when(source == "model", model).otherwise("INTERNAL_ERROR")


def pdf_available(now: str) -> Column:
    """There is a file, not deleted, not expired; no expiry is available for good, one that isn't a time never."""
    at = F.try_to_timestamp(F.col("pdf_expires_at"))
    fresh = F.col("pdf_expires_at").isNull() | F.coalesce(at > F.lit(now).cast("timestamp"), F.lit(False))
    return F.col("pdf_path").isNotNull() & F.col("pdf_deleted_at").isNull() & fresh


# --- rules: current rows -> changed rows --------------------------------------------------------


def claimed(tasks: DataFrame, now: str, k: int = 1) -> DataFrame:
    """O4, T-2: the k oldest queued tasks with attempts left, as started."""
    due = tasks.filter((F.col("status") == "queued") & (F.col("attempt_count") < schemas.MAX_TASK_ATTEMPTS)).orderBy("created_at", "id").limit(k)
    return due.withColumns({"status": F.lit("rendering"), "progress": F.lit(1), "processed_pages": F.lit(0), "started_at": F.coalesce("started_at", F.lit(now)), "updated_at": F.lit(now), "completed_at": null(), "error_code": null(), "error_message": null(), "attempt_count": F.col("attempt_count") + 1})


def progressed(tasks: DataFrame, updates: DataFrame, now: str) -> DataFrame:
    """T-3: updates(id, status, progress, processed_pages, total_pages) of tasks that aren't finished."""
    u = updates.select("id", *[F.col(c).alias(f"new_{c}") for c in ("status", "progress", "processed_pages", "total_pages")])
    joined = tasks.filter(~terminal()).join(u, "id").filter(F.col("new_status").isin(*schemas.ACTIVE_STATUSES))
    return joined.withColumns({c: F.col(f"new_{c}") for c in ("status", "progress", "processed_pages", "total_pages")} | {"updated_at": F.lit(now)}).select(*TASK_COLUMNS)


def completed(tasks: DataFrame, audits: DataFrame, now: str) -> DataFrame:
    """K3: audits(id, outcome, issue_count, summary_json, report_json, report_text) of tasks that aren't finished."""
    new = ("outcome", "issue_count", "summary_json", "report_json", "report_text")
    joined = tasks.filter(~terminal()).drop(*new).join(audits.select("id", *new), "id")
    return joined.withColumns({"status": F.lit("completed"), "progress": F.lit(100), "model": F.lit(schemas.MODEL), "error_code": null(), "error_message": null(), "updated_at": F.lit(now), "completed_at": F.lit(now)}).select(*TASK_COLUMNS)


def failed(tasks: DataFrame, failures: DataFrame, now: str) -> DataFrame:
    """K4: failures(id, code) of tasks that aren't finished; the outcome stays null."""
    joined = tasks.filter(~terminal()).join(failures.select("id", F.col("code").alias("__code")), "id")
    code, message = safe_failure(F.col("__code"))
    return joined.withColumns({"status": F.lit("failed"), "error_code": code, "error_message": message, "updated_at": F.lit(now), "completed_at": F.lit(now)}).select(*TASK_COLUMNS)


def requeued(tasks: DataFrame, ids: list[str], now: str) -> DataFrame:
    """T-5: active tasks given back at a graceful stop; the attempt doesn't count."""
    given = tasks.filter(active() & F.col("id").isin(ids))
    return given.withColumns({"status": F.lit("queued"), "progress": F.lit(0), "processed_pages": F.lit(0), "total_pages": null("int"), "error_code": null(), "error_message": null(), "completed_at": null(), "attempt_count": F.greatest(F.col("attempt_count") - 1, F.lit(0)), "updated_at": F.lit(now)})


def recovered(tasks: DataFrame, now: str) -> DataFrame:
    """T-4: active tasks after a crash: queued again, or failed when their attempts are used up."""
    again = F.col("attempt_count") < schemas.MAX_TASK_ATTEMPTS
    either = lambda a, b: F.when(again, a).otherwise(b)
    return tasks.filter(active()).withColumns({
        "status": either(F.lit("queued"), F.lit("failed")), "progress": either(F.lit(0), F.col("progress")), "processed_pages": either(F.lit(0), F.col("processed_pages")), "updated_at": F.lit(now),
        "completed_at": either(null(), F.lit(now)), "error_code": either(null(), F.lit("WORKER_RETRY_EXHAUSTED")), "error_message": either(null(), F.lit(FAILURES["WORKER_RETRY_EXHAUSTED"])),
    })


def retried(tasks: DataFrame, asked: list[tuple[str, str]], now: str) -> DataFrame:
    """T-6: of the tasks asked for as (owner, id) the finished ones of that owner whose file is still there, as new."""
    usable = F.col("pdf_path").isNotNull() & F.col("pdf_deleted_at").isNull() & (F.col("pdf_expires_at").isNull() | (F.col("pdf_expires_at") > now))
    cleared = {c: null() for c in ("outcome", "model", "summary_json", "report_json", "report_text", "error_code", "error_message", "started_at", "completed_at")}
    zero = {"status": F.lit("queued"), "progress": F.lit(0), "processed_pages": F.lit(0), "total_pages": null("int"), "issue_count": null("int"), "attempt_count": F.lit(0), "updated_at": F.lit(now)}
    by_owner: dict[str, list[str]] = {}
    for owner, task in asked:
        by_owner.setdefault(owner, []).append(task)
    theirs = F.lit(False)
    for owner, ids in by_owner.items():
        theirs = theirs | ((F.col("owner_email") == owner) & F.col("id").isin(ids))
    return tasks.filter(theirs & terminal() & usable).withColumns(cleared | zero)


def deletable(tasks: DataFrame, owner: str, ids: list[str]) -> DataFrame:
    """T-7: the owner's tasks among at most MAX_BATCH_DELETE ids; blocked, all of them, when one is still active."""
    ids = list(dict.fromkeys(ids))
    if not 1 <= len(ids) <= MAX_BATCH_DELETE:
        raise ValueError(f"1 to {MAX_BATCH_DELETE} ids")
    rows = tasks.filter((F.col("owner_email") == owner) & F.col("id").isin(ids))
    return rows.withColumn("blocked", F.bool_or(~terminal()).over(W.partitionBy("owner_email")))


def prunable(claims: DataFrame, tasks: DataFrame, stale_before: str) -> DataFrame:
    """Old claims on files that no task names."""
    return claims.filter(F.col("claimed_at") <= stale_before).join(tasks.filter("pdf_path is not null").select("pdf_path"), "pdf_path", "left_anti")


def orphans(files: DataFrame, tasks: DataFrame, claims: DataFrame, modified_before: dt.datetime) -> DataFrame:
    """files(path, modified) that are old, named by no task and claimed by nobody."""
    old = files.filter(F.col("modified") < F.lit(modified_before))
    for names in (tasks.filter("pdf_path is not null"), claims):
        old = old.join(names.select(F.col("pdf_path").alias("path")), "path", "left_anti")
    return old


def waiting(queued: DataFrame, most: int) -> DataFrame:
    """The oldest files of queued(pdf_path, queued_at), each under its first time, with their place."""
    first = queued.groupBy("pdf_path").agg(F.min("queued_at").alias("queued_at")).orderBy("queued_at", "pdf_path").limit(most)
    return first.withColumn("place", F.row_number().over(W.orderBy("queued_at", "pdf_path"))).select("pdf_path", F.col("place").cast("long"))  # at most `most` rows


def expired(tasks: DataFrame, now: str) -> DataFrame:
    """T-8: finished tasks whose file is due for deletion."""
    return tasks.filter(terminal() & F.col("pdf_path").isNotNull() & F.col("pdf_deleted_at").isNull() & F.col("pdf_expires_at").isNotNull() & (F.col("pdf_expires_at") <= now))


def file_deleted(tasks: DataFrame, ids: list[str], now: str) -> DataFrame:
    return expired(tasks, now).filter(F.col("id").isin(ids)).withColumns({"pdf_path": null(), "pdf_deleted_at": F.lit(now), "updated_at": F.lit(now)})


def importable(tasks: DataFrame, incoming: DataFrame, owner: str) -> DataFrame:
    """K5: incoming tasks (with `ord`) whose id is new; of equal ids the first."""
    first = incoming.groupBy("id").agg(F.min_by(F.struct(*[c for c in incoming.columns if c != "id"]), "ord").alias("t")).select("id", *[f"t.{c}" for c in incoming.columns if c not in ("id", "ord")])
    new = first.join(tasks.select("id"), "id", "left_anti")
    code, message = safe_failure(F.col("error_code"))
    new = new.withColumns({"owner_email": F.lit(owner), "pdf_path": null(), "pdf_expires_at": null(), "pdf_deleted_at": null(), "attempt_count": F.lit(0), "error_message": F.when(F.col("error_code").isNotNull(), message), "error_code": F.when(F.col("error_code").isNotNull(), code)})
    return new.select(*TASK_COLUMNS)


def history(tasks: DataFrame, owner: str, *, query: str | None = None, created_from: str | None = None, created_to: str | None = None, after: tuple[str, str] | None = None) -> DataFrame:
    """The owner's tasks, newest first, that match; only the given filters become predicates. after: (created_at, id) of the last one seen."""
    out = tasks.filter(F.col("owner_email") == owner)
    if query:
        out = out.filter(like_ascii(F.col("file_name"), query))
    if created_from:
        out = out.filter(F.col("created_at") >= created_from)
    if created_to:
        out = out.filter(F.col("created_at") <= created_to)
    if after:
        out = out.filter((F.col("created_at") < after[0]) | ((F.col("created_at") == after[0]) & (F.col("id") < after[1])))
    return out.orderBy(F.desc("created_at"), F.desc("id"))


def page_query(query: str | None = None, created_from: str | None = None, created_to: str | None = None, cursor: str | None = None, limit: int | str = DEFAULT_LIMIT) -> dict:
    """Trimmed, empty as absent, times canonical, limit 1 to MAX_LIMIT."""
    query = (query or "").strip() or None
    if query and schemas.units(query) > 200 or not 1 <= int(limit) <= MAX_LIMIT:
        raise ValueError("query or limit out of range")
    time = lambda t: utc(dt.datetime.fromisoformat(t)) if t else None
    return {"query": query, "created_from": time(created_from), "created_to": time(created_to), "cursor": cursor or None, "limit": int(limit)}


def summary(tasks: DataFrame, now: str) -> DataFrame:
    """What a list shows: parsed summary, no report, whether the file is available."""
    parsed = F.from_json("summary_json", schemas.SUMMARY.spark())
    return tasks.withColumns({"summary": parsed, "pdf_available": pdf_available(now)}).drop("summary_json", "report_json", "report_text", "pdf_path", "pdf_deleted_at", "owner_email", "attempt_count")


def worker_view(tasks: DataFrame, now: str) -> DataFrame:
    """What a worker gets: a task with its report, its owner, the file's path and the attempts."""
    return tasks.withColumns({"summary": F.from_json("summary_json", schemas.SUMMARY.spark()), "report": F.from_json("report_json", schemas.REPORT.spark()), "pdf_available": pdf_available(now)}).drop("summary_json", "report_json", "pdf_deleted_at")


def detail(tasks: DataFrame, now: str) -> DataFrame:
    """A task with its report, for its owner."""
    return worker_view(tasks, now).drop("pdf_path", "owner_email", "attempt_count")


def kpis(tasks: DataFrame) -> DataFrame:
    """Unfinished tasks, tasks to review, issues in all (null counts 0)."""
    return tasks.agg(F.count_if(~terminal()).alias("active"), F.count_if(F.col("outcome") == "needs_review").alias("needs_review"), F.coalesce(F.sum(F.coalesce("issue_count", F.lit(0))), F.lit(0)).alias("issues"))


def status_histogram(tasks: DataFrame) -> DataFrame:
    """A17."""
    return tasks.groupBy("status").count()


def newest(reads: DataFrame, key: str, order: list[str]) -> DataFrame:
    """W4, J15, T-13: of several reads of a key the one with the greatest (generation, sequence, ...)."""
    rest = [c for c in reads.columns if c != key]
    return reads.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *[f"r.{c}" for c in rest])


# --- the log ----------------------------------------------------------------------------------------


class CursorError(ValueError):
    """A list cursor that isn't a task of the owner."""


class _Log:
    """Snapshots of keyed rows; the last one of a key counts."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema
        self.names = [c.split()[0] for c in schema.replace("\n", " ").split(", ")]
        self.lock = threading.RLock()
        self.seq = None

    def _events(self) -> DataFrame | None:
        fs = self._fs()
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(at):
            return None
        return self.spark.read.schema(f"{self.schema}, seq long, gone boolean").parquet(f"{self.path}/*")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def rows(self) -> DataFrame:
        """The current rows."""
        events = self._events()
        if events is None:
            return self.spark.createDataFrame([], self.schema)
        rest = [c for c in self.names if c != self.key]
        last = events.groupBy(self.key).agg(F.max_by(F.struct(*rest, "gone"), "seq").alias("t"))
        return last.filter(~F.col("t.gone")).select(*[F.col(c) if c == self.key else F.col(f"t.{c}") for c in self.names])

    def append(self, rows: DataFrame, gone: bool = False) -> int:
        """One commit of changed rows, in as many files as rows has partitions; their number. Many commits become one."""
        with self.lock:
            if self.seq is None:
                events = self._events()
                self.seq = (events.agg(F.max("seq")).first()[0] or 0) if events is not None else 0
            self.seq += 1
            at = f"{self.path}/commit-{self.seq:012d}-{uuid.uuid4().hex[:8]}"
            rows.select(*self.names).withColumns({"seq": F.lit(self.seq).cast("long"), "gone": F.lit(gone)}).write.parquet(at)
            changed = self.spark.read.parquet(at).count()  # from the files' footers
            if len(self._commits()) > MOST_COMMITS:
                self.compact()
            return changed

    def _commits(self) -> list:
        """The paths of the commits, oldest first."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return sorted((s.getPath() for s in self._fs().listStatus(at)), key=lambda p: p.getName()) if self._fs().exists(at) else []

    def compact(self) -> None:
        """Replace all commits by one with the current rows. The oldest go first, so that a crash between brings no deleted row back."""
        with self.lock:
            old = self._commits()
            if not old:
                return
            self.seq = self.seq or self._events().agg(F.max("seq")).first()[0] or 0
            self.seq += 1
            whole = self.rows().withColumns({"seq": F.lit(self.seq).cast("long"), "gone": F.lit(False)})
            whole.write.parquet(f"{self.path}/commit-{self.seq:012d}-{uuid.uuid4().hex[:8]}")
            for p in old:
                self._fs().delete(p, True)


class TaskLog:
    """The task store: tasks, files waiting for deletion, claims on orphaned files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.tasks = _Log(spark, f"{path}/tasks", "id", TASK)
        self.pending = _Log(spark, f"{path}/pending_deletions", "pdf_path", "pdf_path string, queued_at string")
        self.claims = _Log(spark, f"{path}/orphan_claims", "pdf_path", "pdf_path string, claimed_at string")
        self.migrated = _Log(spark, f"{path}/migrations", "owner_email", "owner_email string, migrated_at string")
        self.lock = threading.RLock()

    def _change(self, rule) -> list:
        """Apply a rule to the current rows; the changed rows."""
        with self.lock:
            changed = [r.asDict() for r in rule(self.tasks.rows()).select(*TASK_COLUMNS).collect()]
            if changed:
                self.tasks.append(self._frame(changed))
            return changed

    def _frame(self, rows: list[dict]) -> DataFrame:
        return self.spark.createDataFrame([tuple(r.get(c) for c in TASK_COLUMNS) for r in rows], TASK).coalesce(1)  # a request's few rows

    def create(self, *, id: str, owner_email: str, file_name: str, file_size: int, file_type: str | None, pdf_path: str, pdf_expires_at: str, now: str) -> dict:
        """K2: a queued task; refused while its file is claimed for deletion."""
        with self.lock:
            if self.claims.rows().filter(F.col("pdf_path") == pdf_path).limit(1).count() or self.get(id) is not None:
                raise ValueError("the file or the id is in use")
            row = {"id": id, "owner_email": owner_email, "file_name": file_name, "file_size": file_size, "file_type": file_type, "pdf_path": pdf_path, "pdf_expires_at": pdf_expires_at, "status": "queued", "progress": 0, "processed_pages": 0, "attempt_count": 0, "created_at": now, "updated_at": now}
            self.tasks.append(self._frame([row]))
            return row

    def get(self, task: str, owner: str | None = None) -> dict | None:
        rows = self.tasks.rows().filter(F.col("id") == task)
        found = (rows.filter(F.col("owner_email") == owner) if owner is not None else rows).first()
        return found.asDict() if found else None

    def claim(self, now: str) -> dict | None:
        return next(iter(self._change(lambda t: claimed(t, now))), None)

    def progress(self, task: str, status: str, progress: int, processed_pages: int, total_pages: int, now: str) -> bool:
        update = self.spark.createDataFrame([(task, status, progress, processed_pages, total_pages)], "id string, status string, progress int, processed_pages int, total_pages int")
        return bool(self._change(lambda t: progressed(t, update, now)))

    def complete(self, task: str, audit: dict, now: str) -> bool:
        """audit: outcome, report, report_text, summary, as records; checked against the schemas first."""
        wrong = [*schemas.REPORT.errors(audit["report"], "report"), *schemas.SUMMARY.errors(audit["summary"], "summary"), *schemas.Text(one_of=schemas.OUTCOMES).errors(audit["outcome"], "outcome")]
        if wrong or schemas.units(audit["report_text"]) > 1_000_000:
            raise ValueError(f"the result isn't valid: {wrong[:3]}")
        text = lambda x: json.dumps(x, ensure_ascii=False)
        row = (task, audit["outcome"], len(audit["report"]["issues"]), text(audit["summary"]), text(audit["report"]), audit["report_text"])
        done = self.spark.createDataFrame([row], "id string, outcome string, issue_count int, summary_json string, report_json string, report_text string")
        return bool(self._change(lambda t: completed(t, done, now)))

    def fail(self, task: str, code: str, now: str) -> bool:
        return bool(self._change(lambda t: failed(t, self.spark.createDataFrame([(task, code)], "id string, code string"), now)))

    def requeue(self, task: str, now: str) -> bool:
        return bool(self._change(lambda t: requeued(t, [task], now)))

    def recover(self, now: str) -> int:
        with self.lock:
            return self.tasks.append(recovered(self.tasks.rows(), now))

    def retry(self, owner: str, task: str, now: str) -> bool:
        return bool(self._change(lambda t: retried(t, [(owner, task)], now)))

    def list(self, owner: str, *, query=None, created_from=None, created_to=None, cursor=None, limit=DEFAULT_LIMIT, now: str | None = None) -> tuple[list[dict], str | None]:
        """O3: a page of summaries and the next cursor; the cursor is the id of the last task shown."""
        after = None
        if cursor:
            seen = self.get(cursor, owner)
            if seen is None:
                raise CursorError("unknown cursor")
            after = (seen["created_at"], cursor)
        rows = summary(history(self.tasks.rows(), owner, query=query, created_from=created_from, created_to=created_to, after=after).limit(limit + 1), now or utc(dt.datetime.now(dt.UTC))).collect()
        shown = [r.asDict() for r in rows[:limit]]
        return shown, shown[-1]["id"] if len(rows) > limit else None

    def delete(self, owner: str, ids: list[str], now: str) -> int | None:
        """T-7: all finished tasks among the ids, or None and nothing when one is still active; their files are queued for deletion."""
        with self.lock:
            rows = deletable(self.tasks.rows(), owner, ids).collect()  # at most MAX_BATCH_DELETE
            if any(r["blocked"] for r in rows):
                return None
            if rows:
                named = list({r["pdf_path"] for r in rows if r["pdf_path"] is not None})
                waiting = {r["pdf_path"] for r in self.pending.rows().filter(F.col("pdf_path").isin(named)).collect()} if named else set()
                files = [(p, now) for p in named if p not in waiting]
                if files:
                    self.pending.append(self.spark.createDataFrame(files, self.pending.schema))
                self.tasks.append(self._frame([r.asDict() for r in rows]), gone=True)
            return len(rows)

    def pending_deletions(self, most: int = CLEAN_BATCH) -> list[str]:
        """The oldest, at most so many."""
        return [r["pdf_path"] for r in waiting(self.pending.rows(), most).orderBy("place").collect()]

    def deleted(self, *paths: str) -> None:
        """The files are gone: one commit."""
        if paths:
            self.pending.append(self.pending.rows().filter(F.col("pdf_path").isin(*paths)), gone=True)

    def import_finished(self, owner: str, tasks: DataFrame) -> int:
        """K5: tasks with the columns of TASK and `ord`; the number of new ones."""
        with self.lock:
            return self.tasks.append(importable(self.tasks.rows(), tasks, owner))

    def migrate(self, owner: str, tasks: DataFrame, now: str) -> tuple[str, int]:
        """T-15: an owner's old history, once: a marker is written when it was imported or there was nothing to import. (state, new tasks)."""
        with self.lock:
            if self.migrated.rows().filter(F.col("owner_email") == owner).limit(1).count():
                return "already-migrated", 0
            n = self.import_finished(owner, tasks) if tasks.limit(1).count() else None
            self.migrated.append(self.spark.createDataFrame([(owner, now)], self.migrated.schema).coalesce(1))
            return ("skipped", 0) if n is None else ("imported", n)

    def expired(self, now: str, most: int = CLEAN_BATCH) -> list[dict]:
        """T-8: tasks whose file is due, the first due first, at most so many."""
        return [r.asDict() for r in expired(self.tasks.rows(), now).orderBy("pdf_expires_at", "id").limit(most).collect()]

    def mark_deleted(self, tasks: list[str], now: str) -> int:
        """The files of the tasks are gone: one commit."""
        with self.lock:
            return self.tasks.append(file_deleted(self.tasks.rows(), tasks, now)) if tasks else 0

    def claim_orphan(self, pdf_path: str, now: str) -> bool:
        """A claim on a file that no task names and nobody has claimed."""
        return bool(self.claim_orphans([pdf_path], now))

    def claim_orphans(self, paths: list[str], now: str) -> list[str]:
        """Claims, in one commit, on those of the files that no task names and nobody has claimed."""
        with self.lock:
            files = self.spark.createDataFrame([(p, dt.datetime(1970, 1, 1)) for p in dict.fromkeys(paths)], "path string, modified timestamp")
            free = [r["path"] for r in orphans(files, self.tasks.rows(), self.claims.rows(), dt.datetime(2000, 1, 1)).collect()]
            if free:
                self.claims.append(self.spark.createDataFrame([(p, now) for p in free], self.claims.schema).coalesce(1))
            return free

    def release_orphan(self, *paths: str) -> None:
        if paths:
            self.claims.append(self.claims.rows().filter(F.col("pdf_path").isin(*paths)), gone=True)

    def prune_claims(self, stale_before: str) -> int:
        """Old claims on files that no task names."""
        with self.lock:
            return self.claims.append(prunable(self.claims.rows(), self.tasks.rows(), stale_before), gone=True)

    def clean_up(self, now: dt.datetime, files: DataFrame, remove) -> dict[str, int]:
        """T-10: prune claims, delete waiting files, expired files, then old files that no task names. files(path, modified); remove(path) succeeds for a missing file."""
        done = {"claims": self.prune_claims(utc(now - dt.timedelta(minutes=ORPHAN_CLAIM_MINUTES))), "pending": 0, "expired": 0, "orphans": 0}
        at = utc(now)

        def each(items: list, path, commit) -> int:
            """Remove the files of a batch; what is gone when one fails is committed all the same."""
            gone = []
            try:
                for x in items:
                    remove(path(x))
                    gone.append(x)
            finally:
                commit(gone)
            return len(gone)

        while batch := self.pending_deletions():
            done["pending"] += each(batch, lambda p: p, lambda gone: self.deleted(*gone))
        while batch := self.expired(at):
            done["expired"] += each(batch, lambda t: t["pdf_path"], lambda gone: self.mark_deleted([t["id"] for t in gone], at))
        # Written first: commits of this loop may compact the logs that the list was read from.
        stale = materialize(orphans(files, self.tasks.rows(), self.claims.rows(), now - dt.timedelta(hours=STALE_FILE_HOURS)).select("path"), "stale-files").toLocalIterator()
        while batch := [r["path"] for r in islice(stale, CLEAN_BATCH)]:
            done["orphans"] += each(self.claim_orphans(batch, at), lambda p: p, lambda gone: self.release_orphan(*gone))
        return done
