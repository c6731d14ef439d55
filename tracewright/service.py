"""Entries A to C behind one object: what an HTTP layer would call. Every task call names its owner.

Answers are (status, body); bodies are JSON-ready, errors are {"error": {"code", "message"}}.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from tracewright import schemas
from tracewright.functions import misc
from tracewright.plans.audit import audit_json, response
from tracewright.sources import legacy
from tracewright.streaming import tasks
from tracewright.streaming.worker import now

MAX_BODY, MAX_IMPORT, MAX_DELETE = 2 * 1024 * 1024, 1_310_720, 64 * 1024
SITE_HEADER = "oai-authenticated-user-email"


class Refused(Exception):
    def __init__(self, status: int, code: str, message: str):
        super().__init__(message)
        self.answer = status, {"error": {"code": code, "message": message}}


def owner_of(headers: dict[str, str], *, require_login: bool = True, single_owner: str | None = None, production: bool = True) -> str:
    """The signed-in user, or the one configured owner where no login is asked for; trimmed and lower-cased."""
    if require_login:
        email = {k.lower(): v for k, v in headers.items()}.get(SITE_HEADER, "").strip().lower()
    else:
        email = (single_owner or "").strip().lower() or ("" if production else "local-development")
    if not email:
        raise Refused(401, "AUTH_REQUIRED", "Please sign in before managing tasks.")
    return email


def same_origin(origin: str | None, host: str) -> bool:
    """A request from another site is refused; one without an origin isn't from a page."""
    return origin is None or origin.split("://", 1)[-1].rstrip("/") == host


def bounded_json(body: bytes, most: int):
    """JSON of at most `most` bytes in valid UTF-8."""
    if len(body) > most:
        raise Refused(413, "PAYLOAD_TOO_LARGE", "The request is too large.")
    try:
        return json.loads(body.decode("utf-8"))
    except ValueError:
        raise Refused(400, "INVALID_INPUT", "The request isn't valid JSON.") from None


class Service:
    def __init__(self, spark: SparkSession, log: tasks.TaskLog, store: Callable[[str, bytes], str], retention_hours: int | None = None, clock: Callable[[], dt.datetime] = now):
        self.spark, self.log, self.store, self.clock = spark, log, store, clock
        self.retention = dt.timedelta(hours=misc.retention_hours(retention_hours))

    def _text(self, column) -> str | None:
        return self.spark.range(1).select(column).first()[0]

    def upload(self, owner: str, encoded_name: str, body: bytes, kind: str = "application/pdf") -> tuple[int, dict]:
        """A PDF as a queued task."""
        from pyspark.sql import functions as F

        name = self._text(misc.decoded_name(F.lit(encoded_name)))
        if name is None or kind.split(";")[0].strip().lower() != "application/pdf":
            return Refused(400, "INVALID_PDF_UPLOAD", tasks.FAILURES["INVALID_PDF_UPLOAD"]).answer
        if len(body) > schemas.MAX_PDF_BYTES:
            return Refused(413, "PDF_TOO_LARGE", tasks.FAILURES["PDF_TOO_LARGE"]).answer
        if not body.startswith(b"%PDF-"):
            return Refused(400, "INVALID_PDF_UPLOAD", tasks.FAILURES["INVALID_PDF_UPLOAD"]).answer
        at = self.clock()
        task = str(uuid.uuid4())
        row = self.log.create(id=task, owner_email=owner, file_name=name, file_size=len(body), file_type="application/pdf", pdf_path=self.store(f"{task}.pdf", body), pdf_expires_at=tasks.utc(at + self.retention), now=tasks.utc(at))
        return 202, {"task": {"id": task, "fileName": name, "status": row["status"]}}

    def list(self, owner: str, **query) -> tuple[int, dict]:
        try:
            items, cursor = self.log.list(owner, **tasks.page_query(**query), now=tasks.utc(self.clock()))
        except ValueError:
            return Refused(400, "INVALID_INPUT", "The query is invalid.").answer
        return 200, {"tasks": items, "nextCursor": cursor}

    def get(self, owner: str, task: str) -> tuple[int, dict]:
        row = self.log.get(task, owner)
        return (200, {"task": row}) if row else Refused(404, "TASK_NOT_FOUND", tasks.FAILURES["TASK_NOT_FOUND"]).answer

    def delete(self, owner: str, ids: list[str]) -> tuple[int, dict]:
        try:
            n = self.log.delete(owner, ids, tasks.utc(self.clock()))
        except ValueError:
            return Refused(400, "INVALID_INPUT", "1 to 100 ids are allowed.").answer
        if n is None:
            return Refused(409, "TASK_ACTIVE", tasks.FAILURES["TASK_ACTIVE"]).answer
        return (200, {"deleted": n}) if n else Refused(404, "TASK_NOT_FOUND", tasks.FAILURES["TASK_NOT_FOUND"]).answer

    def retry(self, owner: str, task: str) -> tuple[int, dict]:
        if self.log.retry(owner, task, tasks.utc(self.clock())):
            return 202, {"task": self.log.get(task, owner)}
        return Refused(*((409, "TASK_ACTIVE") if self.log.get(task, owner) else (404, "TASK_NOT_FOUND")), "The task can't be retried.").answer

    def _history(self, owner: str, text: str):
        from pyspark.sql import functions as F

        found = legacy.legacy_tasks(self.spark.createDataFrame([(owner, text)], "owner_email string, text string"))
        return found.withColumn("id", misc.legacy_id(F.lit(owner), F.col("id")))

    def import_history(self, owner: str, body: bytes) -> tuple[int, dict]:
        """K5: importing again changes nothing, since ids are hashed from owner and old id."""
        try:
            bounded_json(body, MAX_IMPORT)
        except Refused as e:
            return e.answer
        return 200, {"imported": self.log.import_finished(owner, self._history(owner, body.decode()))}

    def migrate_history(self, owner: str, text: str) -> dict:
        """T-15: what a browser kept, imported once for each owner; a text that can't be read counts as nothing to import."""
        state, n = self.log.migrate(owner, self._history(owner, text), tasks.utc(self.clock()))
        return {"status": state, "imported": n}

    def finalize(self, body: bytes) -> tuple[int, dict]:
        """Entry B for one document."""
        try:
            bounded_json(body, MAX_BODY)
        except Refused as e:
            return e.answer
        good, bad = audit_json(self.spark.createDataFrame([("request", body.decode())], "doc_id string, json string"))
        wrong = bad.first()
        if wrong:
            return Refused(400, "INVALID_INPUT", "; ".join(wrong["errors"][:5])).answer
        return 200, json.loads(response(good).first()["response"])
