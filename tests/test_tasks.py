import datetime as dt
import json
import threading

import pytest
from golden import patched

from tracewright.plans.audit import audit_json
from tracewright.sources import legacy
from tracewright.streaming import tasks, worker
from tracewright.streaming.tasks import TaskLog

NOW = "2026-07-18T08:00:00.000Z"
LATER = "2026-07-25T08:00:00.000Z"
SUMMARY = {"parserMode": "m", "pageCount": 1, "rightsFieldCount": 0, "groupCount": 0, "tableRowCount": 0, "screenshotHeadingCount": 0, "warnings": [], "confidence": 1, "extractionComplete": True}
REPORT = {"certificateIssues": [], "resultIssues": [], "issues": [], "verificationNotices": []}
AUDIT = {"outcome": "passed", "report": REPORT, "report_text": "ok", "summary": SUMMARY}


def add(log, n, owner="a@x", created=NOW, name=None, expires=LATER):
    return log.create(id=f"t{n}", owner_email=owner, file_name=name or f"file-{n}.pdf", file_size=10, file_type="application/pdf", pdf_path=f"/data/t{n}.pdf", pdf_expires_at=expires, now=created)


@pytest.fixture
def log(spark, tmp_path):
    return TaskLog(spark, str(tmp_path / "log"))


def test_oldest_first_and_once(log):
    add(log, 2, created="2026-07-18T08:00:01.000Z")
    add(log, 1)
    add(log, 3, owner="b@x", created="2026-07-18T08:00:02.000Z")
    first, second = log.claim(NOW), log.claim(NOW)
    assert (first["id"], first["status"], first["attempt_count"], first["progress"], first["started_at"]) == ("t1", "rendering", 1, 1, NOW)
    assert second["id"] == "t2" and log.claim(NOW)["id"] == "t3" and log.claim(NOW) is None
    assert log.list("a@x")[0][0]["id"] == "t2" and log.get("t3", "a@x") is None


def test_attempts_end_in_failure(log):
    add(log, 1)
    for i in range(3):
        assert log.claim(NOW)["attempt_count"] == i + 1
        log.recover(NOW)
    task = log.get("t1")
    assert (task["status"], task["error_code"], task["outcome"]) == ("failed", "WORKER_RETRY_EXHAUSTED", None)
    assert log.claim(NOW) is None


def test_finished_is_final(log):
    add(log, 1)
    log.claim(NOW)
    assert log.progress("t1", "locating", 20, 1, 3, NOW) and not log.progress("t1", "completed", 20, 1, 3, NOW)
    assert log.complete("t1", AUDIT, NOW)
    assert not log.fail("t1", "PDF_INVALID", NOW) and not log.progress("t1", "locating", 1, 1, 1, NOW) and not log.complete("t1", AUDIT, NOW)
    task = log.get("t1")
    assert (task["status"], task["outcome"], task["issue_count"], task["progress"]) == ("completed", "passed", 0, 100)
    shown = log.list("a@x", now=NOW)[0][0]
    assert shown["summary"]["pageCount"] == 1 and shown["pdf_available"] and "report_text" not in shown
    with pytest.raises(ValueError):
        log.complete("t1", AUDIT | {"outcome": "great"}, NOW)


def test_requeue_gives_the_attempt_back_and_unknown_codes_are_internal(log):
    add(log, 1)
    log.claim(NOW)
    assert log.requeue("t1", NOW) and log.get("t1")["attempt_count"] == 0 and not log.requeue("t1", NOW)
    log.claim(NOW)
    assert log.fail("t1", "SECRET_DETAIL", NOW)
    task = log.get("t1")
    assert (task["error_code"], task["error_message"]) == ("INTERNAL_ERROR", "The audit could not be completed.")
    assert log.retry("a@x", "t1", NOW) and not log.retry("a@x", "t1", NOW)
    assert log.get("t1")["status"] == "queued" and log.get("t1")["error_code"] is None


def test_retry_needs_the_file(log):
    add(log, 1, expires=NOW)
    log.claim(NOW)
    log.fail("t1", "PDF_INVALID", NOW)
    assert not log.retry("a@x", "t1", NOW)
    assert [t["id"] for t in log.expired(NOW)] == ["t1"] and log.mark_deleted(["t1"], NOW) and not log.mark_deleted(["t1"], NOW)
    assert log.get("t1")["pdf_path"] is None


def test_pages_and_filters(log):
    for i in range(7):
        add(log, i, created=f"2026-07-1{i}T08:00:00.000Z", name=["report%2026.pdf", "Alpha_1.pdf", "alpha-2.pdf", "[final].pdf", "Ärger.pdf", "x.pdf", "y.pdf"][i])
    seen, cursor = [], None
    while True:
        page, cursor = log.list("a@x", cursor=cursor, limit=3)
        seen += [t["id"] for t in page]
        if cursor is None:
            break
    assert seen == [f"t{i}" for i in (6, 5, 4, 3, 2, 1, 0)]
    found = lambda q: sorted(t["id"] for t in log.list("a@x", query=q)[0])
    assert found("ALPHA") == ["t1", "t2"] and found("alpha_") == ["t1", "t2"] and found("[final]") == ["t3"] and found("t%2") == ["t0"] and found("ä") == [] and found("Ä") == ["t4"]
    assert [t["id"] for t in log.list("a@x", created_from="2026-07-12T08:00:00.000Z", created_to="2026-07-14T08:00:00.000Z")[0]] == ["t4", "t3", "t2"]
    with pytest.raises(tasks.CursorError):
        log.list("b@x", cursor="t1")


def test_batch_delete_is_whole(log):
    for i in range(3):
        add(log, i)
    for _ in range(2):
        log.fail(log.claim(NOW)["id"], "PDF_INVALID", NOW)
    assert log.delete("a@x", ["t0", "t1", "t2"], NOW) is None and log.get("t0") is not None
    assert log.delete("b@x", ["t0"], NOW) == 0
    assert log.delete("a@x", ["t0", "t1", "t1"], NOW) == 2 and log.get("t0") is None
    assert log.pending_deletions() == ["/data/t0.pdf", "/data/t1.pdf"]
    with pytest.raises(ValueError):
        log.delete("a@x", [str(i) for i in range(101)], NOW)


def test_orphans(log, spark):
    add(log, 1)
    assert not log.claim_orphan("/data/t1.pdf", NOW) and log.claim_orphan("/data/x.pdf", NOW) and not log.claim_orphan("/data/x.pdf", NOW)
    with pytest.raises(ValueError):
        log.create(id="n", owner_email="a@x", file_name="n", file_size=1, file_type=None, pdf_path="/data/x.pdf", pdf_expires_at=LATER, now=NOW)
    assert log.prune_claims("2026-07-18T07:00:00.000Z") == 0 and log.prune_claims(NOW) == 1 and log.claim_orphan("/data/x.pdf", NOW)
    log.release_orphan("/data/x.pdf")
    at = dt.datetime(2026, 7, 18, 8, tzinfo=dt.UTC)
    listing = spark.createDataFrame([("/data/t1.pdf", at - dt.timedelta(hours=5)), ("/data/old.pdf", at - dt.timedelta(hours=5)), ("/data/new.pdf", at)], "path string, modified timestamp")
    removed = []
    assert log.clean_up(at, listing, removed.append) == {"claims": 0, "pending": 0, "expired": 0, "orphans": 1} and removed == ["/data/old.pdf"]


def test_compaction_keeps_the_rows(log):
    for i in range(3):
        add(log, i)
    log.fail(log.claim(NOW)["id"], "PDF_INVALID", NOW)
    log.delete("a@x", ["t0"], NOW)
    before = sorted(log.tasks.rows().collect())
    log.tasks.compact()
    assert sorted(log.tasks.rows().collect()) == before and len(before) == 2
    add(log, 9)
    assert log.tasks.rows().count() == 3


def test_kpis(log):
    for i in range(3):
        add(log, i)
    log.claim(NOW)
    log.complete("t0", AUDIT | {"outcome": "needs_review"}, NOW)
    assert tuple(tasks.kpis(log.tasks.rows()).first()) == (2, 1, 0)
    assert {r["status"]: r["count"] for r in tasks.status_histogram(log.tasks.rows()).collect()} == {"queued": 2, "completed": 1}


def old_task(**change):
    return {"id": "o1", "fileName": "C:\\x\\old.pdf", "fileSize": 5, "status": "completed", "progress": 100, "processedPages": 1, "totalPages": 1, "model": "qwen3.7-plus", "issueCount": 0, "createdAt": NOW, "updatedAt": NOW, "startedAt": None, "completedAt": NOW, "summary": SUMMARY, "report": REPORT, "reportText": "text"} | change


def test_legacy_import(log, spark):
    values = [old_task(), old_task(id="o2", issueCount=1), old_task(id="o3", status="failed", errorMessage="secret"), old_task(id="o1"), old_task(id="o4", status="queued"), 7, old_task(id="o5", totalPages=2), old_task(id="o6", completedAt="yesterday")]
    found = legacy.legacy_tasks(spark.createDataFrame([("a@x", json.dumps(values)), ("a@x", "no json"), ("a@x", None), ("a@x", "x" * 1_000_001)], "owner_email string, text string"))
    assert log.import_finished("a@x", found) == 2 and log.import_finished("a@x", found) == 0
    a, b = log.get("o1"), log.get("o3")
    assert (a["file_name"], a["outcome"], a["report_text"]) == ("old.pdf", "needs_review", "历史迁移记录，未由当前服务器重新核验。\n\ntext")
    assert (b["error_code"], b["error_message"], b["outcome"]) == ("INTERNAL_ERROR", "The audit could not be completed.", "failed")


def test_worker_drains_the_queue(log, spark):
    for i in range(5):
        add(log, i, created=f"2026-07-18T08:00:0{i}.000Z")
    running, most, lock = [0], [0], threading.Lock()

    def process(task, progress):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        progress("locating", 20, 1, 1)
        with lock:
            running[0] -= 1
        if task["id"] == "t1":
            raise worker.TaskFailed("PDF_ENCRYPTED")
        if task["id"] == "t2":
            raise RuntimeError("secret")
        return AUDIT

    assert worker.Worker(log, process, slots=2).run(until_idle=True) == 5 and most[0] <= 2
    assert [log.get(f"t{i}")["error_code"] for i in range(5)] == [None, "PDF_ENCRYPTED", "INTERNAL_ERROR", None, None]


def test_a_stopped_worker_gives_its_task_back(log):
    add(log, 1)
    w = worker.Worker(log, lambda task, progress: (w.stop(), progress("locating", 20, 1, 1)))
    w.run()
    assert (log.get("t1")["status"], log.get("t1")["attempt_count"]) == ("queued", 0)


def test_uploads_as_a_stream(log, spark, tmp_path):
    folder = tmp_path / "up"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (folder / "b.pdf").write_bytes(b"not a pdf")
    (folder / "c.txt").write_bytes(b"%PDF-1.7 x")
    for _ in range(2):
        worker.upload_stream(spark, str(folder), str(tmp_path / "cp"), log, "a@x").awaitTermination()
        (folder / "d.pdf").write_bytes(b"%PDF-1.4")
    assert sorted(t["file_name"] for t in log.list("a@x")[0]) == ["a.pdf", "d.pdf"]


def test_states_as_a_stream(spark, tmp_path):
    source = tmp_path / "events"
    names = ["id", "seq", "status"]
    batches = [[("a", 0, "queued"), ("a", 2, "locating"), ("a", 1, "rendering"), ("b", 0, "rendering")], [("a", 3, "completed"), ("a", 4, "locating"), ("b", 1, "queued"), ("a", 1, "failed")]]
    for b in batches:
        spark.createDataFrame(b, names).coalesce(1).write.mode("append").parquet(str(source))
        q = worker.state_stream(spark.readStream.schema(worker.EVENT).parquet(str(source))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r["id"], r["seq"], r["from_status"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 0, None, "queued"), ("a", 1, "queued", "rendering"), ("a", 2, "rendering", "locating"), ("a", 3, "locating", "completed"), ("b", 1, None, "queued")]


def test_page_query():
    q = tasks.page_query("  x ", "2026-07-18T10:00:00+02:00", None, "", "5")
    assert q == {"query": "x", "created_from": NOW, "created_to": None, "cursor": None, "limit": 5}
    for bad in ({"limit": 0}, {"limit": 201}, {"query": "x" * 201}):
        with pytest.raises(ValueError):
            tasks.page_query(**bad)


def test_audits_become_results(spark, log):
    add(log, 1)
    log.claim(NOW)
    good, _ = audit_json(spark.createDataFrame([("t1", json.dumps(patched((("table", "rows", 0, "publisher", "rawText"), "x"))))], "doc_id string, json string"))
    r = good.first()
    plain = lambda row: [f.asDict() for f in row]
    done = {"outcome": r["outcome"], "report": {"certificateIssues": plain(r["certificate_issues"]), "resultIssues": plain(r["result_issues"]), "issues": plain(r["issues"]), "verificationNotices": plain(r["notices"])}, "report_text": r["report_text"], "summary": r["summary"].asDict()}
    assert log.complete("t1", done, NOW) and log.get("t1")["issue_count"] == 1


def test_many_commits_become_one(log, monkeypatch):
    """The log compacts itself, and a cleaning pass writes one commit a batch."""
    monkeypatch.setattr(tasks, "MOST_COMMITS", 3)
    for i in range(6):
        add(log, f"c{i}")
    assert len(log.tasks._commits()) <= 4 and log.tasks.rows().count() == 6
    for i in range(5):
        log.claim_orphans([f"/data/o{i}a", f"/data/o{i}b"], NOW)
    assert log.claims.rows().count() == 10 and log.claim_orphans(["/data/o1a", "/data/new", "/data/new"], NOW) == ["/data/new"]
    log.release_orphan("/data/new", "/data/o0a", "/data/o0b")
    assert log.claims.rows().count() == 8 and len(log.claims._commits()) <= 4
