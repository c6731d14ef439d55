import datetime as dt
import json

import pytest
from golden import GOLDEN
from test_tasks import AUDIT, LATER, NOW, old_task

from tracewright import service
from tracewright.functions import dates
from tracewright.operators import history
from tracewright.streaming.tasks import TaskLog

AT = dt.datetime(2026, 7, 18, 8, tzinfo=dt.UTC)


@pytest.fixture
def api(spark, tmp_path):
    stored = {}
    s = service.Service(spark, TaskLog(spark, str(tmp_path / "log")), lambda name, body: stored.setdefault(f"/data/{name}", body) and f"/data/{name}", clock=lambda: AT)
    s.stored = stored
    return s


def test_upload_list_delete(api):
    status, body = api.upload("a@x", "my%20file.pdf", b"%PDF-1.7")
    assert (status, body["task"]["fileName"], body["task"]["status"]) == (202, "my file.pdf", "queued") and len(api.stored) == 1
    assert api.upload("a@x", "x.pdf", b"nope")[0] == 400 and api.upload("a@x", "a b", b"%PDF-")[0] == 400 and api.upload("a@x", "x.pdf", b"%PDF-" + b" " * (20 << 20))[0] == 413
    task = body["task"]["id"]
    assert [t["id"] for t in api.list("a@x")[1]["tasks"]] == [task] and api.list("b@x")[1]["tasks"] == [] and api.list("a@x", limit=0)[0] == 400
    assert api.get("b@x", task)[0] == 404 and api.get("a@x", task)[1]["task"]["pdf_expires_at"] == "2026-07-21T08:00:00.000Z"
    assert api.delete("a@x", [task])[0] == 409 and api.retry("a@x", task)[0] == 409
    api.log.claim(NOW)
    api.log.complete(task, AUDIT, NOW)
    assert api.retry("a@x", task)[0] == 202
    api.log.claim(NOW)
    api.log.fail(task, "PDF_INVALID", NOW)
    assert api.delete("b@x", [task])[0] == 404 and api.delete("a@x", [task]) == (200, {"deleted": 1}) and api.get("a@x", task)[0] == 404


def test_import_twice(api):
    body = json.dumps([old_task(), old_task(id="o2", status="failed")]).encode()
    assert api.import_history("a@x", body) == (200, {"imported": 2}) and api.import_history("a@x", body) == (200, {"imported": 0}) and api.import_history("b@x", body) == (200, {"imported": 2})
    assert api.migrate_history("c@x", body.decode()) == {"status": "imported", "imported": 2} and api.migrate_history("c@x", body.decode()) == {"status": "already-migrated", "imported": 0}
    assert api.migrate_history("d@x", "no json") == {"status": "skipped", "imported": 0} and api.migrate_history("d@x", body.decode())["status"] == "already-migrated"
    assert api.import_history("a@x", b"{" + b" " * 10)[0] == 400 and api.import_history("a@x", b" " * 1_400_000)[0] == 413


def test_finalize(api):
    status, body = api.finalize(json.dumps(GOLDEN).encode())
    assert (status, body["outcome"], body["model"]) == (200, "passed", "qwen3.7-plus")
    assert api.finalize(json.dumps(GOLDEN | {"x": 1}).encode())[0] == 400 and api.finalize(b"\xff")[0] == 400


def test_owners():
    assert service.owner_of({"OAI-Authenticated-User-Email": " A@X "}) == "a@x"
    assert service.owner_of({}, require_login=False, single_owner="Team") == "team" and service.owner_of({}, require_login=False, production=False) == "local-development"
    for bad in ({"require_login": True}, {"require_login": False}):
        with pytest.raises(service.Refused):
            service.owner_of({}, **bad)
    assert service.same_origin("https://a.com", "a.com") and service.same_origin(None, "a.com") and not service.same_origin("https://b.com", "a.com")


TASKS = "id string, file_name string, created_at string"


def test_client_lists(spark):
    t = spark.createDataFrame([("1", "Report%.pdf", "2026-07-10T00:00:00.000Z"), ("2", "Ärger_x.pdf", "2026-07-18T23:59:59.999Z"), ("3", "report2.pdf", "2026-07-12T00:00:00.000Z"), ("4", "report3.pdf", "never")], TASKS)
    ids = lambda df: sorted(r["id"] for r in df.collect())
    week = dates.preset_bounds("7d", dt.date(2026, 7, 18))
    everything = (None, None)
    assert ids(history.filtered(t, " REPORT ", everything)) == ["1", "3", "4"] and ids(history.filtered(t, "t%", everything)) == ["1"] and ids(history.filtered(t, "ärger", everything)) == ["2"] and ids(history.filtered(t, "", week)) == ["2", "3"]
    assert history.list_filters(" x ", week) == {"query": "x", "created_from": "2026-07-12T00:00:00.000Z", "created_to": "2026-07-18T23:59:59.999Z", "limit": 80}
    assert ids(t.filter(history.matches("t%2"))) == ["3"] and ids(t.filter(history.matches("ärger"))) == [] and ids(t.filter(history.matches(created_from="2026-07-12T00:00:00.000Z", created_to="2026-07-18T23:59:59.999Z"))) == ["2", "3"]
    new = spark.createDataFrame([("3", "new.pdf", "2026-07-19T00:00:00.000Z"), ("5", "five.pdf", "2026-07-01T00:00:00.000Z")], TASKS)
    assert [(r["id"], r["file_name"]) for r in history.upserted(t.filter("id < '4'"), new, 3).collect()] == [("3", "new.pdf"), ("2", "Ärger_x.pdf"), ("1", "Report%.pdf")]
    assert ids(history.removed(t, new)) == ["1", "2", "4"] and [r["id"] for r in history.visible(t, 2).collect()] == ["2", "3"]


def test_cache(spark):
    rows = [(str(i), "completed" if i % 2 else "queued", i < 3, i) for i in range(10)]
    kept = history.evicted(spark.createDataFrame(rows, "id string, status string, visible boolean, used int"), 7)
    assert sorted(r["id"] for r in kept.collect()) == ["0", "1", "2", "4", "6", "8", "9"]
    kind = "id string, generation int, gone boolean, status string, updated_at string, report string"
    old = spark.createDataFrame([("a", 1, False, "completed", NOW, "r"), ("b", 1, False, "completed", NOW, "r"), ("c", 5, False, "queued", NOW, None), ("d", 1, True, "completed", NOW, None), ("e", 1, False, "queued", NOW, None)], kind)
    new = spark.createDataFrame([("a", 2, False, "completed", NOW, None), ("b", 2, False, "completed", LATER, None), ("c", 4, False, "rendering", LATER, None), ("d", 2, False, "completed", NOW, None), ("f", 1, False, "queued", NOW, None)], kind)
    got = {r["id"]: (r["generation"], r["status"], r["report"]) for r in history.merged(old, new).collect()}
    assert got == {"a": (2, "completed", "r"), "b": (2, "completed", None), "c": (5, "queued", None), "d": (1, "completed", None), "e": (1, "queued", None), "f": (1, "queued", None)}
    assert tuple(history.tallies(spark.createDataFrame([(None,), ("x",), (None,)], "error string")).first()) == (2, 1)
