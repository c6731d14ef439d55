"""Queries of the task life cycle: orders are tasks, customers own and import them. Each calls the store's rule and has a DuckDB twin."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright import schemas
from tracewright.functions import misc
from tracewright.operators import clustered, history
from tracewright.plans.queries import query, table
from tracewright.shipping import place
from tracewright.streaming import tasks as store

NOW = "2001-08-01T00:00:00.000Z"
#: Every finished sixth order has this summary.
_SUMMARY = '{"parserMode":"m","pageCount":3,"rightsFieldCount":2,"groupCount":1,"tableRowCount":4,"screenshotHeadingCount":5,"warnings":["w"],"confidence":0.5,"extractionComplete":true}'
_quoted = lambda items: ", ".join(f"'{x}'" for x in items)
_TERMINAL, _ACTIVE = _quoted(schemas.TERMINAL_STATUSES), _quoted(schemas.ACTIVE_STATUSES)

_TASKS = f"""WITH o AS (
  SELECT printf('%010d', o_orderkey) AS id, o_orderkey AS k, 'segment-' || (o_custkey % 7) AS owner_email, o_orderpriority || '.pdf' AS file_name, o_custkey AS file_size,
         [{_quoted(schemas.TASK_STATUSES)}][1 + o_orderkey % 10] AS status, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS created_at, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%dT%H:%M:%S.000Z') AS due,
         (o_custkey % 5)::INTEGER AS attempt_count FROM orders
), t AS (
  SELECT *, CASE WHEN k % 3 <> 0 THEN '/data/' || (k % 1000) || '.pdf' END AS pdf_path, CASE WHEN k % 4 <> 0 THEN due END AS pdf_expires_at, CASE WHEN k % 11 = 0 THEN created_at END AS pdf_deleted_at,
         (k % 100)::INTEGER AS progress, (k % 7)::INTEGER AS processed_pages, 7 AS total_pages, CASE WHEN status = 'completed' THEN ['passed', 'issues_found', 'needs_review'][1 + (k // 10) % 3] END AS outcome,
         CASE WHEN status = 'completed' THEN ((k // 10) % 5)::INTEGER END AS issue_count, CASE WHEN status <> 'queued' THEN created_at END AS started_at, CASE WHEN status IN ({_TERMINAL}) THEN created_at END AS completed_at,
         CASE WHEN status = 'failed' THEN 'MODEL_UNAVAILABLE' END AS error_code FROM o
)"""


def tasks(spark, sf_dir) -> DataFrame:
    """Orders as rows of the task store."""
    k, null = F.col("o_orderkey"), store.null
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    status = F.get(F.array(*[F.lit(s) for s in schemas.TASK_STATUSES]), (k % 10).cast("int"))
    o = table(spark, sf_dir, "orders").withColumns({"status": status, "created_at": iso("o_orderdate")})
    done, finished = F.col("status") == "completed", F.col("status").isin(*schemas.TERMINAL_STATUSES)
    tens = F.floor(k / 10)
    columns = {
        "id": F.format_string("%010d", k), "owner_email": F.concat(F.lit("segment-"), F.col("o_custkey") % 7), "file_name": F.concat("o_orderpriority", F.lit(".pdf")), "file_size": F.col("o_custkey"), "file_type": F.lit("application/pdf"),
        "pdf_path": F.when(k % 3 != 0, F.concat(F.lit("/data/"), (k % 1000).cast("string"), F.lit(".pdf"))), "pdf_expires_at": F.when(k % 4 != 0, iso(F.col("o_orderdate") + F.expr("interval 30 days"))),
        "pdf_deleted_at": F.when(k % 11 == 0, F.col("created_at")), "status": F.col("status"), "progress": (k % 100).cast("int"), "processed_pages": (k % 7).cast("int"), "total_pages": F.lit(7),
        "outcome": F.when(done, F.get(F.array(F.lit("passed"), F.lit("issues_found"), F.lit("needs_review")), (tens % 3).cast("int"))), "model": null(), "issue_count": F.when(done, (tens % 5).cast("int")),
        "summary_json": F.when(finished & (k % 6 == 2), _SUMMARY), "report_json": null(), "report_text": null(), "error_code": F.when(F.col("status") == "failed", "MODEL_UNAVAILABLE"), "error_message": F.when(F.col("status") == "failed", store.FAILURES["MODEL_UNAVAILABLE"]),
        "attempt_count": (F.col("o_custkey") % 5).cast("int"), "created_at": F.col("created_at"), "updated_at": F.col("created_at"), "started_at": F.when(F.col("status") != "queued", F.col("created_at")), "completed_at": F.when(finished, F.col("created_at")),
    }
    return o.select(*[columns[c].alias(c) for c in store.TASK_COLUMNS])


def number(c: str = "id"):
    return F.col(c).cast("long")


@query(f"""{_TASKS} SELECT id, 'rendering' AS status, 1 AS progress, 0 AS processed_pages, attempt_count + 1 AS attempt_count, coalesce(started_at, '{NOW}') AS started_at, '{NOW}' AS updated_at
FROM t WHERE status = 'queued' AND attempt_count < 3 ORDER BY created_at, id LIMIT 3""")
def claim_oldest(spark, sf_dir):
    """O4, T-2: the three oldest queued tasks with attempts left, as started."""
    return store.claimed(tasks(spark, sf_dir), NOW, 3).select("id", "status", "progress", "processed_pages", "attempt_count", "started_at", "updated_at")


@query(f"""{_TASKS} SELECT id, 'recognizing' AS status, 50 AS progress, 3 AS processed_pages, 9 AS total_pages, '{NOW}' AS updated_at FROM t WHERE status NOT IN ({_TERMINAL}) AND k % 2 = 0 AND k % 3 <> 0""")
def task_progress(spark, sf_dir):
    """T-3: progress of unfinished tasks; finished ones and updates to a final status are refused."""
    t = tasks(spark, sf_dir)
    updates = t.filter(number() % 2 == 0).select("id", F.when(number() % 3 == 0, "completed").otherwise("recognizing").alias("status"), F.lit(50).alias("progress"), F.lit(3).alias("processed_pages"), F.lit(9).alias("total_pages"))
    return store.progressed(t, updates, NOW).select("id", "status", "progress", "processed_pages", "total_pages", "updated_at")


@query(f"""{_TASKS} SELECT id, 'completed' AS status, 100 AS progress, 'passed' AS outcome, (k % 4)::INTEGER AS issue_count, '{{}}' AS summary_json, 'text ' || id AS report_text, '{schemas.MODEL}' AS model, '{NOW}' AS completed_at, attempt_count
FROM t WHERE status NOT IN ({_TERMINAL}) AND k % 2 = 0""")
def task_complete(spark, sf_dir):
    """K3, T-1: results of unfinished tasks."""
    t = tasks(spark, sf_dir)
    audits = t.filter(number() % 2 == 0).select("id", F.lit("passed").alias("outcome"), (number() % 4).cast("int").alias("issue_count"), F.lit("{}").alias("summary_json"), F.lit("{}").alias("report_json"), F.concat(F.lit("text "), F.col("id")).alias("report_text"))
    return store.completed(t, audits, NOW).select("id", "status", "progress", "outcome", "issue_count", "summary_json", "report_text", "model", "completed_at", "attempt_count")


_CODES = ["PDF_INVALID", "NEVER_HEARD_OF", "WORKER_RETRY_EXHAUSTED"]
_MESSAGES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in store.FAILURES.items())


@query(f"""{_TASKS}, f AS (SELECT *, [{_quoted(["PDF_INVALID", "INTERNAL_ERROR", "WORKER_RETRY_EXHAUSTED"])}][1 + k % 3] AS code FROM t WHERE status NOT IN ({_TERMINAL}))
SELECT id, 'failed' AS status, code AS error_code, CASE code {_MESSAGES} END AS error_message, coalesce(outcome, '') AS outcome, '{NOW}' AS completed_at FROM f""")
def task_fail(spark, sf_dir):
    """Failures of unfinished tasks; an unknown code becomes INTERNAL_ERROR, and the message is the code's own."""
    t = tasks(spark, sf_dir)
    failures = t.select("id", F.get(F.array(*[F.lit(c) for c in _CODES]), (number() % 3).cast("int")).alias("code"))
    return store.failed(t, failures, NOW).select("id", "status", "error_code", "error_message", F.coalesce("outcome", F.lit("")).alias("outcome"), "completed_at")


_GIVEN = [f"{k:010d}" for k in range(1, 60)]


@query(f"""{_TASKS} SELECT id, 'queued' AS status, 0 AS progress, greatest(attempt_count - 1, 0) AS attempt_count, started_at FROM t WHERE status IN ({_ACTIVE}) AND k BETWEEN 1 AND 59""")
def task_requeue(spark, sf_dir):
    """T-5: tasks given back at a graceful stop; the attempt doesn't count, and never falls below 0."""
    return store.requeued(tasks(spark, sf_dir), _GIVEN, NOW).select("id", "status", "progress", "attempt_count", "started_at")


@query(f"""{_TASKS} SELECT id, CASE WHEN attempt_count < 3 THEN 'queued' ELSE 'failed' END AS status, CASE WHEN attempt_count < 3 THEN 0 ELSE progress END AS progress,
  CASE WHEN attempt_count < 3 THEN '' ELSE 'WORKER_RETRY_EXHAUSTED' END AS error_code, attempt_count FROM t WHERE status IN ({_ACTIVE})""")
def task_recover(spark, sf_dir):
    """T-4, A18: active tasks after a crash."""
    return store.recovered(tasks(spark, sf_dir), NOW).select("id", "status", "progress", F.coalesce("error_code", F.lit("")).alias("error_code"), "attempt_count")


@query(f"""{_TASKS} SELECT id, 'queued' AS status, 0 AS attempt_count, true AS cleared FROM t
WHERE status IN ({_TERMINAL}) AND pdf_path IS NOT NULL AND pdf_deleted_at IS NULL AND (pdf_expires_at IS NULL OR pdf_expires_at > '1992-01-01T00:00:00.000Z') AND k BETWEEN 1 AND 90 AND owner_email IN ('segment-1', 'segment-2')""")
def task_retry(spark, sf_dir):
    """T-6: of some finished tasks those of their owner whose file is still there, as new."""
    t = tasks(spark, sf_dir)
    asked = [(owner, f"{k:010d}") for owner in ("segment-1", "segment-2") for k in range(1, 91)]
    again = store.retried(t, asked, "1992-01-01T00:00:00.000Z")
    cleared = F.coalesce("outcome", "summary_json", "report_text", "error_code", "started_at", "completed_at").isNull() & F.col("issue_count").isNull()
    return again.select("id", "status", "attempt_count", cleared.alias("cleared"))


@query(f"""{_TASKS}, b AS (SELECT id, pdf_path, status, owner_email, CASE WHEN k % 10 IN (8, 9) THEN 'finished' ELSE 'mixed' END AS batch FROM t WHERE k BETWEEN 1 AND 90 AND (k % 10 IN (8, 9) OR k % 20 = 1) AND owner_email = 'segment-3')
SELECT 'finished' AS batch, id, pdf_path IS NOT NULL AS has_file FROM b WHERE status IN ({_TERMINAL})
UNION ALL SELECT 'mixed', id, pdf_path IS NOT NULL FROM t WHERE k BETWEEN 1 AND 90 AND (k % 10 IN (8, 9) OR k % 20 = 1) AND owner_email = 'segment-3'
  AND NOT EXISTS (SELECT 1 FROM b WHERE status NOT IN ({_TERMINAL}))""")
def task_delete(spark, sf_dir):
    """T-7, U5: a batch of finished tasks goes as a whole, one with a task that is still active doesn't go at all; ids count once."""
    t = tasks(spark, sf_dir)
    finished = [f"{k:010d}" for k in range(1, 91) if k % 10 in (8, 9)]
    mixed = [*finished, *(f"{k:010d}" for k in range(1, 91) if k % 20 == 1)]
    gone = lambda name, ids: store.deletable(t, "segment-3", ids + ids[:1]).filter("not blocked").select(F.lit(name).alias("batch"), "id", F.col("pdf_path").isNotNull().alias("has_file"))
    return gone("finished", finished).unionByName(gone("mixed", mixed))


_LAST = "1999-01-01T00:00:00.000Z"


@query(f"""{_TASKS} SELECT id, '{_LAST}' AS pdf_deleted_at, true AS path_gone FROM t WHERE status IN ({_TERMINAL}) AND pdf_path IS NOT NULL AND pdf_deleted_at IS NULL AND pdf_expires_at IS NOT NULL AND pdf_expires_at <= '{_LAST}' AND k BETWEEN 1 AND 59""")
def task_files_deleted(spark, sf_dir):
    """T-8: files of finished tasks past their time, marked as deleted."""
    return store.file_deleted(tasks(spark, sf_dir), _GIVEN, _LAST).select("id", "pdf_deleted_at", F.col("pdf_path").isNull().alias("path_gone"))


@query(f"""WITH i AS (SELECT 'legacy-' || sha256(c_mktsegment || chr(0) || (c_custkey % 500)::VARCHAR) AS id, c_custkey, c_nationkey % 3 AS kind FROM customer),
f AS (SELECT id, min(c_custkey) AS first, arg_min(kind, c_custkey) AS kind FROM i GROUP BY id), old AS (SELECT 'legacy-' || sha256(c_mktsegment || chr(0) || (c_custkey % 500)::VARCHAR) AS id FROM customer WHERE c_custkey % 10 = 0)
SELECT id, 'me' AS owner_email, CASE kind WHEN 0 THEN '' WHEN 1 THEN 'INTERNAL_ERROR' ELSE 'PDF_ENCRYPTED' END AS error_code, CASE kind WHEN 0 THEN '' WHEN 1 THEN '{store.FAILURES["INTERNAL_ERROR"]}' ELSE '{store.FAILURES["PDF_ENCRYPTED"]}' END AS error_message, first AS file_size
FROM f WHERE id NOT IN (SELECT id FROM old)""")
def idempotent_import(spark, sf_dir):
    """Customers imported under hashed ids, of equal ids the first, none that is there already; codes made safe."""
    c = table(spark, sf_dir, "customer").withColumn("id", misc.legacy_id(F.col("c_mktsegment"), (F.col("c_custkey") % 500).cast("string")))
    code = F.when(F.col("c_nationkey") % 3 == 1, "whatever").when(F.col("c_nationkey") % 3 == 2, "PDF_ENCRYPTED")
    kinds = {x.split()[0]: x.split()[1] for x in store.TASK.replace("\n", " ").split(", ")}
    known = {"id": F.col("id"), "file_size": F.col("c_custkey"), "error_code": code}
    incoming = c.select(*[known.get(n, store.null(kind)).alias(n) for n, kind in kinds.items()], F.col("c_custkey").alias("ord"))
    new = store.importable(c.filter("c_custkey % 10 = 0").select("id"), incoming, "me")
    return new.select("id", "owner_email", F.coalesce("error_code", F.lit("")).alias("error_code"), F.coalesce("error_message", F.lit("")).alias("error_message"), "file_size")


@query(f"""{_TASKS} SELECT 'status' AS kind, status AS key, count(*) AS n FROM t GROUP BY status
UNION ALL SELECT 'kpi', 'active', count_if(status NOT IN ({_TERMINAL}))::BIGINT FROM t UNION ALL SELECT 'kpi', 'needs_review', count_if(outcome = 'needs_review')::BIGINT FROM t UNION ALL SELECT 'kpi', 'issues', sum(coalesce(issue_count, 0))::BIGINT FROM t""")
def kpi_rollup(spark, sf_dir):
    """The dashboard's figures and the histogram of states."""
    t = tasks(spark, sf_dir)
    k = store.kpis(t).select(F.inline(F.array(*[F.struct(F.lit("kpi").alias("kind"), F.lit(c).alias("key"), F.col(c).cast("long").alias("n")) for c in ("active", "needs_review", "issues")])))
    return store.status_histogram(t).select(F.lit("status").alias("kind"), F.col("status").alias("key"), F.col("count").alias("n")).unionByName(k)


@query(f"""{_TASKS} SELECT id, status, pdf_path IS NOT NULL AND pdf_deleted_at IS NULL AND (pdf_expires_at IS NULL OR pdf_expires_at > '{_LAST}') AS pdf_available,
  CASE WHEN status IN ({_TERMINAL}) AND k % 6 = 2 THEN 3 ELSE -1 END AS pages, CASE WHEN status IN ({_TERMINAL}) AND k % 6 = 2 THEN 0.5::DOUBLE ELSE -1.0::DOUBLE END AS confidence, false AS shows_path, true AS report_in_detail FROM t""")
def task_views(spark, sf_dir):
    """What a list and a detail show: the parsed summary, whether the file is available, never its path or the owner."""
    shown, whole = store.summary(tasks(spark, sf_dir), _LAST), store.detail(tasks(spark, sf_dir), _LAST)
    private = F.lit(bool({"pdf_path", "owner_email", "attempt_count"} & {*shown.columns, *whole.columns}))
    return shown.select("id", "status", "pdf_available", F.coalesce("summary.pageCount", F.lit(-1)).alias("pages"), F.coalesce("summary.confidence", F.lit(-1.0)).alias("confidence"), private.alias("shows_path"), F.lit("report" in whole.columns and "report" not in shown.columns).alias("report_in_detail"))


@query(f"""{_TASKS} SELECT id, owner_email, coalesce(pdf_path, '') AS pdf_path, attempt_count, total_pages FROM t""")
def worker_rows(spark, sf_dir):
    """Tasks as a worker gets them, with owner, path and attempts."""
    return store.worker_view(tasks(spark, sf_dir), NOW).select("id", "owner_email", F.coalesce("pdf_path", F.lit("")).alias("pdf_path"), "attempt_count", "total_pages")


@query(f"""SELECT event_id, CASE WHEN event_type = 'error' THEN (CASE WHEN user_id % 4 = 0 THEN 'PDF_INVALID' WHEN user_id % 4 = 1 THEN 'INTERNAL_ERROR' WHEN user_id % 4 = 2 THEN 'INTERNAL_ERROR' ELSE 'PDF_ENCRYPTED' END)
  WHEN event_type = 'click' THEN (CASE WHEN user_id % 4 = 0 THEN 'PDF_INVALID' WHEN user_id % 4 = 1 THEN 'PDF_RENDER_FAILED' WHEN user_id % 4 = 2 THEN 'INTERNAL_ERROR' ELSE 'PDF_ENCRYPTED' END)
  WHEN event_type = 'view' THEN (CASE WHEN user_id % 4 = 2 THEN 'INVALID_MODEL_OUTPUT' ELSE 'MODEL_UNAVAILABLE' END) ELSE 'INTERNAL_ERROR' END AS code FROM events""")
def classify_errors(spark, sf_dir):
    """Errors of the worker, the renderer, the model and anything else as failure codes."""
    source = F.when(F.col("event_type") == "error", "worker").when(F.col("event_type") == "click", "pdf").when(F.col("event_type") == "view", "model").otherwise("disk")
    code = F.when((F.col("user_id") % 4 == 0), F.when(source == "pdf", "PDF_UNSUPPORTED").otherwise("PDF_INVALID")).when(F.col("user_id") % 4 == 1, F.when(source == "worker", "NO_SUCH").otherwise("PDF_IMAGE_TOO_LARGE")).when(F.col("user_id") % 4 == 2, F.when(source == "worker", "?").otherwise("INVALID_MODEL_OUTPUT")).otherwise("PDF_ENCRYPTED")
    return table(spark, sf_dir, "events").select("event_id", store.classify_error(source, code).alias("code"))


@query(f"""{_TASKS} SELECT id, created_at FROM t WHERE translate(file_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%-h_g%' AND created_at >= '1996-01-01T00:00:00.000Z' AND created_at <= '1998-12-31T23:59:59.999Z' ORDER BY created_at DESC, id DESC LIMIT 80""")
def client_list(spark, sf_dir):
    """The newest 80 tasks that match a client's query and days, both ends included."""
    f = history.list_filters(" -H_G ", (dt.date(1996, 1, 1), dt.date(1999, 1, 1)))
    return history.visible(tasks(spark, sf_dir), f["limit"], query=f["query"], created_from=f["created_from"], created_to=f["created_to"]).select("id", "created_at")


@query(f"""{_TASKS} SELECT id, file_name FROM t WHERE contains(lower(file_name), '5-low') AND created_at >= '1997-02-01T00:00:00.000Z' AND created_at < '1997-08-01T00:00:00.000Z'""")
def client_filter(spark, sf_dir):
    """Names that hold the query as it is, created in a span of days."""
    return history.filtered(tasks(spark, sf_dir), " 5-LOW ", (dt.date(1997, 2, 1), dt.date(1997, 8, 1))).select("id", "file_name")


@query(f"""WITH c AS (SELECT c_custkey AS id, c_nationkey % 5 = 0 AS visible, c_nationkey % 7 IN (1, 2) AS active, c_acctbal AS used FROM customer),
r AS (SELECT *, row_number() OVER (ORDER BY visible OR active DESC, used DESC, id) AS rank FROM c) SELECT id FROM r WHERE rank <= {history.MAX_CACHED} OR visible OR active""")
def cache_eviction(spark, sf_dir):
    """A client's cache of customers; what is active or visible stays, then the last used."""
    status = F.when((F.col("c_nationkey") % 7).isin(1, 2), "rendering").otherwise("failed")
    cache = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), status.alias("status"), (F.col("c_nationkey") % 5 == 0).alias("visible"), F.col("c_acctbal").alias("used"))
    return history.evicted(cache).select("id")


@query("SELECT count_if(event_type <> 'error')::BIGINT AS fulfilled, count_if(event_type = 'error')::BIGINT AS rejected FROM events")
def settled_tallies(spark, sf_dir):
    """How many of many actions went well."""
    return history.tallies(table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", F.col("props")).alias("error")))


@query(f"""{_TASKS}, files AS (SELECT '/data/' || p_partkey || '.pdf' AS path, p_size FROM part), claims AS (SELECT path FROM files WHERE p_size % 5 = 0)
SELECT 'orphan' AS kind, path FROM files WHERE p_size < 25 AND path NOT IN (SELECT pdf_path FROM t WHERE pdf_path IS NOT NULL) AND path NOT IN (SELECT path FROM claims)
UNION ALL SELECT 'pruned', path FROM files WHERE p_size % 5 = 0 AND p_size <= 30 AND path NOT IN (SELECT pdf_path FROM t WHERE pdf_path IS NOT NULL)""")
def orphan_rows(spark, sf_dir):
    """J12, J13, T-9: old files that no task names and nobody has claimed, and old claims on files that no task names."""
    t, day = tasks(spark, sf_dir), F.lit(dt.datetime(2001, 1, 1, tzinfo=dt.UTC))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("/data/"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("path"), "p_size", (day + F.make_dt_interval(F.col("p_size"))).alias("modified"))
    claims = files.filter("p_size % 5 = 0").select(F.col("path").alias("pdf_path"), F.format_string("%04d", "p_size").alias("claimed_at"))
    orphans = store.orphans(files.select("path", "modified"), t, claims, dt.datetime(2001, 1, 26, tzinfo=dt.UTC))
    return orphans.select(F.lit("orphan").alias("kind"), "path").unionByName(store.prunable(claims, t, "0030").select(F.lit("pruned").alias("kind"), F.col("pdf_path").alias("path")))


@query(f"""{_TASKS}, p AS (SELECT DISTINCT ON (pdf_path) pdf_path, created_at AS queued_at FROM t WHERE pdf_path IS NOT NULL AND status = 'failed' ORDER BY pdf_path, created_at, id)
SELECT pdf_path, row_number() OVER (ORDER BY queued_at, pdf_path) AS place FROM p ORDER BY queued_at, pdf_path LIMIT 50""")
def pending_deletions(spark, sf_dir):
    """Files waiting for deletion, each once under its first time, oldest first."""
    t = tasks(spark, sf_dir).filter("status = 'failed' and pdf_path is not null")
    return store.waiting(t.select("pdf_path", F.col("created_at").alias("queued_at")), 50)


_HISTORY = """WITH t AS (SELECT printf('%010d', o_orderkey) AS id, 'segment-' || (o_custkey % 7) AS owner_email, o_orderpriority AS file_name, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'rendering' ELSE 'queued' END AS status, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 'needs_review' END AS outcome, CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice / 100000)::INTEGER END AS issue_count FROM orders)"""
_PAGE = 25


@query(f"""{_HISTORY}, p AS (SELECT owner_email, id, created_at, row_number() OVER (PARTITION BY owner_email ORDER BY created_at DESC, id DESC) AS place FROM t WHERE owner_email IN ('segment-1', 'segment-4') AND created_at <= '2000-06-30T00:00:00.000Z'),
q AS (SELECT owner_email, id, created_at, row_number() OVER (ORDER BY created_at DESC, id DESC) AS place FROM t WHERE owner_email = 'segment-2' AND contains(lower(file_name), 'urgent')),
k AS (SELECT owner_email, count_if(status NOT IN ('completed', 'failed'))::BIGINT AS active, count_if(coalesce(outcome, '') = 'needs_review')::BIGINT AS review, sum(coalesce(issue_count, 0))::BIGINT AS issues FROM t WHERE owner_email = 'segment-1' GROUP BY 1)
SELECT 'page' AS kind, owner_email, id, created_at, place, true AS few_files FROM p WHERE place <= {3 * _PAGE} UNION ALL SELECT 'found', owner_email, id, created_at, place, true FROM q WHERE place <= {_PAGE}
UNION ALL SELECT 'active', owner_email, '', '', active, true FROM k UNION ALL SELECT 'needs_review', owner_email, '', '', review, true FROM k UNION ALL SELECT 'issues', owner_email, '', '', issues, true FROM k""")
def history_pages(spark, sf_dir):
    """Pages of a history that is clustered by owner and time, each from its cursor, and the dashboard's figures from the index; a page reads three files at most."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "rendering").otherwise("queued")
    done = F.col("o_orderstatus") == "F"
    t = o.select(
        F.format_string("%010d", "o_orderkey").alias("id"), F.concat(F.lit("segment-"), F.col("o_custkey") % 7).alias("owner_email"), F.col("o_orderpriority").alias("file_name"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"),
        status.alias("status"), F.when(done & (F.col("o_totalprice") > 200000), "needs_review").alias("outcome"), F.when(done, F.floor(F.col("o_totalprice") / 100000).cast("int")).alias("issue_count"),
    )
    kept = clustered.ClusteredHistory(spark, place(spark, "history"))
    kept.write(t, file_rows=1000)
    out = []
    for owner in ("segment-1", "segment-4"):
        after, n = None, 0
        for _ in range(3):
            page = kept.page(owner, created_to="2000-06-30T00:00:00.000Z", after=after, limit=_PAGE)
            out += [("page", owner, r["id"], r["created_at"], n + i + 1, page.files_read <= 3) for i, r in enumerate(page.rows)]
            n += len(page.rows)
            if page.cursor is None:
                break
            after = kept.cursor(owner, page.cursor[1])  # as a client gives it: the id alone
    page = kept.page("segment-2", query="uRGENT", limit=_PAGE)
    out += [("found", "segment-2", r["id"], r["created_at"], i + 1, page.files_read <= 3) for i, r in enumerate(page.rows)]
    figures = kept.kpis("segment-1").first()
    out += [(c, "segment-1", "", "", figures[c], True) for c in ("active", "needs_review", "issues")]
    return spark.createDataFrame(out, "kind string, owner_email string, id string, created_at string, place long, few_files boolean")
