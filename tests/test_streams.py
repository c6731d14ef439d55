"""Event-time streams by hand, and the clustered history."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import clustered
from tracewright.streaming import tasks as store
from tracewright.streaming import timers

HOUR = 3_600_000_000


def by_hand(events):
    """Expiries of a key's events, known in full: [at, seq, expires]."""
    events = sorted(events)
    return [e for e, after in itertools.zip_longest(events, events[1:]) if e[2] is not None and (after is None or after[0] > e[2])]


def test_decisions_are_those_of_all_events_in_any_order():
    rng = random.Random(8)
    for _ in range(400):
        events, at = [], 0
        for n in range(rng.randrange(1, 9)):
            at += rng.randrange(0, 5) * HOUR
            events.append([at, n, rng.choice([None, at + HOUR, at + 3 * HOUR, at])])
        arrivals = sorted(((e[0] + rng.randrange(3 * HOUR), e) for e in events for _ in range(rng.randrange(1, 3))), key=lambda x: x[0])
        pending, out, newest = [], [], 0
        for _, e in arrivals:  # at most three hours late
            watermark = newest - 3 * HOUR
            assert e[0] >= watermark
            if e[1] not in {p[1] for p in pending}:
                pending = sorted([*pending, e])
            told, pending = timers.decide(pending, watermark)
            out += told
            newest = max(newest, e[0])
        told, pending = timers.decide(pending, at + 100 * HOUR)
        assert sorted(out + told) == by_hand(events) and pending == []


def test_pending_events_are_bounded_by_lateness():
    pending = []
    for n in range(500):
        _, pending = timers.decide([*pending, [n * HOUR, n, n * HOUR + 2 * HOUR]], (n - 3) * HOUR)
        assert len(pending) <= 6


def stream(spark, tmp_path, batches, schema, make):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        run = make(source).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out")
        run.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out").collect()


def at(hours):
    import datetime as dt

    return dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(hours=hours)


def test_states_with_tombstones_and_late_events(spark, tmp_path):
    e = lambda i, h, n, s, failed=False, gone=False: (i, at(h), n, s, failed, gone)
    batches = [
        [e("a", 1, 1, "queued"), e("a", 3, 3, "locating", True), e("b", 1, 1, "queued"), e("c", 1, 1, "queued"), e("c", 2, 2, "failed"), e("d", 2, 9, "rendering")],
        [e("a", 2, 2, "rendering", True), e("a", 3, 3, "locating", True), e("b", 4, 4, "deleted", False, True), e("c", 3, 3, "queued")],  # late, repeated, a tombstone, and after an end
        [e("b", 3, 3, "rendering"), e("a", 5, 5, "completed"), e("b", 6, 6, "queued")],
        [e("x", 30, 1, "queued")],
        [e("x", 31, 2, "rendering"), e("a", 2, 7, "failed", True)],  # far too late
        [e("b", 29, 8, "queued")],  # a new task under an old name, when its tombstone is gone
    ]
    rows = stream(spark, tmp_path, batches, timers.CHANGE, lambda s: timers.states(s, "4 hours"))
    last = {}
    for r in sorted(rows, key=lambda r: (r["at"], r["version"])):
        last[r["id"]] = (r["status"], r["failures"], r["gone"])
    assert last == {"a": ("completed", 2, False), "b": ("queued", 0, False), "c": ("failed", 0, False), "x": ("rendering", 0, False)}
    assert ("deleted", True) in {(r["status"], r["gone"]) for r in rows if r["id"] == "b"}
    assert not any(r["id"] == "b" and r["seq"] in (3, 6) for r in rows)


def test_retention_ends_with_the_state(spark, tmp_path):
    batches = [[("f", at(0), 1, at(72)), ("g", at(0), 2, at(1)), ("h", at(1), 3, at(2))], [("f", at(10), 4, None), ("g", at(0), 2, at(1)), ("h", at(1.5), 5, at(30))], [("", at(200), 6, None)], [("", at(201), 7, None)]]
    rows = stream(spark, tmp_path, batches, timers.TIMED, lambda s: timers.expiries(s, "12 hours"))
    assert sorted((r["id"], r["seq"]) for r in rows) == [("g", 2), ("h", 5)]


def made_tasks(spark, n=5000):
    rng = random.Random(3)
    rows = [(f"{i:06d}", rng.choice(["a@x", "a@x", "a@x", "b@x", "c@x"]) if i % 50 else None, f"2024-01-{rng.randrange(1, 29):02d}T{rng.randrange(24):02d}:00:00.000Z", f"Report {i % 97}.pdf", rng.choice(["queued", "completed", "failed"]), rng.choice([None, "needs_review"]), rng.choice([None, 2])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id string, owner_email string, created_at string, file_name string, status string, outcome string, issue_count int").repartition(5)


@pytest.fixture(scope="module")
def layout(spark, tmp_path_factory):
    rows, df = made_tasks(spark)
    kept = clustered.ClusteredHistory(spark, str(tmp_path_factory.mktemp("history")))
    kept.write(df, file_rows=200)
    return rows, kept


def listed(rows, owner, test=lambda r: True):
    return [r[0] for r in sorted((r for r in rows if r[1] == owner and test(r)), key=lambda r: (r[2], r[0]), reverse=True)]


def test_pages_follow_one_another_and_read_few_files(layout):
    rows, kept = layout
    assert kept.index().select("file").distinct().count() >= 15
    for owner in ("a@x", "b@x", "nobody@x"):
        got, after, read, pages = [], None, 0, 0
        while True:
            page = kept.page(owner, after=after, limit=150)
            got, read, pages, after = got + [r["id"] for r in page.rows], read + page.files_read, pages + 1, page.cursor
            assert page.files_read <= 3
            if after is None:
                break
        assert got == listed(rows, owner)
    assert kept.cursor("a@x", got[0] if got else listed(rows, "a@x")[7]) == next((r[2], r[0]) for r in rows if r[0] == listed(rows, "a@x")[7])
    assert kept.cursor("b@x", listed(rows, "a@x")[0]) is None


def test_filters_of_pages(layout):
    rows, kept = layout
    page = kept.page("a@x", query="REPORT 9_", limit=40)
    assert [r["id"] for r in page.rows] == listed(rows, "a@x", lambda r: int(r[0]) % 97 in (9, *range(90, 97)))[:40] and page.cursor
    page = kept.page("a@x", created_from="2024-01-05T00:00:00.000Z", created_to="2024-01-06T12:00:00.000Z", limit=200)
    want = listed(rows, "a@x", lambda r: "2024-01-05T00:00:00.000Z" <= r[2] <= "2024-01-06T12:00:00.000Z")
    assert [r["id"] for r in page.rows] == want[:200] and page.files_read <= 3
    assert kept.page("a@x", query="nothing like it", limit=5).rows == []


def test_figures_come_from_the_index(spark, layout):
    rows, kept = layout
    df = spark.createDataFrame([r for r in rows if r[1]], "id string, owner_email string, created_at string, file_name string, status string, outcome string, issue_count int")
    assert kept.kpis().first() == store.kpis(df).first()
    assert kept.kpis("a@x").first() == store.kpis(df.filter("owner_email = 'a@x'")).first()
    assert tuple(kept.kpis("nobody@x").first()) == (0, 0, 0)
    assert kept.index().agg(F.sum("n")).first()[0] == sum(1 for r in rows if r[1])
