"""What a client keeps of the task list: filters, newest first, a bounded cache, versions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright import schemas
from tracewright.functions import dates, text
from tracewright.streaming.tasks import DEFAULT_LIMIT, MAX_LIMIT, utc

MAX_CACHED = 240


def time(c: Column) -> Column:
    """An ISO text as a time, null when it isn't one."""
    return F.try_to_timestamp(c)


def filtered(tasks: DataFrame, query: str, bounds: tuple[dt.date | None, dt.date | None]) -> DataFrame:
    """File names that hold the query as it is, in lower case, created in [first, last); no wildcards here."""
    query = query.strip(text.JS_SPACE).lower()
    out = tasks.filter(F.contains(F.lower("file_name"), F.lit(query))) if query else tasks
    return out if bounds == (None, None) else out.filter(dates.in_bounds(time(F.col("created_at")), bounds))


def list_filters(query: str, bounds: tuple[dt.date | None, dt.date | None], zone: dt.tzinfo = dt.UTC) -> dict:
    """The parameters of a list query; the last day's end is inclusive to the millisecond."""
    start = lambda d: dt.datetime(d.year, d.month, d.day, tzinfo=zone)
    first, last = bounds
    out = {"query": query.strip(text.JS_SPACE) or None, "created_from": utc(start(first)) if first else None, "created_to": utc(start(last) - dt.timedelta(milliseconds=1)) if last else None, "limit": DEFAULT_LIMIT}
    return {k: v for k, v in out.items() if v is not None}


def matches(query: str | None = None, created_from: str | None = None, created_to: str | None = None) -> Column:
    """Whether a task belongs to a list; both ends count, names match as in the store."""
    at = time(F.col("created_at"))
    ok = at.isNotNull()
    if query and query.strip(text.JS_SPACE):
        ok = ok & text.like_ascii(F.col("file_name"), query.strip(text.JS_SPACE))
    if created_from:
        ok = ok & (at >= F.lit(created_from).cast("timestamp"))
    if created_to:
        ok = ok & (at <= F.lit(created_to).cast("timestamp"))
    return F.coalesce(ok, F.lit(False))


def upserted(tasks: DataFrame, changed: DataFrame, limit: int = 80) -> DataFrame:
    """Changed tasks replace those of their id; the newest `limit` remain."""
    rest = tasks.join(changed.select("id"), "id", "left_anti").select(*tasks.columns)
    return changed.select(*tasks.columns).unionByName(rest).orderBy(F.desc("created_at"), F.desc("id")).limit(max(0, limit))


def removed(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """U6."""
    return tasks.join(ids.select("id").distinct(), "id", "left_anti")


def visible(tasks: DataFrame, limit: int = DEFAULT_LIMIT, **filters: str | None) -> DataFrame:
    """The newest matching tasks of a list."""
    return tasks.filter(matches(**filters)).orderBy(F.desc("created_at"), F.desc("id")).limit(min(max(limit, 1), MAX_LIMIT))


def evicted(cache: DataFrame, most: int = MAX_CACHED) -> DataFrame:
    """cache(id, status, visible, used) without what goes first when it is too large: neither active nor visible, longest unused."""
    needed = F.col("visible") | ~F.col("status").isin(*schemas.TERMINAL_STATUSES)
    rest = cache.filter(~needed).orderBy(F.desc("used"), "id").limit(most)
    rest = rest.withColumn("__place", F.row_number().over(W.orderBy(F.desc("used"), "id")))  # at most `most` rows
    held = cache.agg(F.count_if(needed).alias("__held")).withColumn("__one", F.lit(1))  # one row
    rest = rest.withColumn("__one", F.lit(1)).join(F.broadcast(held), "__one").filter(F.col("__place") + F.col("__held") <= most)
    return cache.filter(needed).unionByName(rest.select(*cache.columns))


def merged(cached: DataFrame, read: DataFrame) -> DataFrame:
    """J15, T-13, T-14: cached(id, generation, ...) with a list's rows: newer generations win, tombstones stay, and a report is kept only for the same finished snapshot.

    Both hold id, generation, gone, status, updated_at, report; rows of lists have a null report.
    """
    names = [c for c in read.columns if c != "id"]
    new = read.select("id", F.struct(*names).alias("new"))
    both = cached.select("id", F.struct(*names).alias("old")).join(new, "id", "full")
    stale = F.col("new").isNull() | (F.col("old").isNotNull() & (F.col("old.gone") | (F.col("old.generation") > F.col("new.generation"))))
    same = F.col("old").isNotNull() & (F.col("old.status") == F.col("new.status")) & F.col("new.status").isin(*schemas.TERMINAL_STATUSES) & (F.col("old.updated_at") == F.col("new.updated_at"))
    kept = F.when(F.coalesce(same, F.lit(False)), F.coalesce(F.col("new.report"), F.col("old.report"))).otherwise(F.col("new.report"))
    row = F.when(F.coalesce(stale, F.lit(False)), F.col("old")).otherwise(F.col("new").withField("report", kept))
    return both.select("id", row.alias("r")).select("id", *[f"r.{c}" for c in names])


def tallies(results: DataFrame) -> DataFrame:
    """results(error) settled: how many went well and how many didn't."""
    return results.agg(F.count_if(F.col("error").isNull()).alias("fulfilled"), F.count_if(F.col("error").isNotNull()).alias("rejected"))
