"""Streams over the events, which arrive shuffled, late and partly twice; each result is that of the batch rule over the table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.plans.queries import SQL, query, table
from tracewright.shipping import place
from tracewright.streaming import tasks as store
from tracewright.streaming import timers

NOW = dt.datetime(2024, 2, 1, tzinfo=dt.UTC)
#: Events arrive up to a day after they happened; what is older than two days behind the newest isn't waited for.
LATENESS, LATEST = "2 days", 86_400
PARTS = 3


def played(events: DataFrame, stream: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What a stream gives for events(id, at, seq, ...), in as many deliveries as there are parts: each event comes up to a day late, every third one again later. Afterwards the clock is moved to
    NOW by rows of a key of their own."""
    spark = events.sparkSession
    folder = place(spark, name)
    first, last = events.agg(F.min(F.unix_seconds("at")), F.max(F.unix_seconds("at"))).first()
    late = lambda copy: F.pmod(F.xxhash64("seq", "id", F.lit(copy)), F.lit(LATEST))
    copies = F.explode(F.when(F.pmod(F.xxhash64("seq", "id"), F.lit(3)) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    span = ((last or 0) - (first or 0) + LATEST) // PARTS + 1
    arriving = events.withColumn("copy", copies).withColumn("part", F.floor((F.unix_seconds("at") + F.when(F.col("copy") == 0, late(0)).otherwise(late(1)) - (first or 0)) / span)).drop("copy")
    arriving.write.partitionBy("part").parquet(f"{folder}/deliveries")
    clock = spark.createDataFrame([("", NOW + dt.timedelta(days=2), n) for n in (-1, -2)], "id string, at timestamp, seq long")
    for part in range(PARTS + 2):
        if part < PARTS:
            rows = spark.read.schema(arriving.schema).parquet(f"{folder}/deliveries").filter(F.col("part") == part).drop("part")
        else:
            rows = clock.filter(F.col("seq") == PARTS - 1 - part).unionByName(events.limit(0), allowMissingColumns=True)
        rows.select(*events.columns).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        run = stream(source).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
        run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").filter("id <> ''")


@query("""
WITH e AS (
  SELECT 'file-' || user_id AS id, ts, event_id, CASE WHEN event_type <> 'signup' THEN ts + INTERVAL 72 HOUR END AS until FROM events WHERE event_type IN ('purchase', 'error', 'signup')
  UNION ALL SELECT 'claim-' || user_id, ts, event_id, CASE WHEN event_type = 'click' THEN ts + INTERVAL 30 MINUTE END FROM events WHERE event_type IN ('click', 'view')
), n AS (SELECT *, lead(ts) OVER (PARTITION BY id ORDER BY ts, event_id) AS after FROM e)
SELECT id, event_id AS seq, epoch_us(until) AS expires_us FROM n WHERE until < TIMESTAMP '2024-02-01 00:00:00' AND (after IS NULL OR after > until)""")
def expired_stream(spark, sf_dir):
    """T-8, T-9: files of finished tasks whose 72 hours, and claims whose 30 minutes, are over before another event of theirs: by timers of a stream."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    of = lambda name, until, hours: e.filter(kind.isin(*until)).select(F.concat(F.lit(name), F.col("user_id").cast("string")).alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.when(kind.isin("purchase", "error", "click"), F.col("ts").cast("timestamp") + hours).alias("expires_at"))
    events = of("file-", ("purchase", "error", "signup"), F.expr("interval 72 hours")).unionByName(of("claim-", ("click", "view"), F.expr("interval 30 minutes")))
    found = played(events, lambda s: timers.expiries(s, LATENESS), "expiries")
    return found.select("id", "seq", F.unix_micros("expires_at").alias("expires_us"))


@query(SQL["recover_state"])
def recovered_stream(spark, sf_dir):
    """T-1, T-4, T-13: a stream folded to the last state of every user, whatever the order and number of arrivals; then active ones are recovered as after a crash."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "signup", "queued").otherwise("rendering")
    events = e.select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), status.alias("status"), (kind == "error").alias("failed"), F.lit(False).alias("gone"))
    last = store.newest(played(events, lambda s: timers.states(s, LATENESS, free=True), "states"), "id", ["version"])
    last = last.select(F.col("id").cast("long").alias("user_id"), "status", F.col("failures").alias("attempt_count"))
    idle = last.filter(~store.active()).select("user_id", "status", F.col("attempt_count").alias("attempts"), F.lit(False).alias("exhausted"))
    back = store.recovered(last.withColumns({c: store.null("int") for c in ("progress", "processed_pages")}), "2024-02-01T00:00:00.000Z")
    return idle.unionByName(back.select("user_id", "status", F.col("attempt_count").alias("attempts"), F.col("error_code").isNotNull().alias("exhausted")))
