"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each listed source has a target weight; all others share the weight of OTHER. A bucket's mean repetition rate is
its share of the weights x all rows / its rows, however large. A document's count is drawn from the Poisson distribution of
that mean by inverting its cumulative table at a uniform number hashed from seed and doc_id. A mean over PART_RATE is the
sum of as many independent draws of smaller, equal means, which has the same distribution and needs no table that grows. The
row is exploded into that many copies, and all copies are dealt out and sorted by a hash of seed, id and copy.

Scale: one pass counts rows by bucket (summed before the exchange; as many rows as weights are listed reach the
driver, at most MAX_SOURCES), one draws, explodes and shuffles. Copies of one document have different keys, and rows that repeat an id are
spread by the task that they come from, so no task gets them all; no array holds more than CHUNK copies.

Defined cases: a null source belongs to OTHER. A null doc_id is drawn by its text's md5; rows with the same id (or, without id,
the same text) get the same count. Null texts stay null. A bucket without rows gets nothing; its weight can't be reached, which a warning tells,
as it does where a `max_rate` that the caller sets binds. Extra columns are kept; `copy` (from 1) is added, in place of an input column of that name (stage() keeps
the input's own). Weights that aren't finite, are negative or sum to 0 are an error.
"""

from __future__ import annotations

import json
import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common

OTHER = "*"
#: Production weights: the largest source is thinned, four are raised, the rest share what remains.
WEIGHTS = {"src0": 0.15, "src1": 0.10, "src2": 0.10, "src3": 0.08, "src4": 0.07, OTHER: 0.50}
MAX_SOURCES, SEED = 1000, 20
#: Means above this are drawn in parts; an array of copies has at most CHUNK of them.
PART_RATE, CHUNK = 16.0, 4096


def poisson_table(mean: float) -> list[float]:
    """P(X <= 0), P(X <= 1), ... up to where it stops growing."""
    total, table, k = 0.0, [], 0
    term = math.exp(-mean)
    while True:
        total += term
        table.append(total)
        k += 1
        term *= mean / k
        if k > mean and total + term == total:
            return table


def drawn_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit(""))


def rates(docs: DataFrame, weights: dict[str, float], max_rate: float | None = None) -> dict[str, float]:
    """Mean repetitions of each bucket that has rows."""
    if len(weights) > MAX_SOURCES:
        raise ValueError(f"at most {MAX_SOURCES} weights")
    whole = sum(weights.values())
    if any(not math.isfinite(w) or w < 0 for w in weights.values()) or whole <= 0:
        raise ValueError("weights must be finite, not negative, and not all 0")
    counts = bucket_counts(docs, weights)
    total = sum(counts.values())
    wanted = {b: weights.get(b, 0.0) / whole * total / n for b, n in counts.items()}
    mean = {b: m if max_rate is None else min(max_rate, m) for b, m in wanted.items()}
    capped = sorted(b for b in mean if mean[b] < wanted[b])
    empty = sorted(b for b, w in weights.items() if w > 0 and not counts.get(b)) if total else []
    if capped or empty:
        said = "; ".join(f"{b}: {want:.4f} wanted, {got:.4f} reached" for b, (want, got) in weights_reached(counts, mean, weights).items())
        warnings.warn(f"weights are missed (rate capped at {max_rate}: {capped}; without rows: {empty}): {said}", stacklevel=4)
    return mean


def bucket_counts(docs: DataFrame, weights: dict[str, float]) -> dict[str, int]:
    return {r["bucket"]: r["count"] for r in docs.groupBy(bucket(weights).alias("bucket")).count().collect()}


def weights_reached(counts: dict[str, int], mean: dict[str, float], weights: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Each bucket's target share of the mix and the share expected at the mean rates."""
    out = {b: n * mean[b] for b, n in counts.items()}
    whole, mixed = sum(weights.values()), sum(out.values())
    return {b: (weights.get(b, 0.0) / whole, out.get(b, 0.0) / mixed if mixed else 0.0) for b in sorted(weights.keys() | counts.keys())}


def bucket(weights: dict[str, float]) -> Column:
    named = [s for s in weights if s != OTHER]
    return F.when(F.col("source").isin(named), F.col("source")).otherwise(OTHER) if named else F.lit(OTHER)


def parts_of(mean: float) -> int:
    """How many draws of equal means, none over PART_RATE, make up a draw of this mean."""
    return max(1, math.ceil(mean / PART_RATE))


def mix_sources(docs: DataFrame, weights: dict[str, float], *, seed: int = SEED, max_rate: float | None = None) -> DataFrame:
    """docs' rows, each as often as drawn, with `copy`, dealt out at random."""
    return _mixed(docs, [c for c in docs.columns if c != "copy"], "copy", weights, seed, max_rate)


def _mixed(docs: DataFrame, names: list[str], copy: str, weights: dict[str, float], seed: int, max_rate: float | None) -> DataFrame:
    mean = rates(docs, weights, max_rate)
    known = [{"b": b, "parts": parts_of(m), "table": poisson_table(m / parts_of(m))} for b, m in sorted(mean.items())]
    at = f"__tw_{'_'.join(docs.columns)}"  # no column has this name
    # As many rows as there are buckets, at most MAX_SOURCES + 1.
    table = docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(known)), "array<struct<b:string,parts:int,table:array<double>>>")).alias(f"{at}_rate"))
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.struct(drawn_id().alias("id"), bucket(weights).alias("b")).alias(at))
    rate = F.col(f"{at}_rate")
    rows = rows.join(F.broadcast(table), F.col(at)["b"] == rate["b"])

    def drawn(part: Column) -> Column:
        name = F.concat(F.lit(f"{seed}|"), F.col(at)["id"], F.when(part > 0, F.concat(F.lit("|"), part.cast("string"))).otherwise(""))
        uniform = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
        return F.size(F.filter(rate["table"], lambda c: c <= uniform)).cast("long")

    count = F.aggregate(F.sequence(F.lit(0), rate["parts"] - 1), F.lit(0).cast("long"), lambda n, part: n + drawn(part))
    own = [F.col(f"`{c}`") for c in names]
    rows = rows.select(*own, F.struct(F.col(at)["id"].alias("id"), count.alias("n")).alias(at)).filter(F.col(at)["n"] > 0)
    first = F.explode(F.sequence(F.lit(1).cast("long"), F.col(at)["n"], F.lit(CHUNK).cast("long")))
    rows = rows.select(*own, at, first.alias(f"{at}_from"))
    if max(mean.values(), default=0.0) > CHUNK:  # runs of copies of one row go to several tasks
        rows = rows.repartition(at, f"{at}_from")
    each = F.explode(F.sequence(F.col(f"{at}_from"), F.least(F.col(at)["n"], F.col(f"{at}_from") + (CHUNK - 1))))
    rows = rows.select(*own, F.col(at)["id"].alias(at), each.alias(f"{at}_copy")).select(*own, at, F.col(f"{at}_copy").cast("int").alias(copy))
    key = F.md5(F.concat(F.lit(f"order {seed}|"), F.col(at), F.lit("|"), F.col(f"`{copy}`").cast("string")).cast("binary"))
    dealt = rows.select(*own, F.col(f"`{copy}`"), key.alias(at))
    # Rows that repeat an id share their keys; the task that they come from spreads them.
    return dealt.repartition(at, F.spark_partition_id()).sortWithinPartitions(at).drop(at)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as its source's weight in WEIGHTS asks, see mix_sources(); the columns are docs' own. An empty table stays empty."""
    names = docs.columns
    return _mixed(docs, names, f"__tw_copy_{'_'.join(names)}", WEIGHTS, SEED, None).select(*[F.col(f"`{c}`") for c in names])


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(common.table(spark, sf_dir, "documents"), WEIGHTS)


def mixing_sql(source: str, columns: str) -> str:
    """DuckDB SQL for the copies of `source`'s rows (columns, copy) under WEIGHTS."""
    weights = ", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in WEIGHTS.items())
    named = ", ".join(f"'{s}'" for s in WEIGHTS if s != OTHER)
    return f"""
WITH RECURSIVE weights(bucket, w) AS (VALUES {weights}),
docs AS (SELECT *, CASE WHEN source IN ({named}) THEN source ELSE '{OTHER}' END AS bucket, coalesce(doc_id::VARCHAR, md5(text), '') AS draw FROM {source}),
rates AS (
  SELECT bucket, greatest(1, ceil(mean / {PART_RATE}))::BIGINT AS parts, mean / greatest(1, ceil(mean / {PART_RATE})) AS mean
  FROM (SELECT bucket, w / (SELECT sum(w) FROM weights) * (SELECT count(*) FROM docs) / n AS mean
        FROM weights JOIN (SELECT bucket, count(*) AS n FROM docs GROUP BY bucket) USING (bucket))
), cdf(bucket, mean, k, term, total) AS (
  SELECT bucket, mean, 0, exp(-mean), exp(-mean) FROM rates
  UNION ALL
  SELECT bucket, mean, k + 1, term * mean / (k + 1), total + term * mean / (k + 1) FROM cdf WHERE k < 100
), numbered AS (
  SELECT *, row_number() OVER () AS row FROM docs
), uniforms AS (
  SELECT d.row, d.bucket, ('0x' || substr(md5('{SEED}|' || draw || CASE WHEN part > 0 THEN '|' || part ELSE '' END), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT n.row, n.bucket, n.draw, unnest(range(r.parts)) AS part FROM numbered n JOIN rates r USING (bucket)) d
), counts AS (
  SELECT u.row, count(*) AS n FROM uniforms u JOIN cdf c ON c.bucket = u.bucket AND c.total <= u.u GROUP BY u.row
)
SELECT {columns}, unnest(range(1, counts.n + 1))::INTEGER AS copy FROM numbered d JOIN counts USING (row)
"""


OP7_SQL = mixing_sql("documents", "doc_id, text, lang, d.source, n_chars")
