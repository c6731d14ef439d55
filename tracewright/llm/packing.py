"""Best-fit packing under conflicts.

A document of more than `capacity` words is cut into full pieces, each a bin of its own, and a rest. Rests are packed
longest first. Open bins are ordered by what they have left and carry bitmaps of the sources and duplicate
clusters inside; from the tightest bin that is large enough the successor search goes on, bin by bin, until one is
compatible: it holds no text of the same cluster and less than `per_source` pieces of the same source. The registered
query takes op5's components of near copies as clusters, and words as op5 counts them when it reads the texts; the pipeline's stage, where near copies are gone, equal words.

Scale: texts never move, only ids, lengths and hashes. Items are dealt by hash to shards of about SHARD_ITEMS and
every shard is packed alone, so bins need no agreement between tasks and a shard's memory is bounded. Equal rows
are counted before the exchange, and their number is dealt out in runs of COPIES, so that no task makes all copies of one row.

Defined cases: null or wordless texts have length 0 and no bin. Null and empty sources are one source. Repeated rows are packed
each, never two in a bin (same cluster). Equal lengths are taken in order of a hash of the row. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewright.llm import common, jaccard_join

CAPACITY, PER_SOURCE, SHARD_ITEMS = 2048, 4, 4096
#: Copies of a row that one task makes at once.
COPIES = 4096


def pack(lengths: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> list[int]:
    """The bin of each item, items taken in the given order."""
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in seen.items() if n > 1)}  # others can't conflict
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    left: list[int] = []  # of a bin
    held: list[int] = []  # its clusters
    planes: list[list[int]] = []  # plane k: sources with more than k pieces inside
    order: list[tuple[int, int]] = []  # (left, bin), ascending
    out = []
    for size, source, cluster in zip(lengths, sources, clusters, strict=True):
        c, s = cluster_bit.get(cluster, 0), source_bit[source]
        at = bisect_left(order, (size, -1))
        while at < len(order) and (held[order[at][1]] & c or planes[order[at][1]][-1] & s):
            at += 1
        if at < len(order):
            _, b = order.pop(at)
        else:
            b = len(left)
            left.append(capacity)
            held.append(0)
            planes.append([0] * per_source)
        left[b] -= size
        held[b] |= c
        carry = s
        for k in range(per_source):
            planes[b][k], carry = planes[b][k] | carry, planes[b][k] & carry
            if not carry:
                break
        if left[b]:
            insort(order, (left[b], b))
        out.append(b)
    return out


def text_cluster() -> Column:
    """Equal for texts of the same words, A-Z lower-cased."""
    words = F.trim(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[\\x20\\x09-\\x0D]+", " "))
    return F.xxhash64(words)


def word_counts(docs: DataFrame, cluster: Column) -> DataFrame:
    """doc_id, source, cluster, words of every row."""
    common.ship(docs.sparkSession)
    kept = ["doc_id", "source", "cluster"]

    def run(batches):
        for batch in batches:
            d = dict(zip(batch.schema.names, batch.columns, strict=True))
            n = np.zeros(batch.num_rows, np.int64)
            for at, data, offsets in common.text_chunks(d["text"]):
                n[at : at + len(offsets) - 1] = np.bincount(common.words(data, offsets)[2], minlength=len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([*(d[c] for c in kept), pa.array(n)], [*kept, "words"])

    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), cluster.cast("long").alias("cluster"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, source string, cluster long, words long")


def best_fit_pack(docs: DataFrame, *, cluster: Column | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """doc_id, source, cluster, copy, piece, start, length, bin_id of every piece (start and length in words); texts of one cluster have as many words."""
    return pack_rows(word_counts(docs, text_cluster() if cluster is None else cluster), False, capacity=capacity, per_source=per_source, shard_items=shard_items)


def pack_rows(rows: DataFrame, differ: bool, *, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """best_fit_pack() of rows(doc_id, source, cluster, words); differ: whether texts of one cluster may have different numbers of words."""
    common.ship(rows.sparkSession)
    item = ["doc_id", "source", "cluster", "words"]
    rows = rows.groupBy(*item).count()
    before = F.lit(0).cast("long")
    if differ:
        # Different texts of one id in one cluster are copies as well; a window has a row for each of their lengths.
        window = W.partitionBy("doc_id", "source", "cluster").orderBy("words").rowsBetween(W.unboundedPreceding, -1)
        before = F.coalesce(F.sum("count").over(window), F.lit(0)).cast("long")
    rows = rows.select(*item, before.alias("before"), (before + F.col("count")).alias("last"))
    rows = rows.withColumn("first", F.explode(F.sequence(F.col("before") + 1, F.col("last"), F.lit(COPIES).cast("long")))).repartition(*item, "first")
    each = F.explode(F.sequence(F.col("first"), F.least("last", F.col("first") + (COPIES - 1))))
    rows = common.materialize(rows.select(*item, each.alias("copy")).withColumn("copy", F.col("copy").cast("int")), "packing")
    shards = max(1, round(rows.filter(F.col("words") % capacity > 0).count() / shard_items))
    key = F.xxhash64("doc_id", "source", "cluster", "words", "copy")
    full = (F.col("words") / capacity).cast("long")
    wide = rows.filter(full > 0).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)))
    wide = wide.select("doc_id", "source", "cluster", "copy", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), F.concat_ws("-", F.lit("full"), F.hex(key), "piece").alias("bin_id"))
    none = rows.filter(F.col("words") == 0).select("doc_id", "source", "cluster", "copy", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.col("words").alias("length"), F.lit(None).cast("string").alias("bin_id"))
    rest = rows.select("doc_id", "source", "cluster", "copy", full.alias("piece"), (full * capacity).alias("start"), (F.col("words") % capacity).alias("length"), key.alias("key"), F.pmod(key, F.lit(shards)).alias("shard"))
    rest = rest.filter(F.col("length") > 0)
    kind = dict(rows.dtypes)

    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "key"], ascending=[False, True], kind="stable")
        bins = pack(items["length"].tolist(), items["source"].fillna("").tolist(), items["cluster"].tolist(), capacity, per_source)
        items["bin_id"] = [f"{items['shard'].iat[0]}-{b}" for b in bins]
        return items.drop(columns=["key", "shard"])

    schema = f"doc_id {kind['doc_id']}, source string, cluster long, copy int, piece long, start long, length long, bin_id string"
    packed = rest.groupBy("shard").applyInPandas(run, schema)
    return packed.unionByName(wide).unionByName(none)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row, see best_fit_pack(); near copies are gone by now, so clusters are equal words: copies made by the mixing stage
    never share a bin. An empty table has no pieces."""
    return best_fit_pack(docs)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.col("source").cast("string").alias("source"), "text")
    return pack_rows(jaccard_join.clustered_rows(docs, "source"), True)
