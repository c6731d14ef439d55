"""Exact top-k search with block-at-a-time pruning.

Vectors are integers floor(256 x) a dimension; each signed dimension is a term. Candidates are cut in shards by ranges of
vec_id and ordered there; ranges of BLOCK of them are blocks with the largest and smallest value of every dimension and a
forward index (the values by dimension). For a query the sum of its terms' maxima bounds the scores of a block, as does its score with the block's
centre plus its norm times the block's radius. Blocks are visited in descending order of the smaller bound until it is below the
k-th best score; equal bounds are still scored, because ties go to the smaller vec_id. Within a block the query's heaviest terms
come first, and a candidate is left as soon as what it has, plus the norms of the rest of both vectors, is below the k-th score.

A sixteenth of the shards is searched first; each query's k-th score there is carried to all others, so that none starts from nothing.
Shards' best k are merged for the result.

Scale: queries are cut in chunks and each chunk meets each shard once, as blobs of bounded size; no pair of rows is ever a
row of a join. Work is queries x candidates less what is pruned, and each query is sent to each shard: with queries a fixed share of the rows both are
quadratic in the rows, by the task. Equal rows are counted before they are dealt out, so that one common row is one row.
What a task does depends only on the content of its rows, not on their order: blobs are sorted, queries are known by id and a hash of their vector.

Defined cases: null vectors, vectors that hold null or non-finite values, and rows with a null vec_id take no part. Shorter
vectors count as padded with 0; an empty one scores 0. Candidates with the query's vec_id are its own. Repeated
candidate rows count each; queries with equal vec_id and vector are one query. Scores beyond 64 bits are clipped.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm import common

K, EVERY = 5, 50
BLOCK, SHARD_ROWS, CHUNK_QUERIES = 128, 8192, 1024
#: One shard in so many is searched first.
FIRST = 16
#: Dimensions that are added between two tests of a candidate's bound.
TERMS = 8
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


class Shard:
    """Candidates ordered by id, cut in blocks. `counts`: how often a candidate is there."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, counts: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.counts = np.ones(len(ids), np.int64) if counts is None else counts[order]
        self.starts = np.arange(0, len(ids), BLOCK)
        self.high, self.low = np.maximum.reduceat(self.values, self.starts), np.minimum.reduceat(self.values, self.starts)
        self.scored = self.products = 0  # candidates scored in full, and multiplications

    def search(self, queries: np.ndarray, owners: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of its best k candidates that reach its floor (-inf: none is known)."""
        d = max(queries.shape[1], self.values.shape[1])
        q, x, high, low = (np.pad(a, ((0, 0), (0, d - a.shape[1]))) for a in (queries, self.values, self.high, self.low))
        floors = np.full(len(q), -np.inf) if floors is None else floors
        size = max(1.0, float(np.abs(q).max(initial=0))) * max(1.0, float(np.abs(x).max(initial=0))) * max(1, d)
        if size >= _EXACT:  # beyond what doubles hold exactly: whole numbers, and the box bound alone
            q, x, high, low = (np.vectorize(int, otypes=[object])(a) if a.size else a.astype(object) for a in (q, x, high, low))
        zero = q * 0
        bounds = np.maximum(q, zero) @ high.T + np.minimum(q, zero) @ low.T
        if size < _EXACT and d:
            n = np.diff(np.append(self.starts, len(x)))
            centre = np.add.reduceat(x, self.starts) / n[:, None]
            radius = np.sqrt(np.maximum.reduceat(((x - np.repeat(centre, n, 0)) ** 2).sum(1), self.starts))
            norms = np.sqrt((q * q).sum(1))
            bounds = np.minimum(bounds, _above(q @ centre.T + norms[:, None] * radius, norms[:, None] * (np.sqrt((centre**2).sum(1)) + radius)))
            turned = np.ascontiguousarray(x.T)
            squares = turned * turned
            lengths = squares.sum(0)
        out = []
        for i in range(len(q)):
            order = np.argsort(-bounds[i], kind="stable")
            ids, scores, floor = np.zeros(0, self.ids.dtype), np.zeros(0, x.dtype), floors[i]
            at, step = 0, 1
            while at < len(order) and bounds[i][order[at]] >= floor:
                blocks = order[at : at + step]
                blocks = blocks[(bounds[i][blocks] >= floor).astype(bool)]
                rows = (self.starts[np.sort(blocks)][:, None] + np.arange(BLOCK)).ravel()
                rows = rows[rows < len(x)]
                rows = rows[self.ids[rows] != owners[i]]
                if size >= _EXACT or floor == -np.inf or not d:
                    got = x[rows] @ q[i]
                    self.products += len(rows) * d
                else:
                    rows, got = self._finish(q[i], turned, squares, lengths, rows, floor)
                self.scored += len(rows)
                times = np.minimum(self.counts[rows], k)
                ids, scores = np.concatenate([ids, np.repeat(self.ids[rows], times)]), np.concatenate([scores, np.repeat(got, times)])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k and scores[-1] > floor:
                    floor = scores[-1]
                at, step = at + step, 16 if step == 1 else len(order)
            keep = (scores >= floors[i]).astype(bool)
            out.append((ids[keep], scores[keep]))
        return out

    def _finish(self, q, turned, squares, lengths, rows, floor):
        """Those of the rows whose score may reach the floor, with their scores."""
        order = np.argsort(-np.abs(q), kind="stable")
        rest_q = np.append(np.sqrt(np.cumsum((q[order] ** 2)[::-1])[::-1]), 0.0)
        got, rest_x = np.zeros(len(rows)), lengths[rows]
        for t in range(0, len(order), TERMS):
            dims = order[t : t + TERMS]
            if not rest_q[t]:
                break  # the query has no more terms
            if 3 * len(rows) > len(lengths):  # most of the index: cheaper as a whole than by row
                got, rest_x = got + (q[dims] @ turned[dims])[rows], rest_x - squares[dims].sum(0)[rows]
            else:
                part = turned[np.ix_(dims, rows)]
                got, rest_x = got + q[dims] @ part, rest_x - (part * part).sum(0)
            self.products += len(rows) * len(dims)
            more = rest_q[min(t + TERMS, len(order))] * np.sqrt(np.maximum(rest_x, 0.0))
            able = _above(got + more, np.abs(got) + more) >= floor
            if not able.all():
                rows, got, rest_x = rows[able], got[able], rest_x[able]
        return rows, got


def _above(x, size):
    """x, surely not below what exact arithmetic gives; size: of the terms that made it."""
    return x + 1e-9 * size + 1e-6


def _values(vectors: list) -> np.ndarray:
    whole = [np.floor(256 * np.asarray(v, np.float64)) for v in vectors]
    out = np.zeros((len(whole), max(map(len, whole), default=0)))
    for i, v in enumerate(whole):
        out[i, : len(v)] = v
    return out


def _query_blob(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["vec_id", "hash"], kind="stable")
    number = lambda c, kind: rows[c].to_numpy(kind).tobytes()
    return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "q_ids": [number("vec_id", np.int64)], "q_hashes": [number("hash", np.int64)], "q_floors": [rows["floor"].fillna(-np.inf).to_numpy(np.float64).tobytes()], "q_values": [_values(rows["embedding"].tolist()).tobytes()]})


def _shards(rows: DataFrame, shards: int) -> DataFrame:
    """shard, ids, counts, values: the candidates by ranges of vec_id, each range ordered; a shard may have several blobs."""

    def pack(batches):
        shard = TaskContext.get().partitionId() % shards
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        for at in range(0, whole.num_rows, 2 * SHARD_ROWS):
            part = whole.slice(at, 2 * SHARD_ROWS)
            number = lambda c, part=part: part.column(c).to_numpy().astype(np.int64).tobytes()
            blobs = [number("vec_id"), number("count"), _values(part.column("embedding").to_pylist()).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)], ["shard", "ids", "counts", "values"])

    ranges = rows.select("vec_id", "hash", "count", "embedding").repartitionByRange(shards, "vec_id", "hash").sortWithinPartitions("vec_id", "hash")
    return ranges.mapInArrow(pack, "shard long, ids binary, counts binary, values binary")


def _met(held: DataFrame, asked: DataFrame, shards: int, chunks: int, k: int, *, first: bool) -> DataFrame:
    """query_id, asked, vec_id, score: the best k of each query in each of the first shards, or of the others."""
    chosen = lambda s: (s % FIRST == 0) if first else (s % FIRST != 0)
    held = held.filter(chosen(F.col("shard")))
    place = F.pmod(F.xxhash64("vec_id", "hash"), F.lit(chunks))
    query = asked.withColumn("chunk", place).groupBy("chunk").applyInPandas(_query_blob, "chunk long, q_ids binary, q_hashes binary, q_floors binary, q_values binary")
    to = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), chosen))
    parts = 4 * shards  # so that two shards seldom fall to one task
    met = held.repartition(parts, "shard").join(query.withColumn("shard", to).repartition(parts, "shard").hint("merge"), "shard")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, q_ids, hashes = (np.frombuffer(r[c], np.int64) for c in ("ids", "q_ids", "q_hashes"))
                values, queries = np.frombuffer(r["values"]).reshape(len(ids), -1), np.frombuffer(r["q_values"]).reshape(len(q_ids), -1)
                got = Shard(ids, values, np.frombuffer(r["counts"], np.int64)).search(queries, q_ids, k, np.frombuffer(r["q_floors"]))
                turn = np.repeat(np.arange(len(q_ids)), [len(i) for i, _ in got])
                number = [max(-_LONG - 1, min(_LONG, int(s))) for _, v in got for s in v]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[turn]), pa.array(hashes[turn]), pa.array(np.concatenate([i for i, _ in got]) if got else [], pa.int64()), pa.array(number, pa.int64())], ["query_id", "asked", "vec_id", "score"]
                )

    return met.select("ids", "counts", "values", "q_ids", "q_hashes", "q_floors", "q_values").mapInArrow(run, "query_id long, asked long, vec_id long, score long")


def top_k(embeddings: DataFrame, *, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's best k. Queries are the rows whose vec_id is divisible by `every`."""
    spark = embeddings.sparkSession
    common.ship(spark)
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(F.forall("embedding", finite))
    # An array with null never passes forall; the check above makes null elements false, not null.
    rows = rows.groupBy("vec_id", "embedding").count().withColumn("hash", F.xxhash64("embedding"))
    rows = common.materialize(rows, "vectors")
    asked = rows.filter(F.col("vec_id") % every == 0)
    shards, chunks = max(1, -(-rows.count() // SHARD_ROWS)), max(1, -(-asked.count() // CHUNK_QUERIES))
    held = common.materialize(_shards(rows, shards), "vector-shards")
    unknown = asked.withColumn("floor", F.lit(None).cast("double"))
    found = common.materialize(_met(held, unknown, shards, chunks, k, first=True), "first-found")
    best = W.partitionBy("query_id", "asked").orderBy(F.col("score").desc(), "vec_id")
    if shards > 1:
        kth = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("asked").alias("hash"), F.col("score").cast("double").alias("floor"))
        # A score that a double doesn't hold exactly is taken a little lower.
        kth = kth.withColumn("floor", F.when(F.abs("floor") < _EXACT, F.col("floor")).otherwise(F.col("floor") - F.abs("floor") * 1e-15))
        begun = common.materialize(asked.join(kth, ["vec_id", "hash"], "left"), "vector-queries")
        found = found.unionByName(_met(held, begun, shards, chunks, k, first=False))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"))


OP10_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
