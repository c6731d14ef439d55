"""Exact k-means on integer vectors with balls.

A cluster is a ball: its centroid and the largest distance of a member. After a round the driver (which holds the k centroids, nothing of the vectors)
knows how far each centroid has moved and so a radius that surely covers the members of the last round. Only centroids within twice that radius of
a cluster's centroid are its neighbours. A member nearer to its centroid than half the way to the nearest neighbour is in the ball's core and
stays; the others lie in rings between the halves of the ways to successive neighbours, and are compared exactly with just the neighbours of their
ring and those inside it. Where a centroid hasn't moved, members' distances are known and only neighbours that moved are compared. All tests are on
squared integers and leave a member out only where the other centroid is strictly farther, so that ties still go to the smaller number.

Vectors are written in blocks of some thousand, each with its members' clusters, distances and per-cluster sums. A round reads the blocks, writes
them with new clusters, adds the sums up (k rows reach the driver) and removes the table before: work and disk grow with the vectors, a lost executor repeats its blocks of
one round.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part; a null vec_id does (its seed text is
`3:`). Seeds of equal hash are ordered by their vectors; repeated rows count each, so that centroids may be equal (the smaller number then gets all).
Fewer vectors than k: as many centroids; none: no rows. A component beyond 2**27 after scaling is an error, since distances wouldn't fit 64 bits. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright import shipping
from tracewright.llm import common

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, "3"
BLOCK = 8192
#: Largest component, after scaling, with which squared distances fit 64 bits, and with which doubles hold them exactly.
LARGEST, EXACT = 1 << 27, 1 << 22
#: Sums of a block: by cluster and place, where places from 0 are dimensions.
COUNT, RADIUS, INERTIA = -1, -2, -3
STATE = "block long, ids array<long>, width int, vectors binary, clusters binary, distances binary, compared long, sums array<struct<cluster:int,place:int,value:decimal(38,0)>>"
_SUM = pa.struct([("cluster", pa.int32()), ("place", pa.int32()), ("value", pa.decimal128(38, 0))])


@dataclass
class Balls:
    """What a task must know of the k clusters. `near`: for each cluster its neighbours by distance; empty in the first round, when no vector has a cluster."""

    centroids: np.ndarray
    moved: np.ndarray | None = None
    near: list[np.ndarray] | None = None

    @staticmethod
    def after(centroids: np.ndarray, before: np.ndarray, radii: dict[int, int]) -> Balls:
        """Balls of the centroids that replaced `before`, whose members lay within radii (squared) of those."""
        way = squared(centroids, centroids)
        shift = [int(d) for d in ((centroids - before) ** 2).sum(1)]
        near = []
        for i in range(len(centroids)):
            reach = math.isqrt(radii.get(i, 0)) + 1 + (math.isqrt(shift[i]) + 1 if shift[i] else 0)
            others = np.array([j for j in range(len(centroids)) if j != i and int(way[i, j]) <= 4 * reach * reach], np.int64)
            near.append(others[np.argsort(way[i, others], kind="stable")])
        return Balls(centroids, np.array(shift) > 0, near)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x and of c, as int64."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1) if len(c) else np.zeros((len(x), 0), np.int64)


def assign(x: np.ndarray, balls: Balls, clusters: np.ndarray | None, distances: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Clusters and squared distances of the vectors x, and how many distances were computed."""
    c = balls.centroids
    if clusters is None or balls.near is None:
        d = squared(x, c)
        best = d.argmin(1)  # the first of equal ones
        return best.astype(np.int32), d[np.arange(len(x)), best], d.size
    best, nearest, compared = clusters.copy(), distances.copy(), 0
    for i in np.unique(clusters):
        rows = np.flatnonzero(clusters == i)
        if balls.moved[i]:
            nearest[rows] = squared(x[rows], c[i : i + 1])[:, 0]
            compared += len(rows)
        own = nearest[rows]
        near = balls.near[i] if balls.moved[i] else balls.near[i][balls.moved[balls.near[i]]]
        if not len(near):
            continue
        ring = np.searchsorted(squared(c[i : i + 1], c[near])[0], 4 * own, "right")  # neighbours that could be as near as the own centroid
        for at, j in enumerate(near):
            members = rows[ring > at]
            if not len(members):
                break
            d = squared(x[members], c[j : j + 1])[:, 0]
            compared += len(members)
            better = (d < nearest[members]) | (d == nearest[members]) & (j < best[members])
            best[members[better]], nearest[members[better]] = j, d[better]
    return best, nearest, compared


def _numbers(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, f"i{width}").astype(np.int64)


def packed(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """The written blocks of (vec_id, x) rows, without clusters."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x = part.column("x").flatten().to_numpy()
                most = int(np.abs(x).max(initial=0))
                if most > LARGEST:
                    raise ValueError(f"a component is {most} after scaling: squared distances don't fit 64 bits")
                width = 2 if most < 1 << 15 else 4
                one = lambda value, kind: pa.array([value], kind)
                yield pa.RecordBatch.from_arrays(
                    [one(number, pa.int64()), one(part.column("vec_id").to_pylist(), pa.list_(pa.int64())), one(width, pa.int32()), one(x.astype(f"i{width}").tobytes(), pa.binary()), one(None, pa.binary()), one(None, pa.binary()), one(0, pa.int64()), one([], pa.list_(_SUM))],
                    ["block", "ids", "width", "vectors", "clusters", "distances", "compared", "sums"],
                )
                number += 1

    return common.materialize(vectors.mapInArrow(run, STATE), "vector-blocks")


def _round(state: DataFrame, balls: Balls) -> DataFrame:
    """The blocks with the clusters, distances and sums that the balls give."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, batch=batch, i=i: batch.column(c)[i].as_py()
                x = _numbers(get("vectors"), get("width")).reshape(-1, balls.centroids.shape[1])
                before = get("clusters")
                clusters, distances, compared = assign(x, balls, before and np.frombuffer(before, np.int32), before and np.frombuffer(get("distances"), np.int64))
                held, value = np.unique(clusters), []
                for j in held:
                    rows = clusters == j
                    far = distances[rows]
                    value += [len(far), int(far.max()), sum(far.tolist()), *x[rows].sum(0).tolist()]
                places = [COUNT, RADIUS, INERTIA, *range(x.shape[1])]
                sums = pa.StructArray.from_arrays([pa.array(np.repeat(held, len(places)), pa.int32()), pa.array(places * len(held), pa.int32()), pa.array(value, _SUM[2].type)], fields=list(_SUM))
                new = {"clusters": pa.array([clusters.tobytes()], pa.binary()), "distances": pa.array([distances.tobytes()], pa.binary()), "compared": pa.array([compared], pa.int64()), "sums": pa.ListArray.from_arrays(pa.array([0, len(sums)], pa.int32()), sums)}
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([new.get(c, row.column(c)) for c in batch.schema.names], batch.schema.names)

    return state.mapInArrow(run, STATE)


def _sums(state: DataFrame) -> dict[int, dict[int, int]]:
    """For each cluster that has members its sums by place, and its radius: k times as many rows as a vector has components."""
    one = state.select(F.explode("sums").alias("s")).groupBy("s.cluster", "s.place").agg(F.sum("s.value").alias("all"), F.max("s.value").alias("most"))
    found: dict[int, dict[int, int]] = {}
    for r in one.collect():
        found.setdefault(r["cluster"], {})[r["place"]] = int(r["most"] if r["place"] == RADIUS else r["all"])
    return found


def ball_kmeans(embeddings: DataFrame, *, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED, block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 and compared (how many distances the last round computed in the vector's block) of
    every vector that takes part. k centroids, their sums and radii are all that the driver holds."""
    spark = embeddings.sparkSession
    common.ship(spark)
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    vectors = embeddings.filter((F.size("embedding") == dims) & F.forall("embedding", finite))
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("x"))
    state = packed(vectors, block)
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(named.alias("hash"), "x").orderBy("hash", "x").limit(k).collect()
    centroids = np.array([r["x"] for r in sorted(first, key=lambda r: (r["hash"], r["x"]))], np.int64).reshape(-1, dims)
    balls = Balls(centroids)
    for turn in range(rounds + 1):
        before, state = state, common.materialize(_round(state, balls), f"vector-round-{turn}")
        shipping.discard(before)
        found = _sums(state)
        if turn == rounds:
            break
        new = centroids.copy()
        for j, r in found.items():
            new[j] = [r[i] // r[COUNT] for i in range(dims)]
        balls, centroids = Balls.after(new, centroids, {j: r[RADIUS] for j, r in found.items()}), new
    whole = sum(r[INERTIA] for r in found.values())
    of = [(j, r[INERTIA], whole, hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, r in found.items()]
    clusters = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                number = lambda c, kind, batch=batch, i=i: pa.array(np.frombuffer(batch.column(c)[i].as_py(), kind))
                yield pa.RecordBatch.from_arrays([ids, number("clusters", np.int32), number("distances", np.int64), pa.array(np.full(len(ids), batch.column("compared")[i].as_py()))], ["vec_id", "cluster", "distance", "compared"])

    assigned = state.select("ids", "clusters", "distances", "compared").mapInArrow(rows, "vec_id long, cluster int, distance long, compared long")
    return assigned.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")


def op11_ball_kmeans(spark, sf_dir: str) -> DataFrame:
    return ball_kmeans(common.table(spark, sf_dir, "embeddings")).drop("compared")


def _sql() -> str:
    """The rounds one after another."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY hash, x) - 1 AS n, x FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS hash, x FROM v ORDER BY hash, x LIMIT {K})
)""",
    ]
    for t in range(ROUNDS + 1):
        steps.append(f"""a{t} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, min({{'d': (list_dot_product(v.x::DOUBLE[], v.x::DOUBLE[]) - 2 * list_dot_product(v.x::DOUBLE[], c.x::DOUBLE[]) + list_dot_product(c.x::DOUBLE[], c.x::DOUBLE[]))::BIGINT, 'n': n}}) AS m
  FROM v, c{t} c GROUP BY row
)""")
        if t < ROUNDS:
            steps.append(f"""c{t + 1} AS MATERIALIZED (
  SELECT c.n, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN (
    SELECT n, list(((s - (s % count + count) % count) // count)::BIGINT ORDER BY i) AS x
    FROM (SELECT a.m.n AS n, i, sum(v.x[i]) AS s, count(*) AS count FROM a{t} a JOIN v USING (row), range(1, {DIMS + 1}) r(i) GROUP BY ALL) GROUP BY n
  ) m USING (n)
)""")
    return f"""WITH {", ".join(steps)}
SELECT a.vec_id, a.m.n::INTEGER AS cluster, a.m.d AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.n))::BIGINT AS cluster_inertia, (sum(a.m.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.n = a.m.n"""


OP11_SQL = _sql()
