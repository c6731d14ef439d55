import hashlib
import math

import numpy as np
import pytest

from tracewright.llm import ball_kmeans

FORM = "vec_id long, embedding array<float>, label int, cluster int, x string"


def by_hand(rows, k, rounds, dims, scale=1024, seed="3"):
    """Lloyd's rounds with Python's whole numbers."""
    v = [(i, [math.floor(scale * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    named = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    c = [x for _, x in sorted((named(i), x) for i, x in v)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), n) for n, y in enumerate(c))
    for _ in range(rounds):
        to = [near(x)[1] for _, x in v]
        for n in range(len(c)):
            own = [x for (_, x), t in zip(v, to, strict=True) if t == n]
            if own:
                c[n] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    got = [near(x) for _, x in v]
    each = {n: sum(d for d, m in got if m == n) for _, n in got}
    return [(i, n, d, each[n], sum(each.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(v, got, strict=True)]


def same(spark, rows, *, k, rounds, dims, **options):
    df = spark.createDataFrame([(i, e, 1, 2, "x") for i, e in rows], FORM).repartition(3)
    got = ball_kmeans.ball_kmeans(df, k=k, rounds=rounds, dims=dims, **options).drop("compared").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(by_hand(rows, k, rounds, dims), key=repr)
    return got


@pytest.mark.parametrize(("k", "spread"), [(8, 0.02), (8, 1.0), (3, 0.2), (20, 0.05)])
def test_against_plain_rounds(spark, k, spread):
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(6, 4)) * 0.3
    rows = [(i, (centres[i % 6] + rng.normal(size=4) * spread * 0.3).astype(np.float32).tolist()) for i in range(400)]
    same(spark, rows, k=k, rounds=6, dims=4, block=64)


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [0.5, 0.25]), (1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [1.0, 2.0, 3.0]), (8, [-0.0001, 0.0]), (None, [0.5, -0.25])]
    rows += [(20, [0.125, 0.125])] * 30 + [(20, [0.5, 0.5])] * 5 + [(21 + i, [i % 3 / 1024, i % 2 / 1024]) for i in range(60)]
    same(spark, rows, k=8, rounds=10, dims=2, block=16)  # equal vectors, equal centroids and ties
    same(spark, rows[:10], k=8, rounds=3, dims=2)  # fewer vectors than centroids
    same(spark, [(1, [1000.0, -70000.5]), (2, [-100000.25, 3.0]), (3, [131071.0, 131071.0]), (4, [-131072.0, 131071.9])], k=2, rounds=2, dims=2)  # beyond what doubles hold exactly
    df = spark.createDataFrame([], FORM)
    assert ball_kmeans.ball_kmeans(df).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        ball_kmeans.ball_kmeans(spark.createDataFrame([(1, [2.0e5, 0.0], 1, 2, "x")], FORM), dims=2).collect()


def test_balls_leave_most_comparisons_out():
    """A plain round computes n k distances; a later round of the balls far fewer, with equal results."""
    rng = np.random.default_rng(5)
    k, n = 16, 4000
    centres = rng.integers(-1000, 1000, (k, 8))
    x = centres[rng.integers(0, k, n)] + rng.integers(-60, 60, (n, 8))
    c = x[rng.choice(n, k, replace=False)]
    balls, clusters, distances, share = ball_kmeans.Balls(c), None, None, []
    for _ in range(8):
        clusters, distances, compared = ball_kmeans.assign(x, balls, clusters, distances)
        d = ball_kmeans.squared(x, balls.centroids)
        assert np.array_equal(clusters, d.argmin(1)) and np.array_equal(distances, d.min(1))
        share.append(compared / d.size)
        new = balls.centroids.copy()
        for j in np.unique(clusters):
            new[j] = x[clusters == j].sum(0) // np.count_nonzero(clusters == j)
        balls = ball_kmeans.Balls.after(new, balls.centroids, {int(j): int(distances[clusters == j].max()) for j in np.unique(clusters)})
    assert share[0] == 1.0 and max(share[3:]) < 0.4 and share[-1] < 0.1


def test_a_tie_at_half_the_way_goes_to_the_smaller_number():
    x = np.array([[5], [5], [9]])
    old = np.array([[1], [10]])
    c = np.array([[0], [10]])
    balls = ball_kmeans.Balls.after(c, old, {1: 25})
    clusters, distances, _ = ball_kmeans.assign(x, balls, np.array([1, 1, 1], np.int32), np.array([25, 25, 1]))
    assert clusters.tolist() == [0, 0, 1] and distances.tolist() == [25, 25, 1]
