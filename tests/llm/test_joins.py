import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import cases
from pyspark.sql import functions as F

from tracewright.llm import common, components, jaccard_join, packing, topk_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def join_by_hand(rows):
    sets = [shingles(r[1]) for r in rows]
    top, links = list(range(len(rows))), Counter()
    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                top[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)] += [r[0]] if r[0] is not None else []
    return Counter((r[0], len(sets[i]), (min(least[find(i)], default=None) if sets[i] else r[0]), links[i]) for i, r in enumerate(rows))


def answer(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in df.collect())


def test_join_hard_rows(spark):
    assert answer(jaccard_join.jaccard_components(cases.hard(spark))) == join_by_hand([r[:2] for r in cases.hard_rows()])
    assert jaccard_join.jaccard_components(cases.empty(spark)).count() == 0


def changed(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(cases.WORDS)
    return " ".join(words)


@pytest.mark.parametrize("block", [16, 256])
def test_join_families_and_chains(spark, monkeypatch, block):
    """Families of near copies larger than a block, chains, shared passages, and single texts."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng, rows = random.Random(5), []
    for f in range(3):
        base = cases.prose(1000 + f, 90).split()
        rows += [changed(base, rng, rng.randrange(4)) for _ in range(50)]
    text = cases.prose(77, 100).split()
    for _ in range(12):
        text = changed(text, rng, 2).split()
        rows.append(" ".join(text))
    passage = cases.prose(78, 40)
    rows += [f"{cases.prose(2000 + i, 60)} {passage}" for i in range(60)]
    rows += [cases.prose(3000 + i, rng.randrange(1, 30)) for i in range(60)]
    rows = [(i, t, "s") for i, t in enumerate(rows)]
    rng.shuffle(rows)
    assert answer(jaccard_join.jaccard_components(cases.docs(spark, rows))) == join_by_hand(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_join_small_sets(spark, monkeypatch, seed):
    """Sets of 1 to 60 shingles near the threshold, where prefixes, positions and the needed agreement are tight."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 3 if seed == 1 else 256)
    rng, rows = random.Random(seed), []
    for f in range(30):
        base = cases.prose(4000 + 100 * seed + f, rng.randrange(5, 65)).split()
        for _ in range(6):
            w = base[rng.randrange(3) :][: len(base) - rng.randrange(max(1, len(base) // 4))] + cases.prose(rng.randrange(10**6), rng.randrange(1, 4)).split() * rng.randrange(2)
            rows.append(changed(w, rng, rng.randrange(2)) if w else "")
    rows = [(i, t, "s") for i, t in enumerate(rows)]
    want = join_by_hand(rows)
    assert sum(1 for *_, links in want if links) > 60
    assert answer(jaccard_join.jaccard_components(cases.docs(spark, rows))) == want


def test_join_rows_without_id(spark):
    """Near copies without ids: beside numbered ones, among themselves, as the middle of a chain and in a large family."""
    rng, rows = random.Random(6), []
    base = cases.prose(500, 90).split()
    rows += [(1, " ".join(base)), (None, changed(base, rng, 1)), (None, changed(base, rng, 1))]
    base = cases.prose(501, 90).split()
    rows += [(None, changed(base, rng, 1)) for _ in range(3)] + [(None, " ".join(base))] * 3
    w = cases.prose(502, 104).split()
    rows += [(10, " ".join(w[:92])), (None, " ".join(w[6:98])), (11, " ".join(w[12:]))]  # the ends don't link directly
    few = cases.docs(spark, [(i, t, "s") for i, t in rows])
    assert Counter(r["doc_id"] for r in jaccard_join.stage(spark, few, "").collect()) == Counter([1, 10, None])
    base = cases.prose(503, 90).split()
    rows += [(100 + i if i % 3 == 0 else None, changed(base, rng, rng.randrange(4))) for i in range(60)]
    rng.shuffle(rows)
    want = join_by_hand(rows)
    assert {c for i, _, c, _ in want if i in (10, 11)} == {10}
    assert answer(jaccard_join.jaccard_components(cases.docs(spark, [(i, t, "s") for i, t in rows]))) == want


def test_join_one_id_for_many_texts(spark):
    """An id that a third of all rows bears, under different texts and repeated rows, brings each text once."""
    rng, base = random.Random(9), cases.prose(520, 80).split()
    rows = [(7, changed(base, rng, rng.randrange(3))) for _ in range(40)] + [(7, " ".join(base))] * 60 + [(i, changed(base, rng, 1)) for i in range(100, 110)] + [(i, cases.prose(5200 + i, 40)) for i in range(200, 260)]
    docs = cases.docs(spark, [(i, t, "s") for i, t in rows])
    assert answer(jaccard_join.jaccard_components(docs)) == join_by_hand(rows)
    described = jaccard_join.describe_sets(docs)
    known = described.groupBy("class").agg(F.min("doc_id").alias("rep"), F.min("text_hash").alias("text_hash")).select("class", F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("block"), "rep", "text_hash")
    assert jaccard_join.whole_sets(docs.coalesce(1), known).coalesce(1).count() <= known.count() * 5  # a task gives each set once


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_block_links(seed):
    rng = np.random.default_rng(seed)
    base = rng.choice(400, 60, replace=False)
    make = lambda: np.unique(np.concatenate([rng.choice(base, rng.integers(30, 60), replace=False), rng.choice(400, rng.integers(0, 12))])).astype(np.uint64)
    left, right = [make() for _ in range(25)], [make() for _ in range(25)]
    want = lambda i, others: [j for j, y in enumerate(others) if 100 * len(np.intersect1d(left[i], y)) >= 75 * len(np.union1d(left[i], y))]
    one, two = jaccard_join.BlockIndex.of(left), jaccard_join.BlockIndex.of(right)
    assert [f.tolist() for _, f, _ in jaccard_join.block_links(one, two)] == [want(i, right) for i in range(25)]
    assert [f.tolist() for _, f, _ in jaccard_join.block_links(one, one)] == [want(i, left) for i in range(25)]


def test_answers_are_derived(spark):
    """In families of near copies nearly every answer but a block's first comes from another set's answer, and the number of meetings is bounded."""
    rng = random.Random(11)
    rows = []
    for f in range(5):
        base = cases.prose(1500 + f, 300).split()
        rows += [(100 * f + i, changed(base, rng, 2), "s") for i in range(40)]
    *_, met = jaccard_join.linked_classes(cases.docs(spark, rows))
    answers, derived = jaccard_join.derived_sets(met)
    assert answers >= 200 and derived > 0.9 * answers
    assert met.filter("class is null").count() <= 10


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_answers_are_derived_on_the_tables(spark):
    *_, met = jaccard_join.linked_classes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert jaccard_join.derived_sets(met)[1] > 0


def test_shuffled_rows_are_linear(spark, monkeypatch):
    """Twice the documents give at most about twice the rows of every step before the meetings."""
    def sizes(n):
        docs = cases.docs(spark, [(i, cases.prose(5000 + i // 2, 60) + (" more" if i % 2 else ""), "s") for i in range(n)])
        described = jaccard_join.describe_sets(docs).persist()
        classes = described.groupBy("class").agg(F.min("n").alias("n"), F.min("low").alias("low"))
        shared = jaccard_join.shared_shingles(described)
        prefix = jaccard_join.prefixes(shared, classes).persist()
        members = jaccard_join.grouped(prefix).persist()
        return np.array([shared.count(), prefix.count(), members.count(), jaccard_join.head_pairs(prefix, members).count() + 1])
    few, many = sizes(100), sizes(200)
    assert (few > 0).all() and (many <= 2.2 * few + 10).all()


@pytest.mark.parametrize("hot, most", [(3, 20_000), (10, 20_000), (3, 2), (10**9, 2)])
def test_hot_shingles_are_not_held(spark, monkeypatch, hot, most):
    """Shingles of many classes leave the counting task and get their count back, and few tasks count in groups: the answer is the same."""
    monkeypatch.setattr(jaccard_join, "MOST_PARTS", most)
    monkeypatch.setattr(jaccard_join, "PART", 500)
    monkeypatch.setattr(jaccard_join, "FLUSH", 300)
    rng = random.Random(12)
    passage = cases.prose(79, 30)
    rows = [(i, f"{passage} {cases.prose(2500 + i // 3, 8)} {changed(passage.split(), rng, 1) if i % 4 else ''}", "s") for i in range(90)]
    rows += [(200 + i, cases.prose(2600 + i, 3) + " " + passage, "s") for i in range(30)]
    docs = cases.docs(spark, rows)
    described = jaccard_join.describe_sets(docs)
    df = lambda x: {(r["class"], r["token"]): r["df"] for r in x.collect()}
    kept, passed = df(jaccard_join.shared_shingles(described, hot=10**9)), df(jaccard_join.shared_shingles(described, hot=hot))
    assert kept.keys() == passed.keys() and all(passed[k] >= v for k, v in kept.items())
    assert len({(t, v) for (_, t), v in passed.items()}) == len({t for _, t in passed})  # one count a shingle
    counter = jaccard_join._Counter(hot, 50)
    out = [b for i in range(40) for b in counter.add(np.arange(10), np.full(10, i))] + list(counter.finish())
    out = [r for b in out for r in b.to_pylist()]
    without = [r for r in out if r["class"] is not None and r["df"] is None]
    assert len(out) >= 400 and (len(without) == 400 and all(r["df"] >= 40 for r in out if r["class"] is None) if hot < 40 else not without)
    monkeypatch.setattr(jaccard_join, "shared_shingles", lambda d, f=jaccard_join.shared_shingles: f(d, hot=hot))
    assert answer(jaccard_join.jaccard_components(docs)) == join_by_hand(rows)


def test_stage_keeps_one_of_each_group(spark):
    docs = cases.hard(spark)
    kept = jaccard_join.stage(spark, docs, "")
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[5] == 1 and not {6, 7, 8} & set(ids) and ids[20] == 1 and ids[None] == 2 and ids[1] == ids[2] == ids[3] == 1
    assert ids[4] == 2  # two texts under one id are two documents


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(300, 300)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    top = {n: n for p in pairs for n in p}
    def find(n):
        while top[n] != n:
            n = top[n]
        return n
    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for n in top}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def pack_by_hand(lengths, sources, clusters, capacity, per_source):
    bins, out = [], []
    for i, n in enumerate(lengths):
        fits = [b for b in range(len(bins)) if bins[b][0] >= n and clusters[i] not in bins[b][1] and bins[b][2][sources[i]] < per_source]
        b = min(fits, key=lambda b: (bins[b][0], b), default=None)
        if b is None:
            b = len(bins)
            bins.append([capacity, set(), Counter()])
        bins[b][0] -= n
        bins[b][1].add(clusters[i])
        bins[b][2][sources[i]] += 1
        out.append(b)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 3), st.integers(0, 8)), max_size=80), st.integers(1, 3))
def test_pack_is_best_fit_under_conflicts(items, per_source):
    items.sort(key=lambda x: -x[0])
    lengths, sources, clusters = ([x[k] for x in items] for k in range(3))
    assert packing.pack(lengths, sources, clusters, 50, per_source) == pack_by_hand(lengths, sources, clusters, 50, per_source)


def test_packing_hard_rows(spark):
    got = packing.best_fit_pack(cases.hard(spark), capacity=100, shard_items=10).collect()
    pieces, want = defaultdict(list), Counter()
    for r in cases.hard_rows():
        want[r[0]] += len(WORD.findall(r[1] or ""))
    for r in got:
        pieces[r["doc_id"], r["cluster"], r["copy"]].append((r["start"], r["length"]))
    total = Counter()
    for (doc, _, _), at in pieces.items():
        at.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False))  # nothing lost between pieces
        total[doc] += sum(n for _, n in at)
    assert total == want
    bins = defaultdict(list)
    for r in got:
        assert (r["bin_id"] is None) == (r["length"] == 0)
        bins[r["bin_id"]].append(r)
    bins.pop(None)
    for rows in bins.values():
        assert sum(r["length"] for r in rows) <= 100 and len({r["cluster"] for r in rows}) == len(rows) and max(Counter(r["source"] for r in rows).values()) <= packing.PER_SOURCE
    assert packing.best_fit_pack(cases.empty(spark)).count() == 0


def test_op6_keeps_near_copies_apart(spark, tmp_path):
    rng, rows = random.Random(8), [(1, "", "s"), (None, None, "s")]
    for f in range(4):
        base = cases.prose(600 + f, 90).split()
        rows += [(100 * f + i if f else None, changed(base, rng, 1) + " more" * (i % 2), f"s{i}") for i in range(4)]
    rows += [(900, cases.prose(700, 90), "s0"), (900, cases.prose(700, 90) + " more", "s0"), (901, cases.prose(701, 5000), "s1"), (902, cases.prose(701, 5000) + " more", "s1")]
    rows += [(910 + i, cases.prose(710 + i, 50), f"s{i}") for i in range(6)]
    cases.docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op6_best_fit_packing(spark, str(tmp_path)).collect()
    component = {i: c for i, _, c, _ in join_by_hand(rows)}
    bins, pieces = defaultdict(list), Counter()
    for r in got:
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(component[r["doc_id"]])
        pieces[r["doc_id"], r["source"], r["cluster"], r["copy"], r["piece"]] += 1
    assert all(len(set(c)) == len(c) for c in bins.values()) and set(pieces.values()) == {1}
    assert max(len(c) for c in bins.values()) > 4  # different documents still meet
    assert sum(r["length"] for r in got) == sum(len(WORD.findall(t or "")) for _, t, _ in rows)


def test_op6_counts_words_where_the_join_reads_texts(spark, tmp_path, monkeypatch):
    cases.hard(spark).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(packing, "word_counts", None)  # a second reading of all texts
    got = Counter()
    for r in packing.op6_best_fit_packing(spark, str(tmp_path)).collect():
        got[r["doc_id"], r["source"]] += r["length"]
    want = Counter()
    for r in cases.hard_rows():
        want[r[0], r[3]] += len(WORD.findall(r[1] or ""))
    assert got == want and got.keys() == want.keys()


def test_prefixes_of_classes_over_several_batches(spark):
    rng = random.Random(14)
    classes = [(c, rng.randrange(1, 60)) for c in range(-20, 20)]
    classes, shared = [(c, n, rng.randrange(n + 1)) for c, n in classes], []
    for c, n, low in classes[3:]:
        for k in rng.sample(range(100), rng.randrange(n + 1)):
            high = rng.random() < 0.5
            shared.append((c, (k - 200 if k % 2 else 6 * 10**18 + k) if high else k, rng.randrange(2, 5)))
    want = []
    for c, n, low in classes:
        mine = sorted((t < 0 or t >= 0.3 * 2**64, df, t) for d, t, df in shared if d == c)
        below, need = sum(not high for high, *_ in mine), -(-75 * n // 100)
        at = [(t, (n - len(mine) if high else low - below) + i) for i, (high, _, t) in enumerate(mine)]
        at = [(t, pos) for t, pos in at if pos < n - need + min(6, need)]
        want += [(c, n, t, pos) for t, pos in at if len(at) >= min(6, -(-75 * need // 100))]
    with common.arrow_rows(spark, 7):
        got = jaccard_join.prefixes(spark.createDataFrame(shared, "class long, token long, df long"), spark.createDataFrame(classes, "class long, n long, low long")).collect()
    assert want and Counter(map(tuple, got)) == Counter(want)


def top_by_hand(rows, every, k):
    v = [(i, [int(np.floor(256 * float(c))) for c in x]) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = Counter()
    for q, x in {(i, tuple(x)) for i, x in v if i % every == 0}:
        scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(x, y, strict=False)))), i) for i, y in v if i != q)
        out.update((q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k]))
    return out


def test_topk_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk_search, "CHUNK_QUERIES", 2)
    monkeypatch.setattr(topk_search, "BLOCK", 8)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(c) for c in rng.normal(size=6).astype(np.float32)]) for i in range(200)]
    rows += [(i, [0.5] * 6) for i in range(300, 360)] + [(400, [0.5] * 6)] * 3  # ties and repeated rows
    rows += [(500, None), (501, []), (550, [1.0, None]), (551, [float("nan")]), (552, [float("inf")] * 6), (None, [1.0] * 6), (553, [1.0, 2.0]), (554, [1.0] * 9)]
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in rows], "vec_id long, embedding array<float>, score string, rank int")
    got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.top_k(df).collect())
    assert got == top_by_hand(rows, 50, 5)
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.top_k(df.repartition(7, "score")).collect()) == got
    assert topk_search.top_k(df.limit(0)).count() == 0
    assert topk_search.top_k(df.filter("vec_id = 50")).count() == 0


def test_topk_beyond_exact_doubles(spark):
    rows = [(50, [3e9, -1e9]), (1, [2e9, 1e9]), (2, [2e9, 1.000001e9]), (3, [1e30, 1e30]), (4, [-1e30, 1e30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.top_k(df).collect()) == top_by_hand(rows, 50, 5)


def best_by_hand(values, queries, k):
    scores = queries @ values.T
    return [[(int(j), float(r[j])) for j in np.lexsort((np.arange(len(r)), -r))[:k]] for r in scores]


def test_blocks_below_the_bound_are_skipped():
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(90, 100, (128, 8)), rng.integers(0, 10, (128 * 30, 8))]).astype(float)
    shard = topk_search.Shard(np.arange(len(values)), values)
    got = shard.search(values[:3], np.full(3, -1), 5)
    assert shard.scored == 3 * 128
    assert [list(zip(i.tolist(), s.tolist(), strict=True)) for i, s in got] == best_by_hand(values, values[:3], 5)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_bounds_and_floors_lose_nothing(seed):
    """Clustered and unclustered vectors, with and without a known floor: the same best k, ties by id."""
    rng = np.random.default_rng(seed)
    d, n = int(rng.integers(1, 20)), int(rng.integers(1, 700))
    centres = rng.integers(-200, 200, (4, d))
    values = (centres[np.arange(n) * 4 // n] + rng.integers(-9, 10, (n, d))).astype(float) if seed % 2 else rng.integers(-60, 60, (n, d)).astype(float)
    queries = rng.integers(-200, 200, (3, d)).astype(float)
    want = best_by_hand(values, queries, 5)
    for floors in (None, np.array([w[-1][1] if len(w) == 5 else -np.inf for w in want])):
        got = topk_search.Shard(np.arange(n), values).search(queries, np.full(3, -1), 5, floors)
        assert [list(zip(i.tolist(), s.tolist(), strict=True)) for i, s in got] == want


def test_a_task_does_not_depend_on_the_order_of_its_rows():
    import pandas as pd
    rows = pd.DataFrame({"chunk": 0, "vec_id": [50, 50, 100, 0], "hash": [3, -2, 1, 9], "floor": [1.0, None, None, 4.0], "embedding": [[0.1, 0.2], [0.3], [0.5, 0.5, 0.5], []]})
    blobs = [topk_search._query_blob(rows.sample(frac=1, random_state=i)).to_dict("records") for i in range(6)]
    assert all(b == blobs[0] for b in blobs)
