import hashlib
import random
from collections import Counter

import cases
import numpy as np
import pytest

from tracewright.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def by_hand(rows, min_docs, min_chars):
    lines = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(BLANK).translate(LOWER)
    held = Counter(k for _, ls in lines for k in {key(line) for line in ls})
    often = {k for k, n in held.items() if n >= min_docs and len(k) >= min_chars}
    out = []
    for i, ls in lines:
        kept = [line for line in ls if key(line) not in often]
        out.append((i, "\n".join(kept), len(ls), len(ls) - len(kept)))
    return sorted(out, key=repr)


def got(df, **options):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_lines(df, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"min_docs": 2, "shards": 8, "chunk": 300}, {"min_docs": 2, "min_chars": 25, "chunk": 5000}, {"min_docs": 3, "min_chars": 0, "shards": 1}])
def test_hard_rows(spark, options):
    rows = [(r[0], r[1]) for r in cases.hard_rows()]
    assert got(cases.hard(spark), **options) == by_hand(rows, options.get("min_docs", 10), options.get("min_chars", 1))
    assert got(cases.empty(spark), **options) == []


def test_shared_lines_and_long_ones(spark):
    rng = random.Random(3)
    shared, long_line = [cases.prose(i, 5) for i in range(40)], "é" + "Ab " * 400_000
    rows = []
    for i in range(120):
        lines = [rng.choice(["", " ", "\t"]) + (line.upper() if rng.random() < 0.3 else line) + rng.choice(["", "\r", " \x0b"]) for line in rng.sample(shared, rng.randrange(6))]
        lines += [cases.prose(1000 + i, 4), "", "the hottest line of all"] + ([f"  {long_line}"] if i % 11 == 0 else [])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{i % 2}"))
    for options in ({}, {"shards": 16, "chunk": 2000}):
        have = got(cases.docs(spark, rows), **options)
        assert have == by_hand([r[:2] for r in rows], 10, 1)
        assert all("hottest" not in text for _, text, _, _ in have)
        assert sum(n for *_, n in have) > 200


def test_query_digests_what_stays(spark, tmp_path):
    cases.hard(spark).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in by_hand([(r[0], r[1]) for r in cases.hard_rows()], 10, 1)), key=repr)
    assert sorted((tuple(r) for r in line_dedup.op13_line_dedup(spark, str(tmp_path)).collect()), key=repr) == want


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 100_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    places = line_dedup.PerfectHash.of(keys)
    assert np.array_equal(np.sort(places.index(keys)), np.arange(len(keys)))
    if n == 100_000:
        assert len(places.words) * 64 < 4.5 * n and not len(places.rest)
    aside = line_dedup.PerfectHash(places.sizes[:1], places.words[: (places.sizes[0] // 64 if places.sizes else 0)], places.rest)
    assert set(aside.index(keys).tolist()) <= set(range(-1, len(keys)))


def test_index_counts_are_exact_and_unknown_keys_are_none():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64))
    counts = rng.integers(1, 400, len(keys)) ** 2
    shard = line_dedup.LineShard.read(*line_dedup.LineShard.of(keys, counts).row())
    assert np.array_equal(shard.probe(keys), counts)
    others = np.setdiff1d(rng.integers(0, 1 << 63, 200_000, dtype=np.uint64), keys)
    assert np.count_nonzero(shard.probe(others)) < 20
    assert not line_dedup.LineShard.of(keys[:0], counts[:0]).probe(keys).any()


def test_keys_that_no_level_holds_alone(monkeypatch):
    monkeypatch.setattr(line_dedup, "LEVELS", 1)
    keys = np.arange(1000, dtype=np.uint64)
    places = line_dedup.PerfectHash.of(keys)
    assert len(places.rest) and np.array_equal(np.sort(places.index(keys)), np.arange(1000))
