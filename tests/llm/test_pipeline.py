import hashlib
import os
import random
from collections import Counter, defaultdict

import cases
import pytest
import test_joins

import corpus_pipeline
from tracewright.llm import common, mixing, packing

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.materialize(stage(spark, docs, SF), f"test-{name}")
        kept[name] = (before, docs)
        if name != "best_fit_packing":
            assert docs.columns == names
    quality = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = kept["quality_gam"]
    left = lambda df: df.join(quality.filter("quality = 1"), "doc_id", "left_semi").count()
    assert left(after) > 0.97 * left(before)
    assert after.join(quality.filter("quality = 0"), "doc_id", "left_semi").count() < 0.5 * before.join(quality.filter("quality = 0"), "doc_id", "left_semi").count()
    _, unique = kept["jaccard_join"]
    assert unique.select("text").distinct().count() == unique.count()
    mixed = kept["mix_sources"][1]
    packed = corpus_pipeline.run(spark, SF)
    words = lambda df: df.selectExpr("sum(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+')) as n").first()["n"]
    assert packed.agg({"length": "sum"}).first()[0] == words(mixed)
    assert packed.groupBy("bin_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def mixed_by_hand(rows):
    of = lambda r: r[2] if r[2] in mixing.WEIGHTS else mixing.OTHER
    n, whole, out = Counter(of(r) for r in rows), sum(mixing.WEIGHTS.values()), Counter()
    for r in rows:
        b = of(r)
        drawn = str(r[0]) if r[0] is not None else hashlib.md5(r[1].encode()).hexdigest() if r[1] is not None else ""
        u = int(hashlib.md5(f"{mixing.SEED}|{drawn}".encode()).hexdigest()[:13], 16) / 2**52
        out[r] += sum(c <= u for c in mixing.poisson_table(mixing.WEIGHTS[b] / whole * len(rows) / n[b]))
    return +out


def test_unlearned_stages_by_hand(spark):
    """Join and mixing row by row, packing by its rules, on near copies (one without id) and texts without words."""
    rng, texts = random.Random(4), []
    for f in range(8):
        base = cases.prose(900 + f, 90).split()
        texts += [test_joins.changed(base, rng, rng.randrange(3)) for _ in range(6)]
    texts += [cases.prose(950 + i, rng.randrange(1, 60)) for i in range(40)] + ["", None]
    rows = [(i, t, f"src{i % 7}") for i, t in enumerate(texts)]
    base = cases.prose(990, 90).split()
    rows += [(1000, " ".join(base), "src1"), (None, test_joins.changed(base, rng, 1), "src2")]
    stages, row = dict(corpus_pipeline.STAGES), lambda r: (r["doc_id"], r["text"], r["source"])
    kept = common.materialize(stages["jaccard_join"](spark, cases.docs(spark, rows), ""), "test-kept")
    first = {i for i, _, c, _ in test_joins.join_by_hand(rows) if i == c}
    want = [r for r in rows if r[0] in first]
    assert Counter(map(row, kept.collect())) == Counter(want) and len(want) < len(rows) - 8
    mixed = common.materialize(stages["mix_sources"](spark, kept, ""), "test-mixed")
    assert Counter(map(row, mixed.collect())) == mixed_by_hand(want)
    words, packed, bins = Counter(), Counter(), defaultdict(list)
    for r in mixed.collect():
        words[r["doc_id"]] += len(test_joins.WORD.findall(r["text"] or ""))
    for r in stages["best_fit_packing"](spark, mixed, "").collect():
        packed[r["doc_id"]] += r["length"]
        bins[r["bin_id"]].append(r)
    assert packed == words
    bins.pop(None, None)
    for b in bins.values():
        assert sum(r["length"] for r in b) <= packing.CAPACITY and len({r["cluster"] for r in b}) == len(b) and max(Counter(r["source"] for r in b).values()) <= packing.PER_SOURCE


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_no_near_copies_after_the_join_stage(spark):
    docs = common.table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["jaccard_join"](spark, docs, SF).collect()]
    sets, held, common_n = [test_joins.shingles(t) for _, t in rows], defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for g in s:
            common_n.update((j, i) for j in held[g])
            held[g].append(i)
    assert len(rows) < docs.count() and not [p for p, c in common_n.items() if 100 * c >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - c)]


@pytest.mark.parametrize("kind", ["hard", "empty"])
def test_hard_rows_and_empty_tables_through_all_stages(spark, tmp_path, kind):
    """Nulls in any column, empty and long texts, repeated rows and clashing columns: each stage on the raw rows, all in turn, and run()."""
    raw = cases.hard(spark) if kind == "hard" else cases.empty(spark)
    raw.write.parquet(f"{tmp_path}/documents.parquet")
    known = [(i, 1, 0) for i in range(100, 130)] + [(13, 0, 0), (9, 0, 0), (None, 1, 1), (5, None, None)] if kind == "hard" else []
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    raw = spark.read.parquet(f"{tmp_path}/documents.parquet")
    alone, docs, ids = {}, raw, Counter(r[0] for r in raw.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        alone[name] = [r.asDict() for r in stage(spark, raw, str(tmp_path)).collect()]
        docs = common.materialize(stage(spark, docs, str(tmp_path)), f"test-{name}")
        if name != "best_fit_packing":
            assert docs.columns == raw.columns
        assert {r["doc_id"] for r in alone[name]} <= set(ids)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    if kind == "empty":
        assert not any(alone.values()) and docs.count() == 0
        return
    spoken = Counter(r["doc_id"] for r in alone["language_id"])
    assert not {1, 2, 3, 9} & set(spoken) and spoken[20] in (0, 40) and spoken[4] in (0, 2, 3)
    good = Counter(r["doc_id"] for r in alone["quality_gam"])
    assert all(good[i] in (0, n) for i, n in ids.items() if i not in (None, 4)) and sum(good[i] for i in range(100, 130)) > 25
    words = Counter()
    for r in cases.hard_rows():
        words[r[0]] += len(test_joins.WORD.findall(r[1] or ""))
    packed = Counter()
    for r in alone["best_fit_packing"]:
        packed[r["doc_id"]] += r["length"]
    assert packed == words


def test_copies_of_a_row_are_made_in_runs(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 7)
    docs = cases.docs(spark, [(1, "a b c", "s")] * 100 + [(2, "d e", "s"), (3, "", "s")])
    got = packing.best_fit_pack(docs, capacity=10).collect()
    assert sorted(r["copy"] for r in got if r["doc_id"] == 1) == list(range(1, 101)) and Counter(r["doc_id"] for r in got) == Counter({1: 100, 2: 1, 3: 1})
    assert len({r["bin_id"] for r in got if r["doc_id"] == 1}) == 100
