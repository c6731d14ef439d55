import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import cases
from pyspark.sql import functions as F

from tracewright.llm import common, language_id, quality_gam, toxicity

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_hard_rows_all_answered(spark):
    some = [(i, i % 2, int(i % 3 == 0)) for i in range(130)] + [(5, 0, 1), (5, 1, 0), (None, 1, 1), (6, None, None)]
    docs, known = cases.hard(spark), labels(spark, some)
    n = docs.count()
    for scored in (quality_gam.score_quality(docs, quality_gam.train(docs, known)), toxicity.score_toxicity(docs, toxicity.train(docs, known))):
        rows = scored.collect()
        assert len(rows) == n and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["held_out"] is not None for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 20}) == 1
    rows = language_id.predict_languages(docs, language_id.train(docs)).collect()
    assert len(rows) == n and all((r["lang_pred"] == "und") == (r["score"] == 0) for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[i]["lang_pred"] == "und" for i in (1, 2, 3, 9)) and by_id[5]["lang_pred"] != "und"


def test_empty_tables(spark):
    docs = cases.empty(spark)
    assert quality_gam.score_quality(docs, quality_gam.train(docs, labels(spark))).count() == 0
    assert toxicity.score_toxicity(docs, toxicity.train(docs, labels(spark))).count() == 0
    assert language_id.predict_languages(docs, language_id.train(docs)).count() == 0
    hard = cases.hard(spark)
    assert {r["score"] for r in quality_gam.score_quality(hard, quality_gam.train(hard, labels(spark))).collect()} == {0.5}
    assert max(r["score"] for r in toxicity.score_toxicity(hard, toxicity.train(hard, labels(spark))).collect()) < 1e-6
    assert {r["lang_pred"] for r in language_id.predict_languages(hard, language_id.train(docs)).collect()} == {"und"}


@needs_data
def test_held_out_quality(spark):
    docs, known = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    p = quality_gam.score_quality(docs, quality_gam.train(docs, known)).filter("held_out").join(known, "doc_id").toPandas()
    good = p["quality"] == 1
    assert p.loc[good, "predicted"].mean() > 0.95 and p.loc[good, "score"].mean() > p.loc[~good, "score"].mean() + 0.4


@needs_data
def test_held_out_language(spark):
    docs = common.table(spark, SF, "documents")
    p = language_id.predict_languages(docs, language_id.train(docs)).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (p["lang"] == p["lang_pred"]).mean() > 0.97


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test data")
def test_held_out_toxicity(spark):
    docs, known = common.table(spark, LARGER, "documents"), common.table(spark, LARGER, "labels")
    p = toxicity.score_toxicity(docs, toxicity.train(docs, known)).filter("held_out").join(known, "doc_id").toPandas()
    toxic, caught = p["toxic"] == 1, p["predicted"] == 1
    assert toxic.sum() >= 20 and (toxic & caught).sum() >= 0.8 * toxic.sum() and (toxic & caught).sum() >= 0.95 * caught.sum()


def toxic_texts():
    texts = [f"you {g} idiot {cases.prose(i, 20)}." for i in range(30) for g in ("muslim", "gay")] + [f"the {g} people met {cases.prose(1000 + i, 20)}." for i in range(100) for g in ("christian", "straight")]
    return texts, np.array([1.0] * 60 + [0.0] * 200)


def test_toxicity_by_hand(spark):
    """Words, swaps and scores by plain Python; learning where the rows are gives the model of learning at hand."""
    texts, y = toxic_texts()
    docs = cases.docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    keep = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5]
    far = toxicity.train(docs, labels(spark, [(i, 1, int(y[i])) for i in range(len(texts))]))
    near = toxicity.learn([texts[i] for i in keep], y[keep])
    assert set(far.hashes.tolist()) == set(near.hashes.tolist()) and np.allclose(far.weights, near.weights, atol=1e-3) and abs(far.bias - near.bias) < 1e-3
    weight = dict(zip(near.hashes.tolist(), near.weights, strict=True))
    of = {w: int(h) for w in {w for t in texts for w in re.findall(r"\w+", t.lower())} for *_, hs in toxicity.row_words(pa.array([w])) for h in hs}
    for t, got in zip(texts, near.score(pa.array(texts)), strict=True):
        assert abs(1 / (1 + np.exp(-near.bias - sum(weight.get(of[w], 0.0) for w in set(re.findall(r"\w+", t.lower()))))) - got) < 1e-9
    moments, n = toxicity.swap_moments(texts[:40])
    m = np.zeros((len(toxicity.TERMS),) * 2)
    pairs = [(s, o) for t in texts[:40] for s in t.split(".") for o in toxicity.swapped(s)]
    assert len(pairs) == sum(len(toxicity.IDENTITY_TERMS[k]) - 1 for t in texts[:40] for k in ("religion", "orientation") for w in toxicity.IDENTITY_TERMS[k] if w in t.split())
    for s, o in pairs:
        holds = lambda x: np.array([w in x.lower().split() for w in toxicity.TERMS], float)
        d = holds(s) - holds(o)
        m += np.outer(d, d)
    assert n == len(pairs) and moments == {(i, j): int(m[i, j]) for i, j in zip(*np.nonzero(m), strict=True)}


def test_toxicity_gradient():
    rng = np.random.default_rng(3)
    x, y, w = rng.integers(0, 2, (40, 6)).astype(float), rng.integers(0, 2, 40).astype(float), rng.normal(size=6)
    d = rng.integers(-1, 2, (9, 6))
    at = lambda w, b: toxicity.loss(w, b, x, y, 1 + 2 * y, d.T @ d / 9, 1.5, 0.1)
    _, g, gb = at(w, 0.3)
    for k in range(6):
        e = np.eye(6)[k] * 1e-5
        assert abs((at(w + e, 0.3)[0] - at(w - e, 0.3)[0]) / 2e-5 - g[k]) < 1e-6
    assert abs((at(w, 0.3 + 1e-5)[0] - at(w, 0.3 - 1e-5)[0]) / 2e-5 - gb) < 1e-6


def grams_by_hand(text):
    chars = [ord(c) for c in text.replace("\0", " ").lower()]
    for order in range(1, language_id.ORDERS + 1):
        for i in range(len(chars) - order + 1):
            h = 0
            for k in range(order):
                h = ((h ^ (chars[i + k] * int(language_id._SALT[k]) & 0xFFFFFFFF)) * 0x01000193) & 0xFFFFFFFF
            yield (((h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - language_id.BITS)) + (order - 1) * language_id.WIDTH


def test_language_scores_by_hand(monkeypatch):
    """Logits as sums over a text's n-grams, the same in steps of any size, for long, empty and odd texts."""
    rng = np.random.default_rng(4)
    table = rng.normal(size=(language_id.NONE + 1, 3)).astype(np.float32)
    table[language_id.NONE] = 0
    model = language_id.LanguageModel(["a", "b", "c"], table, 1.7)
    texts = ["Hello World", "é\0x", "", "日本 \U0001F600", cases.prose(3, 400), "a"]
    want = []
    for t in texts:
        total = sum((table[g].astype(float) for g in grams_by_hand(t)), np.zeros(3))
        want.append(total * language_id.SCALE / max(len(t), 1) / 1.7)
    for step in (400_000, 7, 64):
        monkeypatch.setattr(language_id, "STEP", step)
        assert np.allclose(model.logits(texts), want, atol=1e-4)


def plain_ftrl(texts, langs, epochs=4, alpha=0.3, beta=1.0, l1=0.02, l2=0.02, seed=7):
    """The learning of language_id.fit with dictionaries and single numbers, from texts."""
    names = sorted(set(langs))
    rows = []
    for t in texts:
        count = {}
        for g in grams_by_hand(t):
            count[g] = count.get(g, 0) + 1
        rows.append({g: c * language_id.SCALE / max(1, len(t)) for g, c in count.items()})
    df = {}
    for r in rows:
        for g in r:
            df[g] = df.get(g, 0) + 1
    idf = {g: math.log((1 + len(rows)) / (1 + n)) + 1 for g, n in df.items()}
    order = np.random.default_rng(seed).permutation(len(rows))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    z, n = {}, {}

    def weight(g, k):
        if abs(z.get((g, k), 0.0)) <= l1:
            return 0.0
        return -math.copysign(abs(z[g, k]) - l1, z[g, k]) / ((beta + math.sqrt(n[g, k])) / alpha + l2)

    rng = np.random.default_rng(seed + 1)
    for _ in range(epochs):
        for i in rng.permutation(used):
            w = {(g, k): weight(g, k) for g in rows[i] for k in range(len(names))}
            scores = [sum(x * idf[g] * w[g, k] for g, x in rows[i].items()) for k in range(len(names))]
            e = [math.exp(s - max(scores)) for s in scores]
            for k in range(len(names)):
                error = e[k] / sum(e) - (names[k] == langs[i])
                for g, x in rows[i].items():
                    step, had = x * idf[g] * error, n.get((g, k), 0.0)
                    z[g, k] = z.get((g, k), 0.0) + step - (math.sqrt(had + step * step) - math.sqrt(had)) / alpha * w[g, k]
                    n[g, k] = had + step * step
    logits = [[sum(x * idf[g] * weight(g, k) for g, x in rows[i].items()) for k in range(len(names))] for i in held]

    def loss(t):
        total = 0.0
        for i, row in zip(held, logits, strict=True):
            top = max(row)
            norm = math.log(sum(math.exp((v - top) / t) for v in row))
            for k, v in enumerate(row):
                share = 1 / (len(held) + 2)
                total -= (1 - share if names[k] == langs[i] else share / (len(names) - 1)) * ((v - top) / t - norm)
        return total

    grid = [math.exp(math.log(0.05) + j * (math.log(20) - math.log(0.05)) / 120) for j in range(121)]
    return {(g, k): weight(g, k) * idf[g] for g in idf for k in range(len(names))}, min(grid, key=loss)


def test_language_learning_by_hand(spark):
    """FTRL, idf and temperature by plain Python; learning where the rows are gives the model of learning at hand."""
    texts = [cases.prose(i, 12) if i % 2 else " ".join(w[::-1] for w in cases.prose(i, 12).split()) for i in range(40)]
    langs = ["xx" if i % 2 else "yy" for i in range(40)]
    model = language_id.learn(texts, langs)
    table, temperature = plain_ftrl(texts, langs)
    want = np.zeros((language_id.NONE + 1, 2))
    for (g, k), w in table.items():
        want[g, k] = w
    assert np.allclose(model.table, want, atol=1e-5) and abs(model.temperature - temperature) < 1e-9
    docs = spark.createDataFrame(list(zip(range(40), texts, langs, strict=True)), "doc_id long, text string, lang string")
    keep = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = sorted((*(x.astype(k).tobytes() for x, k in zip(language_id.counted(texts[i])[:2], (np.int32, np.uint32), strict=True)), i) for i in keep)
    far, near = language_id.train(docs), language_id.learn([texts[i] for *_, i in rows], [langs[i] for *_, i in rows])
    assert np.array_equal(far.table, near.table) and far.temperature == near.temperature


def test_what_only_the_middle_of_a_long_text_shows_is_learned(spark):
    filler = cases.prose(1, 60_000)
    half = len(filler) // 2
    rows = [(i, filler[:half] + (" qqxq" if i % 2 else " zzwz") * 3000 + filler[half:], "xx" if i % 2 else "yy") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    names = [model.langs[k] for k in model.predict([" qqxq" * 40, " zzwz" * 40])[0]]
    assert names == ["xx", "yy"]


def test_counts_do_not_depend_on_the_step(monkeypatch):
    text = "Hello\0World é日本 " + cases.prose(2, 300)
    want = {}
    for g in grams_by_hand(text):
        want[g] = want.get(g, 0) + 1
    for step in (400_000, 5, 64):
        monkeypatch.setattr(language_id, "STEP", step)
        ids, counts, n = language_id.counted(text)
        assert dict(zip(ids.tolist(), counts.tolist(), strict=True)) == want and n == len(text)
    assert [len(x) for x in language_id.counted("")[:2]] == [0, 0]


def test_weight_of_toxic_texts_is_chosen_without_held_out_rows(spark):
    texts, y = toxic_texts()
    docs = cases.docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    known = [(i, 1, int(y[i])) for i in range(len(texts))]
    weight, told = toxicity.choose_weight(docs, labels(spark, known), weights=(1.0, 5.0))
    wrong = [(i, q, t if zlib.crc32(str(i).encode()) % 5 else 1 - t) for i, q, t in known]  # other labels where the queries hold out
    assert toxicity.choose_weight(docs, labels(spark, wrong), weights=(1.0, 5.0)) == (weight, told)
    inner = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 and zlib.crc32(f"inner:{i}".encode()) % 5 == 0]
    assert weight in told and all(t[1] == sum(int(y[i]) for i in inner) and t[1] + t[3] == len(inner) for t in told.values())


def test_samples_do_not_depend_on_the_order_of_rows(spark):
    """Repeated ids with several texts: the same model from any order; the bound is that of the smallest hashes."""
    rows = [(i % 40, cases.prose(i, 30) + (" idiot" if i % 40 < 12 else ""), "s") for i in range(400)]
    known = labels(spark, [(i, i % 2, int(i < 12)) for i in range(40)])
    docs = cases.docs(spark, rows)
    for train in (lambda d: quality_gam.train(d, known, rows=25).bias, lambda d: toxicity.train(d, known, rows=25).weights.tolist(), lambda d: language_id.train(d, rows=25).table.sum()):
        assert train(docs) == train(docs.repartition(5, "text"))
    hashes = sorted(r["h"] for r in docs.selectExpr("xxhash64(doc_id) as h").distinct().collect())
    for size in (1, 5, 39, 40, 1000):
        assert common.hash_sample_bound(docs, "doc_id", size) == hashes[min(size, 40) - 1]
    many = spark.range(200_000)
    assert many.filter(F.xxhash64("id") <= common.hash_sample_bound(many, "id", 500)).count() == 500
    assert common.hash_sample_bound(many.limit(0), "id", 5) is None


def test_neutral_mentions_move_scores_less_with_the_penalty():
    texts = [f"you {g} idiot {cases.prose(i, 20)}." for i in range(60) for g in ("muslim", "gay")] + [f"the {g} people met {cases.prose(1000 + i, 20)}." for i in range(200) for g in ("christian", "straight")]
    y = np.array([1.0] * 120 + [0.0] * 400)
    neutral = pa.array([f"a {g} choir sang {cases.prose(5000, 20)}" for g in ("muslim", "christian")])
    gap = lambda m: abs(float(np.diff(np.log(m.score(neutral) / (1 - m.score(neutral))))[0]))
    free, bound = toxicity.learn(texts, y, counterfactual=0.0), toxicity.learn(texts, y, counterfactual=5.0)
    assert gap(bound) < 0.3 * gap(free)
    assert bound.score(pa.array(["what an idiot you are"]))[0] > 0.5
    assert toxicity.swapped("A Muslim man.")[:2] == ["A Muslim woman.", "A Muslim male."] and toxicity.swapped("A Muslim man.")[5] == "A jewish man." and toxicity.swapped("nobody here") == []


def test_gam_tables_add_up():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # a pure interaction
    m = quality_gam.learn(x, y)
    assert {0, 1} in [{j, k} for j, k, _ in m.pairs] and ((m.score(x) > 0.5) == y).mean() > 0.9
    b = m.bins(x[:5])
    for i in range(5):
        total = m.bias + sum(t[b[j][i]] for j, t in enumerate(m.tables)) + sum(t[b[j][i] // m.stride, b[k][i] // m.stride] for j, k, t in m.pairs)
        assert abs(1 / (1 + np.exp(-total)) - m.score(x[i : i + 1])[0]) < 1e-9


def test_features_by_hand():
    f = dict(zip(quality_gam.FEATURES, quality_gam.features(pa.array(["Ab cd ab.\nAb cd ab.\né 12!", None]))[0], strict=True))
    assert np.isclose(np.expm1(f["log_words"]), 8) and np.isclose(f["repeated_lines"], 1 / 3) and np.isclose(f["digits"], 2 / 25) and np.isclose(f["distinct_words"], 5 / 8)


def features_by_hand(text):
    text = text or ""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, lines = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w], [x for x in low.split("\n") if x]
    chars, some, n_lines = max(len(text), 1), max(len(words), 1), max(len(lines), 1)
    share = lambda kinds: sum(c in kinds for c in text) / chars
    size = lambda w: len(w.encode())
    spaces = sum(c in " \t\n\v\f\r" for c in text)
    return [
        np.log1p(len(words)), (chars - spaces) / some, share("#$%&*<>^~=+@\\_/{}[]"), share("|"), share("#$%&*"), share(".,;:'\"()-"), share("!?"), share("0123456789"),
        sum("A" <= c <= "Z" for c in text) / chars, sum(ord(c) > 127 for c in text) / chars, spaces / chars, len(words) / n_lines, 1 - max(len(set(lines)), 1) / n_lines,
        len(set(words)) / some, max(map(size, words), default=0), sum(size(w) <= 3 for w in words) / some,
    ]


def test_all_features_by_hand():
    rng = np.random.default_rng(6)
    pieces = ["word", "Word", "é", "日本語", " ", "  ", "\n", "\t", "|", "#", "?!", "12", "a.b", "(x)", "end\n", "\U0001F600", "LONGWORD" * 4]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 40))) for _ in range(60)] + ["", None, "\n\n", " "]
    got = quality_gam.features(pa.array(texts, pa.string()))
    assert np.allclose(got, [features_by_hand(t) for t in texts])


def test_gam_learning_by_hand():
    """One round over one feature is the plain Newton tree: the best two cuts of the ordered bins, found by trying all."""
    rng = np.random.default_rng(7)
    g, h = rng.normal(size=7), rng.random(7) + 0.1
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 4.0)

    def grow(a, b, depth):
        cuts = [c for c in range(a + 1, b) if depth]
        best = max(cuts, key=lambda c: gain(a, c) + gain(c, b), default=None)
        if best is None or gain(a, best) + gain(best, b) <= gain(a, b) + 1e-9:
            return [-g[a:b].sum() / (h[a:b].sum() + 4.0)] * (b - a)
        return grow(a, best, depth - 1) + grow(best, b, depth - 1)

    assert np.allclose(quality_gam._step(g, h, 4.0), grow(0, 7, 2))
    gg, hh = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.1
    loss = lambda out: float((gg * out + 0.5 * (hh + 0) * out * out).sum())
    values, gained = quality_gam._step2(gg, hh, 4.0)
    assert loss(values) < 0 and gained > 0 and len(np.unique(values)) <= 4


def test_features_do_not_depend_on_chunks(monkeypatch):
    texts = pa.array([cases.prose(i, 1 + i % 40) for i in range(50)] + ["", None, "é" * 30])
    whole = quality_gam.features(texts)
    monkeypatch.setattr(common.text_chunks, "__defaults__", (64,))
    assert np.array_equal(whole, quality_gam.features(texts))
