"""Toxicity: a word classifier regularised by counterfactuals.

A logistic regression on the presence of words is learned from labelled texts. Every sentence of those texts that
names a group (IDENTITY_TERMS) is also written with another terms of the same kind in their place, each other one in turn; the squared change
of the sentence's score is added to the loss, so that the mere mention of a group moves no score while words that
occur only in toxic texts keep their weight.

Words are runs of ASCII letters, digits, `_` and non-ASCII characters, with A-Z lower-cased, known by a 64-bit hash.

Scale: words are counted, and swaps summed, where the sampled texts are; the driver gets at most MAX_FEATURES words, SAMPLE_ROWS sets of
them, and one number for each two identity terms. Whole texts are learned from and scored, however long.

Defined cases: a null or empty text has the score of the bias alone. Without labelled rows every score is the prior
0 (nothing is known to be toxic). A document labelled more than once counts as the mean of its labels; of several
texts with one id one is learned from. Repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common
from tracewright.llm.quality_gam import labelled

# Identity terms by kind; a term may be swapped with any other of its kind.
IDENTITY_TERMS = {
    "religion": "christian muslim jewish hindu buddhist sikh catholic protestant atheist".split(),
    "religions": "christians muslims jews hindus buddhists sikhs catholics protestants atheists".split(),
    "gender": "man woman male female nonbinary transgender".split(),
    "genders": "men women males females boys girls".split(),
    "orientation": "gay lesbian bisexual straight heterosexual homosexual queer".split(),
    "ethnicity": "black white asian african european latino hispanic arab native".split(),
    "nationality": "american mexican chinese indian german french spanish russian turkish polish".split(),
    "status": "immigrant refugee citizen foreigner migrant".split(),
    "statuses": "immigrants refugees citizens foreigners migrants".split(),
    "ability": "disabled deaf blind autistic paralyzed".split(),
    "religions_fr": "chrétiens musulmans juifs hindous bouddhistes".split(),
    "religions_de": "christen muslime juden hindus buddhisten".split(),
    "religions_es": "cristianos musulmanes judíos hindúes budistas".split(),
}
_KIND = {t: k for k, terms in IDENTITY_TERMS.items() for t in terms}
TERMS = sorted(_KIND)
SAMPLE_ROWS = 12_000
MAX_FEATURES = 2000
#: How much a toxic text weighs in learning, as choose_weight() found it on learning rows alone (README has the figures), and what it chose among.
POSITIVE = 8.0
WEIGHTS = (1.0, 2.0, 3.0, 5.0, 8.0)
THRESHOLD = 0.5
_SENTENCE = re.compile(r"(?<=[.!?\n])")
_WORD = re.compile(r"[0-9A-Za-z_\u0080-\U0010ffff]+")


def row_words(column: pa.Array):
    """(first row, number of rows, rows of the words, hashes of the words) for each chunk of a text column."""
    for at, data, offsets in common.text_chunks(column):
        starts, ends, row = common.words(data, offsets, common.NON_WORD)
        yield at, len(offsets) - 1, row, common.span_hashes(data, starts, ends)


def swapped(sentence: str) -> list[str]:
    """The sentence with the identity terms of one kind replaced by the next, the second next, ... of it, until each has stood for every other; for each kind it names."""
    out = []
    for kind in sorted({_KIND[w] for w in (m[0].lower() for m in _WORD.finditer(sentence)) if w in _KIND}):
        out += [_WORD.sub(lambda m, kind=kind, step=step: _other(m[0], kind, step), sentence) for step in range(1, len(IDENTITY_TERMS[kind]))]
    return out


def _other(word: str, kind: str, step: int) -> str:
    if _KIND.get(word.lower()) != kind:
        return word
    terms = IDENTITY_TERMS[kind]
    return terms[(terms.index(word.lower()) + step) % len(terms)]


@dataclass
class ToxicityModel:
    bias: float = -40.0
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score(self, column: pa.Array) -> np.ndarray:
        total = np.full(len(column), self.bias)
        if len(self.hashes):
            for at, n, row, hashes in row_words(column):
                row, found = present(row, hashes, self.hashes)
                total[at : at + n] += np.bincount(row, self.weights[found], n)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def present(row: np.ndarray, hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, index in known) of the hashes that are known."""
    found = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = known[found] == hashes
    keys = np.unique(row[hit] * len(known) + found[hit])
    return keys // len(known), keys % len(known)


def word_sets(column: pa.Array) -> list[np.ndarray]:
    """The distinct hashes of each row's words, ascending."""
    out = []
    for _, n, row, hashes in row_words(column):
        order = np.lexsort((hashes, row))
        row, hashes = row[order], hashes[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
        row, hashes = row[new], hashes[new]
        out += np.split(hashes, np.searchsorted(row, np.arange(1, n)))
    return out


def term_hashes() -> np.ndarray:
    """A hash for each of TERMS."""
    return np.concatenate([h for *_, h in row_words(pa.array(TERMS, pa.string()))])


def swap_moments(texts: list[str | None]) -> tuple[dict[tuple[int, int], int], int]:
    """The sum, over all swapped sentences, of the products of their changes in two terms (numbers in TERMS), and how many there are.

    A swap only adds and removes identity terms, so this square matrix is all that the penalty needs of the sentences."""
    number, total, n = {t: i for i, t in enumerate(TERMS)}, {}, 0
    for text in texts:
        for sentence in _SENTENCE.split(text or ""):
            named: dict[str, set[str]] = {}
            for m in _WORD.finditer(sentence):
                if (w := m[0].lower()) in _KIND:
                    named.setdefault(_KIND[w], set()).add(w)
            for kind, had in named.items():
                for step in range(1, len(IDENTITY_TERMS[kind])):
                    n += 1
                    has = {_other(w, kind, step) for w in had}
                    change = [(number[w], 1) for w in had - has] + [(number[w], -1) for w in has - had]
                    for i, a in change:
                        for j, b in change:
                            total[i, j] = total.get((i, j), 0) + a * b
    return total, n


def select_words(words: np.ndarray, toxic: np.ndarray, held: np.ndarray, n_toxic: float, n: int, *, least: int = 4, z: float = 3.0, most: int = MAX_FEATURES) -> np.ndarray:
    """Hashes of the words whose presence differs between the classes (log odds over its deviation), and of the identity terms.

    words are in `held` texts, `toxic` of them toxic; n_toxic of the n texts are."""
    clean = held - toxic
    a, b, n1, n0 = toxic + 0.5, clean + 0.5, n_toxic + 1, n - n_toxic + 1
    score = (np.log(a / np.maximum(n1 - toxic, 0.5)) - np.log(b / np.maximum(n0 - clean, 0.5))) / np.sqrt(1 / a + 1 / b)
    usable = np.flatnonzero((held >= least) & (np.abs(score) >= z))
    order = np.lexsort((words[usable], -np.abs(score[usable])))[:most]
    return np.unique(np.concatenate([words[usable[order]], term_hashes()]))


def loss(w: np.ndarray, bias: float, x: np.ndarray, y: np.ndarray, weight: np.ndarray, moments: np.ndarray, counterfactual: float, l2: float) -> tuple[float, np.ndarray, float]:
    """What learning minimises, with its gradient by the weights and by the bias: weighted log loss, ridge, and w' moments w."""
    z = np.clip(x @ w + bias, -40, 40)
    error = weight * (1 / (1 + np.exp(-z)) - y)
    pull = moments @ w
    value = float(np.mean(weight * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z))) + 0.5 * l2 * float(w @ w) + counterfactual * float(w @ pull)
    return value, error @ x / len(x) + l2 * w + 2 * counterfactual * pull, float(error.mean())


def fit(known: np.ndarray, sets: list[np.ndarray], y: np.ndarray, moments: dict[tuple[int, int], int], pairs: int, *, counterfactual: float = 1.0, positive: float = POSITIVE, l2: float = 0.0002, steps: int = 500, rate: float = 0.05) -> ToxicityModel:
    """The model over the known words for texts that hold sets of them (places in known); a toxic text weighs `positive` times another."""
    x = np.zeros((len(sets), len(known)), np.float32)  # at most SAMPLE_ROWS x (MAX_FEATURES + identity terms)
    for row, s in zip(x, sets, strict=True):
        row[s] = 1
    place = np.searchsorted(known, term_hashes())
    swaps = np.zeros((len(known), len(known)), np.float32)
    for (i, j), c in moments.items():
        swaps[place[i], place[j]] += c / pairs
    y, p0 = y.astype(np.float32), (y.sum() + 0.5) / (len(y) + 1)
    weight = np.where(y > 0, np.float32(positive), np.float32(1))
    w, bias = np.zeros(len(known), np.float32), float(np.log(p0 / (1 - p0)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        _, g, gb = loss(w, bias, x, y, weight, swaps, counterfactual, l2)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        lr = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= (lr * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        bias -= lr * mb / (np.sqrt(vb) + 1e-8)
    return ToxicityModel(bias, known, w.astype(float))


def learn(texts: list[str], y: np.ndarray, **options) -> ToxicityModel:
    """train() for texts at hand."""
    if not len(texts):
        return ToxicityModel()
    sets = word_sets(pa.array(texts, pa.string()))
    words, at = np.unique(np.concatenate(sets), return_inverse=True)
    labels = np.repeat(y, [len(s) for s in sets])
    known = select_words(words, np.bincount(at, labels, len(words)), np.bincount(at, minlength=len(words)), y.sum(), len(y))
    places = [np.searchsorted(known, np.intersect1d(s, known)) for s in sets]
    return fit(known, places, y, *swap_moments(texts), **options)


def _sampled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame | None:
    """doc_id, toxic, text of at most `rows` labelled texts, drawn by hash of doc_id outside the held-out fold."""
    sample = labelled(labels, "toxic", rows=rows)
    if sample is None:
        return None
    chosen = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")  # at most `rows` pairs of numbers
    chosen = common.one_text_a_document(chosen, "__tw_label").select("doc_id", (F.col("__tw_label") >= 0.5).alias("toxic"), "text")
    return common.materialize(chosen, "toxic-sample")


def train(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, counterfactual: float = 1.0) -> ToxicityModel:
    """Learn from at most `rows` labelled texts, drawn by hash of doc_id outside the held-out fold."""
    common.ship(docs.sparkSession)
    chosen = _sampled(docs, labels, rows)
    prepared = None if chosen is None else _prepared(chosen)
    return ToxicityModel() if prepared is None else fit(*prepared, counterfactual=counterfactual)


def choose_weight(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS // 3, weights: tuple[float, ...] = WEIGHTS) -> tuple[float, dict[float, tuple[int, int, int, int]]]:
    """The weight of toxic texts with the greatest mean of the shares of toxic and of other texts that are judged right (the smallest of equals), and for each weight: toxic texts caught, toxic
    texts, others left alone, others.

    Only learning rows are used: a second hash of doc_id holds a fifth of them out for this choice. The rows that the queries hold out aren't seen."""
    common.ship(docs.sparkSession)
    chosen = _sampled(docs, labels, rows)
    if chosen is None:
        return POSITIVE, {}
    inner = F.pmod(F.crc32(F.concat(F.lit("inner:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), F.lit(5)) == 0
    tried = chosen.filter(inner).orderBy("doc_id").select("text", "toxic").collect()  # at most a fifth of `rows`, or so
    texts, toxic = pa.array([r["text"] for r in tried], pa.string()), np.array([r["toxic"] for r in tried], bool)
    prepared, told = _prepared(chosen.filter(~inner)), {}
    for weight in weights:
        caught = (fit(*prepared, positive=weight) if prepared else ToxicityModel()).score(texts) >= THRESHOLD
        told[weight] = int((caught & toxic).sum()), int(toxic.sum()), int((~caught & ~toxic).sum()), int((~toxic).sum())
    right = lambda t: t[0] / max(1, t[1]) + t[2] / max(1, t[3])
    return max(weights, key=lambda w: (right(told[w]), -w)), told


def _prepared(chosen: DataFrame) -> tuple | None:
    """What fit() needs of the sample: known words, sets of them, labels, sums and number of swaps. None without rows."""
    chosen = chosen.select("toxic", "text")
    n, n_toxic = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0))).first()
    if not n:
        return None

    def hashed(batches):
        for batch in batches:
            sets = word_sets(batch.column(1))
            blobs = pa.array(np.concatenate(sets).view(np.int64)) if sets else pa.array([], pa.int64())
            ends = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), blobs)], ["toxic", "words"])

    def moments(batches):
        for batch in batches:
            total, pairs = swap_moments(batch.column(1).to_pylist())
            entries = [(-1, -1, pairs), *((i, j, c) for (i, j), c in total.items())]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in entries], pa.int64()) for k in range(3)], ["i", "j", "c"])

    counts = chosen.mapInArrow(hashed, "toxic boolean, words array<long>").select("toxic", F.explode("words").alias("word")).groupBy("word")
    counts = counts.agg(F.count(F.lit(1)).alias("held"), F.sum(F.col("toxic").cast("int")).alias("toxic")).filter("held >= 4")
    words, toxic, held = _strongest(counts, n_toxic, n)
    known = select_words(words, toxic, held, n_toxic, n)
    swaps = {(r["i"], r["j"]): r["c"] for r in chosen.mapInArrow(moments, "i long, j long, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()}
    pairs = swaps.pop((-1, -1), 0)

    def placed(batches):
        for batch in batches:
            sets = [np.searchsorted(known, np.intersect1d(s, known)).astype(np.int32).tobytes() for s in word_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["toxic", "places"])

    got = sorted((r["toxic"], bytes(r["places"])) for r in chosen.mapInArrow(placed, "toxic boolean, places binary").collect())
    return known, [np.frombuffer(p, np.int32) for _, p in got], np.array([t for t, _ in got], float), swaps, pairs


def _strongest(counts: DataFrame, n_toxic: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word, toxic, held of the MAX_FEATURES words that select_words() would take first."""
    a, b = F.col("toxic") + 0.5, F.col("held") - F.col("toxic") + 0.5
    in_toxic, in_clean = F.greatest(F.lit(n_toxic + 1) - F.col("toxic"), F.lit(0.5)), F.greatest(F.lit(n - n_toxic + 1) - (F.col("held") - F.col("toxic")), F.lit(0.5))
    score = (F.log(a / in_toxic) - F.log(b / in_clean)) / F.sqrt(1 / a + 1 / b)
    top = counts.withColumn("score", F.abs(score)).orderBy(F.desc("score"), "word").limit(MAX_FEATURES + 64).collect()  # with room for ties of rounding
    number = lambda c, kind: np.array([r[c] for r in top], kind)
    return number("word", np.int64).view(np.uint64), number("toxic", float), number("held", float)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES words and the terms

    def run(batches):
        for batch in batches:
            d = dict(zip(batch.schema.names, batch.columns, strict=True))
            s = shared.value.score(d["text"])
            yield pa.RecordBatch.from_arrays([d["doc_id"], d["held_out"], pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, train(docs, common.table(spark, sf_dir, "labels")))
