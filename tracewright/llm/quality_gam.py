"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature after another, on the logistic loss; each tree only adds to a
lookup table over its feature's bins, so the model is a table a feature. Then the pairs with the largest gain on
the residuals get two-dimensional tables the same way. A text's score is the logistic function of a sum of table
entries: bin numbers by binary search, one gather and addition a table, for all rows of a batch at once.

The features describe form, not topic: shares of kinds of characters, lengths of words and lines, repetition.

Defined cases: a null or empty text has all features 0 and is scored like any other. Without a labelled row every
score is 0.5. A document labelled more than once counts as the mean of its labels; of several texts with one id one is learned from. Null labels and labels of other
documents are left out. Repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common

FEATURES = ["log_words", "word_length", "symbols", "pipes", "hashes", "punctuation", "exclamations", "digits", "upper", "non_ascii", "spaces", "line_words", "repeated_lines", "distinct_words", "max_word", "short_words"]
#: Learning reads the features of a bounded, uniform sample of the labelled documents.
SAMPLE_ROWS = 12_000
MAX_BINS = 48
THRESHOLD = 0.3


def _share(*groups) -> np.ndarray:
    mask = np.zeros(256, np.int64)
    for g in groups:
        mask[list(g)] = 1
    return mask


_SYMBOLS, _PIPES, _HASHES = _share(b"#$%&*<>^~=+@\\_/{}[]"), _share(b"|"), _share(b"#$%&*")
_PUNCTUATION, _EXCLAMATIONS, _DIGITS = _share(b".,;:'\"()-"), _share(b"!?"), _share(b"0123456789")
_UPPER, _NON_ASCII, _SPACES, _CHARS = _share(range(65, 91)), _share(range(0xC0, 256)), _share(b" \t\n\v\f\r"), _share(range(128), range(0xC0, 256))
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes a row (44 bits of them; a chunk has less than 2**20 rows)."""
    keys = np.sort((rows.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[first] >> np.uint64(44)).astype(np.int64), minlength=n)


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(column), len(FEATURES)))
    for at, data, offsets in common.text_chunks(column):
        n = len(offsets) - 1
        count = lambda mask: common.per_row(mask[data], offsets)
        chars = np.maximum(count(_CHARS), 1)
        starts, ends, row = common.words(data, offsets)
        n_words = np.bincount(row, minlength=n)
        some = np.maximum(n_words, 1)
        length = ends - starts
        longest, short = np.zeros(n), np.bincount(row[length <= 3], minlength=n)
        np.maximum.at(longest, row, length)
        l_start, l_end, l_row = common.words(data, offsets, _NEWLINE)
        n_lines = np.maximum(np.bincount(l_row, minlength=n), 1)
        out[at : at + n] = np.stack(
            [
                np.log1p(n_words), (chars - count(_SPACES)) / some, count(_SYMBOLS) / chars, count(_PIPES) / chars, count(_HASHES) / chars,
                count(_PUNCTUATION) / chars, count(_EXCLAMATIONS) / chars, count(_DIGITS) / chars, count(_UPPER) / chars, count(_NON_ASCII) / chars,
                count(_SPACES) / chars, n_words / n_lines, 1 - np.maximum(_distinct(l_row, common.span_hashes(data, l_start, l_end), n), 1) / n_lines,
                _distinct(row, common.span_hashes(data, starts, ends), n) / some, longest, short / some,
            ], 1)
    return out


@dataclass
class AdditiveModel:
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    """(feature, feature, table over coarse bins): a coarse bin is a bin number // stride."""
    stride: int = 6

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.bias)
        for j, t in enumerate(self.tables):
            total += t[b[j]]
        for j, k, t in self.pairs:
            total += t[b[j] // self.stride, b[k] // self.stride]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _gain(g, h, ridge):
    return g * g / (h + ridge)


def _step(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """The Newton step of a tree over ordered bins with gradients g and hessians h: a value a bin."""
    out = np.zeros(len(g))

    def grow(a, b, d):
        gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        if d and b - a > 1:
            gain = _gain(gs[:-1], hs[:-1], ridge) + _gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1], ridge)
            cut = int(gain.argmax())
            if gain[cut] > _gain(gs[-1], hs[-1], ridge) + 1e-9:
                grow(a, a + cut + 1, d - 1)
                grow(a + cut + 1, b, d - 1)
                return
        out[a:b] = -gs[-1] / (hs[-1] + ridge)

    grow(0, len(g), depth)
    return out


def _step2(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A tree over a grid of two features' bins: a cut on one axis, then one on the other in each half. With its gain."""
    best, best_gain = None, -1.0
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(gg)):
            out, gain = np.zeros(gg.shape), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                gs, hs = gg[part].sum(0), hh[part].sum(0)
                values = _step(gs, hs, ridge, 1)
                out[part] = values
                gain -= float((values * gs + 0.5 * values * values * (hs + 0 * gs)).sum())
            if gain > best_gain:
                best, best_gain = (out.T if flip else out), gain
    return (np.zeros(g.shape) if best is None else best), best_gain


def learn(x: np.ndarray, y: np.ndarray, *, rounds: int = 120, rate: float = 0.1, n_pairs: int = 6, pair_rounds: int = 40, ridge: float = 4.0) -> AdditiveModel:
    model = AdditiveModel()
    if not len(x):
        return model
    p0 = (y.sum() + 1) / (len(y) + 2)
    model.bias = float(np.log(p0 / (1 - p0)))
    for j in range(x.shape[1]):
        model.edges.append(np.unique(np.quantile(x[:, j], np.linspace(0, 1, MAX_BINS + 1)[1:-1], method="higher")))
        model.tables.append(np.zeros(len(model.edges[-1]) + 1))
    b = model.bins(x)
    total = np.full(len(x), model.bias)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            g, h = slopes()
            step = rate * _step(np.bincount(b[j], g, len(t)), np.bincount(b[j], h, len(t)), ridge)
            t += step
            total += step[b[j]]
    coarse = [v // model.stride for v in b]
    sizes = [(len(t) - 1) // model.stride + 1 for t in model.tables]

    def grid(j, k, v):
        return np.bincount(coarse[j] * sizes[k] + coarse[k], v, sizes[j] * sizes[k]).reshape(sizes[j], sizes[k])

    g, h = slopes()
    gains = sorted(((_step2(grid(j, k, g), grid(j, k, h), ridge)[1], j, k) for j in range(x.shape[1]) for k in range(j)), reverse=True)
    model.pairs = [(j, k, np.zeros((sizes[j], sizes[k]))) for gain, j, k in gains[:n_pairs] if gain > 0]
    for _ in range(pair_rounds):
        for j, k, t in model.pairs:
            g, h = slopes()
            step = rate * _step2(grid(j, k, g), grid(j, k, h), ridge)[0]
            t += step
            total += step[coarse[j], coarse[k]]
    return model


def labelled(labels: DataFrame, target: str, *, rows: int) -> DataFrame | None:
    """doc_id and mean label of a uniform sample (by hash) of at most `rows` labelled ids outside the held-out fold; None when there are none."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (common.fold("doc_id", 5) != 0))
    ids = usable.groupBy("doc_id").agg(F.avg(F.col(target).cast("double")).alias("__tw_label"))
    bound = common.hash_sample_bound(ids, "doc_id", rows)
    return None if bound is None else ids.filter(F.xxhash64("doc_id") <= bound)


def _featured(docs: DataFrame, extra: list[str]) -> DataFrame:
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            d = dict(zip(batch.schema.names, batch.columns, strict=True))
            x = pa.array(features(d["text"]).ravel())
            yield pa.RecordBatch.from_arrays([*(d[c] for c in extra), pa.FixedSizeListArray.from_arrays(x, len(FEATURES)).cast(pa.list_(pa.float64()))], [*extra, "x"])

    kinds = dict(docs.dtypes)
    return docs.select(*extra, "text").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in extra), "x array<double>"]))


def train(docs: DataFrame, labels: DataFrame, *, target: str = "quality", rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Learn from the features of at most `rows` labelled documents, drawn by hash of doc_id outside the held-out fold."""
    sample = labelled(labels, target, rows=rows)
    if sample is None:
        return AdditiveModel()
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most `rows` pairs of numbers
    chosen = common.one_text_a_document(chosen, "__tw_label")
    got = sorted((r["__tw_label"] >= 0.5, r["x"]) for r in _featured(chosen, ["__tw_label"]).collect())
    return learn(np.array([v for _, v in got]), np.array([y for y, _ in got], float)) if got else AdditiveModel()


def score_quality(docs: DataFrame, model: AdditiveModel, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def run(batches):
        for batch in batches:
            d = dict(zip(batch.schema.names, batch.columns, strict=True))
            s = shared.value.score(features(d["text"]))
            yield pa.RecordBatch.from_arrays([d["doc_id"], d["held_out"], pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def stage(spark, docs: DataFrame, sf_dir: str, *, threshold: float = THRESHOLD) -> DataFrame:
    """Keep the rows that score at least the threshold; columns stay. Null and empty texts are scored like others; an empty table stays empty."""
    common.ship(spark)
    model = train(docs, common.table(spark, sf_dir, "labels"))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(texts):
        return type(texts)(shared.value.score(features(pa.array(texts, pa.string(), from_pandas=True))))

    return docs.filter(quality("text") >= threshold)


def op1_quality_gam(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, train(docs, common.table(spark, sf_dir, "labels")))
