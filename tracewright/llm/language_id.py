"""Language ID: multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character 1- to 3-grams of the lower-cased text: count / length x idf. The sparse weights are
learned by follow-the-regularised-leader with an L1 and an L2 penalty, and the softmax is calibrated by a
temperature fitted on rows kept out of the learning. A feature is linear in the positions of a text, so whole
texts are scored by gathering idf x weight for each position and summing, without per-document dictionaries; a long text is
summed in steps, so that memory doesn't grow with it. Learning reads whole texts, too: n-grams are counted where the sampled texts are, and the driver gets a text's
features and their counts, at most NONE of them, instead of the text.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is every text when no row could be
learned from. Repeated rows are answered each; of several rows with one id one is learned from. Extra columns are ignored. Of equal scores the first language by
name wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common

BITS, ORDERS = 15, 3
WIDTH = 1 << BITS
NONE = ORDERS * WIDTH
#: Learning reads a bounded, uniform sample of so many labelled rows.
SAMPLE_ROWS = 3000
SCALE = 30.0
#: Characters that are scored in one vectorised step.
STEP = 400_000
_SALT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def lowered(text: str) -> str:
    return text.replace("\0", " ").lower()


def grams(text: str) -> list[np.ndarray]:
    """For each order, the feature of the n-gram that begins at each character of a lowered text; NONE where it would meet NUL or the end."""
    chars = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out, hashed, bad = [], np.zeros(len(chars), np.uint32), np.zeros(len(chars), bool)
    for order in range(ORDERS):
        ahead = np.zeros(len(chars), np.uint32)
        ahead[: max(0, len(chars) - order)] = chars[order:]
        bad |= ahead == 0
        hashed = (hashed ^ (ahead * _SALT[order])) * np.uint32(0x01000193)
        code = ((hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
        out.append(np.where(bad, NONE, code.astype(np.int64) + order * WIDTH))
    return out


def counted(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """A text's features, ascending, how often each occurs, and the number of its characters; in steps, whatever its length."""
    low = lowered(text)
    total = np.zeros(NONE + 1, np.int64)
    for at in range(0, len(low), STEP):
        n = min(STEP, len(low) - at)
        for codes in grams(low[at : at + STEP + ORDERS - 1]):
            total += np.bincount(codes[:n], minlength=NONE + 1)
    ids = np.flatnonzero(total[:NONE])
    return ids, total[ids], len(low)


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # (NONE + 1) x langs: idf x weight
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)))
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) < STEP):
                size += len(texts[last]) + 1
                last += 1
            low = [lowered(t) for t in texts[first:last]]
            lengths = np.array([len(t) + 1 for t in low])
            starts, joined = np.cumsum(lengths) - lengths, "\0".join(low) + "\0"
            for at in range(0, len(joined), STEP):
                piece = joined[at : at + STEP + ORDERS - 1]
                n = min(STEP, len(joined) - at)
                rows = slice(int(np.searchsorted(starts, at, "right")) - 1, int(np.searchsorted(starts, at + n)))
                cuts = np.maximum(starts[rows] - at, 0)
                for codes in grams(piece):
                    out[first + rows.start : first + rows.stop] += np.add.reduceat(self.table[codes[:n]], cuts, axis=0, dtype=np.float64)
            out[first:last] *= (SCALE / np.maximum(lengths - 1, 1))[:, None]
            first = last
        return out / self.temperature

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(texts))
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def learn(texts: list[str], langs: list[str], **options) -> LanguageModel:
    """fit() for texts at hand."""
    return fit([counted(t) for t in texts], langs, **options)


def fit(texts: list[tuple[np.ndarray, np.ndarray, int]], langs: list[str], *, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 7) -> LanguageModel:
    """The model for texts as counted() gives them."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((NONE + 1, 0), np.float32), 1.0)
    rows = [(ids, counts * (SCALE / max(1, n))) for ids, counts, n in texts]
    target = np.array([names.index(x) for x in langs])
    df = np.zeros(NONE + 1)
    for ids, _ in rows:
        df[ids] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    order = np.random.default_rng(seed).permutation(len(rows))
    held = order[: len(order) // 5]
    used = order[len(order) // 5 :] if len(names) > 1 else order
    z, n = np.zeros((NONE + 1, len(names))), np.zeros((NONE + 1, len(names)))

    def weights(ids):
        return -np.sign(z[ids]) * np.maximum(np.abs(z[ids]) - l1, 0) / ((beta + np.sqrt(n[ids])) / alpha + l2)

    rng = np.random.default_rng(seed + 1)
    for _ in range(epochs):
        for i in rng.permutation(used):
            ids, x = rows[i][0], rows[i][1] * idf[rows[i][0]]
            w = weights(ids)
            error = softmax((x @ w)[None])[0]
            error[target[i]] -= 1
            g = x[:, None] * error
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha * w
            n[ids] += g * g
    table = (weights(np.arange(NONE + 1)) * idf[:, None]).astype(np.float32)
    table[NONE] = 0
    model = LanguageModel(names, table, 1.0)
    if len(names) > 1 and len(held):
        logits = np.stack([rows[i][1] @ table[rows[i][0]].astype(np.float64) for i in held])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        soft = np.full(logits.shape, 1 / (len(held) + 2) / (len(names) - 1))  # smoothed targets: separable rows don't drive the temperature to 0
        soft[np.arange(len(held)), target[held]] = 1 - 1 / (len(held) + 2)
        loss = [-(soft * np.log(softmax(logits / t) + 1e-300)).sum(1).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train(docs: DataFrame, *, folds: int = 4, held: int = 2, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn from a uniform sample (by hash of doc_id) of at most `rows` labelled rows outside the held-out fold: whole texts, counted in the tasks."""
    common.ship(docs.sparkSession)
    usable = docs.filter(F.col("lang").isNotNull() & (common.fold("doc_id", folds) != held))
    bound = common.hash_sample_bound(usable, "doc_id", rows)
    if bound is None:
        return learn([], [])
    sample = usable.filter((F.xxhash64("doc_id") <= bound) & F.col("text").rlike("\\p{L}")).select("doc_id", "lang", "text")

    def run(batches):
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):  # one long text at a time
                ids, counts, n = counted(text.as_py())
                one = lambda value, kind: pa.array([value], kind)
                yield pa.RecordBatch.from_arrays([one(lang.as_py(), pa.string()), one(n, pa.int64()), one(ids.astype(np.int32).tobytes(), pa.binary()), one(counts.astype(np.uint32).tobytes(), pa.binary())], ["lang", "chars", "ids", "counts"])

    whole = common.one_text_a_document(sample, "lang").select("text", "lang").mapInArrow(run, "lang string, chars long, ids binary, counts binary")
    got = sorted((bytes(r["ids"]), bytes(r["counts"]), r["chars"], r["lang"]) for r in whole.collect())  # at most `rows` texts' features
    return fit([(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(c, np.uint32).astype(np.float64), n) for i, c, n, _ in got], [x for *_, x in got])


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)  # NONE + 1 rows: its size is fixed by BITS and the number of languages

    def score(batches):
        m = shared.value
        for batch in batches:
            d = dict(zip(batch.schema.names, batch.columns, strict=True))
            letters = np.array(d["letter"].to_pylist(), bool)
            lang, p = np.full(len(letters), "und", object), np.zeros(len(letters))
            texts = d["text"].filter(pa.array(letters)).to_pylist()
            if texts and m.langs:
                best, conf = m.predict(texts)
                lang[letters], p[letters] = np.array(m.langs, object)[best], conf
            yield pa.RecordBatch.from_arrays([d["doc_id"], d["held_out"], pa.array(lang, pa.string()), pa.array(p)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), "text", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letter"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def stage(spark, docs: DataFrame, sf_dir: str, *, least: float = 0.5) -> DataFrame:
    """Keep the rows whose text has a language recognised with a score of at least `least`; columns stay. Null texts and texts without a letter go; an empty table stays empty."""
    common.ship(spark)
    model = train(docs)
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns

    @F.pandas_udf("double")
    def confidence(texts):
        out = np.zeros(len(texts))
        if shared.value.langs and len(texts):
            out = shared.value.predict(list(texts.fillna("")))[1]
        return type(texts)(out)

    return docs.filter(F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))).filter(confidence("text") >= least).select(*[F.col(f"`{c}`") for c in names])


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict_languages(docs, train(docs))
