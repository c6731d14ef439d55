"""Alignment of two tokenizers' tokens by bytes, with corpus-wide counts of linked ids.

Every text is encoded by vocabulary A (space + text) and B (which adds the space itself). An A and a B token whose bytes overlap are linked; byte offsets where
tokens of both end cut them into groups. Each elementary stretch between neighbouring ends of either side is one link.

Texts are cut into units before a space or line feed that follows a character that isn't white space. No pre-token of A crosses such a place, and no piece of B
does, since on the driver it is proved that no piece has its space sign after another character or a line feed beside one; otherwise a text
is one unit. A unit is encoded by the libraries and aligned once for as long as it stays in a bounded cache, so that a common word costs one lookup; when the cache is full,
the units that most documents had stay in it. ASCII units of A go to a faster library with the same ranks, where it is proved on the driver that both merge alike. Since A cuts wherever
units are cut, it is given many new units as one text.

Documents are read once and written as chunks: a row of figures each, and for every stripe of B's ids (id modulo the number of stripes, so that the low, frequent ids lie in
different ones) one blob of the chunk's id pairs, their links, and which documents hold them how often. A task adds the pairs of a stripe with np.add.at to one dense
matrix of B ids by A ids, whose row maxima give each B id's best. Links are scored where they lie, by stripe: a document's number of best
links and its sum of counts come back as one blob for each chunk and stripe, and chunks add them up. A frequent pair is one entry a document, and beyond SALT bytes of
text a stripe's chunks are dealt to several tasks, whose matrices are added before scoring.

Defined cases: null and empty texts, and texts whose tokens don't give their bytes back (those with U+2581), have no tokens: zeros and an empty digest. Rows count each, whatever
their doc_id; special strings are plain text; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import json
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import common
from tracewright.llm.token_count import PATTERN, byte_characters

#: Bytes of text in a chunk (at most 65,535 documents), of a stripe's matrix, and of text for each task of a stripe.
CHUNK, MATRIX, SALT = 2 << 20, 64 << 20, 16 << 30
#: Units kept by a worker between chunks, and their links; beyond either, all but the most used ones go, which are at most half of both.
CACHE_UNITS, CACHE_LINKS = 100_000, 1_500_000
#: Texts that a task is given at once.
ROWS = 512
#: New units that are encoded and aligned together.
LEARN = 8_192
SPACE_SIGN = "▁"
UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
_NO_TOKENS = -1


class Aligner:
    """Both libraries and the cache of aligned units. A unit is known by its number; `n_a` of one whose tokens don't give its bytes is -1."""

    def __init__(self, a_json: str, b_model: bytes):
        self.a, self.b = Tokenizer.from_str(a_json), sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a.encode_special_tokens = True  # their strings in a text are then plain text
        self.sizes = self.a.get_vocab_size(with_added_tokens=True), self.b.vocab_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.sizes[1])]
        back = {sign: byte for byte, sign in byte_characters().items()}
        self.a_bytes = [bytes([back[x] for x in t]) if all(x in back for x in t) else b"" for t in (self.a.id_to_token(i) or "" for i in range(self.sizes[0]))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in known], np.int64) for known in (self.a_bytes, self.b_bytes))
        self.texts = [f"{i}{sign}" for i in range(max(self.sizes)) for sign in ",|;\n"]
        self.cuts = not any(SPACE_SIGN in p.lstrip(SPACE_SIGN) or "\n" in p and p != "\n" for p in pieces)
        self.ranked = self._ranked(json.loads(a_json))
        self.forget()

    def _ranked(self, told: dict) -> tiktoken.Encoding | None:
        """A faster library for A's ASCII units, if it surely gives the same: it merges neighbours by the rank of what they make, A by the rank of the pair. Where every
        token is the only result of encoding its own string, and ids follow the merges, a token's last merge is the only way to it, and both are one."""
        kind, model = told.get("pre_tokenizer") or {}, told["model"]
        plain = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True) and told.get("normalizer") is None and told.get("post_processor") is None
        if not plain or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            return None
        vocab = model["vocab"]
        added = {t["content"] for t in told["added_tokens"]}
        tokens = [t for t in vocab if t not in added]
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [vocab.get(m, -1) for m in made]
        single = {t for t in tokens if len(t) == 1}
        if len(single) != 256 or set(made) | single != set(tokens) or any(x >= y for x, y in zip(ids, ids[1:], strict=False)) or max(map(vocab.get, single)) >= min(ids, default=1 << 31):
            return None
        if any(len(got) != 1 or got[0].value != t for t in tokens for got in [self.a.model.tokenize(t)]):
            return None
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={self.a_bytes[vocab[t]]: vocab[t] for t in tokens}, special_tokens={})

    def forget(self) -> None:
        self.units, self.groups = {}, []
        self.n_a, self.n_b, self.n_groups, self.ends, self.pairs = array("q"), array("q"), array("q"), array("q", [0]), array("q")
        self.uses = np.zeros(0, np.int64)

    def used(self, units: np.ndarray) -> None:
        """Count a use of each of these units."""
        uses = np.bincount(units, minlength=len(self.groups))
        uses[: len(self.uses)] += self.uses
        self.uses = uses

    def thin(self) -> None:
        """Forget all units but the most used, and half of their uses."""
        uses, ends = np.zeros(len(self.groups), np.int64), np.array(self.ends)
        uses[: len(self.uses)] = self.uses
        links = np.diff(ends)
        most = np.argsort(-uses, kind="stable")[: CACHE_UNITS // 2]
        most = most[uses[most] > 1]
        kept = np.sort(most[np.cumsum(links[most]) <= CACHE_LINKS // 2])
        number = np.full(len(uses), -1)
        number[kept] = np.arange(len(kept))
        units = {u: k for u, k in zip(self.units, number[list(self.units.values())].tolist(), strict=True) if k >= 0}
        groups = [self.groups[k] for k in kept.tolist()]
        columns = [np.array(x)[kept] for x in (self.n_a, self.n_b, self.n_groups)]
        pairs = np.array(self.pairs)[_runs(ends[kept], links[kept])]
        self.forget()
        self.units, self.groups, self.uses = units, groups, uses[kept] // 2
        for held, values in zip((self.n_a, self.n_b, self.n_groups, self.ends, self.pairs), (*columns, np.cumsum(links[kept]), pairs), strict=True):
            held.frombytes(values.tobytes())

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """The units of space + text, of each text; an empty one has none."""
        cut = [(UNIT.findall(" " + t) if self.cuts else [" " + t]) if t else [] for t in texts]
        new = list(set(chain.from_iterable(cut)).difference(self.units))
        for at in range(0, len(new), LEARN):
            self.learn(new[at : at + LEARN])
        number = self.units.__getitem__
        return [list(map(number, us)) for us in cut]

    def learn(self, units: list[str]) -> None:
        """Encode and align new units."""
        plain, other, alone = [], [], []
        for u in units:
            ascii = self.ranked and u.isascii()
            (alone if not self.cuts or u[-1].isspace() else plain if ascii else other).append(u)
        units = plain + other + alone
        if not units:
            return
        size = np.array([len(u) if u.isascii() else len(u.encode()) for u in units], np.int64)
        slow = lambda texts: [got.ids for got in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        fast = (lambda texts: list(map(self.ranked.encode_ordinary, texts))) if self.ranked else slow
        at = len(plain) + len(other)
        parts = [self._together(plain, size[: len(plain)], fast), self._together(other, size[len(plain) : at], slow), _flat([(fast if u.isascii() else slow)([u])[0] for u in alone])]
        n_a, a = (np.concatenate(x) for x in zip(*parts, strict=True))
        # B adds a space to what it is given: behind a line feed a unit stands as within a text.
        n_b, b = _flat(self.b.encode(["\n" + u if self.cuts else u[1:] for u in units], num_threads=1))
        if self.cuts:
            b = b[_runs(np.zeros(len(n_b), np.int64), n_b) > 1]
            n_b = np.maximum(n_b - 2, 0)
        self._add(units, size, n_a, a, n_b, b)

    def _together(self, units: list[str], size: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """How many of A's tokens each unit has, and all of them: of the units as one text, if tokens end where units end, else of each unit."""
        if not units:
            return _flat([])
        a = np.array(encode(["".join(units)])[0], np.int64)
        end, wanted = np.cumsum(self.a_size[a]), np.cumsum(size)
        last = np.searchsorted(end, wanted, "right")
        if last[0] and np.array_equal(end[last - 1], wanted):
            return np.diff(last, prepend=0), a
        return _flat(encode(units))

    def _add(self, units: list[str], size: np.ndarray, n_a: np.ndarray, a: np.ndarray, n_b: np.ndarray, b: np.ndarray) -> None:
        """Align all new units at once: their bytes stand one after another, and both sides' tokens end together where a unit ends."""
        fit = (_summed(self.a_size[a], n_a) == size) & (_summed(self.b_size[b], n_b) == size)
        if not (fit.all() and self._gives(units, a, b)):
            a_runs, b_runs = (np.split(ids, np.cumsum(n)[:-1]) for ids, n in ((a, n_a), (b, n_b)))
            fit = np.array([ok and self._gives([u], x, y) for ok, u, x, y in zip(fit, units, a_runs, b_runs, strict=True)])
            a, b = a[np.repeat(fit, n_a)], b[np.repeat(fit, n_b)]
        good = np.flatnonzero(fit)
        good = np.flatnonzero(fit)
        a_end, b_end, end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), np.cumsum(size[good])
        links, cuts = np.union1d(a_end, b_end), np.intersect1d(a_end, b_end, assume_unique=True)
        # One pair for each stretch between neighbouring ends; tokens by group and side, each with the sign that follows it.
        pairs = b[np.searchsorted(b_end, links)] * self.sizes[0] + a[np.searchsorted(a_end, links)]
        side = np.concatenate([2 * np.searchsorted(cuts, a_end), 2 * np.searchsorted(cuts, b_end) + 1])
        order = np.argsort(side, kind="stable")
        side = side[order]
        follows = np.zeros(len(side), np.int64)
        last = np.flatnonzero(np.append(side[1:] != side[:-1], True)) if len(side) else side
        follows[last] = 1 + side[last] % 2
        follows[last[1::2][np.searchsorted(cuts, end)]] = 3
        told = "".join(map(self.texts.__getitem__, (4 * np.concatenate([a, b])[order] + follows).tolist())).split("\n")
        counts = np.full((4, len(units)), [[_NO_TOKENS], [0], [0], [0]], np.int64)
        for row, ends in zip(counts, (a_end, b_end, cuts, links), strict=True):
            row[good] = np.diff(np.searchsorted(ends, end, "right"), prepend=0)
        groups = told[:-1]  # the last one is what follows the last unit
        if len(good) < len(units):
            groups = [""] * len(units)
            for i, text in zip(good.tolist(), told, strict=False):
                groups[i] = text
        self.units.update(zip(units, range(len(self.groups), len(self.groups) + len(units)), strict=True))
        self.groups += groups
        for kept, row in zip((self.n_a, self.n_b, self.n_groups), counts, strict=False):
            kept.frombytes(row.tobytes())
        self.ends.frombytes((self.ends[-1] + np.cumsum(counts[3])).tobytes())
        self.pairs.frombytes(pairs.astype(np.int64).tobytes())

    def _gives(self, units: list[str], a: np.ndarray, b: np.ndarray) -> bool:
        """Whether both sides' tokens, joined, are the units' bytes."""
        data = "".join(units).encode()
        return all(b"".join(map(known.__getitem__, ids.tolist())) == data for ids, known in ((a, self.a_bytes), (b, self.b_bytes)))


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each list has, and all of them."""
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return n, np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n numbers from each first one on."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _summed(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the values over runs of n of them."""
    sums, ends = np.concatenate([[0], np.cumsum(values)]), np.cumsum(n)
    return sums[ends] - sums[ends - n]


class Stripes:
    """How B's ids are dealt to stripes, and where a pair of ids stands."""

    def __init__(self, n_a: int, n_b: int, matrix: int = MATRIX):
        self.n_a = n_a
        self.count = max(1, -(-n_b * n_a * 8 // matrix))
        self.rows = -(-n_b // self.count)

    def place(self, pair: np.ndarray) -> np.ndarray:
        """Pairs (b * n_a + a) renumbered so that a stripe's are together: stripe, row in it, a."""
        b, a = np.divmod(pair, self.n_a)
        return ((b % self.count) * self.rows + b // self.count) * self.n_a + a

    def cells(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stripe, and cell of its matrix."""
        return np.divmod(place, self.rows * self.n_a)

    def ids(self, stripe: int, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, a = np.divmod(cell, self.n_a)
        return row * self.count + stripe, a


_aligners: dict[int, Aligner] = {}


def trim() -> None:
    """Give freed memory back to the system, where that can be asked for."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free:
        free(0)


def release() -> None:
    """Drop the libraries of an earlier task of this worker, before a matrix is made."""
    _aligners.clear()
    gc.collect()
    trim()


FIGURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def encoded(docs: DataFrame, a_path: str, b_path: str, *, chunk: int = CHUNK, matrix: int = MATRIX) -> tuple[DataFrame, Stripes]:
    """The written chunks: rows with a document's figures and its place (stripe is null), and rows with a stripe's pairs of the chunk: cells, links of each, how many
    entries (document, times up to 255) each has, and the entries."""
    spark = docs.sparkSession
    common.ship(spark)
    with open(a_path, encoding="utf-8") as f:
        a_json = f.read()
    with open(b_path, "rb") as f:
        b_model = f.read()
    known = Aligner(a_json, b_model)
    stripes = Stripes(*known.sizes, matrix)
    shared = spark.sparkContext.broadcast((hash((a_json, b_model)), a_json, b_model))  # the size of two vocabularies
    kind = dict(docs.dtypes)["doc_id"]
    form = f"chunk long, doc_id {kind}, place int, {FIGURES}, stripe int, cells binary, links binary, spread binary, docs binary, times binary"
    names = [c.split()[0] for c in form.split(", ")]

    def run(batches):
        name, a, b = shared.value
        aligner = _aligners.get(name) or _aligners.setdefault(name, Aligner(a, b))
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for low in range(0, whole.num_rows, 65_535):
                batch = whole.slice(low, 65_535)
                for first, _, offsets in common.text_chunks(batch.column("text"), chunk):
                    part = batch.slice(first, len(offsets) - 1)
                    figures, blobs = _chunk(aligner, stripes, part.column("text").to_pylist())
                    n, m = part.num_rows, len(blobs["stripe"])
                    rows = {"chunk": np.full(n, number), "doc_id": part.column("doc_id"), "place": pa.array(np.arange(n), pa.int32())} | figures
                    yield _batch(names, form, rows, n, part.column("doc_id").type)
                    if m:
                        yield _batch(names, form, {"chunk": np.full(m, number)} | blobs, m, part.column("doc_id").type)
                    number += 1
                    if len(aligner.groups) > CACHE_UNITS or len(aligner.pairs) > CACHE_LINKS:
                        aligner.thin()
                        trim()
        aligner.forget()  # the worker's next task may need the memory for a matrix
        trim()

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with common.arrow_rows(spark, ROWS):
        return common.materialize(rows.mapInArrow(run, form), "token-chunks"), stripes


def _batch(names: list[str], form: str, held: dict, n: int, key: pa.DataType) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    of = {c.split()[0]: kinds.get(c.split()[1]) for c in form.split(", ")} | {"doc_id": key}
    return pa.RecordBatch.from_arrays([held[c] if isinstance(held.get(c), pa.Array) else pa.array(held[c], of[c]) if c in held else pa.nulls(n, of[c]) for c in names], names)


def _chunk(aligner: Aligner, stripes: Stripes, texts: list[str]) -> tuple[dict, dict]:
    """Figures of each text, and the blobs of each stripe that has links."""
    numbers = aligner.numbers(texts)
    size = np.array([len(u) for u in numbers], np.int64)
    unit = np.fromiter(chain.from_iterable(numbers), np.int64, int(size.sum()))
    doc = np.repeat(np.arange(len(texts)), size)
    n_a, n_b, n_groups, ends = (np.array(x) for x in (aligner.n_a, aligner.n_b, aligner.n_groups, aligner.ends))
    able = np.ones(len(texts), bool)
    able[doc[n_a[unit] == _NO_TOKENS]] = False
    able &= size > 0
    unit, doc = unit[able[doc]], doc[able[doc]]
    n_links = np.diff(ends)
    # Sums of whole numbers far below 2**53: bincount's doubles hold them.
    summed = lambda x: pa.array(np.bincount(doc, x[unit], len(texts)).astype(np.int64))
    figures = {"n_a": summed(n_a), "n_b": summed(n_b), "n_groups": summed(n_groups), "n_links": summed(n_links)}
    groups = aligner.groups
    figures["groups_sha256"] = [hashlib.sha256(";".join([groups[u] for u in us]).encode()).hexdigest() if ok else "" for us, ok in zip(numbers, able, strict=True)]
    # Units of a document once each, then their links.
    if not len(unit):
        return figures, {"stripe": []}
    held, times = np.unique(doc * len(groups) + unit, return_counts=True)
    doc, unit = np.divmod(held, len(groups))
    aligner.used(unit)
    each = n_links[unit]
    place = stripes.place(np.array(aligner.pairs)[_runs(ends[unit], each)])
    doc, times = np.repeat(doc, each), np.repeat(times, each)
    order = np.lexsort((doc, place))
    place, doc, times = place[order], doc[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    place, doc, times = place[new], doc[new], np.add.reduceat(times, new)
    pieces = -(-times // 255)  # an entry holds up to 255 times
    last = np.cumsum(pieces) - 1
    place, doc, rest = np.repeat(place, pieces), np.repeat(doc, pieces), times - 255 * (pieces - 1)
    times = np.full(len(place), 255)
    times[last] = rest
    pair = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    links, spread = np.add.reduceat(times, pair), np.diff(np.append(pair, len(place)))
    stripe, cell = stripes.cells(place[pair])
    cut = np.flatnonzero(np.concatenate([[True], stripe[1:] != stripe[:-1]]))
    bounds = list(zip(cut, np.append(cut[1:], len(pair)), strict=True))
    entries = np.append(pair, len(place))
    blob = lambda x, kind: [x[p:q].astype(kind).tobytes() for p, q in bounds]
    inner = lambda x, kind: [x[entries[p] : entries[q]].astype(kind).tobytes() for p, q in bounds]
    return figures, {"stripe": stripe[cut].astype(np.int32), "cells": blob(cell, np.uint32), "links": blob(links, np.int64), "spread": blob(spread, np.uint32), "docs": inner(doc, np.uint16), "times": inner(times, np.uint8)}


COUNTS = "stripe int, cells binary, links binary"


def _counted(blobs: DataFrame, stripes: Stripes, *keys: str) -> DataFrame:
    """The blobs of each key added up in one dense matrix; cells that have links."""

    def done(at, matrix):
        cells = np.flatnonzero(matrix)
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([cells.astype(np.uint32).tobytes()], pa.binary()), pa.array([matrix[cells].tobytes()], pa.binary())], ["stripe", "cells", "links"])

    def run(batches):
        release()
        at, matrix = None, np.zeros(stripes.rows * stripes.n_a, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(k)[i].as_py() for k in keys)
                if key != at:
                    if at is not None:
                        yield done(at, matrix)
                        matrix[:] = 0
                    at = key
                np.add.at(matrix, np.frombuffer(batch.column("cells")[i].as_py(), np.uint32), np.frombuffer(batch.column("links")[i].as_py(), np.int64))
        if at is not None:
            yield done(at, matrix)

    return blobs.select(*keys, "cells", "links").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, COUNTS)


def _salted(chunks: DataFrame, salts: int) -> DataFrame:
    return chunks.filter("stripe is not null").withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int"))


def pair_counts(chunks: DataFrame, stripes: Stripes, salts: int = 1) -> DataFrame:
    """How many links of the whole table hold each pair of ids: a written row for each stripe."""
    parts = _counted(_salted(chunks, salts), stripes, "stripe", "salt")
    return common.materialize(_counted(parts, stripes, "stripe") if salts > 1 else parts, "pair-counts")


def best_pairs(counts: DataFrame, stripes: Stripes) -> DataFrame:
    """b_id, a_id, n_links, best (whether no other A id has more links with the B id) of every pair that is linked."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                stripe, matrix = batch.column("stripe")[i].as_py(), _fill(np.zeros(stripes.rows * stripes.n_a, np.int64), batch, i)
                cells = np.flatnonzero(matrix)
                b, a = stripes.ids(stripe, cells)
                best = matrix[cells] == matrix.reshape(stripes.rows, -1).max(1)[cells // stripes.n_a]
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(a), pa.array(matrix[cells]), pa.array(best)], ["b_id", "a_id", "n_links", "best"])

    return counts.mapInArrow(run, "b_id long, a_id long, n_links long, best boolean")


def _fill(matrix: np.ndarray, batch: pa.RecordBatch, i: int) -> np.ndarray:
    matrix[:] = 0
    matrix[np.frombuffer(batch.column("cells")[i].as_py(), np.uint32)] = np.frombuffer(batch.column("links")[i].as_py(), np.int64)
    return matrix


def scored(chunks: DataFrame, counts: DataFrame, stripes: Stripes, salts: int = 1) -> DataFrame:
    """doc_id, the figures, n_best and count_sum of every document."""

    def score(batches):
        release()
        at, matrix, best = None, np.zeros(stripes.rows * stripes.n_a, np.int64), None
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("stripe")[i].as_py(), batch.column("salt")[i].as_py()
                chunk = batch.column("chunk")[i].as_py()
                if chunk is None:
                    at = key
                    best = _fill(matrix, batch, i).reshape(stripes.rows, -1).max(1)
                    continue
                if key != at:
                    raise RuntimeError(f"counts of stripe {key[0]} are missing")
                get = lambda c, kind, batch=batch, i=i: np.frombuffer(batch.column(c)[i].as_py(), kind)
                cells, spread = get("cells", np.uint32).astype(np.int64), get("spread", np.uint32)
                docs, times = get("docs", np.uint16), get("times", np.uint8).astype(np.int64)
                each = np.repeat(matrix[cells], spread) * times
                top = np.repeat(matrix[cells] == best[cells // stripes.n_a], spread) * times
                order = np.argsort(docs, kind="stable")
                ordered = docs[order]
                first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                blobs = ordered[first].tobytes(), np.add.reduceat(top[order], first).astype(np.uint32).tobytes(), np.add.reduceat(each[order], first).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), *(pa.array([b], pa.binary()) for b in blobs)], ["chunk", "docs", "tops", "sums"])

    links = _salted(chunks, salts).select("stripe", "salt", "chunk", "cells", "spread", "docs", "times")
    known = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = known.unionByName(links, allowMissingColumns=True).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.col("chunk").asc_nulls_first())
    partial = met.mapInArrow(score, "chunk long, docs binary, tops binary, sums binary")
    kind = dict(chunks.dtypes)["doc_id"]

    def add(batches):
        at, tops, sums = None, None, None
        for batch in batches:
            numbers = batch.column("chunk").to_numpy()
            answers = batch.column("docs").is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], (numbers[1:] != numbers[:-1]) | (answers[1:] != answers[:-1])]))
            for a, b in zip(edges, np.append(edges[1:], len(numbers)), strict=True):
                if numbers[a] != at:
                    at, tops, sums = numbers[a], np.zeros(65_536, np.int64), np.zeros(65_536, np.int64)
                if answers[a]:
                    for i in range(a, b):
                        docs, top, each = (np.frombuffer(batch.column(c)[i].as_py(), k) for c, k in (("docs", np.uint16), ("tops", np.uint32), ("sums", np.int64)))
                        tops[docs] += top  # each document once a blob
                        sums[docs] += each
                    continue
                part = batch.slice(a, b - a)
                place = part.column("place").to_numpy()
                figures = [part.column(c.split()[0]) for c in FIGURES.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *figures, pa.array(tops[place]), pa.array(sums[place])], ["doc_id", *[c.split()[0] for c in FIGURES.split(", ")], "n_best", "count_sum"])

    rows = chunks.filter("stripe is null").select("chunk", "doc_id", "place", *[c.split()[0] for c in FIGURES.split(", ")])
    whole = rows.unionByName(partial, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", F.col("docs").isNull())
    return whole.mapInArrow(add, f"doc_id {kind}, {FIGURES}, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, *, salts: int | None = None, chunk: int = CHUNK, matrix: int = MATRIX) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row, by the vocabulary files (read on the driver only)."""
    chunks, stripes = encoded(docs, a_path, b_path, chunk=chunk, matrix=matrix)
    if salts is None:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        salts = max(1, -(-size // SALT))
    counts = pair_counts(chunks, stripes, salts)
    return scored(chunks, counts, stripes, salts)


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return align_tokenizers(common.table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
