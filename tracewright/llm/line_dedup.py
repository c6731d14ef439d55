"""Lines that many documents share, removed by probes into a sharded minimal perfect hash.

A line's key is the line without white space at both ends, A-Z lower-cased. Documents are read once and written as chunks of a few MiB; a chunk
also writes its distinct keys' 64-bit hashes, cut by shard (a range of hashes) into one blob for each, with the number of its documents that hold each key.
A shard adds up the blobs of all chunks and becomes a row of the index: a minimal perfect hash over its distinct hashes (cascaded bit
tables, a key's place is the rank of its bit), 16-bit fingerprints and counts of one byte, larger ones in a short list aside. The same blobs
then probe the shard's arrays, and a chunk gets back the hashes that are too frequent. Last, chunks meet their answers and drop lines.

No line is ever a row: what is dealt out is blobs, at most one for each chunk and shard, never more of them than distinct lines of chunks. A very
frequent line is one number a chunk. A task holds one chunk or one shard. Every probed key is in the index, so its count is exact;
fingerprints matter to other probes (`probe` gives 0 for them but for one in 65,536).

Two keys of the same 64-bit hash would be taken as one (about 2^-64 a pair).

Defined cases: null and empty texts are one empty line. A row is a document: rows that repeat count each, a null doc_id as well. Keys shorter than the
least length (so empty lines, if that is 1) are never dropped. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common

MIN_DOCS, MIN_CHARS = 10, 1
#: Bytes of text in a chunk, and for each shard of the index.
CHUNK, SHARD = 4 << 20, 32 << 20
LEAST_SHARDS = 64
#: Lines are hashed in runs of so many bytes; a longer line by itself.
RUN = 1 << 19
#: Bits of a level of the perfect hash for each key that reaches it.
GAMMA = 2
LEVELS = 48
_BLANK = b"\t\n\x0b\x0c\r "


# --- lines -----------------------------------------------------------------------------------


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the lines of a chunk's rows; an empty row is one empty line."""
    rows = len(offsets) - 1
    cut = np.flatnonzero(data == 10)
    cut_row = np.searchsorted(offsets, cut, "right") - 1
    lines = np.bincount(cut_row, minlength=rows) + 1
    last = np.cumsum(lines) - 1
    starts, ends = np.empty(len(cut) + rows, np.int64), np.empty(len(cut) + rows, np.int64)
    ends[np.arange(len(cut)) + cut_row] = cut
    ends[last] = offsets[1:]
    starts[1:] = ends[:-1] + 1
    starts[last - lines + 1] = offsets[:-1]
    return starts, ends, np.repeat(np.arange(rows), lines)


def line_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_chars: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every line's key, and whether the key has the least number of code points."""
    out, counts = np.zeros(len(starts), np.uint64), np.zeros(len(starts), bool)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + RUN, "right")))
        low = int(starts[at])
        part = data[low : int(ends[stop - 1])]
        if len(part) > RUN:  # one long line
            key = common.LOWER[np.frombuffer(part.tobytes().strip(_BLANK), np.uint8)]
            out[at] = np.frombuffer(hashlib.blake2b(key.tobytes(), digest_size=8).digest(), np.uint64)[0]
            counts[at] = np.count_nonzero((key & 0xC0) != 0x80) >= min_chars
            at = stop
            continue
        inside = np.flatnonzero(~common.SPACE[part])
        first, end = starts[at:stop] - low, ends[at:stop] - low
        i, j = np.searchsorted(inside, first), np.searchsorted(inside, end)
        full = j > i
        if full.any():
            first, end = inside[i[full]], inside[j[full] - 1] + 1
            long_enough = full
            if min_chars > 1:
                points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                long_enough = full.copy()
                long_enough[full] = points[end] - points[first] >= min_chars
            out[at:stop][full] = common.span_hashes(part, first, end)
            counts[at:stop] = long_enough if min_chars > 0 else True
        elif min_chars <= 0:
            counts[at:stop] = True
        at = stop
    return out, counts


# --- the index -------------------------------------------------------------------------------


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return common.mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)


class PerfectHash:
    """Distinct 64-bit keys to 0 .. n-1. A level has a bit for each place that exactly one of its keys falls on; the other keys go to the next level."""

    def __init__(self, sizes: list[int], words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        self.starts = np.concatenate([[0], np.cumsum([s // 64 for s in sizes])]).astype(np.int64)
        ones = np.bitwise_count(words).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-GAMMA * len(left) // 64) * 64
            at = _place(left, level, size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, np.uint64), np.sort(left))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; of another key, any place or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                return out
            at = _place(keys[left], level, size).astype(np.int64)
            word, bit = self.starts[level] + (at >> 6), (at & 63).astype(np.uint64)
            held = self.words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            below = held & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.ranks[word] + np.bitwise_count(below))[hit]
            left = left[~hit]
        if len(self.rest) and len(left):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            out[left[hit]] = self.ranks[-1] + at[hit]
        return out


def _prints(keys: np.ndarray) -> np.ndarray:
    return (common.mix(keys) >> np.uint64(48)).astype(np.uint16)


INDEX = "shard long, n_keys long, sizes binary, words binary, rest binary, prints binary, counts binary, large_at binary, large binary"


class LineShard:
    """Fingerprints and counts of a shard's keys, at their places."""

    def __init__(self, places: PerfectHash, prints: np.ndarray, counts: np.ndarray, large_at: np.ndarray, large: np.ndarray):
        self.places, self.prints, self.counts, self.large_at, self.large = places, prints, counts, large_at, large

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> LineShard:
        places = PerfectHash.of(keys)
        at = places.index(keys)
        prints, ordered = np.zeros(len(keys), np.uint16), np.zeros(len(keys), np.int64)
        prints[at], ordered[at] = _prints(keys), counts
        large_at = np.flatnonzero(ordered > 254)
        return cls(places, prints, np.minimum(ordered, 255).astype(np.uint8), large_at, ordered[large_at])

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """How many documents hold each key."""
        out = np.zeros(len(keys), np.int64)
        at = self.places.index(keys)
        known = np.flatnonzero(at >= 0)
        known = known[self.prints[at[known]] == _prints(keys[known])]
        out[known] = self.counts[at[known]]
        many = known[out[known] == 255]
        out[many] = self.large[np.searchsorted(self.large_at, at[many])]
        return out

    def row(self) -> list[bytes]:
        p = self.places
        return [a.tobytes() for a in (np.asarray(p.sizes, np.int64), p.words, p.rest, self.prints, self.counts, self.large_at.astype(np.int64), self.large)]

    @classmethod
    def read(cls, sizes, words, rest, prints, counts, large_at, large) -> LineShard:
        places = PerfectHash(np.frombuffer(sizes, np.int64).tolist(), np.frombuffer(words, np.uint64), np.frombuffer(rest, np.uint64))
        return cls(places, np.frombuffer(prints, np.uint16), np.frombuffer(counts, np.uint8), np.frombuffer(large_at, np.int64), np.frombuffer(large, np.int64))


# --- jobs ------------------------------------------------------------------------------------


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def chunked(docs: DataFrame, shards: int, *, min_chars: int = MIN_CHARS, chunk: int = CHUNK) -> DataFrame:
    """The written table of chunks: rows with a text (shard is null) and rows with a shard's keys of the chunk and, for each, the documents that hold it."""
    common.ship(docs.sparkSession)
    bits = np.uint64(64 - (shards - 1).bit_length())

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, data, offsets in common.text_chunks(texts, chunk):
                n = len(offsets) - 1
                starts, ends, row = line_spans(data, offsets)
                keys, counted = line_hashes(data, starts, ends, min_chars)
                keys, row = keys[counted], row[counted]
                order = np.lexsort((row, keys))
                keys, row = keys[order], row[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
                keys, held = _added(keys[new], np.ones(int(new.sum()), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number)), ids.slice(first, n), texts.slice(first, n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], ["chunk", "doc_id", "text", "shard", "keys", "held"]
                )
                if len(keys):
                    shard = (keys >> bits).astype(np.int64) if shards > 1 else np.zeros(len(keys), np.int64)
                    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                    parts = list(zip(at, np.append(at[1:], len(keys)), strict=True))
                    m = len(parts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, number)), pa.nulls(m, ids.type), pa.nulls(m, texts.type), pa.array(shard[at]), pa.array([keys[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([held[a:b].astype(np.uint32).tobytes() for a, b in parts], pa.binary())],
                        ["chunk", "doc_id", "text", "shard", "keys", "held"],
                    )
                number += 1

    kind = dict(docs.dtypes)["doc_id"]
    return common.materialize(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"chunk long, doc_id {kind}, text string, shard long, keys binary, held binary"), "line-chunks")


def _runs(batches, key: str):
    """The rows of sorted batches, as dicts, grouped by key as they come: (key, iterator). Rows are read one after another."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(key)[i].as_py(), batch, i


def line_index(chunks: DataFrame) -> DataFrame:
    """The index: a row for each shard that has keys, written."""

    def run(batches):
        at, keys, counts, size = None, [], [], 0

        def done():
            k, c = _added(np.concatenate(keys), np.concatenate(counts))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([len(k)], pa.int64()), *(pa.array([b], pa.binary()) for b in LineShard.of(k, c).row())], [c.split()[0] for c in INDEX.split(", ")])

        for shard, batch, i in _runs(batches, "shard"):
            if shard != at:
                if at is not None:
                    yield done()
                at, keys, counts, size = shard, [], [], 0
            keys.append(np.frombuffer(batch.column("keys")[i].as_py(), np.uint64))
            counts.append(np.frombuffer(batch.column("held")[i].as_py(), np.uint32).astype(np.int64))
            size += len(keys[-1])
            if size > 1 << 20 and size > 2 * len(keys[0]):
                k, c = _added(np.concatenate(keys), np.concatenate(counts))
                keys, counts, size = [k], [c], len(k)
        if at is not None:
            yield done()

    blobs = chunks.filter("shard is not null").select("shard", "keys", "held").repartition("shard").sortWithinPartitions("shard")
    return common.materialize(blobs.mapInArrow(run, INDEX), "line-index")


def frequent_keys(chunks: DataFrame, index: DataFrame, *, min_docs: int = MIN_DOCS) -> DataFrame:
    """chunk, keys: those of a chunk's keys that at least min_docs documents hold, one blob for each shard that has any."""
    fields = [c.split()[0] for c in INDEX.split(", ")][2:]

    def run(batches):
        at, shard = None, None
        for number, batch, i in _runs(batches, "shard"):
            chunk = batch.column("chunk")[i].as_py()
            if chunk is None:
                at, shard = number, LineShard.read(*(batch.column(c)[i].as_py() for c in fields))
                continue
            if number != at:
                raise RuntimeError(f"shard {number} of the line index is missing")
            keys = np.frombuffer(batch.column("keys")[i].as_py(), np.uint64)
            often = keys[shard.probe(keys) >= min_docs]
            if len(often):
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([often.tobytes()], pa.binary())], ["chunk", "keys"])

    probes = chunks.filter("shard is not null").select("shard", "chunk", "keys")
    met = index.drop("n_keys").unionByName(probes, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.col("chunk").asc_nulls_first())
    return met.mapInArrow(run, "chunk long, keys binary")


def drop_lines(docs: DataFrame, *, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text (the lines that stay, joined by line feeds), n_lines, n_dropped of every row. Lines whose key has min_chars code points and is in min_docs
    documents are dropped wherever they are."""
    if shards is None:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        shards = max(LEAST_SHARDS, -(-size // SHARD))
    shards = 1 << max(0, (shards - 1).bit_length())
    chunks = chunked(docs, shards, min_chars=min_chars, chunk=chunk)
    often = frequent_keys(chunks, line_index(chunks), min_docs=min_docs)
    kind = dict(chunks.dtypes)["doc_id"]

    def run(batches):
        at, found, often = None, [], np.zeros(0, np.uint64)
        for batch in batches:
            numbers = batch.column("chunk").to_numpy()
            answers = batch.column("keys").is_valid().to_numpy(zero_copy_only=False)
            # Answers come before the texts of their chunk, so a run of rows of one chunk and kind is taken at once.
            edges = np.flatnonzero(np.concatenate([[True], (numbers[1:] != numbers[:-1]) | (answers[1:] != answers[:-1])]))
            for a, b in zip(edges, np.append(edges[1:], len(numbers)), strict=True):
                if numbers[a] != at:
                    at, found, often = numbers[a], [], np.zeros(0, np.uint64)
                if answers[a]:
                    found += [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("keys").slice(a, b - a)]
                    continue
                if found:
                    often, found = np.sort(np.concatenate([often, *found])), []
                yield from _kept(batch.slice(a, b - a), often, min_chars)

    answers = often.select("chunk", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("string").alias("text"), "keys")
    texts = chunks.filter("shard is null").select("chunk", "doc_id", "text", F.lit(None).cast("binary").alias("keys"))
    met = answers.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", F.col("keys").isNull())
    return met.mapInArrow(run, f"doc_id {kind}, text string, n_lines long, n_dropped long")


def _kept(batch: pa.RecordBatch, often: np.ndarray, min_chars: int):
    for first, data, offsets in common.text_chunks(batch.column("text")):
        n = len(offsets) - 1
        starts, ends, row = line_spans(data, offsets)
        keys, counted = line_hashes(data, starts, ends, min_chars)
        dropped = np.zeros(len(keys), bool)
        if len(often):
            at = np.minimum(np.searchsorted(often, keys), len(often) - 1)
            dropped = counted & (often[at] == keys)
        n_lines, n_dropped = np.bincount(row, minlength=n), np.bincount(row[dropped], minlength=n)
        whole, last = data.tobytes(), np.cumsum(n_lines)
        texts = []
        for i in range(n):
            if not n_dropped[i]:
                texts.append(whole[offsets[i] : offsets[i + 1]])
                continue
            lines = np.flatnonzero(~dropped[last[i] - n_lines[i] : last[i]]) + last[i] - n_lines[i]
            texts.append(b"\n".join([whole[a:b] for a, b in zip(starts[lines].tolist(), ends[lines].tolist(), strict=True)]))
        kept = pa.array(texts, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), kept, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    got = drop_lines(common.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = f"""
WITH lines AS (
  SELECT row, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place
  FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS MATERIALIZED (
  SELECT row, doc_id, line, place, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
  SELECT key, true AS dropped FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT row) >= {MIN_DOCS}
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE dropped IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often USING (key) GROUP BY row
"""
