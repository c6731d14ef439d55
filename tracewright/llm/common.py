"""Reading, folds and vectorised text hashing shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.shipping import materialize, passing, scratch_dir, ship

__all__ = ["LOWER", "NON_WORD", "SPACE", "arrow_rows", "fold", "hash_sample_bound", "materialize", "mix", "one_text_a_document", "passing", "per_row", "scratch_dir", "ship", "span_hashes", "table", "text_chunks", "words"]

#: Documents of one vectorised step hold about this many bytes together (a longer text is its own step).
CHUNK_BYTES = 1 << 19
#: A table with less than this for each core is dealt out when it is read.
SMALL_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. A file's row group is read by one task; a table too small to have a row group for each core is dealt out first,
    since work on a text costs far more than moving it once."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_BYTES else df


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Jobs run within send at most so many rows at a time to Python: for long texts of which a task needs few at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fold(key: str, folds: int) -> Column:
    """crc32 of the key's text modulo folds; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def hash_sample_bound(keys: DataFrame, key: str, size: int) -> int | None:
    """The largest xxhash64(key) among the `size` smallest different ones, so that a filter on it gives a uniform bounded sample.
    None when there are no rows.

    The rows are counted first and all but about `size` are filtered out by their hash, so no task gets a share of every partition."""
    h = keys.select(F.xxhash64(key).alias("h"))
    n = h.count()
    wanted = size + 6 * size**0.5 + 64
    while n:
        few = h if wanted >= n else h.filter(F.col("h") <= int(-(2**63) + wanted / n * 2**64))
        got = few.distinct().orderBy("h").limit(size).agg(F.max("h"), F.count(F.lit(1))).first()
        if wanted >= n or got[1] == size:
            return got[0]
        wanted *= 8  # many rows of one key
    return None


def one_text_a_document(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, the carried columns and text of one row of each doc_id: that with the smallest hash, whatever the order of the rows."""
    whole = F.struct(F.xxhash64("text", *carried).alias("h"), "text", *carried)
    return docs.groupBy("doc_id").agg(F.min(whole).alias("__tw_row")).select("doc_id", *[F.col(f"__tw_row.{c}").alias(c) for c in (*carried, "text")])


# --- vectorised text ---------------------------------------------------------------------------

_MASK = (1 << 64) - 1
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits and bytes of non-ASCII characters.
NON_WORD = np.array([not (chr(b).isalnum() or b == 0x5F) if b < 128 else False for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, _MASK, 256, dtype=np.uint64, endpoint=True)
_BYTE_LOWER = _BYTE[LOWER]
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n at least."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 65536)
        up, down = np.full(size, _P), np.full(size, _P_INV)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of an Arrow text column: (first row, bytes, offsets of rows in them). A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (in bytes) and row numbers of the words of a chunk; no word crosses rows."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal spans (A-Z lower-cased on request)."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values (one a byte) over each row of a chunk."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[offsets])
