"""N-gram Jaccard join with set-relation skipping.

Two documents link when their sets of five-word shingles have a Jaccard similarity of 0.75 or more; the classes of
documents that links lead to are returned with each document's number of links. The join is exact up to collisions
of 64-bit hashes.

1. Documents with the same set are one *class*; from here on only classes are compared, so copies cost one row each.
2. Prefix filter. Shingles are ordered by range, then by the number of classes that hold them, rarest first; two classes
   that link share AGREE of their first n - ceil(0.75 n) + AGREE. Nearly all classes fill that prefix from the low range,
   the lowest POSTED of the hashes, and only these shingles are counted for them; the others count all of theirs. So a text is
   hashed once, about a third of the shingles is shuffled, in blobs, and common passages come last by themselves.
3. Index lists. Classes of much the same prefix go under one *head*, in blocks of bounded size. The list of a shingle has an entry for
   each head, with its sizes and the most that can agree after its positions, and is cut by size; the part of a list that size and position
   exclude for an entry is skipped. The blocks of one head, and of two heads that enough lists leave, meet in a task, each pair once.
4. Answers. A task holds two indexed blocks. The first set is answered from the lists of its shingles; the next,
   if it is highly similar, gets its answer from that one: the lists of the shingles it lacks are subtracted, those it adds are added.
   A task returns numbers of links and at most a spanning forest.

Scale: what is shuffled is linear in the shingles, but for pairs of blocks: a family of M near copies has (M / BLOCK)^2 / 2 of them
(their links are counted), each with two compact indexes. No list, family or component is held in one task, and nothing
that grows with the input is broadcast by force or collected.

Defined cases: null texts and texts without words have an empty set, link with nothing and are their own component.
Repeated rows are linked copies. Rows with a null doc_id take part; a component's id is its smallest id that isn't
null. Ids are integers. Extra columns are ignored.
"""

from __future__ import annotations

import math



import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common
from tracewright.llm.components import components

N = 5
PERCENT = 75
#: Share of the hash range whose shingles are counted first: the low range.
POSTED = 0.30
_LOW = np.uint64(int(POSTED * 2**64))
#: Shingles that a counting task holds at once on average, those in a task that sends them, and from how many classes on one isn't held.
PART, FLUSH, HOT = 4_000_000, 1_000_000, 65_536
#: Counting tasks at most: Spark keeps a number for each pair of tasks of an exchange.
MOST_PARTS = 20_000
#: A block of similar sets has about so many classes, or so many shingles, at most.
BLOCK, BLOCK_SHINGLES = 256, 2_000_000
#: Two classes that link share so many shingles of prefixes that are as much longer (fewer, where a set is that small).
AGREE = 6
#: Index lists are cut by size in steps of this ratio.
SIZE_STEP = 1.05
INDEX = ["classes", "copies", "sizes", "tokens", "counts", "owners"]
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def sets_of(column: pa.Array):
    """(row, number of words, sorted distinct 64-bit hashes of the row's shingles) of every text."""
    for at, data, offsets in common.text_chunks(column):
        starts, ends, row = common.words(data, offsets)
        w = common.span_hashes(data, starts, ends)
        first = np.searchsorted(row, np.arange(len(offsets)))
        full = np.zeros(max(len(w) - N + 1, 0), np.uint64)
        for k in range(N):
            full += w[k : k + len(full)] * _ODD[k]
        full = common.mix(full + np.uint64(N))
        for i in range(len(offsets) - 1):
            a, b = first[i], first[i + 1]
            if b - a >= N:
                got = np.sort(full[a : b - N + 1])
                yield at + i, b - a, got[np.concatenate([[True], got[1:] != got[:-1]])]
            elif b > a:
                yield at + i, b - a, common.mix((w[a:b] * _ODD[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield at + i, 0, w[:0]


def digest(got: np.ndarray) -> int:
    """A 64-bit number, equal for equal sets: the class."""
    with np.errstate(over="ignore"):
        return int(common.mix(got ^ _ODD[0]).sum().view(np.int64))


def prefix_length(n: int) -> int:
    need = (PERCENT * n + 99) // 100
    return n - need + min(AGREE, need)


def linked(overlap, a, b):
    return 100 * overlap >= PERCENT * (a + b - overlap)


def _text_rows(docs: DataFrame, *carried: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), *carried, "text")


def posted(got: np.ndarray) -> tuple[np.ndarray, int]:
    """The shingles of a sorted set that are counted, and how many of them are of the low range: these alone if they fill the prefix, else all."""
    low = int(np.searchsorted(got, _LOW))
    return (got[:low] if low >= prefix_length(len(got)) else got), low


def describe_sets(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, text_hash, the carried columns, words, n, class, low, and posted (blob) of every row; posted is null for a set seen before in the partition and for
    empty sets."""
    common.ship(docs.sparkSession)
    kept = ["doc_id", "text_hash", *carried]

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            d = dict(zip(batch.schema.names, batch.columns, strict=True))
            words, n, classes, lows, blobs = [], [], [], [], []
            for _, count, got in sets_of(d["text"]):
                c = digest(got)
                mine, low = posted(got)
                blobs.append(mine.tobytes() if len(got) and c not in seen else None)
                seen.add(c)
                words.append(count), n.append(len(got)), classes.append(c), lows.append(low)
            yield pa.RecordBatch.from_arrays([*(d[c] for c in kept), *(pa.array(x, pa.int64()) for x in (words, n, classes, lows)), pa.array(blobs, pa.binary())], [*kept, "words", "n", "class", "low", "posted"])

    rows = _text_rows(docs, *carried)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in rows.drop("text").dtypes) + ", words long, n long, class long, low long, posted binary")


def _dealt(at: np.ndarray, tokens: np.ndarray, owners: np.ndarray, name: str) -> pa.RecordBatch:
    """Shingles and their classes as a row of blobs for each number in `at`."""
    order = np.argsort(at, kind="stable")
    at, tokens, owners = at[order], tokens[order], owners[order]
    cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    ends = np.append(cuts[1:], len(at))
    blobs = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(at[cuts].astype(np.int64)), blobs(tokens), blobs(owners)], [name, "tokens", "owners"])


def _flushed(pairs, number, name: str, flush: int):
    """(shingles, classes) dealt out by a number of the shingle, about `flush` of them at a time."""
    tokens, owners, held = [], [], 0
    for t, o in pairs:
        tokens.append(t), owners.append(o)
        held += len(t)
        if held >= flush:
            whole = np.concatenate(tokens)
            yield _dealt(number(whole), whole, np.concatenate(owners), name)
            tokens, owners, held = [], [], 0
    if held:
        whole = np.concatenate(tokens)
        yield _dealt(number(whole), whole, np.concatenate(owners), name)


class _Counter:
    """Counts the classes of each shingle of one group; gives class, token, df of those that several hold. From 2 x `part` on it passes hot ones on."""

    def __init__(self, hot: int, part: int):
        self.hot, self.part = hot, part
        self.reset()

    def reset(self):
        self.tokens, self.owners, self.held, self.most = [], [], 0, 2 * self.part
        self.counted: dict[int, int] = {}  # hot shingles: their rows are passed on without df

    def add(self, tokens: np.ndarray, owners: np.ndarray):
        self.tokens.append(tokens), self.owners.append(owners)
        self.held += len(tokens)
        if self.held >= self.most:
            yield from self._pass_hot()

    def _ordered(self):
        t, o = np.concatenate(self.tokens), np.concatenate(self.owners)
        order = np.lexsort((o, t))
        t, o = t[order], o[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
        t, o = t[new], o[new]
        edges = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        df = np.diff(np.append(edges, len(t)))
        return t, o, t[edges], df, np.repeat(df, df)

    def _known(self, t):
        for x in self.counted:
            self.counted[x] += int(np.searchsorted(t, x, "right") - np.searchsorted(t, x))
        return np.isin(t, np.fromiter(self.counted, np.int64, len(self.counted)))

    @staticmethod
    def _rows(classes, tokens, df):
        for a in range(0, len(tokens), 1 << 16):
            part = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(x[part], pa.int64()) if x is not None else pa.nulls(len(tokens[part]), pa.int64()) for x in (classes, tokens, df)], ["class", "token", "df"])

    def _pass_hot(self):
        t, o, named, df, _ = self._ordered()
        for x in named[df > self.hot].tolist():
            self.counted.setdefault(x, 0)
        much = self._known(t)
        yield from self._rows(o[much], t[much], None)
        self.tokens, self.owners, self.held = [t[~much]], [o[~much]], int((~much).sum())
        self.most = max(2 * self.part, 2 * self.held)

    def finish(self):
        if self.held:
            t, o, _, _, each = self._ordered()
            late = self._known(t)
            yield from self._rows(o[late], t[late], None)
            more = (each > 1) & ~late
            yield from self._rows(o[more], t[more], each[more])
        if self.counted:
            yield from self._rows(None, np.array(list(self.counted)), np.array(list(self.counted.values())))
        self.reset()


def shared_shingles(described: DataFrame, *, hot: int = HOT) -> DataFrame:
    """class, token, df for the counted shingles that more than one class holds.

    Shingles are dealt to buckets, in blobs (one a bucket for each FLUSH shingles of a task). A task counts the shingles of its buckets, PART at a time on
    average: beyond MOST_PARTS tasks, a task sorts its shingles into groups (Spark's sort, which spills) and counts one group after the other. A shingle of
    more classes than `hot` doesn't stay in memory: its rows are passed on without df and get it from a join; their df counts copies of
    other tasks again, but it is one number.
    """
    spark = described.sparkSession
    common.ship(spark)
    total = described.agg(F.coalesce(F.sum(F.octet_length("posted")), F.lit(0))).first()[0] // 8
    parts = min(MOST_PARTS, max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART)))
    buckets, groups = 4 * parts, max(1, -(-total // (PART * parts)))
    part, flush = PART, FLUSH

    def post(batches):
        pairs = ((np.frombuffer(blob.as_buffer(), np.uint64), c) for batch in batches for c, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        yield from _flushed(((t, np.full(len(t), c, np.int64)) for t, c in pairs), lambda t: t % np.uint64(buckets), "bucket", flush)

    def blobs(batch, kind):
        return ((np.frombuffer(t.as_buffer(), kind), np.frombuffer(o.as_buffer(), np.int64)) for t, o in zip(batch.column(1), batch.column(2), strict=True))

    def regroup(batches):
        yield from _flushed((pair for batch in batches for pair in blobs(batch, np.uint64)), lambda t: t // np.uint64(buckets) % np.uint64(groups), "group", flush)

    def meet(batches):
        counter, now = _Counter(hot, part), None
        for batch in batches:
            for group, (t, o) in zip(batch.column(0).to_pylist(), blobs(batch, np.int64), strict=True):
                if group != now:
                    yield from counter.finish()
                    now = group
                yield from counter.add(t, o)
        yield from counter.finish()

    packed = described.filter("posted is not null").select("class", "posted").mapInArrow(post, "bucket long, tokens binary, owners binary")
    packed = packed.repartition(parts, "bucket")
    if groups > 1:
        packed = packed.mapInArrow(regroup, "group long, tokens binary, owners binary").sortWithinPartitions("group")
    else:
        packed = packed.select(F.lit(0).cast("long").alias("group"), "tokens", "owners")
    found = common.materialize(packed.mapInArrow(meet, "class long, token long, df long"), "shared")
    often = found.filter("class is null").select("token", F.col("df").alias("often"))
    late = found.filter("class is not null and df is null").select("class", "token").distinct().join(often, "token").select("class", "token", F.col("often").alias("df"))
    return found.filter("class is not null and df is not null").unionByName(late)


def needed(n: Column) -> Column:
    """The least overlap of a class of n shingles with any that it links with."""
    return F.floor((PERCENT * n + 99) / 100)


def agree(n: Column) -> Column:
    """How many prefix shingles a class of n shingles shares at least with one that it links with."""
    return F.least(F.lit(AGREE), needed(n))


def _prefix(classes: np.ndarray, n: np.ndarray, low: np.ndarray, tokens: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
    """class, n, token, pos of prefixes() for whole classes, whose rows stand together: a row of n and low (df is 0), and one of each shared shingle."""
    new = np.concatenate([[True], classes[1:] != classes[:-1]])
    group = np.cumsum(new) - 1
    told, sizes = df == 0, np.zeros((2, int(new.sum())), np.int64)
    sizes[:, group[told]] = n[told], low[told]
    group, tokens, df = group[~told], tokens[~told], df[~told]
    high = (tokens < 0) | (tokens >= int(_LOW))
    order = np.lexsort((tokens, df, high, group))
    group, tokens, high = group[order], tokens[order], high[order]
    n, low = sizes[:, group]
    several, below = np.bincount(group, minlength=sizes.shape[1]), np.bincount(group, ~high, sizes.shape[1]).astype(np.int64)
    at = np.arange(len(group)) - (np.cumsum(several) - several)[group]
    # Shingles that no other class holds come first in their range.
    pos = np.where(high, n - several[group], low - below[group]) + at
    need = (PERCENT * n + 99) // 100
    kept = (n > 0) & (pos < n - need + np.minimum(AGREE, need))
    # With fewer than the smallest class that may link asks for, no list can lead to a link.
    kept &= np.bincount(group[kept], minlength=sizes.shape[1])[group] >= np.minimum(AGREE, (PERCENT * need + 99) // 100)
    return pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (classes[new][group], n, tokens, pos)], ["class", "n", "token", "pos"])


def prefixes(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """class, n, token, pos of the shared shingles in each class's prefix, in the order (range, df, token).

    A class's shingles, no more than one text has, come sorted by class to one task, which holds those of a few classes at a time."""

    def run(batches):
        held: list[list[np.ndarray]] = []  # of the class that may go on
        for batch in batches:
            columns = [c.fill_null(0).to_numpy() for c in batch.columns]
            if not batch.num_rows:
                continue
            if columns[0][-1] == columns[0][0] and (not held or held[0][0][0] == columns[0][0]):
                held.append(columns)
                continue
            last = int(np.flatnonzero(columns[0] != columns[0][-1])[-1]) + 1 if columns[0][0] != columns[0][-1] else 0
            yield _prefix(*map(np.concatenate, zip(*held, [c[:last] for c in columns], strict=True)))
            held = [[c[last:] for c in columns]]
        if held:
            yield _prefix(*map(np.concatenate, zip(*held, strict=True)))

    none = F.lit(None).cast("long")
    rows = shared.select("class", none.alias("n"), none.alias("low"), "token", "df").unionByName(classes.select("class", "n", "low", none.alias("token"), none.alias("df")))
    return rows.repartition("class").sortWithinPartitions("class").mapInArrow(run, "class long, n long, token long, pos long")


def grouped(prefix: DataFrame) -> DataFrame:
    """class, n, head, part, parts: classes of much the same prefix under one head, in parts of about BLOCK classes or BLOCK_SHINGLES shingles.

    A class follows the class that is the smallest of the most of its lists, if it shares enough of them with it to be compared with it anyway;
    else it stays alone. Heads decide which sets meet in a task, never whether they are compared.
    """
    least = common.materialize(prefix.groupBy("token").agg(F.min("class").alias("head"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("token", "head"), "list-heads")
    votes = prefix.join(least, "token").groupBy("class", "head").agg(F.count(F.lit(1)).alias("votes"), F.first("n").alias("n"))
    best = votes.groupBy("class").agg(F.first("n").alias("n"), F.max(F.struct("votes", "head")).alias("best"))
    members = common.materialize(best.select("class", "n", F.when(F.col("best.votes") >= agree(F.col("n")), F.col("best.head")).otherwise(F.col("class")).alias("head")), "heads")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    parts = common.materialize(members.groupBy("head").agg(parts.alias("parts")), "head-parts")
    return members.join(parts, "head").select("class", "n", "head", F.pmod(F.xxhash64("class"), F.col("parts")).alias("part"), "parts")


def block(head: str, part: str) -> Column:
    return F.xxhash64(head, part)


def head_pairs(prefix: DataFrame, members: DataFrame) -> DataFrame:
    """a, b: the pairs of heads with sets that index lists, cut by head and size, don't skip by position or size."""
    about = common.materialize(members.groupBy("head").agg(F.min(agree(F.col("n"))).alias("agree")), "head-sizes")
    entries = prefix.join(members.select("class", "head"), "class").groupBy("token", "head")
    lists = common.materialize(entries.agg(F.max(F.col("n") - F.col("pos")).alias("rest"), F.min("n").alias("low"), F.max("n").alias("high")), "list-entries")
    several = common.materialize(lists.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token"), "list-tokens")
    # After the k-th shingle that two sets share, at positions i and j, min(n - i, n - j) must hold all but k - 1 of what a link needs.
    # So a set goes with sets up to a size that falls as its position grows, and is skipped where that is below its own unless the other is smaller.
    reach = F.floor((F.col("rest") + F.col("agree") - 1) * (100 + PERCENT) / PERCENT) - F.col("low")
    lists = lists.join(several, "token").join(about, "head").withColumn("reach", F.least(reach, F.floor(100 * F.col("high") / PERCENT)))
    lists = common.materialize(lists, "index-lists")
    step = lambda n: F.floor(F.log(n) / math.log(SIZE_STEP)).cast("int")
    a = lists.filter("reach >= low").withColumn("step", F.explode(F.sequence(step(F.col("low")), step(F.col("reach"))))).alias("a")
    b = lists.withColumn("step", step(F.col("low"))).alias("b")
    least = F.ceil(PERCENT * (F.col("a.low") + F.col("b.low")) / (100 + PERCENT))
    both = F.least("a.agree", "b.agree")
    room = F.least("a.rest", "b.rest") >= least - both + 1
    later = (F.col("a.low") < F.col("b.low")) | ((F.col("a.low") == F.col("b.low")) & (F.col("a.head") < F.col("b.head")))
    sizes = (F.col("b.low") <= F.col("a.reach")) & (F.col("a.low") <= F.col("b.reach"))
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.step") == F.col("b.step")) & (F.col("a.head") != F.col("b.head")) & later & sizes & room)
    pair = [F.least("a.head", "b.head").alias("a"), F.greatest("a.head", "b.head").alias("b")]
    return met.select(*pair, both.alias("agree")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("agree").alias("agree")).filter("c >= agree").select("a", "b")


def block_pairs(prefix: DataFrame, members: DataFrame) -> DataFrame:
    """i, j: the pairs of different blocks whose sets are compared: the parts of one head, and those of head_pairs(); j has more shingles."""
    heads = common.materialize(members.groupBy("head").agg(F.first("parts").alias("parts"), F.sum("n").alias("weight")), "head-weights")
    zero = F.lit(0).cast("long")
    within = heads.filter("parts > 1").select("head", "parts", F.explode(F.sequence(zero, F.col("parts") - 2)).alias("p"))
    within = within.select("head", "p", F.explode(F.sequence(F.col("p") + 1, F.col("parts") - 1)).alias("q")).select(block("head", "p").alias("i"), block("head", "q").alias("j"))
    side = lambda x: heads.select(F.col("head").alias(x), F.struct("head", "parts", (F.col("weight") / F.col("parts")).alias("weight")).alias(f"{x}_of"))
    across = head_pairs(prefix, members).join(side("a"), "a").join(side("b"), "b")
    swap = F.col("a_of.weight") > F.col("b_of.weight")
    across = across.select(F.when(swap, F.col("b_of")).otherwise(F.col("a_of")).alias("x"), F.when(swap, F.col("a_of")).otherwise(F.col("b_of")).alias("y"))
    across = across.withColumn("p", F.explode(F.sequence(zero, F.col("x.parts") - 1))).withColumn("q", F.explode(F.sequence(zero, F.col("y.parts") - 1)))
    return within.unionByName(across.select(block("x.head", "p").alias("i"), block("y.head", "q").alias("j")))


def whole_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """class, copies, block, shingles (blob) of the given classes(class, rep, text_hash, copies, block), at most once from a task."""
    common.ship(docs.sparkSession)
    carried = ["class", "copies", "block"]

    def run(batches):
        seen: set[int] = set()  # repeated rows of a task count once
        for batch in batches:
            d = dict(zip(batch.schema.names, batch.columns, strict=True))
            new = [c not in seen and not seen.add(c) for c in d["class"].to_pylist()]
            batch = batch.filter(pa.array(new, pa.bool_()))
            d = dict(zip(batch.schema.names, batch.columns, strict=True))
            sets = [s.tobytes() if digest(s) == c else None for c, (*_, s) in zip(d["class"].to_pylist(), sets_of(d["text"]), strict=True)]
            found = pa.array(sets, pa.binary())
            yield pa.RecordBatch.from_arrays([*(d[c] for c in carried), found], [*carried, "shingles"]).filter(found.is_valid())

    rows = _text_rows(docs)
    # Some part of all texts is asked for, at any size of the input: never a broadcast.
    numbered = rows.join(classes.filter("rep is not null").select(*carried, "text_hash", F.col("rep").alias("doc_id")).hint("merge"), ["doc_id", "text_hash"]).select(*carried, "text")
    # A class without any id is found by a text of its rows; copies are dropped first, so that at most one a task moves.
    nameless = rows.filter("doc_id is null").select("text_hash", "text").dropDuplicates(["text_hash"])
    nameless = nameless.join(classes.filter("rep is null").select(*carried, "text_hash"), "text_hash").select(*carried, "text")
    return numbered.unionByName(nameless).mapInArrow(run, "class long, copies long, block long, shingles binary")


class BlockIndex:
    """The sets of a block, indexed by shingle: the list of a shingle is that of the sets that hold it."""

    def __init__(self, sizes: np.ndarray, tokens: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        self.sizes, self.tokens, self.counts, self.owners = sizes, tokens, counts.astype(np.int64), owners
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> BlockIndex:
        sizes = np.array([len(s) for s in sets], np.int64)
        all_tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(all_tokens, kind="stable")
        tokens, counts = np.unique(all_tokens[order], return_counts=True)
        return cls(sizes, tokens, counts, owners[order].astype(np.uint16 if len(sets) < 1 << 16 else np.uint32))

    def sets(self) -> list[np.ndarray]:
        """For each set the places of its shingles in `tokens`, ascending."""
        order = np.argsort(self.owners, kind="stable")
        return np.split(np.repeat(np.arange(len(self.tokens)), self.counts)[order], np.cumsum(self.sizes)[:-1])

    def places(self, tokens: np.ndarray) -> np.ndarray:
        """The places of tokens here, -1 where no set holds one."""
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, at, -1)

    def answer(self, places: np.ndarray) -> np.ndarray:
        """How often each set is in the lists at the places."""
        n = self.counts[places]
        at = np.arange(int(n.sum())) + np.repeat(self.starts[places] - np.cumsum(n) + n, n)
        return np.bincount(self.owners[at], minlength=len(self.sizes))


def block_links(left: BlockIndex, right: BlockIndex):
    """For each set of left: (its number, the numbers of the sets of right that it links with, whether its answer was derived)."""
    place = np.arange(len(left.tokens)) if left is right else right.places(left.tokens)
    before = overlap = None
    for i, mine in enumerate(left.sets()):
        x = place[mine]
        x = x[x >= 0]
        derived = False
        if before is not None:
            both = np.isin(x, before, assume_unique=True)
            if 2 * (len(x) + len(before) - 2 * int(both.sum())) < len(x):  # less to change than to count anew
                lacks = np.setdiff1d(before, x, assume_unique=True)
                overlap, derived = overlap - right.answer(lacks) + right.answer(x[~both]), True
        if not derived:
            overlap = right.answer(x)
        before = x
        yield i, np.flatnonzero(linked(overlap, int(left.sizes[i]), right.sizes)), derived


def index_blocks(sets: DataFrame) -> DataFrame:
    """block and its index: classes, copies, sizes, tokens, counts, owners (blobs). Sets given twice count once."""

    def run(group: pa.Table) -> pa.Table:
        d = group.to_pydict()
        one = {c: (n, s) for c, n, s in zip(d["class"], d["copies"], d["shingles"], strict=True)}
        order = sorted(one, key=lambda c: (one[c][1][:8], c))  # sets that begin alike follow each other
        index = BlockIndex.of([np.frombuffer(one[c][1], np.uint64) for c in order])
        blobs = [np.array(order, np.int64), np.array([one[c][0] for c in order], np.int64), index.sizes, index.tokens, index.counts.astype(np.uint32), index.owners.astype(np.uint32 if len(order) >= 1 << 16 else np.uint16)]
        return pa.table([pa.array([d["block"][0]], pa.int64()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], names=["block", *INDEX])

    return sets.groupBy("block").applyInArrow(run, "block long, " + ", ".join(f"{c} binary" for c in INDEX))


def met_blocks(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """class, other, links, derived: a class's linked documents in one meeting (other null), links as stars, and of each meeting (class null) the numbers of sets and of derived answers."""

    def side(row, mark):
        part = lambda name, kind: np.frombuffer(row[mark + name], kind)
        classes = part("classes", np.int64)
        kind = np.uint32 if len(classes) >= 1 << 16 else np.uint16
        return classes, part("copies", np.int64), BlockIndex(part("sizes", np.int64), part("tokens", np.uint64), part("counts", np.uint32), part("owners", kind))

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                yield meeting(side(row, "a_"), side(row, "b_") if row["b_classes"] is not None else None)

    a = blocks.select(F.col("block").alias("i"), *[F.col(c).alias(f"a_{c}") for c in INDEX])
    b = blocks.select(F.col("block").alias("j"), *[F.col(c).alias(f"b_{c}") for c in INDEX])
    within = a.filter(F.octet_length("a_classes") > 8).select(*a.columns[1:], *[F.lit(None).cast("binary").alias(f"b_{c}") for c in INDEX])
    across = pairs.join(a, "i").join(b, "j").select(within.columns)
    return within.unionByName(across).mapInArrow(run, "class long, other long, links long, derived long")


def meeting(one, two) -> pa.RecordBatch:
    """The links between two blocks (classes, copies, index), or within the first."""
    classes, copies, index = one
    others, other_copies, other = one if two is None else two
    off = 0 if two is None else len(classes)
    label = np.arange(off + len(others))
    links, n_derived = np.zeros(len(label), np.int64), 0
    for i, found, derived in block_links(index, other):
        n_derived += derived
        if two is None:
            found = found[found > i]  # each pair is met twice
        if not len(found):
            continue
        links[i] += other_copies[found].sum()
        links[off + found] += copies[i]
        parts = np.unique(label[off + found])
        label[np.isin(label, parts)] = label[i]
    ids = classes if two is None else np.concatenate([classes, others])
    # What is linked here, as stars around the smallest class: a group that one meeting finds whole needs no further step.
    order = np.lexsort((ids, label))
    first = np.concatenate([[True], label[order][1:] != label[order][:-1]])
    centre = ids[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    some = np.flatnonzero(links)
    rows = [(int(ids[k]), None, int(links[k]), None) for k in some] + [(int(a), int(b), 0, None) for a, b in zip(ids[order][~first], centre[~first], strict=True)] + [(None, None, len(classes), n_derived)]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["class", "other", "links", "derived"])


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row."""
    return _answers(docs).select("doc_id", "n_shingles", "component_id", "n_links")


def linked_classes(docs: DataFrame, *carried: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: the rows (doc_id, text_hash, n, class; where columns are carried, these and words, too), the classes (class, rep, text_hash, copies, n, low), and met_blocks(). All others are removed."""
    with common.passing(docs.sparkSession) as outside:
        described = common.materialize(describe_sets(docs, *carried), "sets")
        rows = common.materialize(described.select("doc_id", "text_hash", "n", "class", *(["words", *carried] if carried else [])), "rows", outside)
        # A class is fetched by one row of it, by id and text, so that an id that many texts bear brings no more than that.
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
        classes = described.filter("n > 0").groupBy("class").agg(first.alias("row"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("low").alias("low"))
        classes = classes.select("class", F.col("row.doc_id").alias("rep"), F.col("row.text_hash").alias("text_hash"), "copies", "n", "low")
        classes = common.materialize(classes, "classes", outside)
        prefix = common.materialize(prefixes(shared_shingles(described), classes), "prefixes")
        members = common.materialize(grouped(prefix).withColumn("block", block("head", "part")), "members")
        pairs = common.materialize(block_pairs(prefix, members), "block-pairs")
        several = members.groupBy("block").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("block")
        needed = several.unionByName(pairs.select(F.explode(F.array("i", "j")).alias("block"))).distinct()
        wanted = common.materialize(members.join(needed, "block").select("class", "block").join(classes, "class").select("class", "block", "rep", "text_hash", "copies"), "wanted")
        blocks = common.materialize(index_blocks(whole_sets(docs, wanted)), "blocks")
        return rows, classes, common.materialize(met_blocks(blocks, pairs), "links", outside)


def derived_sets(met: DataFrame) -> tuple[int, int]:
    """How many answers met_blocks() gave, and how many of them were derived from a similar set's."""
    row = met.filter("class is null").agg(F.coalesce(F.sum("links"), F.lit(0)), F.coalesce(F.sum("derived"), F.lit(0))).first()
    return row[0], row[1]


def _answers(docs: DataFrame, *carried: str) -> DataFrame:
    """jaccard_components() with the rows' text_hash and their component's root class (null for empty sets); where columns are carried, these and the words of a row, too."""
    described, classes, met = linked_classes(docs, *carried)  # the rows with their class and size
    roots = components(met.filter("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")))
    ends = met.filter("class is not null and other is null").groupBy("class").agg(F.sum("links").alias("links"))
    whole = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")).join(ends, "class", "left")
    whole = common.materialize(whole.select("class", "rep", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "roots")
    named = common.materialize(whole.groupBy("root").agg(F.min("rep").alias("component_id")), "names")  # a join of tables can split a large family
    answer = whole.join(named, "root").select("class", "root", "component_id", "n_links")
    more = ["words", *carried] if carried else []
    rows = described.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "class", *more).join(answer, "class", "left")
    empty = F.col("n_shingles") == 0
    return rows.select("doc_id", "text_hash", "n_shingles", F.when(~empty, F.col("root")).alias("root"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), *more)


def clustered_rows(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, the carried columns, cluster (the component's root class, without words the text's xxhash64) and words of every row; texts are read for the join alone."""
    return _answers(docs, *carried).select("doc_id", *carried, F.coalesce("root", "text_hash").alias("cluster"), "words")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component: the smallest doc_id (null only where there is no other), of equal ids the smallest text hash.

    Rows without a shingle are components of their own; of equal ones among them, too, one stays.
    """
    found = _answers(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("p")
    picked = found.filter("root is not null").groupBy("root").agg(first).select("p.doc_id", "p.text_hash")
    picked = picked.unionByName(found.filter("root is null").select("doc_id", "text_hash")).distinct()
    picked = common.materialize(picked.withColumnRenamed("text_hash", "__tw_text"), "kept")
    names = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.withColumn("__tw_text", F.xxhash64("text"))
    keys = ["doc_id", "__tw_text"]  # texts move once: the duplicates of a key are where the join has put them
    kept = own.filter("doc_id is not null").join(picked, keys, "left_semi").dropDuplicates(keys)
    nameless = own.filter("doc_id is null").join(picked.filter("doc_id is null").drop("doc_id"), "__tw_text", "left_semi").dropDuplicates(["__tw_text"])
    return kept.unionByName(nameless).select(*names)


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS to_id FROM w
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.to_id
)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.to_id) AS component_id, coalesce(any_value(d.c), 0)::BIGINT AS n_links
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id LEFT JOIN (SELECT a, count(*) AS c FROM both_ways GROUP BY a) d ON d.a = r.doc_id GROUP BY r.doc_id
"""
