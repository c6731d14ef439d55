"""Quality rules: cross-document line frequency, in DataFrame functions only.

Lines are normalised (A-Z lower-cased, digits as 0, white space runs as one space) and hashed. The distinct
documents that hold a line are counted for each host (the `source`); copies of a text are one document. Lines in more documents
of a host than its limit are removed from the documents of that host; a document that keeps too few of its words is rejected.
The limit of a host is `share` of its documents, but `min_docs` at least and `max_docs` at most: it doesn't grow with a large host.

Beside it, the base figures of a text: words, their characters, symbols, repeated lines, words in repeated
5-word windows.

Scale: texts are parsed where they are: once for the lines, which are written down as hashes, and once for the figures. What is shuffled is one hash a
distinct line, summed before each exchange (the distinct count deals a common line out by document). A text moves only for `clean_text`, and
only if that is asked for. The lines over their limit are written down, so that Spark knows their size
when it joins them: below its threshold they are broadcast, else skewed keys are split.

Defined cases: null texts are empty and fail the base rule. A null source is a host of its own. Rows are told apart by
(doc_id, text, source), so repeated rows all get the same answer; rows with the same text count as one document of their host, whatever their doc_id. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0000000000"
WORD = "[^\\x20\\x09-\\x0D]+"
MIN_DOCS, SHARE, MAX_DOCS = 10, 0.1, 100
MIN_WORDS, MIN_LEFT = 10, 0.3


def let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever the body's lambdas do with it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), "[\\x20\\x09-\\x0D]+", " "))


def lines(text: Column) -> Column:
    """The \\n-split lines, with their places, that hold a word: array<struct<pos, line>>."""
    numbered = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    return F.filter(numbered, lambda x: x["line"].rlike(WORD))


def repeat_words(words: Column) -> Column:
    """Words that lie in a 5-word window found twice or more."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(
            F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])),
            lambda p: p.isNotNull(),
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last"))
        return let(ordered, lambda s: F.aggregate(F.array_sort(twice(s)), start, step, lambda a: a["n"]))

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
        return F.when(F.size(w) >= 6, let(windows, lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), covered(x)).otherwise(0))).otherwise(0)

    return let(words, of)


def base_rules(docs: DataFrame) -> DataFrame:
    """The base figures beside the columns doc_id, source and row (see rows())."""
    text = F.coalesce("text", F.lit(""))
    some = F.transform(lines(text), lambda x: x["line"])
    out = docs.select(
        *[c for c in docs.columns if c != "text"],
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(some, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
        repeat_words(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, host, a number for the text and one for the row's content."""
    host = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return docs.select("doc_id", "text", host.alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc"), F.xxhash64("doc_id", "text", host).alias("row"))


def hashed_lines(known: DataFrame) -> DataFrame:
    """host, doc, row, pos, line (hash) and words of every line with a word."""
    each = known.select("host", "doc", "row", F.explode(lines(F.coalesce("text", F.lit("")))).alias("x"))
    return each.select("host", "doc", "row", F.col("x.pos").alias("pos"), F.xxhash64(normalised(F.col("x.line"))).alias("line"), F.regexp_count("x.line", F.lit(WORD)).alias("words"))


def frequent_lines(each: DataFrame, known: DataFrame, *, min_docs: int = MIN_DOCS, share: float = SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """host, line (hash) of the lines over their host's limit."""
    counts = each.groupBy("host", "line").agg(F.count_distinct("doc").alias("n")).filter(F.col("n") > min_docs)
    sizes = known.select("host", "doc").groupBy("host").agg(F.count_distinct("doc").alias("docs"))
    limit = F.greatest(F.lit(min_docs), F.least(F.lit(max_docs), F.ceil(F.col("docs") * share)))
    return counts.join(sizes, "host").filter(F.col("n") > limit).select("host", "line")


def remove_frequent_lines(docs: DataFrame, *, min_docs: int = MIN_DOCS, share: float = SHARE, max_docs: int = MAX_DOCS, min_words: int = MIN_WORDS, min_left: float = MIN_LEFT) -> DataFrame:
    """For each row of docs: doc_id, the base figures, words_left, clean_text (without the frequent lines) and kept."""
    known = rows(docs)
    each = common.materialize(hashed_lines(known), "lines")
    frequent = common.materialize(frequent_lines(each, known, min_docs=min_docs, share=share, max_docs=max_docs), "frequent-lines")
    hit = each.join(frequent, ["host", "line"]).groupBy("row", "pos").agg(F.first("words").alias("words"))
    gone = hit.groupBy("row").agg(F.collect_set("pos").alias("gone"), F.sum("words").alias("gone_words"))
    text = F.coalesce("text", F.lit(""))
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False))), "\n")
    figures = base_rules(known.drop("doc").withColumn("__tw_text", F.col("text"))).withColumnRenamed("__tw_text", "text")
    out = figures.join(gone, "row", "left").withColumn("words_left", F.col("n_words") - F.coalesce("gone_words", F.lit(0)))
    enough = (F.col("words_left") >= min_words) & (F.col("words_left") >= min_left * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_left", left.alias("clean_text"), (~F.col("base_failed") & enough).alias("kept"))


def op3_line_frequency(spark, sf_dir: str) -> DataFrame:
    return remove_frequent_lines(common.table(spark, sf_dir, "documents")).drop("clean_text")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, range(5) r(k) GROUP BY doc_id
), ln AS (
  SELECT doc_id, source, t, pos, line,
         trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dupl AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY doc_id
), hosts AS (
  SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY source
), freq AS (
  SELECT l.source, norm FROM (SELECT source, norm, count(DISTINCT t) AS n FROM ln GROUP BY source, norm) l
  JOIN hosts h ON h.source IS NOT DISTINCT FROM l.source WHERE n > greatest(10, least(100, ceil(docs * 0.1)))
), gone AS (
  SELECT doc_id, sum(words) AS n FROM ln JOIN freq f ON f.source IS NOT DISTINCT FROM ln.source AND f.norm = ln.norm GROUP BY doc_id
), base AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dupl.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, (len(ws) - coalesce(gone.n, 0))::BIGINT AS words_left
  FROM d LEFT JOIN dupl USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
), judged AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_left,
       (NOT base_failed AND words_left >= 10 AND words_left >= 0.3 * n_words) AS kept
FROM judged
"""
