"""Chat formatting: multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all others
as named users; the mask marks the assistant's own words. System messages are rendered as such for all and are no
participants. `<|` inside messages and names is written `< |`, so that no message can forge a header.

A conversation is rendered whole. Where a training example must be shorter, `part_turns` cuts it by turn (so many turns a part)
and `part_rows` cuts what still has more messages; a part is rendered for those who speak in it.

Scale: one exchange by conversation; positions come from a running sum, so that a view costs time in proportion to its messages. A view is
one row: a whole dialogue must fit in a row (2 GB), a longer one needs `part_turns`. A dialogue of p speakers has p views.

Defined cases: null roles speak as `unknown`; null texts are empty; null turns come first, in a part of their own. Equal
turns are ordered by role, then text; repeated rows are repeated messages. A message with a null conv_id is a conversation of its own (nothing says that
such messages belong together). A conversation of system messages only has no perspective and no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm import common

SYSTEM, UNKNOWN = "system", "unknown"
END = "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate(conversations: DataFrame, *, part_turns: int | None = None, part_rows: int | None = None) -> DataFrame:
    """conv_id, perspective, part, subpart, n_messages, text, mask (array<struct<start, end>> in characters of text, end exclusive)."""
    role, text, zero = F.coalesce("role", F.lit(UNKNOWN)), F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long") if part_turns else zero
    said = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), part.alias("part"), zero.alias("subpart"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    named = F.concat(F.lit("<|user:"), escaped(F.col("role")), F.lit("|>\n"))
    said = said.withColumn("head", F.when(F.col("role") == SYSTEM, F.lit("<|system|>\n")).otherwise(named)).withColumn("body", F.concat(escaped(F.col("text")), F.lit(END)))
    known = said.filter("conv_id is not null")
    if part_rows:
        rank = F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order))
        known = known.withColumn("subpart", F.floor((rank - 1) / part_rows).cast("long"))
    part_of = ["conv_id", "part", "subpart"]
    place = W.partitionBy(*part_of).orderBy(*order)
    before = F.coalesce(F.sum(F.length("head") + F.length("body")).over(place.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    message = F.struct("rn", "role", "head", "body", "at").alias("m")
    known = known.withColumn("rn", F.row_number().over(place)).withColumn("at", before.cast("long")).groupBy(*part_of).agg(F.sort_array(F.collect_list(message)).alias("said"))
    alone = said.filter("conv_id is null").withColumn("rn", F.lit(1)).withColumn("at", zero).select(*part_of, F.array(message).alias("said"))
    parts = known.unionByName(alone)
    people = F.array_distinct(F.filter(F.transform("said", lambda m: m["role"]), lambda r: r != SYSTEM))
    views = parts.select(*part_of, "said", F.explode(people).alias("perspective"))
    own, me = "<|assistant|>\n", F.col("perspective")
    pieces = F.transform("said", lambda m: F.concat(F.when(m["role"] == me, F.lit(own)).otherwise(m["head"]), m["body"]))

    def span(m: Column, k: Column) -> Column:
        """The k-th of the speaker's messages: the headers of those before it are the assistant's, not their own."""
        start = m["at"] + k * (len(own) - F.length(m["head"])) + len(own)
        end = start + F.length(m["body"]) - 1  # with the end marker, without its line break
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))

    mask = F.transform(F.filter("said", lambda m: m["role"] == me), span)
    return views.select("conv_id", "perspective", "part", "subpart", F.size("said").alias("n_messages"), F.array_join(pieces, "").alias("text"), mask.alias("mask"))


def op9_chat_rotation(spark, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return rotate(common.table(spark, sf_dir, "conversations")).withColumn("mask", spans)


OP9_SQL = f"""
WITH said AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '{UNKNOWN}') AS role, coalesce(text, '') AS text FROM conversations
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) AS rn FROM said
), views AS (
  SELECT n.*, perspective FROM numbered n
  JOIN (SELECT DISTINCT conv_id AS of, alone AS one, role AS perspective FROM said WHERE role <> '{SYSTEM}') p
  ON p.of IS NOT DISTINCT FROM n.conv_id AND p.one IS NOT DISTINCT FROM n.alone
), pieces AS (
  SELECT conv_id, alone, perspective, rn, role = perspective AS own,
         CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) WHEN role = '{SYSTEM}' THEN '<|system|>' || chr(10)
              ELSE '<|user:' || replace(role, '<|', '< |') || '|>' || chr(10) END AS head,
         replace(text, '<|', '< |') || '<|end|>' || chr(10) AS body FROM views
), placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, alone, perspective ORDER BY rn) AS upto FROM pieces
)
SELECT conv_id, perspective, 0::BIGINT AS part, 0::BIGINT AS subpart, count(*)::INTEGER AS n_messages, string_agg(head || body, '' ORDER BY rn) AS text,
       coalesce(string_agg(CASE WHEN own THEN (upto - length(body))::BIGINT || '-' || (upto - 1)::BIGINT END, ',' ORDER BY rn), '') AS mask
FROM placed GROUP BY conv_id, alone, perspective
"""
