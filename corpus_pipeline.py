"""A corpus from raw documents: language, quality, near duplicates, source weights, packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. The last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright import shipping
from tracewright.llm import common, jaccard_join, language_id, mixing, packing, quality_gam

STAGES = [
    ("language_id", language_id.stage),
    ("quality_gam", quality_gam.stage),
    ("jaccard_join", jaccard_join.stage),
    ("mix_sources", mixing.stage),
    ("best_fit_packing", packing.stage),
]

#: Learned models and hash-ordered packing have no SQL twin. Tests hold the join and mixing stages against plain versions row by row and packing
#: against its rules, on a small fixture; quality only by the labels it keeps, and run() as a whole only by words and bin sizes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with shipping.passing(spark) as outside:  # what a stage writes for itself goes when its result is written
            docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}", outside)
    return STAGES[-1][1](spark, docs, sf_dir)
