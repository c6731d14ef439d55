from pyspark.sql import functions as F

from tracewright import shipping
from tracewright.operators import clustered
from tracewright.sources import legacy, pdf


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_few_rows_of_much_work_go_to_all_tasks(spark):
    one = spark.range(200).coalesce(1)
    assert tasks(one) == 1
    assert tasks(shipping.spread(one, "id")) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = one.select(F.col("id").cast("string").alias("path"), F.lit(b"no pdf").alias("content"))
    assert tasks(pdf.opened(files)) > 1
    task = '[{"id": "a", "fileName": "f.pdf", "fileSize": 1, "fileType": null, "status": "failed", "processedPages": 0, "totalPages": null, "createdAt": "2024-01-02T03:04:05Z", "completedAt": "2024-01-02T03:04:05Z"}]'
    kept = legacy.legacy_tasks(one.select(F.col("id").cast("string").alias("owner_email"), F.lit(task).alias("text")))
    assert (kept.count(), tasks(kept) > 1) == (200, True)


def test_no_rows_of_a_schema(spark):
    none = shipping.empty(spark, "a string, n long")
    assert (none.dtypes, none.count()) == ([("a", "string"), ("n", "bigint")], 0)


def test_a_layout_has_many_files_of_few_tasks(spark, tmp_path):
    kept = clustered.ClusteredHistory(spark, str(tmp_path))
    rows = spark.range(1000).select(F.format_string("%04d", "id").alias("id"), F.lit("a").alias("owner_email"), F.lit("2024-01-02T03:04:05.000Z").alias("created_at"), F.lit("completed").alias("status"), F.lit("passed").alias("outcome"), F.lit(1).alias("issue_count"))
    kept.write(rows, file_rows=10)
    index = kept.index().select("n", F.regexp_extract("file", "/part-([0-9]+)-", 1).alias("task")).collect()
    assert (sum(r["n"] for r in index), max(r["n"] for r in index)) == (1000, 10)
    assert len({r["task"] for r in index}) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    page = kept.page("a", limit=25)
    assert [r["id"] for r in page.rows] == [f"{999 - i:04d}" for i in range(25)]
