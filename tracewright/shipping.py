"""Python code for the executors, and tables in the folder they share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ship(spark: SparkSession) -> None:
    """Give executors this package, once a session, so that functions sent to Python workers find it."""
    context = spark.sparkContext
    if getattr(context, "_tracewright_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tracewright-code-"), "tracewright_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    z.write(f"{folder}/{name}", os.path.relpath(f"{folder}/{name}", os.path.dirname(package)))
    context.addPyFile(path)
    context._tracewright_shipped = True


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a private one only where that is unset and all runs in one process (tests)."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_tracewright_scratch", None)
    if not shared:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = context._tracewright_scratch = tempfile.mkdtemp(prefix="tracewright-")
    return shared.rstrip("/")


def _folder(spark: SparkSession) -> str:
    """Where this application's tables are now written."""
    context = spark.sparkContext
    return "/".join([scratch_dir(spark), f"tracewright-{context.applicationId}", *getattr(context, "_tracewright_inside", [])])


def place(spark: SparkSession, name: str) -> str:
    """A new path among this application's tables."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write df as a table in the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{folder or _folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._tracewright_path = path
    return written


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys over all tasks of an exchange: for few bytes of much work, which would else be read, or put together, as a few tasks.

    The keys are hashed first: an exchange by the keys of a join below would be dropped as a second one, and the join's is put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of a schema, without a job of Python workers."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(written: DataFrame) -> None:
    """Remove a table that materialize returned; nothing may read it any more."""
    _delete(written.sparkSession, written._tracewright_path)


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; results that were not written before are lost."""
    _delete(spark, "/".join([scratch_dir(spark), f"tracewright-{spark.sparkContext.applicationId}"]))


@contextmanager
def passing(spark: SparkSession):
    """Tables written within go when the block ends. Gives the folder outside, for what is to stay."""
    context = spark.sparkContext
    outside = _folder(spark)
    context._tracewright_inside = [*getattr(context, "_tracewright_inside", []), f"passing-{uuid.uuid4().hex}"]
    try:
        yield outside
    finally:
        inside = _folder(spark)
        context._tracewright_inside = context._tracewright_inside[:-1]
        _delete(spark, inside)


def vectorised(kind: str):
    """A pandas function as a Column function, made when it is first used in a session."""

    def wrap(f):
        def call(*columns):
            ship(SparkSession.active())
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap
