import os

import pytest

from tracewright import shipping


def test_tables_stay_or_pass(spark):
    kept = shipping.materialize(spark.range(3), "kept")
    with shipping.passing(spark) as outside:
        gone = shipping.materialize(spark.range(4), "gone")
        with shipping.passing(spark):
            inner = shipping.materialize(spark.range(5), "inner")
        stays = shipping.materialize(gone.filter("id > 0"), "stays", outside)
        assert gone.count() == 4
    where = lambda df: df.inputFiles()[0].removeprefix("file://")
    assert kept.count() == 3 and stays.count() == 3 and os.path.exists(where(kept)) and not os.path.exists(where(gone)) and not os.path.exists(where(inner))


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://there:7077"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shipping.scratch_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shipping.scratch_dir(Session())
    Context.master = "local[2]"
    assert os.path.isdir(shipping.scratch_dir(Session()))
