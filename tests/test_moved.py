"""How many rows the cleaners of triples move: what is written once is not worked out again for every result."""

import pytest

from trellis.plans import cleaner_queries as C
from trellis.plans import prescription_queries as Q

SF = "/root/testdata/sf0.01"


@pytest.fixture
def no_broadcast(spark):
    """As on large tables: nothing is small enough to be sent to all tasks."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def rows_moved(spark, run):
    """Rows that went through shuffles while ``run`` ran."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        stages, n = store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None), 0
        for i in range(stages.size()):
            n += stages.apply(i).shuffleWriteRecords()
        return n

    before = total()
    run().write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


@pytest.mark.parametrize(("name", "most"), [("prescription_edges", 10), ("prescription_nodes", 10), ("prescription_report", 10)])
def test_prescriptions(spark, no_broadcast, name, most):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    n = rows_moved(spark, lambda: getattr(Q, name)(spark, SF))
    assert n < most * lines


@pytest.mark.parametrize(("name", "most"), [("terminology_edges", 8), ("terminology_nodes", 8), ("terminology_report", 8)])
def test_terminology(spark, no_broadcast, name, most):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    n = rows_moved(spark, lambda: getattr(C, name)(spark, SF))
    assert n < most * lines
