"""Sizes of shuffled partitions in queries whose sums and sorts need much memory."""

import pytest

from tradewind.plans import catalog
from tradewind.session import with_smaller_partitions

SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
SF = "/root/testdata/sf0.001"


def test_settings_are_the_callers_but_for_the_size(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        session = with_smaller_partitions(spark)
        assert session.conf.get("spark.sql.shuffle.partitions") == "7"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert session.conf.get("spark.sql.session.timeZone") == "UTC"
    assert session.conf.get(SIZE) == "16m"
    assert SIZE not in spark.conf.getAll


def test_a_size_of_the_caller_is_kept(spark):
    spark.conf.set(SIZE, "8m")
    try:
        assert with_smaller_partitions(spark) is spark
    finally:
        spark.conf.unset(SIZE)


@pytest.mark.parametrize("name", ["session_report", "import_stores", "import_invoices", "import_items", "import_counts"])
def test_queries_keep_partitions_small(spark, name):
    df = catalog.load_all()[0][name](spark, SF)
    assert df.sparkSession.conf.get(SIZE) == "16m"
    assert df.count() > 0
