"""Session helpers: sizing and runtime settings applied to any session."""

from tallyframe.session import configure, sizing_conf


def test_sizing_scales_with_input():
    small, big = sizing_conf(50 * 1024 ** 2), sizing_conf(100 * 1024 ** 4)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert big["spark.sql.shuffle.partitions"] == "100000"
    assert big["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "128m"


def test_configure_sets_runtime_conf(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Almaty")
    configure(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.checkpoint.dir")
