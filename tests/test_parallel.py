from corpusmith.plans import files  # noqa: F401
from corpusmith.plans.relational import ORACLES, QUERIES
from tests.oracle import DATA, assert_same, connect


def test_lines_belong_together_where_ranges_are_cut_by_a_sample(spark):
    name = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        assert_same(QUERIES["source_parallel"](spark, f"{DATA}/sf0.001"), connect("sf0.001"), ORACLES["source_parallel"])
    finally:
        spark.conf.set(name, before)
