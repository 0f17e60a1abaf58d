import pytest

from marlstone.llm import common


@pytest.mark.parametrize("given, bounded", [("64MB", True), ("256m", True), ("2m", False), ("1024", False)])
def test_batches_are_bounded_unless_the_session_asks_for_less(spark, given, bounded):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, given)
        common.bounded_batches(spark)
        assert spark.conf.get(name) == (str(common.BATCH_BYTES) if bounded else given)
    finally:
        spark.conf.set(name, before)


def test_scratch_goes_and_results_stay(spark):
    import os

    folder = common.scratch_dir(spark)
    there = lambda: {n.split("-")[0] for n in os.listdir(folder) if n.startswith("scratchtest")}
    df = spark.range(3)
    with common.scratch(spark):
        common.materialize(df, "scratchtest1")
        with common.scratch(spark):
            inner = common.result(common.materialize(df, "scratchtest2"), "scratchtest3")
        assert there() == {"scratchtest1", "scratchtest3"} and inner.count() == 3
        outer = common.result(inner, "scratchtest4")
    assert there() == {"scratchtest4"} and outer.count() == 3
    with pytest.raises(ValueError), common.scratch(spark):
        common.materialize(df, "scratchtest5")
        raise ValueError
    assert there() == {"scratchtest4"}
    common.materialize(df, "scratchtest6")
    assert there() == {"scratchtest4", "scratchtest6"}
