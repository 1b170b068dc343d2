"""Line items are dealt by key before their least rows are sought, so that no task sorts its whole piece of a file."""

from fieldloom.sources.relations import Relations


def test_least_rows_are_sought_after_the_shuffle(spark):
    plan = Relations(spark, "/root/testdata/sf0.001").lines._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min") < plan.index("Exchange hashpartitioning(l_orderkey")
