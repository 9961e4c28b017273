"""Intermediate tables that go when nothing reads them."""

import os

from tracewright.sources import scratch


def test_an_owned_folder_stays_while_something_reads_it(spark):
    def stage(n):
        with scratch.owned(spark, "stage") as folder:
            table = scratch.stored(spark.range(n), "table")
            with scratch.under(spark, "inner"):
                scratch.stored(table.where("id > 1"), "other")  # a folder of its own, deleted by whoever opened it
            return folder.removeprefix("file:"), table.selectExpr("id * 2 AS x")

    first, a = stage(10)
    second, b = stage(20)
    derived = a.where("x > 4")
    del a
    scratch.release(spark)
    assert os.path.isdir(first) and os.path.isdir(second) and derived.count() == 7 and b.count() == 20
    del derived
    scratch.release(spark)
    assert not os.path.exists(first) and os.path.isdir(second)
    del b
    scratch.release(spark)
    assert not os.path.exists(second)
    scratch.release(spark)
