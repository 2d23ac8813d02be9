"""Tables written on the way are deleted, the result and tables of others stay."""

import os

import pytest

from marketspark.sources.snapshot import materialize, shared_dir, written


def _tables(spark):
    root = shared_dir(spark)
    root = root.removeprefix("file:")
    return {d for _, names, _ in os.walk(root) for d in names}


def test_written_keeps_only_its_result(spark):
    outside = materialize(spark.range(5), "outside")
    before = _tables(spark)

    def inner():
        return materialize(spark.range(3), "step").join(outside, "id")

    def outer():
        part = written(spark, inner, "part")
        assert part.count() == 3
        return part.union(materialize(spark.range(2), "other"))

    result = written(spark, outer, "result")
    assert sorted(r.id for r in result.collect()) == [0, 0, 1, 1, 2]
    assert {d.rsplit("-", 1)[0] for d in _tables(spark) - before} == {"result"}
    assert outside.count() == 5


def test_written_that_fails_leaves_no_open_step(spark):
    def fails():
        raise ValueError("no result")

    with pytest.raises(ValueError):
        written(spark, fails, "never")
    before = _tables(spark)
    materialize(spark.range(1), "after")
    assert len(_tables(spark) - before) == 1
