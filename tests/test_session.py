from __future__ import annotations

import pytest

from granary.plans.session import discard, scratch


def test_scratch_folders_go(spark, tmp_path):
    path = scratch(spark, "some")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    discard(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    with pytest.raises(ValueError):
        discard(spark, str(tmp_path / "mine"))
