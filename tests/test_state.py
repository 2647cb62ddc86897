"""Snapshots of the lifecycle state under several writers."""

import pytest

from lodestone import storage
from lodestone.operators.retrievers import RECORD
from lodestone.sources.state import StateChanged, StateStore


def test_of_two_writers_one_is_told(spark, tmp_path):
    records = lambda *units: spark.createDataFrame([(u, u, "f", "t", "t", None, "active") for u in units], RECORD)
    one, two = StateStore(spark, f"file://{tmp_path}/state"), StateStore(spark, f"file://{tmp_path}/state")
    assert one.write(records("a")) == 1
    seen = two.versions()[-1]
    assert one.write(records("a", "b")) == 2
    with pytest.raises(StateChanged):
        two.write(records("a", "c"), after=seen)
    assert sorted(r.source_unit_id for r in two.read().collect()) == ["a", "b"]
    # A claim without a snapshot holds its number until it is given up.
    assert storage.claimed(spark, f"file://{tmp_path}/state/claim-3") and not storage.claimed(spark, f"file://{tmp_path}/state/claim-3")
    with pytest.raises(StateChanged):
        two.write(records("c"))
    two.give_up(3)
    assert two.write(records("c")) == 3 and two.versions() == [2, 3]
    two.give_up(3)  # a whole snapshot keeps its number
    with pytest.raises(StateChanged):
        one.write(records("d"), after=2)


def test_a_replaced_file_is_another_version(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    spark.range(5).coalesce(1).write.parquet(path)
    before = storage.version(spark, path)
    assert storage.version(spark, path) == before
    spark.range(5).coalesce(1).write.mode("overwrite").parquet(path)
    assert storage.version(spark, path) != before
