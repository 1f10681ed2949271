import pytest

from footmesh.llm import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_empty_tables(spark, small, tmp_path, name):
    for table in ("documents", "eval_items", "mix_targets", "custom_stops", "stops", "operator_stops", "place_aliases"):
        spark.read.parquet(f"{small}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert plans.QUERIES[name](spark, str(tmp_path)).count() == (1 if name in ("p3_audit", "p4_audit") else 0)
