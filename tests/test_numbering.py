import pytest
from pyspark.sql import functions as F

from conftest import rows
from hashwave.operators.numbering import numbered


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_numbers_follow_key_and_order(spark, ranges):
    hot = [("hot", i * 7919 % 3000, i) for i in range(3000)]
    data = [*hot, *((k, i % 5, i) for k in ("a", "z", None) for i in range(17)), ("hot", None, -1), ("one", 1, 1)]
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(data, "k string, v int, id int").repartition(5)
        found = rows(numbered(frame, ["k"], ["v", "id"], "at"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    first_null = lambda r: (r[1] is not None, r[1] or 0, r[2])
    expected = [(*r, i) for k in {r[0] for r in data} for i, r in enumerate(sorted((r for r in data if r[0] == k), key=first_null))]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_numbers_without_keys_of_equal_and_of_no_rows(spark):
    same = spark.range(50).select(F.lit(1).alias("v"), F.lit("x").alias("_place"), F.lit("y").alias("number"))
    found = numbered(same, [], ["v"])
    assert found.columns == ["v", "number"]
    assert sorted(r.number for r in found.collect()) == list(range(50))
    assert numbered(same.limit(0), ["v"], ["v"]).count() == 0
