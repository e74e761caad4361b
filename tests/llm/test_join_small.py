"""The join to a table that is usually small, when it isn't."""

from pyspark.sql import functions as F

from geoledger.llm import common


def test_copies_for_salts_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    small = common.materialize(spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "small")
    big = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 60).alias("k"))
    got = common.join_small(big, small, ["k"], F.xxhash64("id"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    key = lambda i: 7 if i % 3 == 0 else i % 60
    assert sorted((r.id, r.k, r.v) for r in got.collect()) == [(i, key(i), key(i) * 2 if key(i) < 50 else None) for i in range(1000)]
