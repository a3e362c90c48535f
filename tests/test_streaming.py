from quern.streaming import catalog

SCHEMA = "name string, ordinal long, size long"


def test_last_copy_wins_across_batches(spark, tmp_path):
    drop, root, check = (str(tmp_path / x) for x in ("drop", "root", "check"))
    spark.createDataFrame([("a", 0, 1), ("b", 1, 1)], SCHEMA).coalesce(1).write.parquet(drop)
    catalog.follow(spark, drop, SCHEMA, root, check).awaitTermination()
    spark.createDataFrame([("a", 2, 2), ("c", 3, 1)], SCHEMA).coalesce(1).write.mode("append").parquet(drop)
    catalog.follow(spark, drop, SCHEMA, root, check).awaitTermination()
    assert {tuple(r) for r in catalog.current(spark, root).select("name", "size").collect()} == {("a", 2), ("b", 1), ("c", 1)}
