"""First events by keyed state: keys of a bucket share a call and keep apart."""

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import events as stream


@pytest.mark.parametrize("buckets", [1, 3, 256])
def test_keys_of_a_bucket_are_kept_apart(spark, tmp_path, buckets):
    big = 2**60 + 1  # a frame with a null among longs would round it
    schema = "event_id long, user_id long, kind string, ts timestamp"
    parts = [
        [(1, big, "a", "2024-01-01 10:00:00"), (2, None, "a", "2024-01-01 10:00:00"), (3, None, None, "2024-01-01 10:00:00.000123"), (4, big, "a", "2024-01-01 09:00:00")],
        [(5, None, "a", "2024-01-01 09:30:00"), (6, big, "a", "2024-01-01 09:30:00"), (7, 7, "b", "2024-01-01 11:00:00"), (8, None, None, "2024-01-01 11:00:00")],
    ]
    path = lambda x: f"file://{tmp_path}/{x}"
    for rows in parts:
        spark.createDataFrame(rows, "event_id long, user_id long, kind string, t string").select("event_id", "user_id", "kind", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(path("events"))
        live = spark.readStream.schema(schema).parquet(path("events"))
        found = stream.first_by_time(live, ["user_id", "kind"], buckets=buckets)
        assert found.dtypes == [("user_id", "bigint"), ("kind", "string"), ("event_id", "bigint"), ("ts", "timestamp")]
        stream.to_table(found, path("rows"), path("state")).awaitTermination()
    out = spark.read.parquet(path("rows"))
    assert out.count() == 5  # four keys, of which one is corrected
    got = {(r.user_id, r.kind): (r.event_id, r.ts.isoformat(" ")) for r in stream.settled(out, ["user_id", "kind"]).collect()}
    assert got == {(big, "a"): (4, "2024-01-01 09:00:00"), (None, "a"): (5, "2024-01-01 09:30:00"), (None, None): (3, "2024-01-01 10:00:00.000123"), (7, "b"): (7, "2024-01-01 11:00:00")}
