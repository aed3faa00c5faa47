"""State with a time to live: a stream against the static twin, and its size."""

import os

from pyspark.sql import functions as F

from corpusloom.streaming import state

SCHEMA = "user_id bigint, ts timestamp, value double"


def test_state_of_silent_keys_goes(spark, tmp_path):
    def rows(*found):
        return spark.createDataFrame([(k, f"2024-01-01 {at}", v) for k, at, v in found], "user_id bigint, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))

    batches = [
        rows((1, "00:00:00", 1.0), (1, "00:00:10", 2.0), (2, "00:00:05", 5.0), (3, "00:00:01", 7.0), (1, "00:00:05", 3.0)),
        rows((1, "00:00:40", 4.0), (1, "00:00:20", 9.0), (4, "00:00:30", None)),
        rows((1, "00:10:00", 1.5)),
        rows((1, "00:10:01", 2.5), (5, "00:10:02", 6.0)),
    ]
    source, sizes, last = str(tmp_path / "in"), [], {}
    for k, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        out = str(tmp_path / f"out{k}")
        writer = state.last_values(stream, "user_id", n=3, ttl=60, late="1 second").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint"))
        query = writer.foreachBatch(lambda batch, number, out=out: batch.write.mode("overwrite").parquet(f"{out}/{number}")).trigger(availableNow=True).start()
        assert query.awaitTermination(60) and query.exception() is None
        for number in sorted(map(int, os.listdir(out))):
            last |= {r["key"]: (r["n"], r["total"]) for r in spark.read.parquet(f"{out}/{number}").collect()}
        if query.lastProgress:
            sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sizes[-1] < max(sizes)
    whole = batches[0]
    for batch in batches[1:]:
        whole = whole.unionByName(batch)
    twin = {r["key"]: (r["n"], r["total"]) for r in state.last_values_of(whole, "user_id", 3, 60).collect()}
    assert twin == {1: (2, 4.0), 5: (1, 6.0)} and {k: v for k, v in last.items() if v[0]} == twin


def test_last_values_of_a_table(spark):
    rows = [(None, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:00:00", 3.0), (1, None, 9.0), (1, "2024-01-01 00:00:01", None), (2, "2023-01-01 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "user_id bigint, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {tuple(r) for r in state.last_values_of(df, "user_id", 1, 60).collect()} == {(None, 1, 1.0), (1, 1, 3.0)}
    assert state.last_values_of(df.where("false"), "user_id").collect() == []
