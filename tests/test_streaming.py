"""The stream gives what the batch fold gives."""

from lonja.operators import tracker
from lonja.streaming.tracker import follow


def test_stream_equals_batch(spark, tmp_path):
    names = ["in_transit", "in_customs", "cleared", "delivered", "cancelled"]
    events = [(k % 7, i, names[(k * 3 + i * 2) % 5] if i % 3 else names[min(i // 3, 3)]) for k in range(7) for i in range(12)]
    df = spark.createDataFrame(events, "record int, seq int, target string")
    for part in range(3):
        df.where(f"seq >= {part * 4} AND seq < {part * 4 + 4}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = {}

    def keep(batch, _):
        last.update({r["record"]: tuple(r) for r in batch.collect()})

    follow(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert last == {r["record"]: tuple(r) for r in tracker.replay(df).collect()}
