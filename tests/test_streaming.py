import pytest
from pyspark.sql import functions as F

from kinograph.operators.cohort import retained_sequences
from kinograph.operators.throughput import tumbling_counts as batch_counts
from kinograph.streaming import operators as S


@pytest.fixture
def stream(spark, tmp_path):
    """Writes frames as files that a stream reads one by one."""

    def make(*frames):
        for k, frame in enumerate(frames):
            frame.coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
        return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))

    return make


def finished(query):
    query.processAllAvailable()
    query.stop()


def test_tumbling_counts_equal_batch(spark, stream, rows):
    seconds = [(s,) for s in (0, 5, 29, 30, 61, 95, 4000)]
    frame = spark.createDataFrame(seconds, "s long").select(F.timestamp_seconds("s").alias("ts"))
    counted = S.tumbling_counts(stream(frame), late="1 minute")
    finished(counted.writeStream.format("memory").queryName("counts").outputMode("append").start())
    assert rows(spark.table("counts")) == rows(batch_counts(frame).where("start < timestamp_seconds(3900)"))


def test_repeated_deliveries(spark, stream, rows):
    schema = "event_id long, user_id string, item_id string, timestamp long"
    one = spark.createDataFrame([(0, "1", "2", 1000), (1, "01", "2", 1000), (2, "x", "2", 1000)], schema)
    two = spark.createDataFrame([(3, "1", "2", 1000), (4, "1", "3", 1000)], schema)
    finished(S.usable_interactions(stream(one, two)).writeStream.format("memory").queryName("usable").outputMode("append").start())
    assert rows(spark.table("usable"), "user", "item") == [(1, 2), (1, 3)]


def test_last_events_equal_batch(spark, stream):
    data = [(k % 3, k, (k * 37) % 50, k) for k in range(60)]
    schema = "user long, item long, ts long, event_id long"
    parts = [spark.createDataFrame(data[a : a + 20], schema) for a in (0, 20, 40)]
    query = S.last_events(stream(*parts)).writeStream.format("memory").queryName("last").outputMode("update").start()
    finished(query)
    final = spark.table("last").groupBy("user").agg(F.max_by("kept", "events").alias("kept")).collect()
    batch = retained_sequences(spark.createDataFrame(data, schema))
    for row in final:
        expected = batch.where(F.col("user") == row.user).orderBy("position").collect()
        assert row.kept == ",".join(f"{r.ts}:{r.event_id}:{r.item}" for r in expected)


def test_upsert_batches(spark, stream):
    frames = [spark.createDataFrame(d, "k int, n int, v string") for d in ([(1, 0, "a"), (1, 1, "b")], [(2, 2, "c")])]
    seen = {}
    query = S.upsert_batches(stream(*frames), ["k"], ["n"], lambda batch, number: seen.update({r.k: r.v for r in batch.collect()}))
    finished(query)
    assert seen == {1: "b", 2: "c"}
