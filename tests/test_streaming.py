from datetime import datetime, timedelta

from symgraph.streaming import changes


def test_stream_and_batch_say_the_same(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(1, 0, "a", "write"), (2, 1, "a", "write"), (3, 10, "a", "remove"), (4, 0, "b", "create"), (5, 1, "b", "remove"), (6, 30, "c", "write")]
    events = spark.createDataFrame([(i, t + timedelta(seconds=s), p, op) for i, s, p, op in rows], changes.SCHEMA)
    closing = spark.createDataFrame([(99, t + timedelta(hours=1), "z", "write")], changes.SCHEMA)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.repartition(3).write.parquet(folder)

    def apply(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/{batch_id}")

    def sync():
        changes.start_sync(changes.read_changes(spark, folder), apply, str(tmp_path / "checkpoint"), once=True).awaitTermination()

    sync()
    closing.write.mode("append").parquet(folder)
    sync()  # a second start goes on where the first ended; the late event lets all earlier sessions close
    got = spark.read.option("recursiveFileLookup", "true").parquet(out)
    want = changes.sessions(events)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 4
    gone, again = changes.split_batch(got)
    assert {r["path"] for r in gone.collect()} == {"a", "b"} and {r["path"] for r in again.collect()} == {"c"}
