import pytest

from scriptorium.sources import sealed
from scriptorium.streaming import events


def test_sealed_paths(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k int, t string")
    where = str(tmp_path / "out")
    sealed.write_sealed(df, where)
    assert sealed.read_sealed(spark, where).count() == 2
    with pytest.raises(Exception):
        sealed.write_sealed(df, where)
    df.write.mode("append").parquet(where + "/data")
    with pytest.raises(ValueError):
        sealed.read_sealed(spark, where)


def test_strict_leaves(spark):
    rows = [(1, '{"a": [1.50, -0, null, {}], "b/c": {"d": [true, "x"]}, "e": []}'), (2, '{"a": 1, "a": 2}'), (3, "NaN"), (4, "[1,"), (5, None), (6, '"s"')]
    got = {}
    for r in sealed.json_leaves(spark.createDataFrame(rows, "k int, body string"), "k", "body").collect():
        got.setdefault(r.k, []).append((r.pointer, r.type, r.lexeme, r.problem))
    assert got[1] == [("/a/0", "number", "1.50", None), ("/a/1", "number", "-0", None), ("/a/2", "null", None, None), ("/a/3", "object", None, None), ("/b~1c/d/0", "bool", "true", None), ("/b~1c/d/1", "string", "x", None), ("/e", "array", None, None)]
    assert got[2][0][3] == "repeated key" and got[3][0][3] == got[4][0][3] == "not JSON" and 5 not in got and got[6] == [("", "string", "s", None)]


def test_stream_equals_batch(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    rows = [(t + dt.timedelta(minutes=7 * i), "ab"[i % 2], float(i)) for i in range(60)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "ts timestamp, kind string, value double").repartition(3).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, kind string, value double").parquet(src)
    q = events.build_in_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    built = spark.read.parquet(str(tmp_path / "out"))
    want = events.windowed_counts(spark.read.parquet(src), "ts", "kind").collect()
    assert sorted(map(tuple, events.windowed_counts(built.drop("batch"), "ts", "kind").collect())) == sorted(map(tuple, want)) and built.count() == 60


def test_folded_stream_equals_batch(spark, tmp_path):
    import random

    from scriptorium.streaming import folds

    rng = random.Random(2)
    rows = [(f"t{rng.randint(0, 5)}", rng.randint(0, 9), None) for _ in range(80)]
    rows = [(k, n, f"s{n % 3}") for k, n, _ in rows] + [(None, 1, "x"), ("t1", None, "x")]
    src = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "key string, event_no int, status string")
    df.repartition(5).write.parquet(src)
    stream = spark.readStream.schema("key string, event_no int, status string").option("maxFilesPerTrigger", 2).parquet(src)
    seen = {}

    def keep(batch, number):
        for r in batch.collect():
            seen[r.key] = tuple(r)

    q = folds.latest_states(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert set(seen.values()) == {tuple(r) for r in folds.latest_states_batch(df).collect()} and len(seen) > 3
