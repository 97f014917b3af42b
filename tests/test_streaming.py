from datetime import datetime, timedelta

from graphweft.streaming.edges import append_to, sessions, windowed_edges

SCHEMA = "ts timestamp, user long, kind string, value double"


def rows():
    start = datetime(2024, 1, 1)
    return [(start + timedelta(seconds=40 * k), k % 3, "a" if k % 2 else "b", float(k)) for k in range(60)]


def test_batch_windows(spark):
    got = windowed_edges(spark.createDataFrame(rows(), SCHEMA), "user", "kind", "ts", value="value").collect()
    want = {}
    for ts, user, kind, value in rows():
        key = (ts.replace(minute=ts.minute // 5 * 5, second=0), user, kind)
        n, total = want.get(key, (0, 0.0))
        want[key] = (n + 1, total + value)
    assert {(r.start, r.src, r.dst): (r.n, r.total) for r in got} == want


def test_sessions(spark):
    got = sessions(spark.createDataFrame(rows(), SCHEMA), "user", "ts", "3 minutes").collect()
    assert sorted((r.key, r.n) for r in got) == [(0, 20), (1, 20), (2, 20)]


def test_stream_equals_batch(spark, tmp_path):
    table = spark.createDataFrame(rows(), SCHEMA)
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    later = spark.createDataFrame([(datetime(2024, 1, 2), 9, "z", 0.0)], SCHEMA)
    later.write.mode("append").parquet(f"{tmp_path}/in")
    found = []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    writer = append_to(windowed_edges(stream, "user", "kind", "ts"), lambda df, _: found.extend(df.collect()), f"{tmp_path}/state")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(90)
    batch = windowed_edges(table, "user", "kind", "ts").collect()
    assert {tuple(r) for r in found} <= {tuple(r) for r in batch} and (not found or len(found) == len(batch))
