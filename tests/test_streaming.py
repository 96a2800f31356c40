import datetime as dt

from promptlens.streaming import sessions


def run(spark, tmp_path, rows, made, name):
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = made(stream).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return spark.table(name).collect()


def test_sessions_keep_the_last_messages_and_close(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    first = [(i, at(i), 1, "click") for i in range(30)] + [(50, at(1), 2, "click"), (51, at(2), 2, "clear"), (52, at(3), 2, "click")]
    later = [(99, at(600), 3, "click")]
    got = run(spark, tmp_path, [first, later], sessions.session_messages, "sessions")
    assert (1, 20, 30, False) in [tuple(r) for r in got] and (2, 1, 3, False) in [tuple(r) for r in got]
    assert {r.user_id for r in got if r.closed} <= {1, 2}


def test_windowed_counts(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    got = run(spark, tmp_path, [[(i, at(i), 1, "click") for i in range(10)]], sessions.audit_counts, "counts")
    assert sorted(r.n for r in got) == [5, 5]
