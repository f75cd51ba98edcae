from caseweave.streaming import detectors


def drain(df, mode="append"):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table("out").collect()


def stream(spark, folder, rows, schema, last):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/1")
    spark.createDataFrame(last, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/2")
    typed = spark.read.parquet(f"{folder}/1").schema
    return spark.readStream.schema(typed).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_spray(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1, 10)
    rows = [(t + timedelta(minutes=i), f"u{i}", "ip1", "50126") for i in range(6)] + [(t, "u1", "ip2", "50126"), (t, "u9", "ip1", ""), (t + timedelta(minutes=1), "u1", "ip1", "50126"), (t, None, "ip1", "50126")]
    s = stream(spark, str(tmp_path / "s"), rows, "ts timestamp, user string, ip string, code string", [(t + timedelta(days=1), "z", "ip9", "50126")])
    got = drain(detectors.spray_stream(s))
    assert {r.ip for r in got} == {"ip1"} and max((r.users, r.failures) for r in got) == (6, 8)


def test_sessions(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1, 10)
    rows = [(t, "a", "harddelete"), (t + timedelta(minutes=20), "a", "send"), (t + timedelta(hours=3), "a", "send")]
    s = stream(spark, str(tmp_path / "e"), rows, "ts timestamp, actor string, op_lower string", [(t + timedelta(days=1), "z", "send")])
    got = sorted((r.events, r.deletes) for r in drain(detectors.session_stream(s)) if r.actor == "a")
    assert got == [(1, 0), (2, 1)]


def test_lures(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1, 10)
    schema = "id long, user string, ts timestamp"
    a = stream(spark, str(tmp_path / "a"), [(1, "u", t), (2, "u", t - timedelta(hours=2))], schema, [(9, "z", t)])
    b = stream(spark, str(tmp_path / "b"), [(5, "u", t + timedelta(minutes=10)), (6, "v", t)], schema, [(8, "y", t)])
    assert [(r.lure, r.token) for r in drain(detectors.lure_stream(a, b))] == [(1, 5)]
