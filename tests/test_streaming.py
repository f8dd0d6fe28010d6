import datetime as dt

from tessera.streaming.bursts import live_bursts, live_sessions


def test_stream_equals_batch(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 10)
    rows = [("a", at + dt.timedelta(minutes=5 * i)) for i in range(8)] + [("b", at + dt.timedelta(hours=2 * i)) for i in range(8)]
    df = spark.createDataFrame(rows, "caller string, ts timestamp")
    df.write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "calls"))
    for k, make in enumerate((live_bursts, live_sessions)):
        query = make(stream).writeStream.outputMode("append" if k else "update").format("memory").queryName(f"live{k}").option("checkpointLocation", str(tmp_path / f"c{k}")).start()
        query.processAllAvailable()
        query.stop()
    assert {r["caller"] for r in spark.sql("SELECT * FROM live0").collect()} == {"a"}
    assert {tuple(r) for r in live_bursts(df).collect()} == {tuple(r) for r in spark.sql("SELECT * FROM live0").collect()}
    sessions = {tuple(r) for r in live_sessions(df).collect()}
    assert {tuple(r) for r in spark.sql("SELECT * FROM live1").collect()} <= sessions and len(sessions) == 9
