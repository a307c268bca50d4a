import datetime as dt
import time

from phonoduct.streaming import events as E

T = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, make, mode="append"):
    rows = [(1, T + dt.timedelta(minutes=m), v) for m, v in [(0, 1.0), (5, 1.0), (9, 2.0), (100, 3.0), (400, 9.0), (900, 9.0)]]
    spark.createDataFrame(rows, "k int, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k int, ts timestamp, v double").parquet(str(tmp_path / "in"))
    name = f"out_{make.__name__}"
    q = make(s).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return spark.sql(f"select * from {name}").collect()


def test_framed_stream(spark, tmp_path):
    def framed(s):
        return E.framed_stats(s, "k", "ts", "v", "10 minutes", "10 minutes")

    got = {r.start: (r.n, r["min"], r["max"]) for r in run(spark, tmp_path, framed)}
    assert got[T] == (3, 1.0, 2.0)


def test_session_stream(spark, tmp_path):
    def sessions(s):
        return E.sessions(s, "k", "ts", "30 minutes")

    assert (T, 3) in {(r.start, r.n) for r in run(spark, tmp_path, sessions)}


def test_repeated_stream(spark, tmp_path):
    def repeated(s):
        return E.repeated_values(s, "k", "ts", "v")

    assert [(r.n) for r in sorted(run(spark, tmp_path, repeated), key=lambda r: r.start)] == [2, 1, 1]


def test_repeated_stream_takes_late_events_in_their_place(spark, tmp_path):
    """Events that come out of order within the watermark's delay join the runs of their time; later ones are left out."""
    files = [[(0, 1.0), (10, 1.0), (30, 2.0)], [(20, 1.0), (40, 2.0)], [(35, 2.0), (300, 5.0)], [(301, 5.0), (900, 6.0)], [(5, 7.0), (2000, 0.0)]]
    folder = tmp_path / "in"
    folder.mkdir()
    s = spark.readStream.schema("k int, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(folder))
    for i, rows in enumerate(files):
        d = spark.createDataFrame([(1, T + dt.timedelta(minutes=m), v) for m, v in rows], "k int, ts timestamp, v double").coalesce(1)
        d.write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # files are read in order of their times
    q = E.repeated_values(s, "k", "ts", "v").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    minutes = lambda x: int((x - T).total_seconds() // 60)
    got = sorted((minutes(r.start), minutes(r.end), r.n) for r in spark.sql("select * from late").collect())
    assert got == [(0, 20, 3), (30, 40, 3), (300, 301, 2)]  # at 900 a run is open, as the event at 2000 waits
