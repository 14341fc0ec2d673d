import datetime as dt
import time

from panelwright.streaming.bars import LateEvents, all_grains, intraday_bars, late_events

T0 = dt.datetime(2024, 1, 1, 9, 0)


def rows(minutes, start=0):
    return [(start + k, T0 + dt.timedelta(minutes=m), "a" if k % 2 else "b", float(k)) for k, m in enumerate(minutes)]


SCHEMA = "event_id long, ts timestamp, event_type string, value double"


def test_stream_equals_batch_on_closed_bars(spark, tmp_path):
    files = [rows(range(0, 30)), rows(range(30, 60), 100), [*rows([62, 70], 200), (300, T0 + dt.timedelta(minutes=1), "a", 999.0)], rows([90], 400)]
    for k, part in enumerate(files):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    late = LateEvents()
    spark.streams.addListener(late)
    query = intraday_bars(stream).writeStream.outputMode("append").format("memory").queryName("bars_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = {tuple(r) for r in spark.table("bars_out").collect()}
    on_time = spark.createDataFrame([r for part in files for r in part if r[0] != 300], SCHEMA)
    expected = {tuple(r) for r in intraday_bars(on_time).collect() if r.ts < T0 + dt.timedelta(minutes=75)}
    assert {r for r in got if r[1] < T0 + dt.timedelta(minutes=75)} == expected
    assert late_events(query) == 1
    for _ in range(100):
        if late.dropped.get(str(query.id)):
            break
        time.sleep(0.1)
    spark.streams.removeListener(late)
    assert late.dropped[str(query.id)] == 1


def test_all_grains_in_one_stream_with_a_restart(spark, tmp_path):
    """Each grain equals its own batch bars, also when the stream goes on from its checkpoint in mid-hour."""
    minutes = [k * 1.7 for k in range(100)]
    parts = [rows(minutes[:40]), rows(minutes[40:70], 100), rows(minutes[70:], 200), rows([400], 300), rows([800], 400)]
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = all_grains(stream).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        query.awaitTermination(240)

    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        if k in (1, 4):
            run()
    got = {tuple(r) for r in spark.read.parquet(out).select("code", "grain", "ts", "open", "high", "low", "close", "volume").collect()}
    events = spark.createDataFrame([r for part in parts[:3] for r in part], SCHEMA)
    for grain in (1, 5, 15, 30, 60):
        want = {(r.code, grain, r.ts, r.open, r.high, r.low, r.close, r.volume) for r in intraday_bars(events, grain).collect()}
        assert {r for r in got if r[1] == grain and r[2] < T0 + dt.timedelta(minutes=240)} == want, grain
