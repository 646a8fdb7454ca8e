from framewright.operators import anomalies, packets, sync
from framewright.plans import adapter
from framewright.sources.files import stream_packets
from framewright.streaming import live

DDL = "media_id long, idx long, stream_index int, stream_type int, pts long, size int, flags int, ts double"


def feed(spark, data, tmp_path, parts=3):
    """The packet log as files in arrival order, one a micro-batch, and as a stream over them."""
    p = adapter.packets(spark, data).select("media_id", "idx", "stream_index", "stream_type", "pts", "size", "flags", "ts").persist()
    top = p.agg({"idx": "max"}).head()[0] + 1
    for i in range(parts):
        p.filter(f"idx >= {top * i // parts} and idx < {top * (i + 1) // parts}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return p, stream_packets(spark, str(tmp_path / "in"), ddl=DDL, files_per_trigger=1)


def run(spark, df, name, tmp_path, mode="append"):
    q = live.start(df, name, str(tmp_path / name), mode, every=None)
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_streams_agree_with_batches(spark, data, tmp_path):
    p, s = feed(spark, data, tmp_path)
    got = run(spark, live.anomalies(s), "live_anomalies", tmp_path)
    want = anomalies.missing_timestamps(p).unionByName(anomalies.back_and_jump(p).drop("delta"))
    cols = ["media_id", "stream_index", "idx", "pts", "ts", "type"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    got = run(spark, live.sync(s), "live_sync", tmp_path)
    assert sorted(map(str, got.collect())) == sorted(map(str, sync.pair(p).collect()))


def test_rates_by_second(spark, data, tmp_path):
    p, s = feed(spark, data, tmp_path)
    got = {(r["media_id"], r["second"]): (r["bps"], r["packets"], r["video_fps"]) for r in run(spark, live.rates(s, late="100 seconds"), "live_rates", tmp_path).collect()}
    want = {(r["media_id"], r["second"]): (r["bps"], r["packets"], r["video_fps"]) for r in packets.per_second(p).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_running_stats_replace_rows(spark, data, tmp_path):
    p, s = feed(spark, data, tmp_path)
    kept = {}

    def sink(batch, _):
        kept.update({r["media_id"]: r["total_packets"] for r in batch.collect()})

    q = live.start(live.running_stats(s), "live_stats", str(tmp_path / "stats"), "update", every=None, sink=sink)
    q.awaitTermination(120)
    assert kept == {r["media_id"]: r["total_packets"] for r in packets.stats(p).collect()}
