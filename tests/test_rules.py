"""Hand-made cases at the edges of the rules."""

import math

import pytest
from pyspark.sql import functions as F

from framewright import schema
from framewright.functions import formatting as fmt
from framewright.operators import anomalies, audio, frames, images, packets, sync, timeline
from framewright.plans import adapter


def log(spark, rows):
    """Packets of media 1: (idx, stream, ts or None, flags)."""
    return spark.createDataFrame([(1, i, s + 4, s, None if t is None else int(t * 90000), 100, f, t) for i, s, t, f in rows], "media_id long, idx long, stream_index int, stream_type int, pts long, size int, flags int, ts double")


def stream(spark, times):
    return log(spark, [(i, 0, t, 0) for i, t in enumerate(times)])


def kinds(df):
    return [(r["idx"], r["type"]) for r in df.orderBy("idx").collect()]


def test_small_steps_back_are_no_event(spark):
    assert kinds(anomalies.back_and_jump(stream(spark, [1.0, 0.9995, 0.998]))) == [(2, "timestamp_back")]


def test_a_step_of_two_seconds_is_no_jump(spark):
    assert kinds(anomalies.back_and_jump(stream(spark, [0.0, 2.0, 4.0001]))) == [(2, "timestamp_jump")]


def test_missing_timestamps_are_reported_once_and_skipped(spark):
    p = stream(spark, [0.0, None, None, 2.5])
    assert kinds(anomalies.missing_timestamps(p)) == [(1, "missing_timestamp")]
    assert kinds(anomalies.back_and_jump(p)) == [(3, "timestamp_jump")]
    log_ = anomalies.event_log(p).orderBy("event_idx").collect()
    assert [(r["event_idx"], r["severity"], r["type"]) for r in log_] == [(0, "warning", "missing_timestamp"), (1, "warning", "timestamp_jump")]


def test_normalize_uses_dts_and_survives_bad_time_bases(spark):
    p = spark.createDataFrame([(1, 0, 0, None, 900, 1, 0), (1, 1, 1, 5, None, 1, 0), (1, 2, 9, 5, None, 1, 0)], "media_id long, idx long, stream_index int, pts long, dts long, size int, flags int")
    s = spark.createDataFrame([(1, 0, 0, 1, 90000), (1, 1, 1, 1, 0)], "media_id long, stream_index int, stream_type int, tb_num int, tb_den int")
    rows = {r["idx"]: (r["stream_type"], r["ts"]) for r in packets.normalize(p, s).collect()}
    assert rows == {0: (0, 0.01), 1: (1, None), 2: (-1, None)}


def test_groups_of_pictures(spark):
    f = spark.createDataFrame([(1, i, k, 0, i / 10) for i, k in enumerate([False, False, True, False, True])], "media_id long, fidx long, is_key boolean, frame_type int, ts double")
    got = [(r["gop_index"], r["gop_position"]) for r in frames.assign_gops(f).orderBy("fidx").collect()]
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)]
    assert frames.gop_summary(frames.assign_gops(f)).agg(F.sum("total_frames")).head()[0] == 5


def test_sync_pairs_with_the_last_of_the_other_kind(spark):
    p = log(spark, [(0, 1, 1.0, 0), (1, 0, 1.1, 0), (2, 0, 1.2, 0), (3, 1, 1.3, 0)])
    rows = sync.pair(p).orderBy("sync_idx").collect()
    assert [round(r["diff_ms"]) for r in rows] == [-100, -200, 100]
    assert [r["audio_anchor"] for r in rows] == [False, False, True]


def test_sampling(spark):
    f = spark.range(7).select(F.lit(1).alias("media_id"), F.col("id").alias("fidx"))
    assert [r["fidx"] for r in frames.every_nth(f, 3).orderBy("fidx").collect()] == [0, 3, 6]
    a = spark.range(45).select(F.lit(1).cast("long").alias("media_id"), F.col("id").alias("fidx"), F.col("id").alias("arrival"), (F.col("id") / 10).alias("ts"))
    none = spark.createDataFrame([], "media_id long, fidx long, arrival long, ts double, is_key boolean")
    events = spark.createDataFrame([], "media_id long, event_idx long, packet_idx long, ts double, type string")
    assert [r["label"] for r in timeline.timeline(none, a, events).orderBy("timeline_idx").collect()] == ["#19", "#39"]


def test_short_audio_has_a_waveform_and_no_spectrum(spark):
    a = spark.createDataFrame([(1, 0, 0.0, 48000, 1, [1] * 7), (1, 1, 0.0, 48000, 2, [-32768] * 600), (1, 2, 0.0, 48000, 1, [])], "media_id long, idx long, ts double, sample_rate int, channels int, samples array<smallint>")
    rows = {r["idx"]: r for r in audio.visualization(a).collect()}
    assert (len(rows[0]["waveform"]), len(rows[0]["spectrum"])) == (7, 0)
    assert rows[1]["level"] == 1.0 and len(rows[1]["waveform"]) == 128 and len(rows[1]["spectrum"]) == 32
    assert rows[2]["level"] == 0.0 and rows[2]["waveform"] == []


def test_spectrum_expression_equals_numpy(spark):
    wave = [math.sin(i / 3) / 2 for i in range(100)]
    df = spark.createDataFrame([(wave,)], "w array<double>")
    a, b = df.select(audio.spectrum(F.col("w")).alias("a"), audio.spectrum_expression(F.col("w")).alias("b")).head()
    assert a == pytest.approx(b, abs=1e-12)


def test_flags(spark):
    df = spark.createDataFrame([(31,), (0,)], "f int").select(fmt.flag_text(F.col("f")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["KEY|CORRUPT|DISCARD|TRUSTED|DISPOSABLE", "-"]


def test_texts(spark):
    one = spark.range(1)
    show = lambda c: one.select(c.alias("x")).head()["x"]
    assert show(fmt.duration_text(F.lit(3723000))) == "1 h 2 min 3 s"
    assert show(fmt.duration_text(F.lit(0))) == ""
    assert show(fmt.bitrate_report(F.lit(1500000))) == "1 Mbps"
    assert show(fmt.fourcc(F.lit(0x31637661))) == "avc1"
    assert show(fmt.display_aspect(F.lit(1920), F.lit(1080), F.lit(0), F.lit(1))) == "1.778"
    assert show(fmt.hdr_class(F.lit("PQ"), F.lit(False), F.lit(True))) == "HDR10"
    assert show(fmt.container_id(F.lit("isom"), F.lit("iso2"))) == "isom (iso2)"
    assert show(fmt.metadata(F.create_map(F.lit("comment"), F.lit("c")), "description", "comment")) == "c"
    assert show(fmt.pcm_duration_ms(F.lit(176400), F.lit(44100), F.lit(2), F.lit(16))) == 1000
    assert show(fmt.mastering_luminance(F.lit(0.005), F.lit(1000.0))) == "0.0 - 1000.0 cd/m2"
    assert show(fmt.frame_bytes(F.lit(3), F.lit(2), F.lit("YUV420P"))) is None


def test_empty_tables(spark):
    empty = spark.createDataFrame([], schema.PACKETS)
    assert packets.stats(empty).count() == anomalies.event_log(empty).count() == sync.pair(empty).count() == sync.summary(sync.pair(empty)).count() == 0


def test_results_do_not_depend_on_partitions(spark, data):
    p = adapter.packets(spark, data)
    views = [lambda p: anomalies.event_log(p), lambda p: sync.pair(p), lambda p: frames.assign_gops(frames.numbered(adapter.video_arrivals(p)))]
    for view in views:
        one, many = (sorted(map(str, view(p.repartition(n)).collect())) for n in (1, 13))
        assert one == many


def test_faces(spark):
    boxes = spark.createDataFrame([(1, 1, 10, 20, 100, 50)], "media_id long, frame_idx long, x int, y int, width int, height int")
    r = images.face_landmarks(boxes).head()
    assert (r["left_eye"]["x"], r["left_eye"]["y"], r["right_mouth"]["x"]) == (40, 40, 75)
    with pytest.raises(NotImplementedError):
        images.detect_faces(boxes, None)


@pytest.mark.parametrize("segment", [1, 7, 500])
def test_segments_give_what_whole_windows_give(spark, data, segment):
    p = adapter.packets(spark, data)
    video = adapter.video_arrivals(p)
    views = [
        lambda n: sync.pair(p, n),
        lambda n: anomalies.back_and_jump(p, segment=n),
        lambda n: frames.assign_gops(frames.numbered(video, n), n).select("media_id", "fidx", "arrival", "gop_index", "gop_position"),
    ]
    for view in views:
        assert sorted(map(str, view(None).collect())) == sorted(map(str, view(segment).collect()))


def test_seek_ties_and_targets_without_key_packets(spark):
    p = log(spark, [(0, 0, 1.0, 0), (1, 0, 2.0, 1), (2, 0, 2.0, 1), (3, 0, 1.5, 1)])
    targets = spark.createDataFrame([(1, 0.5), (1, 1.5), (1, 2.0), (1, 9.0), (2, 9.0)], "media_id long, target double")
    got = {(r["media_id"], r["target"]): (r["seek_ts"], r["seek_idx"]) for r in packets.seek(p, targets).collect()}
    assert got == {(1, 0.5): (None, None), (1, 1.5): (1.5, 3), (1, 2.0): (2.0, 2), (1, 9.0): (2.0, 2), (2, 9.0): (None, None)}


def test_running_average_equals_the_recurrence(spark):
    import random

    rng = random.Random(3)
    for n, resets in ((5, ()), (200, ()), (200, (50, 150)), (30, (29,))):
        diffs = [20000.0 if i in resets else rng.uniform(-900, 900) for i in range(n)]
        cum, k, coef = 0.0, 0, 0.7943282347
        for x in diffs:
            cum, k = (0.0, 0) if abs(x / 1000) >= 10 else (x / 1000 + coef * cum, k + 1)
        df = spark.createDataFrame([(1, i, x) for i, x in enumerate(diffs)], "media_id long, sync_idx long, diff_ms double")
        r = sync.running_average(df).head()
        assert r["counted"] == k and (r["avg_diff"] is None if k < 20 else r["avg_diff"] == pytest.approx(cum * (1 - coef), abs=1e-8))


def test_second_audio_streams_and_unknown_ones_count_by_type(spark):
    p = spark.createDataFrame([(1, 0, 5, 1, 10), (1, 1, 7, 1, 10), (1, 2, 0, 0, 10), (1, 3, 9, -1, 10)], "media_id long, idx long, stream_index int, stream_type int, size int").withColumns({"flags": F.lit(0), "ts": F.col("idx") * 0.1})
    r = packets.stats(p).head()
    assert (r["video_packets"], r["audio_packets"]) == (1, 2) and packets.summary(p).head()["other"] == 1


def test_throttles(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate((0.0, 50.0, 100.0, 20.0, None, 0.0, 101.0))], "media_id long, idx long, v double")
    assert sorted(r["idx"] for r in timeline.throttled(rows, "v", 100).collect()) == [0, 2, 5, 6]
    assert sorted(r["idx"] for r in timeline.throttled(rows, "v", 100, both_ways=False).collect()) == [0, 2]


def test_gates_and_headers(spark):
    p = log(spark, [(i, 0, float(i), 0) for i in range(6)])
    on = spark.createDataFrame([(1, "stream", 1, True), (1, "stream", 4, False), (1, "frames", 0, True)], "media_id long, analyzer string, at long, on boolean")
    assert [r["idx"] for r in packets.gated(p, on, "stream").orderBy("idx").collect()] == [1, 2, 3]
    data = p.select("media_id", "stream_index", "idx", F.unhex(F.lit("0000000265")).alias("data"))
    heads = spark.createDataFrame([(1, 4, bytearray(b"\x67"))], "media_id long, stream_index int, header binary")
    got = [r["data"].hex() for r in packets.annex_b(data, headers=heads).orderBy("idx").collect()]
    assert got[0] == "670000000165" and set(got[1:]) == {"0000000165"}


#: Statistics of a media as the reports take them; rates and durations are added.
FACTS = {"total_packets": 8, "total_bytes": 4096, "video_packets": 5, "audio_packets": 3, "current_bitrate_bps": 1, "avg_bitrate_bps": 1, "peak_bitrate_bps": 1, "gop_size": 1, "max_gop_size": 1, "key_frame_count": 1, "avg_packet_size": 1, "max_packet_size": 1, "min_packet_size": 1}
#: Exact ties in binary, decimals that only look like ties, their neighbours, and long ones.
AWKWARD = [0.0, 0.125, 0.375, 0.425, 0.625, 0.285, 0.575, 1.005, 1.015, 9.995, 0.005, math.nextafter(0.125, 1), math.nextafter(0.125, 0), 12345678.125, 123456789.005]


def facts(spark):
    from pyspark.sql import Row

    return spark.createDataFrame([Row(media_id=i, current_fps=x, avg_fps=x, duration_seconds=x, **FACTS) for i, x in enumerate(AWKWARD)])


def test_summaries_round_rates_as_printf_does(spark):
    from framewright.sinks import report

    got = [r["summary"] for r in report.summaries(facts(spark)).orderBy("media_id").collect()]
    assert got == [report.summary({**FACTS, "avg_fps": x, "duration_seconds": x}) for x in AWKWARD]


def test_texts_round_rates_as_printf_does(spark):
    from framewright.sinks import report

    got = [r["report"] for r in report.texts(facts(spark)).orderBy("media_id").collect()]
    assert got == [report.text({**FACTS, "current_fps": x, "avg_fps": x, "duration_seconds": x}) for x in AWKWARD]


def test_json_numbers_are_those_of_duckdb(spark):
    import duckdb

    from framewright.sinks import report

    con = duckdb.connect()
    rows = report.to_json(facts(spark).withColumn("max_gop_size", F.when(F.col("media_id") > 0, F.col("max_gop_size")))).orderBy("media_id").collect()
    for i, (x, r) in enumerate(zip(AWKWARD, rows)):
        values = {**FACTS, "max_gop_size": 1 if i else None, "current_fps": x, "avg_fps": x, "duration_seconds": x}
        fields = ", ".join(f"'{c}', " + (f"round({values[c]!r}::double, 2)" if isinstance(values[c], float) else "null" if values[c] is None else str(values[c])) for c in report.JSON_FIELDS)
        assert r["report"] == con.execute(f"select cast(json_object('video_file', '{i}', 'statistics', json_object({fields})) as varchar)").fetchone()[0]
