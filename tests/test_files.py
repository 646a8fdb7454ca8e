import numpy as np
import pytest

from framewright import schema
from framewright.operators import images, packets
from framewright.plans import adapter
from framewright.sinks import report, tables
from framewright.sources import files, raw


def test_raw_video(spark, tmp_path):
    raw.register(spark)
    frames = [bytes([i] * 6 * 4) for i in range(5)]
    path = tmp_path / "clip.yuv"
    path.write_bytes(b"".join(frames) + b"12345")
    df = spark.read.format("raw_video").option("frames_per_partition", 2).option("width", 4).option("height", 4).load(str(path))
    assert [(r["idx"], bytes(r["data"])[0]) for r in df.orderBy("idx").collect()] == list(enumerate(range(5)))
    assert [r["idx"] for r in df.filter("idx = 3").collect()] == [3]
    assert [r["idx"] for r in df.filter("idx >= 1 and idx <= 2").orderBy("idx").collect()] == [1, 2]
    other = raw.raw_frames_from(spark, str(path), 4, 4, "YUV420P")
    assert [bytes(r["data"]) for r in other.orderBy("idx").collect()] == frames
    grey = images.decode_raw(df).filter("idx = 2").head()
    assert len(grey["pixels"]) == 16
    tables.write_frames(df, str(tmp_path / "out"), every=2)
    names = [r["name"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("name").collect()]
    assert names == ["frame_00000001.rgb", "frame_00000003.rgb", "frame_00000005.rgb"]


def test_raw_video_too_short(spark, tmp_path):
    raw.register(spark)
    (tmp_path / "a_640x480.yuv").write_bytes(b"1")
    with pytest.raises(Exception, match="shorter"):
        spark.read.format("raw_video").load(str(tmp_path / "a_640x480.yuv")).count()


@pytest.mark.parametrize("fmt", list(raw.PCM_BYTES))
def test_raw_pcm(spark, tmp_path, fmt):
    raw.register(spark)
    order = ">" if fmt.endswith("be") else "<"
    want = np.array([0, 256, -256, 32512, -32768, 512], np.int16)
    data = {
        "u8": lambda: ((want >> 8) + 128).astype(np.uint8).tobytes(), "s16": lambda: want.astype(order + "i2").tobytes(), "s32": lambda: (want.astype(np.int64) << 16).astype(order + "i4").tobytes(),
        "f32": lambda: (want / 32768).astype(order + "f4").tobytes(), "s24": lambda: b"".join((int(x) << 8).to_bytes(3, "big" if order == ">" else "little", signed=True) for x in want),
    }[fmt.removesuffix("le").removesuffix("be")]()
    (tmp_path / "a.pcm").write_bytes(data)
    df = spark.read.format("raw_pcm").option("fmt", fmt).option("rate", 8000).option("channels", 2).option("frame_samples", 2).load(str(tmp_path / "a.pcm"))
    rows = df.orderBy("idx").collect()
    assert [x for r in rows for x in r["samples"]] == want.tolist() and [r["sample_count"] for r in rows] == [2, 1]


def test_playlists(spark, tmp_path):
    tracks = spark.createDataFrame([(0, "a.mp4", "A"), (1, "b.mp4", "B")], "pos int, location string, title string")
    tables.write_m3u(tracks, str(tmp_path / "m3u"))
    got = files.read_m3u(spark, str(tmp_path / "m3u" / "*.txt")).orderBy("pos").collect()
    assert [(r["pos"], r["location"], r["title"]) for r in got] == [(0, "a.mp4", "a.mp4"), (1, "b.mp4", "b.mp4")]
    tables.write_xspf(tracks, str(tmp_path / "xspf"))
    got = files.read_xspf(spark, str(tmp_path / "xspf")).collect()
    assert sorted((r["location"], r["title"]) for r in got) == [("a.mp4", "A"), ("b.mp4", "B")]


def test_config():
    c = files.Config.load('# c\n; d\n a = "x y" \nn=3\nn = 4\nf=1.5\nb=Yes\nbad')
    assert (c["a"], c.get_int("n"), c.get_float("f"), c.get_bool("b"), c.get_int("a", 7), c.get_bool("none", True)) == ("x y", 4, 1.5, True, 7, True)
    assert files.Config.load(c.dump()) == c


def test_packet_log_round_trip(spark, data, tmp_path):
    p = adapter.packets(spark, data).selectExpr("media_id", "idx", "stream_index", "stream_index as stream_type", "pts", "cast(null as bigint) as dts", "cast(null as bigint) as duration", "size", "flags", "cast(null as bigint) as pos", "ts")
    p.write.option("header", True).csv(str(tmp_path / "p.csv"))
    p.write.parquet(str(tmp_path / "p"))
    a, b = files.read_packets(spark, str(tmp_path / "p.csv")), files.read_packets(spark, str(tmp_path / "p"))
    assert a.schema.simpleString() == b.schema.simpleString()
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    assert schema.PACKETS.count(",") == len(a.columns) - 1


def test_csv_escapes_quotes(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", you',)], "t string")
    tables.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).head()["t"] == 'say "hi", you'


def test_reports(spark, data):
    s = report.full_stats(adapter.packets(spark, data)).orderBy("media_id").head().asDict()
    text, page = report.text(s, "m<1>"), report.html(s, [1.0, 2.0], "m<1>")
    assert f"Packets: {s['total_packets']}" in text and "m&lt;1&gt;" in page and page.count('class="bar"') == 2
    info = spark.createDataFrame([(1, "A", 0, "ID", "7"), (1, "A", 1, "Format", ""), (1, "B", 0, "Width", "10 pixels")], "media_id long, section string, pos int, key string, value string")
    assert report.info_text(info).head()["report"] == "A\n  " + "ID".ljust(32) + ": 7\n\nB\n  " + "Width".ljust(32) + ": 10 pixels"


def test_elementary_streams_keep_their_order(spark, tmp_path):
    p = spark.range(50).selectExpr("id % 2 as media_id", "0 as stream_index", "id as idx", "cast(cast(id as string) as binary) as data")
    tables.write_stream(p, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 50
    assert packets.annex_b(spark.sql("select unhex('0000000265AA') as data")).head()["data"] == bytearray(b"\0\0\0\1\x65\xaa")


def test_media_report(spark):
    from framewright.operators import metadata

    box = spark.sql("select 1L media_id, 'a.mp4' name, 'mov' format, '' profile, 'isom' brand, 'iso2' compatible, 1572864L size, 61000L duration_ms, 128000L bit_rate, 25.0D fps, map('comment', 'hi') tags")
    video = spark.sql("select 1L media_id, 0 stream_index, 'hevc' codec, 'HEVC' codec_name, 'Main 10' profile, 0L tag, 61000L duration_ms, 0L bit_rate, 1920 width, 1080 height, 0 sar_num, 1 sar_den, 25.0D fps, 1 `range`, 9 primaries, 16 transfer, 9 space, 1 field_order, 1 log2_w, 1 log2_h, false is_rgb, 10 depth, true has_mastering, 1000 max_cll, 0 max_fall")
    sound = spark.sql("select 1L media_id, 1 stream_index, 'pcm_s16le' codec, 'PCM' codec_name, 0L tag, 61000L duration_ms, 0L bit_rate, 2 channels, 'stereo' layout, 48000 sample_rate, true is_default")
    text = report.info_text(metadata.extractor(box).union(metadata.audio(sound)).union(metadata.video(video))).head()["report"]
    got = {line[2:34].strip(): line[36:] for line in text.splitlines() if line.startswith("  ")}
    assert got["Codec ID"] == "isom (iso2)" and got["Duration"] == "1 min 1 s" and got["File size"] == "1.5 MiB" and got["Description"] == "hi"
    assert got["HDR format"] == "HDR10" and got["Display aspect ratio"] == "1.778" and got["Chroma subsampling"] == "4:2:0" and got["Color primaries"] == "BT.2020"
    assert got["Bit rate"] == "1536 kb/s" and got["Sampling rate"] == "48.000000 kHz" and "Scan type" in got and "Maximum Frame-Average Light Level" not in got
