"""Reports of a media from its statistics row: text, HTML, JSON; and the CSV of a statistics series."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JSON_FIELDS = "total_packets total_bytes video_packets audio_packets current_fps avg_fps current_bitrate_bps avg_bitrate_bps peak_bitrate_bps gop_size max_gop_size key_frame_count avg_packet_size max_packet_size min_packet_size duration_seconds".split()
SERIES = {"Time(s)": "second", "TotalPackets": "total_packets", "TotalBytes": "total_bytes", "VideoPackets": "video_packets", "AudioPackets": "audio_packets", "CurrentFPS": "current_fps", "AvgFPS": "avg_fps", "CurrentBitrate": "current_bitrate_bps", "AvgBitrate": "avg_bitrate_bps", "PeakBitrate": "peak_bitrate_bps", "GOPSize": "gop_size", "KeyFrames": "key_frame_count", "AvgPacketSize": "avg_packet_size"}


def rate(bps: int) -> str:
    return f"{bps // 1_000_000} Mbps" if bps >= 1_000_000 else f"{bps // 1000} Kbps" if bps >= 1000 else f"{bps} bps"


def clock(seconds: float) -> str:
    s = int(seconds)
    return f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"


def full_stats(packets: DataFrame) -> DataFrame:
    """The statistics of each media with rates and groups: everything that the reports show."""
    from ..operators import packets as ops

    rates = history(ops.per_second(packets))
    last = rates.groupBy("media_id").agg(F.max_by(F.struct("avg_fps", "bps", "avg_bps", "peak_bps", "video_fps"), "second").alias("r"))
    last = last.select("media_id", F.col("r.video_fps").cast("double").alias("current_fps"), F.col("r.avg_fps").alias("avg_fps"), F.col("r.bps").alias("current_bitrate_bps"), F.col("r.avg_bps").alias("avg_bitrate_bps"), F.col("r.peak_bps").alias("peak_bitrate_bps"))
    return ops.stats(packets).join(last, "media_id", "left").join(ops.mixed_gops(packets), "media_id", "left")


def history(series: DataFrame) -> DataFrame:
    """A per-second series with both rates' means and the peak: one sort serves all."""
    from ..operators.packets import HISTORY, rate_history

    w = Window.partitionBy("media_id").orderBy("second").rowsBetween(-(HISTORY - 1), 0)
    return rate_history(series).withColumn("avg_fps", F.round(F.avg("video_fps").over(w), 9))


def stats_series(packets: DataFrame) -> DataFrame:
    """The statistics of each media as they stood at the end of each second that has a packet, in the columns of series_csv()."""
    key = F.col("flags").bitwiseAND(F.lit(1))
    timed = packets.filter("ts is not null")
    kind = F.col("stream_type")
    per = timed.groupBy("media_id", F.floor("ts").cast("long").alias("second")).agg(
        F.count("*").alias("packets"), F.sum(F.col("size").cast("long")).alias("bytes"), F.count_if(kind == 0).alias("video_fps"), F.count_if(kind == 1).alias("audio"), F.sum(key).alias("keys"), F.sum(F.col("size").cast("long") * 8).alias("bps"),
    )
    so_far = Window.partitionBy("media_id").orderBy("second").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(c).over(so_far)
    rows = history(per).withColumns({"total_packets": total("packets"), "total_bytes": total("bytes"), "video_packets": total("video_fps"), "audio_packets": total("audio"), "key_frame_count": total("keys")})
    return rows.select(
        "media_id", "second", "total_packets", "total_bytes", "video_packets", "audio_packets", F.col("video_fps").cast("double").alias("current_fps"), "avg_fps", F.col("bps").alias("current_bitrate_bps"), F.col("avg_bps").alias("avg_bitrate_bps"),
        F.col("peak_bps").alias("peak_bitrate_bps"), F.when(F.col("key_frame_count") > 0, F.floor(F.col("total_packets") / F.col("key_frame_count"))).otherwise(0).alias("gop_size"), "key_frame_count", F.floor(F.col("total_bytes") / F.col("total_packets")).alias("avg_packet_size"),
    )


def to_json(stats: DataFrame) -> DataFrame:
    """(media_id, report): the statistics as a JSON text."""
    from ..functions.formatting import rounded_number

    value = lambda c: rounded_number(F.col(c)) if c in ("current_fps", "avg_fps", "duration_seconds") else F.col(c).cast("string")
    own = F.concat_ws(",", *[F.concat(F.lit(f'"{c}":'), F.coalesce(value(c), F.lit("null"))) for c in JSON_FIELDS])
    file = F.to_json(F.struct(F.col("media_id").cast("string").alias("video_file")), {"ignoreNullFields": "false"})
    return stats.select("media_id", F.concat(F.regexp_replace(file, "}$", ""), F.lit(',"statistics":{'), own, F.lit("}}")).alias("report"))


def series_csv(history: DataFrame) -> DataFrame:
    return history.select(*[F.col(c).alias(name) for name, c in SERIES.items()])


def rate_column(bps: Column) -> Column:
    from ..functions.formatting import bitrate_report

    return bitrate_report(F.coalesce(bps, F.lit(0)))


def summaries(stats: DataFrame) -> DataFrame:
    """(media_id, summary): what summary() says of each row, as one expression."""
    from ..functions.formatting import clock as clock_column
    from ..functions.formatting import fixed

    c = F.col
    text_ = F.concat(c("total_packets").cast("string"), F.lit(" packets, "), fixed(F.coalesce("avg_fps", F.lit(0.0))), F.lit(" fps, "), rate_column(c("avg_bitrate_bps")), F.lit(", "), clock_column(F.coalesce("duration_seconds", F.lit(0.0))))
    return stats.select("media_id", text_.alias("summary"))


def texts(stats: DataFrame) -> DataFrame:
    """(media_id, report): what text() says of each row, as one expression."""
    from ..functions.formatting import clock as clock_column
    from ..functions.formatting import fixed

    c = F.col
    fps = lambda x: F.concat(fixed(F.coalesce(x, F.lit(0.0))), F.lit(" fps"))
    unit = lambda x, name: F.concat(c(x).cast("string"), F.lit(name))
    groups = {
        "Totals": {"Packets": c("total_packets"), "Bytes": F.concat(F.floor(c("total_bytes") / 1024).cast("string"), F.lit(" KB")), "Video packets": c("video_packets"), "Audio packets": c("audio_packets")},
        "Frame rate": {"Current": fps("current_fps"), "Average": fps("avg_fps")},
        "Bit rate": {"Current": rate_column(c("current_bitrate_bps")), "Average": rate_column(c("avg_bitrate_bps")), "Peak": rate_column(c("peak_bitrate_bps"))},
        "Groups of pictures": {"Last": c("gop_size"), "Largest": c("max_gop_size"), "Key frames": c("key_frame_count")},
        "Packet size": {"Average": unit("avg_packet_size", " bytes"), "Largest": unit("max_packet_size", " bytes"), "Smallest": unit("min_packet_size", " bytes")},
        "Time": {"Duration": clock_column(F.coalesce("duration_seconds", F.lit(0.0)))},
    }
    lines = [F.lit("Stream report"), F.lit("")]
    for title, values in groups.items():
        lines += [F.lit(title), *[F.concat(F.lit(f"  {k}: "), v.cast("string")) for k, v in values.items()], F.lit("")]
    return stats.select("media_id", F.concat_ws("\n", *lines).alias("report"))


def summary(s: dict) -> str:
    return f"{s['total_packets']} packets, {s['avg_fps'] or 0:.2f} fps, {rate(s['avg_bitrate_bps'] or 0)}, {clock(s['duration_seconds'] or 0)}"


def text(s: dict, name: str = "") -> str:
    lines = ["Stream report", "", *([f"File: {name}", f"Summary: {summary(s)}", ""] if name else [])]
    groups = {
        "Totals": {"Packets": s["total_packets"], "Bytes": f"{s['total_bytes'] // 1024} KB", "Video packets": s["video_packets"], "Audio packets": s["audio_packets"]},
        "Frame rate": {"Current": f"{s['current_fps'] or 0:.2f} fps", "Average": f"{s['avg_fps'] or 0:.2f} fps"},
        "Bit rate": {"Current": rate(s["current_bitrate_bps"] or 0), "Average": rate(s["avg_bitrate_bps"] or 0), "Peak": rate(s["peak_bitrate_bps"] or 0)},
        "Groups of pictures": {"Last": s["gop_size"], "Largest": s["max_gop_size"], "Key frames": s["key_frame_count"]},
        "Packet size": {"Average": f"{s['avg_packet_size']} bytes", "Largest": f"{s['max_packet_size']} bytes", "Smallest": f"{s['min_packet_size']} bytes"},
        "Time": {"Duration": clock(s["duration_seconds"] or 0)},
    }
    for title, values in groups.items():
        lines += [title, *[f"  {k}: {v}" for k, v in values.items()], ""]
    return "\n".join(lines)


def html(s: dict, fps: list[float], name: str = "", bars: int = 60) -> str:
    """A page with the statistics and a bar for each of the first `bars` rates, scaled to the largest of all."""
    rows = {"Packets": s["total_packets"], "Bytes": f"{s['total_bytes'] // 1024} KB", "Current frame rate": f"{s['current_fps'] or 0:.2f} fps", "Average frame rate": f"{s['avg_fps'] or 0:.2f} fps", "Current bit rate": rate(s["current_bitrate_bps"] or 0), "Average bit rate": rate(s["avg_bitrate_bps"] or 0), "Peak bit rate": rate(s["peak_bitrate_bps"] or 0), "Group of pictures": s["gop_size"], "Key frames": s["key_frame_count"], "Duration": clock(s["duration_seconds"] or 0)}
    table = "".join(f"<tr><td>{k}</td><td>{v}</td></tr>" for k, v in rows.items())
    top = max(fps, default=0) or 1
    chart = "".join(f'<div class="bar" style="height:{f / top * 100:.0f}px" title="{f} fps"></div>' for f in fps[:bars])
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>Stream report</title></head><body><h1>{escape(name)}</h1><table>{table}</table><div>{chart}</div></body></html>"


def info_text(info: DataFrame) -> DataFrame:
    """(media_id, report): sections of aligned `key : value` lines, empty values left out. info: (media_id, section, pos, key, value)."""
    line = F.concat(F.lit("  "), F.rpad("key", 32, " "), F.lit(": "), F.col("value"))
    some = info.filter("value is not null and value <> ''").groupBy("media_id", "section").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"])).alias("body"))
    return some.groupBy("media_id").agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.struct("section", "body"))), lambda x: F.concat(x["section"], F.lit("\n"), x["body"]))).alias("report"))
