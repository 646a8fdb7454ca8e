"""Timestamp anomalies of each stream in arrival order, and the numbered event log made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.segments import Segments

BACK, JUMP = -0.001, 2.0
#: Stable codes; a label map may show them in any language.
SEVERITY = {"missing_timestamp": "warning", "timestamp_back": "error", "timestamp_jump": "warning", "invalid_video_frame": "error", "audio_missing_pts": "warning"}
LABELS = {"error": "Error", "warning": "Warning", "info": "Info"}


def missing_timestamps(packets: DataFrame) -> DataFrame:
    """The first packet without a timestamp of each stream."""
    nth = F.row_number().over(Window.partitionBy("media_id", "stream_index").orderBy("idx"))
    first = packets.filter("ts is null").withColumn("_n", nth).filter("_n = 1")
    return first.select("media_id", "stream_index", "idx", "pts", "ts", F.lit("missing_timestamp").alias("type"))


def steps(packets: DataFrame, segment: int | None = None) -> DataFrame:
    """Packets with a timestamp, and delta, the step from the last such packet of their stream. With segment, streams too long for a task are cut in pieces of that many arrivals."""
    if segment:
        rows = Segments(["media_id", "stream_index"], "idx", segment).last_value(packets.filter("ts is not null"), F.col("ts"), "prev_ts", before=True)
        return rows.withColumn("delta", F.col("ts") - F.col("prev_ts"))
    w = Window.partitionBy("media_id", "stream_index").orderBy("idx")
    return packets.filter("ts is not null").withColumn("prev_ts", F.lag("ts").over(w)).withColumn("delta", F.col("ts") - F.col("prev_ts"))


def back_and_jump(packets: DataFrame, back: float = BACK, jump: float = JUMP, segment: int | None = None) -> DataFrame:
    """Steps back by more than 1 ms and forward by more than 2 s."""
    kind = F.when(F.col("delta") < back, "timestamp_back").when(F.col("delta") > jump, "timestamp_jump")
    return steps(packets, segment).withColumn("type", kind).filter("type is not null").select("media_id", "stream_index", "idx", "pts", "ts", "type", "delta")


def audio_missing_pts(audio: DataFrame) -> DataFrame:
    """The first frame without a pts of each audio stream."""
    nth = F.row_number().over(Window.partitionBy("media_id", "stream_index").orderBy("arrival"))
    return audio.filter("pts is null").withColumn("_n", nth).filter("_n = 1").select("media_id", "stream_index", F.col("arrival").alias("idx"), "pts", "ts", F.lit("audio_missing_pts").alias("type"))


def invalid_frames(frames: DataFrame) -> DataFrame:
    """Frames without a size, or without data where there is such a column."""
    bad = (F.col("width") <= 0) | (F.col("height") <= 0)
    if "data" in frames.columns:
        bad = bad | F.col("data").isNull() | (F.length("data") == 0)
    return frames.filter(bad)


def event_log(packets: DataFrame, audio: DataFrame | None = None, video: DataFrame | None = None) -> DataFrame:
    """All anomalies of a media, numbered from 0 in the order in which they arise, with severity: of packets, and of decoded audio and video frames if given."""
    found = missing_timestamps(packets).unionByName(back_and_jump(packets).drop("delta"))
    if audio is not None:
        found = found.unionByName(audio_missing_pts(audio))
    if video is not None:
        found = found.unionByName(invalid_frames(video).select("media_id", "stream_index", F.col("arrival").alias("idx"), "pts", "ts", F.lit("invalid_video_frame").alias("type")))
    rank = F.when(F.col("type") == "missing_timestamp", 0).when(F.col("type") == "audio_missing_pts", 2).when(F.col("type") == "invalid_video_frame", 3).otherwise(1)
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("idx", rank)) - 1
    severity = F.when(F.col("type").isin([k for k, v in SEVERITY.items() if v == "error"]), "error").otherwise("warning")
    return found.select("media_id", number.cast("long").alias("event_idx"), severity.alias("severity"), "type", "stream_index", "pts", "ts", F.col("idx").alias("packet_idx"))


RANKS = {"info": 0, "warning": 1, "error": 2}


def at_least(events: DataFrame, severity: str) -> DataFrame:
    """Events of this severity or a graver one."""
    return events.filter(F.col("severity").isin([k for k, v in RANKS.items() if v >= RANKS[severity]]))


def event_summary(events: DataFrame) -> DataFrame:
    s = F.col("severity")
    return events.groupBy("media_id").agg(F.count("*").alias("total"), F.count_if(s == "error").alias("errors"), F.count_if(s == "warning").alias("warnings"), F.count_if(~s.isin("error", "warning")).alias("infos"))
