"""Decoded frames: numbering, groups of pictures, filters, summaries, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.segments import Segments


def numbered(arrivals: DataFrame, segment: int | None = None) -> DataFrame:
    """Frames of a media numbered from 0 by arrival (fidx). With segment, arrivals are cut in pieces of that many, for media too long for a task."""
    if segment:
        rows = Segments(["media_id"], "arrival", segment).running_sum(arrivals, F.lit(1).cast("long"), "fidx")
        return rows.withColumn("fidx", F.col("fidx") - 1)
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("arrival")) - 1
    return arrivals.withColumn("fidx", number.cast("long"))


def assign_gops(frames: DataFrame, segment: int | None = None) -> DataFrame:
    """gop_index from 1 (the first frame opens group 1, key or not; any later key frame opens the next) and gop_position from 1."""
    if segment:
        cut = Segments(["media_id"], "fidx", segment)
        opened = F.when(F.col("is_key") & (F.col("fidx") > 0), 1).otherwise(0).cast("long")
        rows = cut.running_sum(frames, opened, "gop_index").withColumn("gop_index", F.col("gop_index") + 1)
        rows = cut.last_value(rows, F.when((opened == 1) | (F.col("fidx") == 0), F.col("fidx")), "_first")
        return rows.withColumn("gop_position", F.col("fidx") - F.col("_first") + 1).drop("_first")
    w = Window.partitionBy("media_id").orderBy("fidx")
    opens = F.when(F.col("is_key") & (F.col("fidx") > 0), 1).otherwise(0)
    gop = frames.withColumn("gop_index", (1 + F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("long"))
    first = F.max(F.when((opens == 1) | (F.col("fidx") == 0), F.col("fidx"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return gop.withColumn("gop_position", (F.col("fidx") - first + 1).cast("long"))


def gop_summary(frames: DataFrame) -> DataFrame:
    """One row a group: first and last frame and their timestamps, frames by type."""
    kind = F.col("frame_type")
    return frames.groupBy("media_id", "gop_index").agg(
        F.min("fidx").alias("start_frame"), F.max("fidx").alias("end_frame"), F.min_by("ts", "fidx").alias("start_ts"), F.max_by("ts", "fidx").alias("end_ts"), F.count("*").alias("total_frames"),
        F.count_if(kind == 1).alias("i_count"), F.count_if(kind == 2).alias("p_count"), F.count_if(kind == 3).alias("b_count"), F.count_if("is_key").alias("key_count"),
    )


def matching(frames: DataFrame, which: str = "all") -> DataFrame:
    """Frames the filter shows: all, i or key."""
    return {"all": frames, "i": frames.filter("frame_type = 1"), "key": frames.filter("is_key")}[which]


def every_nth(frames: DataFrame, n: int, offset: int = 0, number: str = "fidx") -> DataFrame:
    """Frames whose number leaves `offset` when divided by n; sampling comes before any work on pixels."""
    return frames.filter(F.col(number) % n == offset)


def frame_summary(frames: DataFrame, which: str = "all") -> DataFrame:
    """Frames of each media by type, and how many of them the filter shows."""
    kind = F.col("frame_type")
    shown = {"all": F.lit(True), "i": kind == 1, "key": F.col("is_key")}[which]
    return frames.groupBy("media_id").agg(
        F.count("*").alias("total"), F.count_if(shown).alias("visible"), F.count_if("is_key").alias("key_frames"), F.max("gop_index").alias("gops"), F.count_if(kind == 1).alias("i_frames"), F.count_if(kind == 2).alias("p_frames"), F.count_if(kind == 3).alias("b_frames"),
        F.count_if(~kind.isin(1, 2, 3)).alias("other_frames"),
    )


def audio_summary(audio: DataFrame) -> DataFrame:
    return audio.groupBy("media_id").agg(F.count("*").alias("frames"), F.sum(F.col("sample_count").cast("long")).alias("samples"), F.sum(F.col("byte_count").cast("long")).alias("bytes"))


def nominal_duration(frames: DataFrame, most: float = 10.0) -> DataFrame:
    """The last step between frames that is positive and below `most`, carried along."""
    w = Window.partitionBy("media_id").orderBy("fidx")
    step = F.col("ts") - F.lag("ts").over(w)
    frames = frames.withColumn("_d", step).withColumn("_d", F.when((F.col("_d") > 0) & (F.col("_d") < most), F.col("_d")))
    return frames.withColumn("duration", F.last("_d", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def export_count(nb_frames, duration, fps, interval):
    """Frames an export will write: from the count, else from duration and rate; one in `interval`, rounded up."""
    total = F.when(nb_frames > 0, nb_frames).otherwise(F.floor(duration * fps + 0.5))
    return F.ceil(total / interval).cast("long")
