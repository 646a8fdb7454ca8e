"""Audio/video sync: each frame is paired with the last one of the other kind, in arrival order and without a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.segments import Segments


def pair(packets: DataFrame, segment: int | None = None) -> DataFrame:
    """Samples numbered from 0 in a media: audio_ts, video_ts, diff_ms = (audio - video) * 1000, and whether audio came last. With segment, media too long for a task are cut in pieces of that many arrivals."""
    if segment:
        cut, kind = Segments(["media_id"], "idx", segment), F.col("stream_type")
        rows = packets.filter(kind.isin(0, 1) & F.col("ts").isNotNull()).select("media_id", "idx", "stream_type", "ts")
        rows = cut.last_value(cut.last_value(rows, F.when(kind == 1, F.col("ts")), "audio_ts"), F.when(kind == 0, F.col("ts")), "video_ts")
        rows = cut.running_sum(rows.filter("audio_ts is not null and video_ts is not null"), F.lit(1).cast("long"), "sync_idx")
        return rows.select("media_id", (F.col("sync_idx") - 1).alias("sync_idx"), "audio_ts", "video_ts", ((F.col("audio_ts") - F.col("video_ts")) * 1000).alias("diff_ms"), (kind == 1).alias("audio_anchor"))
    w = Window.partitionBy("media_id").orderBy("idx")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    s = F.col("stream_type")
    both = packets.filter(s.isin(0, 1) & F.col("ts").isNotNull())
    both = both.withColumn("audio_ts", F.last(F.when(s == 1, F.col("ts")), ignorenulls=True).over(so_far)).withColumn("video_ts", F.last(F.when(s == 0, F.col("ts")), ignorenulls=True).over(so_far))
    both = both.filter("audio_ts is not null and video_ts is not null")
    number = F.row_number().over(w) - 1
    return both.select("media_id", number.cast("long").alias("sync_idx"), "audio_ts", "video_ts", ((F.col("audio_ts") - F.col("video_ts")) * 1000).alias("diff_ms"), (s == 1).alias("audio_anchor"))


def summary(samples: DataFrame) -> DataFrame:
    d = F.abs("diff_ms")
    return samples.groupBy("media_id").agg(F.count("*").alias("samples"), F.round(F.coalesce(F.avg(d), F.lit(0.0)), 6).alias("mean_abs_ms"), F.round(F.coalesce(F.max(d), F.lit(0.0)), 6).alias("max_abs_ms"))


def running_average(samples: DataFrame, coef: float = 0.7943282347, warm_up: int = 20, reset_s: float = 10.0) -> DataFrame:
    """Smoothed difference in seconds at the end of each media: cum = diff + coef * cum, average cum * (1 - coef) after warm_up samples; a difference of reset_s or more starts anew.

    After the last reset the sum is linear in the differences, and what lies far back has no weight left in double
    precision; so one window finds the last reset and an aggregation adds up the rest, without a list of a media.
    """
    w = Window.partitionBy("media_id")
    d = F.col("diff_ms") / 1000
    rows = samples.select("media_id", "sync_idx", d.alias("d"), F.max(F.when(F.abs(d) >= reset_s, F.col("sync_idx"))).over(w).alias("reset"), F.max("sync_idx").over(w).alias("last"))
    live = F.col("reset").isNull() | (F.col("sync_idx") > F.col("reset"))
    sums = rows.groupBy("media_id").agg(F.coalesce(F.sum(F.when(live, F.col("d") * F.pow(F.lit(coef), F.col("last") - F.col("sync_idx")))), F.lit(0.0)).alias("cum"), F.count_if(live).alias("n"))
    return sums.select("media_id", F.when(F.col("n") >= warm_up, F.round(F.col("cum") * (1 - coef), 9)).alias("avg_diff"), F.col("n").alias("counted"))


def drops(frames: DataFrame, packets: DataFrame, early_s: float = 0.01, no_sync_s: float = 10.0) -> DataFrame:
    """(media_id, fidx, early, late) of numbered video frames against the audio clock, which stands at the last audio timestamp that arrived before.

    early: a frame whose time is more than early_s behind the clock (and less than no_sync_s away) needn't be decoded;
    late: the next frame is due already.
    """
    nxt = F.lead("ts").over(Window.partitionBy("media_id").orderBy("fidx"))
    own = frames.filter("ts is not null").select("media_id", "fidx", F.col("arrival").alias("idx"), "ts", nxt.alias("next"), F.lit(None).cast("double").alias("clock"))
    sound = packets.filter("stream_type = 1 and ts is not null").select("media_id", F.lit(None).cast("long").alias("fidx"), "idx", "ts", F.lit(None).cast("double").alias("next"), F.col("ts").alias("clock"))
    master = F.last("clock", ignorenulls=True).over(Window.partitionBy("media_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    met = own.unionByName(sound).withColumn("master", master).filter("fidx is not null")
    early = (F.col("ts") < F.col("master") - early_s) & (F.abs(F.col("ts") - F.col("master")) < no_sync_s)
    return met.select("media_id", "fidx", F.coalesce(early, F.lit(False)).alias("early"), F.coalesce(F.col("master") > F.col("next"), F.lit(False)).alias("late"))
