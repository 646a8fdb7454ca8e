"""The timeline of a media: key frames, every 20th audio frame and events, numbered in the order in which they arise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AUDIO_EVERY = 20


def timeline(video: DataFrame, audio: DataFrame, events: DataFrame, every: int = AUDIO_EVERY) -> DataFrame:
    """video: numbered frames; audio: numbered frames; events: event log. Entries without a time are left out; of one arrival events come first, in their order."""
    entry = lambda df, at, rank, n, category, label: df.select("media_id", F.col(at).alias("at"), F.lit(rank).alias("r"), n.cast("long").alias("n"), F.lit(category).alias("category"), "ts", label.alias("label"))
    number = F.concat(F.lit("#"), F.col("fidx").cast("string"))
    keys = entry(video.filter("is_key"), "arrival", 1, F.lit(0), "video_key", number)
    sounds = entry(audio.filter((F.col("fidx") + 1) % every == 0), "arrival", 1, F.lit(0), "audio_sample", number)
    notes = entry(events, "packet_idx", 0, F.col("event_idx"), "event", F.col("type"))
    every_ = keys.unionByName(sounds).unionByName(notes).filter("ts is not null")
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("at", "r", "n")) - 1
    return every_.select("media_id", number.cast("long").alias("timeline_idx"), "category", "ts", "label")


def throttled(rows: DataFrame, value: str, least: float, both_ways: bool = True) -> DataFrame:
    """Of each media, in order of idx, the rows whose value is at least `least` away from that of the last row that passed (both_ways: or below it); the first passes, rows without a value never.

    Which rows pass depends on all before, so a media is one sorted run; just the last value is held.
    """
    own = rows.filter(F.col(value).isNotNull()).repartition("media_id").sortWithinPartitions("media_id", "idx")

    def run(batches):
        import numpy as np

        media, last = None, None
        for b in batches:
            keep = []
            for i, (m, v) in enumerate(zip(b.column("media_id").to_pylist(), b.column(value).to_pylist())):
                if m != media or (abs(v - last) if both_ways else v - last) >= least:
                    media, last = m, v
                    keep.append(i)
            yield b.take(np.array(keep, np.int64))

    return own.mapInArrow(run, rows.schema)


def summary(entries: DataFrame) -> DataFrame:
    c = F.col("category")
    return entries.groupBy("media_id").agg(F.count("*").alias("total"), F.count_if(c == "video_key").alias("video_keys"), F.count_if(c == "audio_sample").alias("audio_samples"), F.count_if(c == "event").alias("events"))


def series(entries: DataFrame, last: int = 300) -> DataFrame:
    """Chart points of the last entries: key frames at 3, audio at 2, the rest at 1."""
    nth = F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("timeline_idx")))
    y = F.when(F.col("category") == "video_key", 3.0).when(F.col("category") == "audio_sample", 2.0).otherwise(1.0)
    return entries.withColumn("_n", nth).filter(F.col("_n") <= last).select("media_id", "timeline_idx", "ts", y.alias("y"))


def axis_range(values: DataFrame, column: str, symmetric: bool = False, margin: float = 1.1) -> DataFrame:
    """Chart range of a media: up to 1.1 times the largest value (1 at least), mirrored below 0 if symmetric."""
    top = F.greatest(F.lit(1.0), F.max(F.abs(column) if symmetric else F.col(column))) * margin
    return values.groupBy("media_id").agg(F.round(top, 9).alias("upper")).withColumn("lower", -F.col("upper") if symmetric else F.lit(0.0))
