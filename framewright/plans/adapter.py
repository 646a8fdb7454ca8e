"""Media tables derived from the `events` and `embeddings` tables, so that every operator runs on the given data.

Events become a packet log: a media for each user, but one long media for a quarter of them; integer ticks of 1/90000 s;
missing or early timestamps where the properties say so. Stream numbers say nothing about types: in odd media audio
comes first, some have a second audio stream, and some packets are of a stream that the dimension doesn't know (type
-1). Embeddings become mono audio frames of 64 samples or grey images of 8 by 8 pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TICKS = 90000
EPOCH_US = 1704067200000000
#: Media of the derived sounds and images.
MEDIA = 8
#: The stream that no dimension has.
UNKNOWN_STREAM = 9


def _media(user: Column) -> Column:
    return F.when(user % 4 == 0, 0).otherwise(user).cast("long")


def packets_of(events: DataFrame) -> DataFrame:
    """The packet log of an events table, which may be a stream."""
    us = F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US
    k = F.get_json_object("props", "$.k").cast("int")
    e = events.select(F.col("event_id").cast("long").alias("idx"), _media(F.col("user_id")).alias("media_id"), "event_type", "value", us.alias("us"), k.alias("k"))
    kind = F.when(F.col("event_type").isin("click", "view"), 0).when(F.col("event_type").isin("signup", "purchase"), 1).otherwise(2)
    odd, second = F.col("media_id") % 2, (F.col("event_type") == "purchase") & (F.col("media_id") % 3 == 0)
    stream = F.when(kind == 0, odd).when(kind == 1, F.when(second, 3).otherwise(1 - odd)).otherwise(F.when(F.col("k") == 5, UNKNOWN_STREAM).otherwise(2))
    e = e.withColumn("stream_index", stream.cast("int")).withColumn("stream_type", F.when(F.col("stream_index") == UNKNOWN_STREAM, -1).otherwise(kind).cast("int"))
    ticks = F.expr("us div 72000")
    e = e.select(
        "media_id", "idx", "k", "stream_index", "stream_type",
        F.when(F.col("k") < 3, F.lit(None)).when(F.col("k") == 7, ticks - 9000).otherwise(ticks).cast("long").alias("pts"), F.when(F.col("k") == 2, ticks).cast("long").alias("dts"),
        (F.round(F.col("value") * 100).cast("int") + 1).alias("size"),
        (F.when(F.col("k") % 12 == 0, 1).otherwise(0) + F.when(F.col("k") % 33 == 0, 2).otherwise(0)).alias("flags"),
    )
    return e.withColumn("ts", F.coalesce("pts", "dts") / F.lit(float(TICKS)))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream dimension of the derived packets."""
    media = spark.read.parquet(f"{sf_dir}/events.parquet").select(_media(F.col("user_id")).alias("media_id")).distinct()
    rows = media.select("media_id", F.explode(F.array(*map(F.lit, range(4)))).alias("stream_index")).filter("stream_index < 3 or media_id % 3 = 0")
    kind = F.when(F.col("stream_index") == 2, 2).when(F.col("stream_index") == 3, 1).when(F.col("stream_index") == F.col("media_id") % 2, 0).otherwise(1)
    return rows.select("media_id", "stream_index", kind.alias("stream_type"), F.lit(1).alias("tb_num"), F.lit(TICKS).alias("tb_den"))


def video_arrivals(packets: DataFrame) -> DataFrame:
    """Decoded video frames, arrival kept: media_id, arrival, stream_index, is_key, frame_type, pts, ts, width, height."""
    key = F.col("flags") % 2 == 1
    kind = F.when(key, 1).when(F.col("k") % 3 == 1, 2).when(F.col("k") % 3 == 2, 3).otherwise(0)
    width = F.when(F.col("k") % 29 == 5, 0).otherwise(640)
    return packets.filter("stream_type = 0").select("media_id", F.col("idx").alias("arrival"), "stream_index", key.alias("is_key"), kind.cast("int").alias("frame_type"), "pts", "ts", width.alias("width"), F.lit(480).alias("height"))


def audio_arrivals(packets: DataFrame) -> DataFrame:
    """Decoded audio frames, arrival kept."""
    return packets.filter("stream_type = 1").select(
        "media_id", F.col("idx").alias("arrival"), "stream_index", "pts", "ts", F.col("size").alias("sample_count"), F.lit(48000).alias("sample_rate"), F.lit(2).alias("channels"), (F.col("size") * 4).alias("byte_count"))


def audio_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, idx, ts, samples): each embedding as 64 mono 16-bit samples."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    samples = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x.cast("double") * 32768), F.lit(-32768)), F.lit(32767)).cast("smallint"))
    return e.select((F.col("vec_id") % MEDIA).cast("long").alias("media_id"), F.col("vec_id").cast("long").alias("idx"), (F.col("vec_id") / F.lit(50.0)).alias("ts"), F.lit(48000).alias("sample_rate"), F.lit(1).alias("channels"), samples.alias("samples"))


def grey_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, idx, width, height, pixels): each embedding as a grey image of 8 by 8."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pixels = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))
    return e.select((F.col("vec_id") % MEDIA).cast("long").alias("media_id"), F.col("vec_id").cast("long").alias("idx"), F.lit(8).alias("width"), F.lit(8).alias("height"), pixels.alias("pixels"))
