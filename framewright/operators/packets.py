"""Packet-log operators: stream lookup, running statistics, rates by second, closed groups between key packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formatting import packet_timestamp

HISTORY = 300


def in_order(*keys: str):
    return Window.partitionBy("media_id", *keys).orderBy("idx")


def normalize(packets: DataFrame, streams: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Packets with stream_type (-1 for an unknown stream) and ts from ticks and the stream's time base.

    The dimension has a few rows a media; it is broadcast up to broadcast_rows rows and joined by a shuffle beyond.
    """
    dim = streams.select("media_id", "stream_index", F.col("stream_type").alias("_type"), "tb_num", "tb_den")
    dim = F.broadcast(dim) if dim.limit(broadcast_rows + 1).count() <= broadcast_rows else dim
    dts = F.col("dts") if "dts" in packets.columns else F.lit(None).cast("long")
    joined = packets.join(dim, ["media_id", "stream_index"], "left")
    return joined.withColumn("stream_type", F.coalesce("_type", F.lit(-1))).withColumn("ts", packet_timestamp(F.col("pts"), dts, F.col("tb_num"), F.col("tb_den"))).drop("_type", "tb_num", "tb_den")


def stats(packets: DataFrame) -> DataFrame:
    """One row a media: packet, byte and key counts, packet sizes, duration."""
    key = F.col("flags").bitwiseAND(F.lit(1)) == 1
    return packets.groupBy("media_id").agg(
        F.count("*").alias("total_packets"), F.sum(F.col("size").cast("long")).alias("total_bytes"), F.count_if(F.col("stream_type") == 0).alias("video_packets"), F.count_if(F.col("stream_type") == 1).alias("audio_packets"),
        F.max("size").alias("max_packet_size"), F.min("size").alias("min_packet_size"), F.expr("sum(cast(size as bigint)) div count(*)").alias("avg_packet_size"), F.count_if(key).alias("key_frame_count"), (F.max("ts") - F.min("ts")).alias("duration_seconds"),
    )


def stats_per_stream(packets: DataFrame) -> DataFrame:
    return packets.groupBy("media_id", "stream_index").agg(F.count("*").alias("packets"), F.sum(F.col("size").cast("long")).alias("bytes"))


def stats_maps(packets: DataFrame) -> DataFrame:
    """The per-stream counts as maps, one row a media."""
    per = stats_per_stream(packets)
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("stream_index", c))))
    return per.groupBy("media_id").agg(entry("packets").alias("packets_per_stream"), entry("bytes").alias("bytes_per_stream"))


def summary(packets: DataFrame) -> DataFrame:
    """Packets by kind; what is neither video nor audio is other."""
    s = F.col("stream_type")
    return packets.groupBy("media_id").agg(F.count("*").alias("total"), F.count_if(s == 0).alias("video"), F.count_if(s == 1).alias("audio"), F.count_if(~s.isin(0, 1) | s.isNull()).alias("other"))


def last_n(packets: DataFrame, n: int = 100) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("idx")))
    return packets.withColumn("_n", nth).filter(F.col("_n") <= n).drop("_n")


def per_second(packets: DataFrame) -> DataFrame:
    """Bits, packets and video packets of each second of media time that has a packet."""
    return packets.filter("ts is not null").groupBy("media_id", F.floor("ts").cast("long").alias("second")).agg(
        F.sum(F.col("size").cast("long") * 8).alias("bps"), F.count("*").alias("packets"), F.count_if(F.col("stream_type") == 0).alias("video_fps"))


def rate_history(series: DataFrame, column: str = "bps", history: int = HISTORY) -> DataFrame:
    """A per-second series with the integer mean of its last `history` values and the peak so far."""
    w = Window.partitionBy("media_id").orderBy("second")
    last = w.rowsBetween(-(history - 1), 0)
    mean = F.floor(F.sum(column).over(last) / F.count("*").over(last)).cast("long")
    return series.withColumn("avg_bps", mean).withColumn("peak_bps", F.max(column).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def fps_history(series: DataFrame, history: int = HISTORY) -> DataFrame:
    w = Window.partitionBy("media_id").orderBy("second").rowsBetween(-(history - 1), 0)
    return series.select("media_id", "second", "video_fps", F.round(F.avg("video_fps").over(w), 9).alias("avg_fps"))


def cumulative_bitrate(series: DataFrame) -> DataFrame:
    """Compatibility variant: all bits since the start as the rate of each tick."""
    w = Window.partitionBy("media_id").orderBy("second").rowsBetween(Window.unboundedPreceding, 0)
    return series.select("media_id", "second", F.sum("bps").over(w).alias("cumulative_bps"), F.sum("packets").over(w).alias("cumulative_packets"))


def mixed_gops(packets: DataFrame) -> DataFrame:
    """Compatibility variant: runs between key packets of any stream. The open run counts for current_gop_size only."""
    run = F.sum(F.col("flags").bitwiseAND(F.lit(1))).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    runs = packets.withColumn("run", run).groupBy("media_id", "run").agg(F.count("*").alias("n"))
    top = Window.partitionBy("media_id")
    runs = runs.withColumn("last", F.max("run").over(top))
    closed = F.col("run") < F.col("last")
    return runs.groupBy("media_id").agg(
        F.coalesce(F.max(F.when(F.col("run") == F.col("last") - 1, F.col("n"))), F.lit(0)).alias("gop_size"), F.coalesce(F.max(F.when(closed, F.col("n"))), F.lit(0)).alias("max_gop_size"),
        F.max(F.when(~closed, F.col("n"))).alias("current_gop_size"),
    )


def select_best(streams: DataFrame) -> DataFrame:
    """The stream of each media and type with the highest bit rate, ties to the smaller index; attached pictures never."""
    best = F.row_number().over(Window.partitionBy("media_id", "stream_type").orderBy(F.desc_nulls_last("bit_rate"), "stream_index"))
    return streams.filter(~F.coalesce("attached_pic", F.lit(False)) & F.col("stream_type").isin(0, 1)).withColumn("_n", best).filter("_n = 1").drop("_n")


def seek(packets: DataFrame, targets: DataFrame) -> DataFrame:
    """For each (media_id, target): the last key packet at or before the target, NULL if there is none. Targets and key packets go through one sort."""
    keys = packets.filter((F.col("flags").bitwiseAND(F.lit(1)) == 1) & F.col("ts").isNotNull()).select("media_id", F.col("ts").alias("at"), F.lit(0).alias("asks"), F.struct("ts", "idx").alias("m"))
    asked = targets.select("media_id", F.col("target").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast(keys.schema["m"].dataType).alias("m"))
    so_far = Window.partitionBy("media_id").orderBy("at", "asks", "m.idx").rowsBetween(Window.unboundedPreceding, 0)
    met = keys.unionByName(asked).withColumn("last", F.last("m", ignorenulls=True).over(so_far)).filter("asks = 1")
    return met.select("media_id", F.col("at").alias("target"), F.col("last.ts").alias("seek_ts"), F.col("last.idx").alias("seek_idx"))


def play_range(packets: DataFrame, start: float, length: float) -> DataFrame:
    """Packets up to `length` seconds after `start`."""
    return packets.filter(F.col("ts") - start <= length)


def only_types(packets: DataFrame, *types: int) -> DataFrame:
    """Packets of the chosen kinds of streams; a plain filter, so it reaches the scan."""
    return packets.filter(F.col("stream_type").isin(*types))


def gated(rows: DataFrame, switches: DataFrame, analyzer: str) -> DataFrame:
    """Rows of media whose analyzer is on: switches has (media_id, analyzer, at, on), the state from arrival `at` on; off before the first."""
    own = switches.filter(F.col("analyzer") == analyzer).select("media_id", F.col("at").alias("idx"), F.lit(0).alias("_k"), F.col("on").alias("_on"), F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("_row"))
    all_ = rows.select("media_id", "idx", F.lit(1).alias("_k"), F.lit(None).cast("boolean").alias("_on"), F.struct(*[F.col(c) for c in rows.columns]).alias("_row"))
    state = F.last("_on", ignorenulls=True).over(Window.partitionBy("media_id").orderBy("idx", "_k").rowsBetween(Window.unboundedPreceding, 0))
    return own.unionByName(all_).withColumn("_state", state).filter("_k = 1 and _state").select("_row.*")


def annex_b(packets: DataFrame, data: str = "data", headers: DataFrame | None = None) -> DataFrame:
    """H.264 payloads with a 4-byte length in front get a start code instead; the first packet of a stream gets the stream's parameter sets (media_id, stream_index, header) in front."""
    body = F.concat(F.unhex(F.lit("00000001")), F.expr(f"substring({data}, 5)"))
    if headers is None:
        return packets.withColumn(data, body)
    first = F.row_number().over(in_order("stream_index")) == 1
    rows = packets.withColumn("_first", first).join(headers.select("media_id", "stream_index", F.col("header").alias("_header")), ["media_id", "stream_index"], "left")
    return rows.withColumn(data, F.when(F.col("_first") & F.col("_header").isNotNull(), F.concat("_header", body)).otherwise(body)).drop("_first", "_header")
