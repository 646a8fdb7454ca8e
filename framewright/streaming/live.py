"""The analyses as streaming queries. Arrival order is the truth: disorder in timestamps is reported, never repaired."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.anomalies import BACK, JUMP

EVENTS = "media_id long, stream_index int, idx long, pts long, ts double, type string"
STATE = "last_ts double, missing boolean"


def _anomalies(key, chunks: Iterator, state):
    """State of a stream: its last timestamp, and whether a missing one was reported."""
    import pandas as pd

    last, missing = state.get if state.exists else (None, False)
    rows = pd.concat(list(chunks), ignore_index=True).sort_values("idx")
    out = []
    for idx, pts, ts in rows[["idx", "pts", "ts"]].itertuples(index=False):
        if pd.isna(ts):
            if not missing:
                out.append((*key, idx, None if pd.isna(pts) else int(pts), None, "missing_timestamp"))
            missing = True
            continue
        if last is not None and not pd.isna(last):
            kind = "timestamp_back" if ts - last < BACK else "timestamp_jump" if ts - last > JUMP else None
            if kind:
                out.append((*key, idx, None if pd.isna(pts) else int(pts), ts, kind))
        last = ts
    state.update((last, missing))
    yield pd.DataFrame(out, columns=["media_id", "stream_index", "idx", "pts", "ts", "type"]).astype({"pts": "Int64"})


def anomalies(packets: DataFrame) -> DataFrame:
    """Missing, backward and jumping timestamps of a stream of packets; a state row for each media and stream."""
    rows = packets.select("media_id", "stream_index", "idx", "pts", "ts")
    return rows.groupBy("media_id", "stream_index").applyInPandasWithState(_anomalies, EVENTS, STATE, "append", "NoTimeout")


def _pairs(key, chunks: Iterator, state):
    import pandas as pd

    audio, video, n = state.get if state.exists else (None, None, 0)
    rows = pd.concat(list(chunks), ignore_index=True).sort_values("idx")
    out = []
    for stream, ts in rows[["stream_type", "ts"]].itertuples(index=False):
        if stream not in (0, 1) or pd.isna(ts):
            continue
        audio, video = (ts, video) if stream == 1 else (audio, ts)
        if audio is not None and video is not None and not pd.isna(audio) and not pd.isna(video):
            out.append((key[0], n, audio, video, (audio - video) * 1000, stream == 1))
            n += 1
    state.update((audio, video, n))
    yield pd.DataFrame(out, columns=["media_id", "sync_idx", "audio_ts", "video_ts", "diff_ms", "audio_anchor"])


def sync(packets: DataFrame) -> DataFrame:
    """Audio/video pairs of a stream of packets; a state row for each media."""
    rows = packets.select("media_id", "stream_type", "idx", "ts")
    return rows.groupBy("media_id").applyInPandasWithState(_pairs, "media_id long, sync_idx long, audio_ts double, video_ts double, diff_ms double, audio_anchor boolean", "audio double, video double, n long", "append", "NoTimeout")


def rates(packets: DataFrame, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Bits and video frames of each second of media time, final once the watermark has passed it."""
    timed = packets.filter("ts is not null").withColumn("at", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")))
    w = timed.withWatermark("at", late).groupBy("media_id", F.window("at", width)).agg(F.sum(F.col("size").cast("long") * 8).alias("bps"), F.count("*").alias("packets"), F.count_if(F.col("stream_type") == 0).alias("video_fps"))
    return w.select("media_id", F.unix_seconds("window.start").alias("second"), "bps", "packets", "video_fps")


def running_stats(packets: DataFrame) -> DataFrame:
    """The packet statistics of each media so far; written in update mode they replace the last row of the media."""
    return packets.groupBy("media_id").agg(F.count("*").alias("total_packets"), F.sum(F.col("size").cast("long")).alias("total_bytes"), F.count_if(F.col("stream_type") == 0).alias("video_packets"), F.count_if(F.col("stream_type") == 1).alias("audio_packets"))


GROUPS = "media_id long, gop_index long, start_frame long, end_frame long, total_frames long, key_count long, open boolean"


def _groups(key, chunks: Iterator, state):
    """State of a media: the open group, and the number of its next frame."""
    import pandas as pd

    gop, first, frames, keys, fidx = state.get if state.exists else (0, 0, 0, 0, 0)
    rows = pd.concat(list(chunks), ignore_index=True).sort_values("arrival")
    out = []
    for is_key in rows["is_key"]:
        if fidx == 0 or is_key:
            if fidx:
                out.append((key[0], gop, first, fidx - 1, frames, keys, False))
            gop, first, frames, keys = gop + 1, fidx, 0, 0
        frames, keys, fidx = frames + 1, keys + bool(is_key), fidx + 1
    out.append((key[0], gop, first, fidx - 1, frames, keys, True))
    state.update((gop, first, frames, keys, fidx))
    yield pd.DataFrame(out, columns=["media_id", "gop_index", "start_frame", "end_frame", "total_frames", "key_count", "open"])


def gops(video: DataFrame) -> DataFrame:
    """Groups of pictures of a stream of frames, in update mode: groups that closed, and the open one of each media, which a later row of the same group replaces."""
    rows = video.select("media_id", "arrival", "is_key")
    return rows.groupBy("media_id").applyInPandasWithState(_groups, GROUPS, "gop long, first long, frames long, keys long, fidx long", "update", "NoTimeout")


def run_to_table(df: DataFrame, path: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a query over what there is and returns its result: in append mode all rows, in update mode the last row of each key. Results and checkpoint go below `path`, a shared folder."""

    def sink(batch, number):
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/batch={number:09d}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    rows = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{path}/out/*")
    if not keys:
        return rows.drop("_batch")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "_batch").alias("r"))
    return last.select(*keys, "r.*").select(*df.columns)


def start(df: DataFrame, name: str, checkpoint: str, mode: str = "append", every: str | None = "120 milliseconds", sink=None):
    """Starts a query into a memory table, or with sink(batch, id) into anything; every=None takes what is there and stops."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).queryName(name)
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    return (w.foreachBatch(sink) if sink else w.format("memory")).start()
