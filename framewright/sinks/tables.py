"""CSV of the derived tables in the column order and number formats of the analysis views, and playlists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _seconds(c: str):
    return F.format_string("%.6f", F.col(c)).alias("timestamp_seconds" if c == "ts" else c)


def frames_csv(frames: DataFrame) -> DataFrame:
    """All frames, whatever a view filters."""
    from ..functions.formatting import picture_name

    return frames.select(F.col("fidx").alias("index"), picture_name(F.col("frame_type")).alias("frame_type"), F.col("is_key").cast("int").alias("is_key_frame"), _seconds("ts"), "pts", "gop_index", "gop_position")


def audio_csv(audio: DataFrame) -> DataFrame:
    return audio.select(F.col("fidx").alias("index"), _seconds("ts"), "pts", "sample_count", "sample_rate", "channels", "byte_count")


def packets_csv(packets: DataFrame) -> DataFrame:
    have = lambda c, alias=None: (F.col(c) if c in packets.columns else F.lit(None).cast("long")).alias(alias or c)
    return packets.select(F.col("idx").alias("index"), "stream_index", _seconds("ts"), "pts", have("dts"), have("duration"), "size", "flags", have("pos", "file_pos"))


def events_csv(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_idx").alias("index"), "severity", "type", "stream_index", _seconds("ts"), "pts", F.col("type").alias("summary"), F.format_string("packet %d", F.col("packet_idx")).alias("detail"))


def sync_csv(samples: DataFrame) -> DataFrame:
    return samples.select(F.col("sync_idx").alias("index"), F.format_string("%.6f", "audio_ts").alias("audio_timestamp_seconds"), F.format_string("%.6f", "video_ts").alias("video_timestamp_seconds"), F.format_string("%.3f", "diff_ms").alias("diff_ms"), F.when(F.col("audio_anchor"), "audio").otherwise("video").alias("anchor"))


def timeline_csv(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("timeline_idx").alias("index"), "category", _seconds("ts"), "label", F.lit("").alias("detail"))


def visualization_csv(viz: DataFrame) -> DataFrame:
    """A row for each point of waveform and spectrum."""
    head = [F.col("idx").alias("index"), _seconds("ts"), F.format_string("%.6f", "level").alias("level"), "sample_rate", "channels"]
    part = lambda c: viz.select(F.lit(c).alias("section"), *head, F.posexplode(c).alias("point_index", "value"))
    return part("waveform").unionByName(part("spectrum"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Standard CSV: quotes inside fields are doubled."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_m3u(tracks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Each track as a comment with its title and a line with its location; a playlist is one file."""
    lines = tracks.select("pos", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.concat(F.lit("#"), F.col("title")).alias("value")), F.struct(F.lit(1).alias("k"), F.col("location").alias("value")))).alias("l"))
    lines.orderBy("pos", "l.k").select("l.value").coalesce(1).write.mode(mode).text(path)


def write_xspf(tracks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A playlist with one list of tracks, in the order of pos."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", "location", "title"))), lambda t: F.struct(t["location"].alias("location"), t["title"].alias("title")))
    tracks.agg(rows.alias("track")).coalesce(1).write.mode(mode).format("xml").option("rootTag", "playlist").option("rowTag", "trackList").save(path)


def write_frames(frames: DataFrame, path: str, every: int = 1, kind: str = "rgb", mode: str = "errorifexists") -> None:
    """Every n-th frame as Parquet rows (name, data), data in RGB or as stored. Sampling comes before conversion."""
    from ..functions.formatting import export_name

    have = lambda c, kind_: F.col(c).cast(kind_) if c in frames.columns else F.lit(None).cast(kind_)
    name = export_name(F.col("idx") + 1, have("pts", "long"), have("ts", "double"), F.lit(kind)).alias("name")
    picked = frames.filter(F.col("idx") % every == 0).select("media_id", name, "width", "height", "format", "data")

    def convert(batches):
        import pandas as pd

        from ..functions.pixels import to_rgb

        for pdf in batches:
            data = [bytes(to_rgb(d, w, h, f).tobytes()) if kind == "rgb" else bytes(d) for w, h, f, d in pdf[["width", "height", "format", "data"]].itertuples(index=False)]
            yield pd.DataFrame({"media_id": pdf["media_id"], "name": pdf["name"], "data": data})

    picked.mapInPandas(convert, "media_id long, name string, data binary").write.mode(mode).parquet(path)


def write_stream(packets: DataFrame, path: str, data: str = "data", mode: str = "errorifexists") -> None:
    """Elementary streams: payloads in arrival order, a folder for each media and stream, ordered within and across its files."""
    packets.repartitionByRange("media_id", "stream_index", "idx").sortWithinPartitions("media_id", "stream_index", "idx").select("media_id", "stream_index", "idx", data).write.mode(mode).partitionBy("media_id", "stream_index").parquet(path)
