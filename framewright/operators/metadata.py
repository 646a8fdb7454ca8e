"""The media report: container, audio and video properties as formatted text, in long form (media_id, section, pos, key, value).

Container and stream properties come as plain columns; a property that is missing gives an empty value and no line in
the report (see sinks.report.info_text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formatting as fmt

SECTIONS = ("ExtractorFormat", "AudioCodecFormat", "VideoCodecFormat")


def duration_ms(container_ms: Column, streams_ms: Column) -> Column:
    """The longest of the container's and all streams' durations; streams_ms is an array."""
    return F.greatest(F.coalesce(container_ms, F.lit(0)), F.coalesce(F.array_max(streams_ms), F.lit(0)))


def _long(df: DataFrame, section: str, values: dict[str, Column]) -> DataFrame:
    entries = [F.struct(F.lit(i).alias("pos"), F.lit(k).alias("key"), F.coalesce(v.cast("string"), F.lit("")).alias("value")) for i, (k, v) in enumerate(values.items())]
    return df.select("media_id", F.lit(section).alias("section"), F.explode(F.array(*entries)).alias("e")).select("media_id", "section", "e.*")


def extractor(container: DataFrame) -> DataFrame:
    """container: media_id, name, format, profile, brand, compatible, size, duration_ms, bit_rate, fps, tags (map)."""
    c = F.col
    return _long(container, SECTIONS[0], {
        "Complete name": c("name"), "Format": c("format"), "Format profile": c("profile"), "Codec ID": fmt.container_id(c("brand"), c("compatible")), "File size": F.when(c("size") > 0, fmt.file_size_mib(c("size"))),
        "Duration": fmt.duration_text(c("duration_ms")), "Overall bit rate": fmt.bitrate_info(c("bit_rate")), "Frame rate": fmt.frame_rate(c("fps")), "Description": fmt.metadata(c("tags"), "description", "comment"), "Writing application": fmt.metadata(c("tags"), "encoder"),
    })


def audio(streams: DataFrame) -> DataFrame:
    """streams: media_id, stream_index, codec, codec_name, tag, duration_ms, bit_rate, channels, layout, sample_rate, is_default; the chosen audio stream of each media."""
    c = F.col
    bits = fmt.pcm_bits(c("codec"))
    return _long(streams, SECTIONS[1], {
        "ID": c("stream_index") + 1, "Format": c("codec"), "Format/Info": c("codec_name"), "Codec ID": fmt.fourcc(c("tag")), "Duration": fmt.duration_text(c("duration_ms")),
        "Bit rate": fmt.bitrate_info(fmt.audio_bit_rate(c("bit_rate"), c("sample_rate"), c("channels"), bits)), "Channel(s)": F.when(c("channels") > 0, F.concat(c("channels").cast("string"), F.lit(" channels"))), "Channel layout": c("layout"),
        "Sampling rate": F.when(c("sample_rate") > 0, fmt.sampling_khz(c("sample_rate"))), "Default": F.when(c("is_default"), "Yes").otherwise("No"),
    })


def video(streams: DataFrame) -> DataFrame:
    """streams: media_id, stream_index, codec, codec_name, profile, tag, duration_ms, bit_rate, width, height, sar_num, sar_den, fps, range, primaries, transfer, space, field_order, log2_w, log2_h, is_rgb, depth, has_mastering, max_cll, max_fall; the chosen video stream of each media."""
    c = F.col
    transfer = fmt.lookup(c("transfer"), fmt.TRANSFERS, F.lit(""))
    light = (F.coalesce(c("max_cll"), F.lit(0)) > 0) | (F.coalesce(c("max_fall"), F.lit(0)) > 0)
    nits = lambda x: F.when(x > 0, F.concat(x.cast("string"), F.lit(" cd/m2")))
    return _long(streams, SECTIONS[2], {
        "ID": c("stream_index") + 1, "Format": c("codec"), "Format/Info": c("codec_name"), "Format profile": c("profile"), "HDR format": fmt.hdr_class(transfer, F.coalesce(c("has_mastering"), F.lit(False)), light), "Codec ID": fmt.fourcc(c("tag")),
        "Duration": fmt.duration_text(c("duration_ms")), "Bit rate": fmt.bitrate_info(c("bit_rate")), "Width": fmt.pixels(c("width")), "Height": fmt.pixels(c("height")),
        "Display aspect ratio": F.when((c("width") > 0) & (c("height") > 0), fmt.display_aspect(c("width"), c("height"), c("sar_num"), c("sar_den"))), "Frame rate": fmt.frame_rate(c("fps")), "Color space": F.when(c("is_rgb"), "RGB").otherwise("YUV"),
        "Chroma subsampling": fmt.chroma_subsampling(c("log2_w"), c("log2_h"), c("is_rgb")), "Bit depth": fmt.bit_depth(c("depth")), "Scan type": fmt.lookup(c("field_order"), fmt.SCAN_TYPES), "Color range": fmt.lookup(c("range"), fmt.COLOR_RANGES),
        "Color primaries": fmt.lookup(c("primaries"), fmt.PRIMARIES), "Transfer characteristics": transfer, "Matrix coefficients": fmt.lookup(c("space"), fmt.SPACES), "Maximum Content Light Level": nits(c("max_cll")), "Maximum Frame-Average Light Level": nits(c("max_fall")),
    })


def playback_clock(streams: DataFrame) -> DataFrame:
    """The stream that paces each media: its video stream, else its audio stream."""
    first = F.row_number().over(Window.partitionBy("media_id").orderBy("stream_type", "stream_index"))
    return streams.filter(F.col("stream_type").isin(0, 1)).withColumn("_n", first).filter("_n = 1").select("media_id", "stream_index")
