"""Python data sources for raw media: image sequences and PCM, both split into ranges that executors read on their own.

A file is read through Spark's own reader (binaryFile) where `raw_frames_from` is used, which works for any store; the
data sources below seek in files and need a path that executors can open.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from ..functions.pixels import frame_size

PCM_BYTES = {"u8": 1, "s16le": 2, "s16be": 2, "s24le": 3, "s24be": 3, "s32le": 4, "f32le": 4, "f32be": 4}


def geometry_of(name: str) -> tuple[int, int]:
    """Width and height in a file name; 1920 by 1080 without any."""
    m = re.search(r"(\d{2,5})\s*[xX]\s*(\d{2,5})", name) or re.search(r"[wW](\d{2,5}).*[hH](\d{2,5})", name)
    return (int(m[1]), int(m[2])) if m else (1920, 1080)


def format_of(name: str) -> str:
    """Pixel format in a file name or suffix, planar 4:2:0 without any."""
    n = name.lower()
    for fmt, marks in (("NV12", ("nv12",)), ("YUY2", ("yuy2",)), ("RGB24", ("rgb24", "_rgb")), ("BGR24", ("bgr24", "_bgr"))):
        if any(x in n for x in marks) or n.endswith("." + fmt[:3].lower()) and fmt in ("RGB24", "BGR24"):
            return fmt
    return "YUV420P"


class Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class RawVideoSource(DataSource):
    """spark.read.format("raw_video").load(path), options width, height, pix_fmt (else from the name), frames_per_partition. Filters on idx are pushed down: other frames aren't read."""

    @classmethod
    def name(cls) -> str:
        return "raw_video"

    def schema(self) -> str:
        return "media_id bigint, idx bigint, width int, height int, format string, data binary"

    def reader(self, schema) -> DataSourceReader:
        return RawVideoReader(self.options)


class RawVideoReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        width, height = geometry_of(os.path.basename(self.path))
        self.width, self.height = int(options.get("width", width)), int(options.get("height", height))
        self.format = options.get("pix_fmt", format_of(os.path.basename(self.path)))
        self.media = int(options.get("media_id", 0))
        self.size = frame_size(self.width, self.height, self.format)
        self.per_partition = max(1, int(options.get("frames_per_partition", max(1, (64 << 20) // self.size))))
        self.low, self.high = 0, None

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute == ("idx",) if hasattr(f, "attribute") else False
            if column and isinstance(f, EqualTo) and f.value is not None:
                self.low, self.high = max(self.low, f.value), f.value if self.high is None else min(self.high, f.value)
            elif column and isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, f.value)
            elif column and isinstance(f, LessThanOrEqual):
                self.high = f.value if self.high is None else min(self.high, f.value)
            else:
                yield f

    def partitions(self):
        total = os.path.getsize(self.path) // self.size  # an incomplete last frame is left out
        if total == 0:
            raise ValueError(f"{self.path} is shorter than a frame of {self.size} bytes")
        end = total if self.high is None else min(total, self.high + 1)
        return [Range(self.path, a, min(end, a + self.per_partition)) for a in range(self.low, end, self.per_partition)] or [Range(self.path, 0, 0)]

    def read(self, part: Range):
        with open(part.path, "rb") as f:
            f.seek(part.first * self.size)
            for i in range(part.first, part.last):
                yield (self.media, i, self.width, self.height, self.format, f.read(self.size))


class RawPcmSource(DataSource):
    """spark.read.format("raw_pcm").load(path), options fmt, rate, channels, frame_samples: audio frames with 16-bit samples."""

    @classmethod
    def name(cls) -> str:
        return "raw_pcm"

    def schema(self) -> str:
        return "media_id bigint, idx bigint, ts double, sample_count int, sample_rate int, channels int, byte_count int, samples array<smallint>"

    def reader(self, schema) -> DataSourceReader:
        return RawPcmReader(self.options)


class RawPcmReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.fmt, self.rate, self.channels = options.get("fmt", "s16le"), int(options.get("rate", 44100)), int(options.get("channels", 2))
        if self.fmt not in PCM_BYTES or not 8000 <= self.rate <= 384000 or not 1 <= self.channels <= 8:
            raise ValueError("PCM needs a known format, a rate of 8000 to 384000 and 1 to 8 channels")
        self.media, self.samples = int(options.get("media_id", 0)), int(options.get("frame_samples", 1024))
        self.size = self.samples * self.channels * PCM_BYTES[self.fmt]

    def partitions(self):
        total = -(-os.path.getsize(self.path) // self.size)
        step = max(1, (32 << 20) // self.size)
        return [Range(self.path, a, min(total, a + step)) for a in range(0, total, step)] or [Range(self.path, 0, 0)]

    def read(self, part: Range):
        from ..operators.audio import decode_pcm

        unit = self.channels * PCM_BYTES[self.fmt]
        with open(part.path, "rb") as f:
            f.seek(part.first * self.size)
            for i in range(part.first, part.last):
                data = f.read(self.size)
                data = data[: len(data) // unit * unit]
                if data:
                    yield (self.media, i, i * self.samples / self.rate, len(data) // unit, self.rate, self.channels, len(data), decode_pcm(data, self.fmt).tolist())


def register(spark: SparkSession) -> None:
    """Makes both formats known, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawVideoSource)
    spark.dataSource.register(RawPcmSource)


def raw_frames_from(spark: SparkSession, path: str, width: int, height: int, fmt: str) -> DataFrame:
    """Frames of raw files in any store that Spark reads, a file a media. Each file is read once and cut in its task; files beyond 2 GB need the raw_video source, which seeks."""
    size = frame_size(width, height, fmt)
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") >= size).select(F.xxhash64("path").alias("media_id"), "content")

    def run(batches):
        import pyarrow as pa

        most = max(1, (8 << 20) // size)
        for b in batches:
            for media, content in zip(b.column("media_id").to_pylist(), b.column("content")):
                data = memoryview(content.as_buffer())
                for at in range(0, len(data) // size, most):
                    idx = list(range(at, min(at + most, len(data) // size)))
                    n = len(idx)
                    columns = [pa.array([media] * n, pa.int64()), pa.array(idx, pa.int64()), pa.array([width] * n, pa.int32()), pa.array([height] * n, pa.int32()), pa.array([fmt] * n), pa.array([data[i * size : (i + 1) * size] for i in idx], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["media_id", "idx", "width", "height", "format", "data"])

    return files.mapInArrow(run, "media_id long, idx long, width int, height int, format string, data binary")
