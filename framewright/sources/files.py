"""Batch sources: packet logs, playlists, configuration files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema


def read_packets(spark: SparkSession, path: str, fmt: str | None = None, ddl: str = schema.PACKETS) -> DataFrame:
    """A packet log in Parquet, CSV (with a header) or JSON, the format by suffix if none is given; the schema is never guessed."""
    fmt = fmt or next((f for f in ("csv", "json", "orc") if path.rstrip("/").endswith("." + f)), "parquet")
    reader = spark.read.schema(ddl)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def stream_packets(spark: SparkSession, path: str, fmt: str = "parquet", ddl: str = schema.PACKETS, files_per_trigger: int = 16) -> DataFrame:
    """The same as an unbounded source; files_per_trigger limits how much a micro-batch takes on."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def playlist_tracks(lines: DataFrame) -> DataFrame:
    """(file, pos, location, title) of lines (file, line, value) of M3U playlists: every line that isn't empty or a comment is a track named by its location."""
    from pyspark.sql import Window

    tracks = lines.select("file", "line", F.trim("value").alias("location")).filter("location <> '' and location not like '#%'")
    pos = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1
    return tracks.select("file", pos.cast("int").alias("pos"), "location", F.col("location").alias("title"))


def read_m3u(spark: SparkSession, path: str) -> DataFrame:
    """The tracks of M3U playlists, see playlist_tracks()."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return playlist_tracks(lines)


def read_xspf(spark: SparkSession, path: str) -> DataFrame:
    """The tracks of XSPF playlists, one row each."""
    ddl = ", ".join(f"{c} STRING" for c in ("location", "title", "creator", "album", "trackNum", "annotation", "duration"))
    return spark.read.format("xml").option("rowTag", "track").schema(ddl).load(path)


def parse_config(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key, value) of `key = value` lines in order of `line`: # and ; start comments, both sides are trimmed, double quotes around a value go, the last wins."""
    text = F.trim(F.col(column))
    rows = lines.select("line", text.alias("t")).filter("t <> '' and t not like '#%' and t not like ';%' and instr(t, '=') > 0")
    key, value = F.trim(F.substring_index("t", "=", 1)), F.trim(F.expr("substring(t, instr(t, '=') + 1)"))
    rows = rows.select("line", key.alias("key"), F.regexp_replace(value, '^"(.*)"$', "$1").alias("value"))
    return rows.groupBy("key").agg(F.max_by("value", "line").alias("value"))


class Config(dict):
    """Typed access to settings read by load()."""

    @classmethod
    def load(cls, text: str) -> Config:
        found = cls()
        for line in text.splitlines():
            line = line.strip()
            if line and line[0] not in "#;" and "=" in line:
                k, v = (x.strip() for x in line.split("=", 1))
                found[k] = v[1:-1] if len(v) >= 2 and v[0] == v[-1] == '"' else v
        return found

    def get_int(self, key: str, default: int = 0) -> int:
        try:
            return int(self[key])
        except (KeyError, ValueError):
            return default

    def get_float(self, key: str, default: float = 0.0) -> float:
        try:
            return float(self[key])
        except (KeyError, ValueError):
            return default

    def get_bool(self, key: str, default: bool = False) -> bool:
        return self[key].lower() in ("true", "1", "yes", "on") if key in self else default

    def dump(self) -> str:
        return "".join(f"{k} = {self[k]}\n" for k in sorted(self))
