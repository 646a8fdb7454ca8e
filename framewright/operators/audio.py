"""Audio frames as arrays. Level and waveform are expressions that stay in the JVM; so is spectrum_expression, but interpreted lambdas
make a Fourier transform some hundred times slower than numpy on Arrow batches, which spectrum uses."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WAVEFORM, BINS, FFT = 128, 32, 256


def rms_level(samples: Column) -> Column:
    """Root mean square over interleaved 16-bit samples as a share of full scale, 0 to 1; 0 without samples."""
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.least(F.sqrt(total / F.size(samples)) / 32768.0, F.lit(1.0))).otherwise(0.0)


def mono(samples: Column, channels: Column) -> Column:
    """The mean over channels of each frame, -1 to 1."""
    frames = F.floor(F.size(samples) / channels).cast("int")
    mix = lambda i: F.aggregate(F.slice(samples, i * channels + 1, channels), F.lit(0.0), lambda a, x: a + x.cast("double")) / channels / 32768.0
    many = F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), mix)).otherwise(F.array().cast("array<double>"))
    return F.when(channels == 1, F.transform(samples, lambda x: x.cast("double") / 32768.0)).otherwise(many)


def waveform(wave: Column, points: int = WAVEFORM) -> Column:
    """At most `points` values of a mono wave, evenly picked."""
    n = F.least(F.lit(points), F.size(wave))
    pick = lambda i: F.least(F.greatest(F.element_at(wave, (F.floor(i.cast("long") * F.size(wave) / n) + 1).cast("int")), F.lit(-1.0)), F.lit(1.0))
    return F.when(F.size(wave) > 0, F.transform(F.sequence(F.lit(0), n - 1), pick)).otherwise(F.array().cast("array<double>"))


def spectrum_expression(wave: Column, bins: int = BINS, fft: int = FFT) -> Column:
    """Magnitudes |X_k| / n of the first n = min(frames, fft) frames at `bins` frequencies; empty below 8 frames."""
    n = F.least(F.size(wave), F.lit(fft))
    half = F.floor(n / 2).cast("int") - 1

    def at(b: Column) -> Column:
        k = F.least(half, F.greatest(F.lit(0), F.floor(b / float(bins) * half).cast("int")))
        turn = lambda i: -2.0 * math.pi * k * i / n
        part = lambda f: F.aggregate(F.transform(F.slice(wave, 1, n), lambda x, i: x * f(turn(i))), F.lit(0.0), lambda a, x: a + x)
        re, im = part(F.cos), part(F.sin)
        return F.sqrt(re * re + im * im) / n

    return F.when(F.size(wave) >= 8, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), at)).otherwise(F.array().cast("array<double>"))


def spectrum(wave: Column, bins: int = BINS, fft: int = FFT) -> Column:
    """The same as spectrum_expression, computed for all frames of a length at once."""
    import numpy as np

    @F.pandas_udf("array<double>")
    def of(waves: pd.Series) -> pd.Series:
        out = [np.zeros(0)] * len(waves)
        lengths = np.fromiter((0 if w is None else len(w) for w in waves), np.int64, len(waves))
        for n in np.unique(np.minimum(lengths, fft)):
            if n < 8:
                continue
            rows = np.flatnonzero(np.minimum(lengths, fft) == n)
            half = n // 2 - 1
            k = np.minimum(half, np.maximum(0, (np.arange(bins) / bins * half).astype(int)))
            turn = np.exp(-2j * np.pi * np.outer(np.arange(n), k) / n)
            x = np.stack([np.asarray(waves.iloc[i], float)[:n] for i in rows])
            for i, values in zip(rows, np.abs(x @ turn) / n):
                out[i] = values
        return pd.Series(out, index=waves.index)

    return of(wave)


def visualization(audio: DataFrame, points: int = WAVEFORM) -> DataFrame:
    """media_id, idx, ts, level, sample_rate, channels, waveform, spectrum of frames with samples."""
    audio = audio.withColumn("_mono", mono(F.col("samples"), F.col("channels")))
    return audio.select("media_id", "idx", "ts", rms_level(F.col("samples")).alias("level"), "sample_rate", "channels", waveform(F.col("_mono"), points).alias("waveform"), spectrum(F.col("_mono")).alias("spectrum"))


def unpivot(viz: DataFrame) -> DataFrame:
    """A row for each point of either array."""
    part = lambda c: viz.select("media_id", "idx", F.lit(c).alias("section"), F.posexplode(c).alias("point_index", "value"))
    return part("waveform").unionByName(part("spectrum"))


def latest(viz: DataFrame) -> DataFrame:
    """The last frame of each media."""
    cols = [c for c in viz.columns if c != "media_id"]
    return viz.groupBy("media_id").agg(F.max_by(F.struct(*cols), "idx").alias("m")).select("media_id", *[F.col("m." + c).alias(c) for c in cols])


def smooth(viz: DataFrame, attack: float = 0.05, release: float = 0.20, history: int = 90) -> DataFrame:
    """The meter at the end of the last `history` frames: y moves toward each level by 1 - exp(-dt / tau), tau by direction."""
    nth = F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("idx")))
    w = Window.partitionBy("media_id").orderBy("idx")
    rows = viz.withColumn("dt", F.col("ts") - F.lag("ts").over(w)).withColumn("_n", nth).filter(F.col("_n") <= history)
    x = F.struct("idx", "level", F.greatest(F.coalesce("dt", F.lit(0.0)), F.lit(0.0)).alias("dt"))
    step = lambda y, v: y + (v["level"] - y) * (1 - F.exp(-v["dt"] / F.when(v["level"] > y, attack).otherwise(release)))
    return rows.groupBy("media_id").agg(F.round(F.aggregate(F.array_sort(F.collect_list(x)), F.lit(0.0), step), 9).alias("meter"))


def decode_pcm(data: bytes, fmt: str):
    """Raw PCM bytes as 16-bit samples."""
    import numpy as np

    order, kind = (">" if fmt.endswith("be") else "<"), fmt.removesuffix("le").removesuffix("be")
    if kind == "u8":
        return ((np.frombuffer(data, np.uint8).astype(np.int16) - 128) << 8).astype(np.int16)
    if kind == "s16":
        return np.frombuffer(data, order + "i2").astype(np.int16)
    if kind == "s24":
        b = np.frombuffer(data, np.uint8).reshape(-1, 3)
        high, mid = (b[:, 0], b[:, 1]) if order == ">" else (b[:, 2], b[:, 1])
        return (high.astype(np.int16) << 8 | mid).astype(np.int16)
    if kind == "s32":
        return (np.frombuffer(data, order + "i4") >> 16).astype(np.int16)
    if kind == "f32":
        return np.clip(np.round(np.frombuffer(data, order + "f4") * 32768.0), -32768, 32767).astype(np.int16)
    raise ValueError(f"unknown PCM format {fmt}")


def trigger(samples: Column, span: int = 1000) -> Column:
    """Where a waveform view starts: among the last `span` samples the place of the steepest fall (over 9 samples) that crosses zero in its middle, the latest of equals; without one, the last place there is."""
    n = F.size(samples)
    low, high = F.greatest(n - span, F.lit(0)), n - 10
    at = lambda i: F.get(samples, i).cast("int")
    scored = F.transform(F.sequence(low, F.greatest(high, low)), lambda i: F.struct(F.when((at(i + 4) < 0) != (at(i + 5) < 0), at(i) - at(i + 9)).alias("score"), i.alias("i")))
    best = F.array_max(F.filter(scored, lambda x: x["score"].isNotNull()))
    return F.when(high >= 0, F.coalesce(best["i"], high)).cast("int")


def rdft_columns(audio: DataFrame, scale: float = 1.0, top: int = 255) -> DataFrame:
    """(media_id, idx, levels): a spectrogram column of each frame: parabolic window, root of the scaled magnitude, capped."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = []
            for x in b.column("mono").to_pylist():
                x, n = np.array(x, np.float64), len(x)
                w = (np.arange(n) - (n - 1) / 2) / max((n - 1) / 2, 1)
                level = np.sqrt(np.abs(np.fft.rfft(x * (1 - w**2))[: n // 2]) / max(np.sqrt(n), 1)) if n else np.zeros(0)
                out.append(np.minimum(level * scale + 1e-7, top).astype(np.int32).tolist())
            yield pa.RecordBatch.from_arrays([b.column("media_id"), b.column("idx"), pa.array(out, pa.list_(pa.int32()))], names=["media_id", "idx", "levels"])

    return audio.select("media_id", "idx", mono(F.col("samples"), F.col("channels")).alias("mono")).mapInArrow(run, "media_id long, idx long, levels array<int>")
