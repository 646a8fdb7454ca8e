"""Macroblock fields in long form: a row for each block of each frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of the macroblock type.
TYPES = {"intra4x4": 0x0001, "intra16x16": 0x0002, "inter16x16": 0x0008, "inter16x8": 0x0010, "inter8x16": 0x0020, "inter8x8": 0x0040, "skip": 0x0800}
LIST0, LIST1 = 0x3000, 0xC000


def q_stats(blocks: DataFrame) -> DataFrame:
    """Quantiser by frame: integer mean over all blocks, maximum, and the smallest that isn't 0 (100 if there is none)."""
    return blocks.groupBy("media_id", "frame_idx").agg(
        F.expr("cast(sum(cast(q as bigint)) div count(*) as int)").alias("avg_q"), F.max("q").alias("max_q"), F.coalesce(F.min(F.when(F.col("q") != 0, F.col("q"))), F.lit(100)).alias("min_q"))


def type_counts(blocks: DataFrame, lists: bool = True) -> DataFrame:
    """Blocks that have each type bit (a block may have several); uses of either list only on request."""
    has = lambda mask: F.count_if(F.col("mb_type").bitwiseAND(F.lit(mask)) != 0)
    cols = [has(bit).alias(name) for name, bit in TYPES.items()]
    return blocks.groupBy("media_id", "frame_idx").agg(*cols, *([has(LIST0).alias("list0"), has(LIST1).alias("list1")] if lists else []))


def geometry(width: Column, height: Column, log2_mv: Column) -> list[Column]:
    """Blocks across, stride, blocks in all, vectors a block."""
    across, stride = F.shiftright(width + 15, 4), (F.floor(width / 16) + 1).cast("int")
    return [across.alias("mb_width"), stride.alias("mb_stride"), (F.shiftright(height + 15, 4) * stride).alias("mb_sum"), F.expr(f"cast(shiftleft(1, 2 * (4 - {log2_mv})) as int)").alias("mvs_per_mb") if isinstance(log2_mv, str) else F.pow(F.lit(2), 2 * (4 - log2_mv)).cast("int").alias("mvs_per_mb")]


def vector_index(mb_y: Column, mb_x: Column, n: Column, m: Column, mb_stride: Column, sample: Column, h264: Column) -> Column:
    """Where the motion vector (n, m) of a block lies in the frame's array; `sample` vectors a block side."""
    mv_stride = mb_stride * sample + F.when(h264, 0).otherwise(1)
    return (mb_y * mv_stride + mb_x) * sample + n + m * mv_stride


def unpack_vectors(frames: DataFrame) -> DataFrame:
    """Vectors by position: (media_id, frame_idx, mb_y, mb_x, part, mv) from an array by frame with mb_stride blocks a row and `sample` vectors a block side."""
    per_row = F.col("mb_stride") * F.col("sample")
    rows = frames.select("media_id", "frame_idx", "mb_stride", "sample", F.posexplode("mv").alias("p", "mv"))
    y, x = F.floor(F.col("p") / per_row), F.col("p") % per_row
    part = (y % F.col("sample")) * F.col("sample") + x % F.col("sample")
    return rows.select("media_id", "frame_idx", F.floor(y / F.col("sample")).cast("int").alias("mb_y"), F.floor(x / F.col("sample")).cast("int").alias("mb_x"), part.cast("int").alias("part"), "mv")


def reference_of(refs: Column, mb: Column) -> Column:
    """The first of a block's four reference indices."""
    return F.element_at(refs, (mb * 4 + 1).cast("int"))


def q_grey(q: Column) -> Column:
    return F.floor(q * 255 / 51).cast("int")


def ref_grey(ref: Column, refs: Column) -> Column:
    return F.when(refs > 0, F.floor(ref * 128 / refs) + 128).otherwise(128).cast("int")


def lines(blocks: DataFrame, field: str = "q") -> DataFrame:
    """A text line for each row of blocks, left to right."""
    line = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("mb_x", F.col(field).cast("string").alias("v")))), lambda s: s["v"]))
    return blocks.groupBy("media_id", "frame_idx", "mb_y").agg(line.alias("line"))
