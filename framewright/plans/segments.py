"""Ordered windows over keys of any length.

A window keyed by media puts all of a media's rows in one task. Here rows are cut into segments by their order value;
windows run inside segments, a summary of a row for each segment is scanned in order, and what it carries into each
segment is joined back. So one very long media is spread over as many tasks as it has segments, at the price of a
second pass; for media that fit a task, the plain window is cheaper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Segments of all media that are broadcast; more are joined by a shuffle.
BROADCAST_SEGMENTS = 500_000


class Segments:
    """keys: what a sequence is keyed by; order: its integer order column; size: order values a segment."""

    def __init__(self, keys: list[str], order: str, size: int):
        self.keys, self.order, self.size = keys, order, size

    def cut(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_seg", F.floor(F.col(self.order) / self.size).cast("long"))

    def _window(self, first: int | None = None, last: int = 0):
        w = Window.partitionBy(*self.keys, "_seg").orderBy(self.order)
        return w.rowsBetween(Window.unboundedPreceding if first is None else first, last)

    def _carry(self, df: DataFrame, summary: Column, over) -> DataFrame:
        """df with _carry: `over` of the summaries of all earlier segments."""
        w = Window.partitionBy(*self.keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
        small = df.groupBy(*self.keys, "_seg").agg(summary.alias("_sum"))
        small = small.withColumn("_carry", over(F.col("_sum")).over(w)).drop("_sum")
        small = F.broadcast(small) if small.limit(BROADCAST_SEGMENTS + 1).count() <= BROADCAST_SEGMENTS else small
        return df.join(small, [*self.keys, "_seg"])

    def running_sum(self, df: DataFrame, value: Column, name: str) -> DataFrame:
        """Sum of value up to and with each row."""
        df = self.cut(df).withColumn("_v", value)
        df = self._carry(df.withColumn(name, F.sum("_v").over(self._window())), F.sum("_v"), F.sum)
        return df.withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).drop("_seg", "_v", "_carry")

    def last_value(self, df: DataFrame, value: Column, name: str, before: bool = False) -> DataFrame:
        """The last value that isn't NULL up to and with each row, or before it."""
        df = self.cut(df).withColumn("_v", value)
        own = F.last("_v", ignorenulls=True).over(self._window(last=-1 if before else 0))
        df = self._carry(df.withColumn(name, own), F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(self.order))), lambda c: F.last(c, ignorenulls=True))
        return df.withColumn(name, F.coalesce(name, "_carry")).drop("_seg", "_v", "_carry")
