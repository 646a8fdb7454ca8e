"""Image operators over frames. Histograms and conversions are plain expressions; geometry runs as numpy in Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(images: DataFrame, channel: str = "grey") -> DataFrame:
    """(media_id, frame_idx, channel, bin, value) in long form; value is the count over the frame's largest."""
    counts = images.select("media_id", F.col("idx").alias("frame_idx"), F.explode("pixels").alias("bin")).groupBy("media_id", "frame_idx", "bin").agg(F.count("*").alias("n"))
    top = F.max("n").over(Window.partitionBy("media_id", "frame_idx"))
    return counts.select("media_id", "frame_idx", F.lit(channel).alias("channel"), "bin", F.round(F.col("n") / top, 9).alias("value"))


def histogram_rgb(images: DataFrame) -> DataFrame:
    """As histogram(), of the three channels of images whose `rgb` is an array of (r, g, b)."""
    one = images.select("media_id", F.col("idx").alias("frame_idx"), F.explode("rgb").alias("p"))
    bins = one.select("media_id", "frame_idx", F.explode(F.create_map(F.lit("r"), F.col("p.r"), F.lit("g"), F.col("p.g"), F.lit("b"), F.col("p.b"))).alias("channel", "bin"))
    counts = bins.groupBy("media_id", "frame_idx", "channel", "bin").agg(F.count("*").alias("n"))
    top = F.max("n").over(Window.partitionBy("media_id", "frame_idx", "channel"))
    return counts.select("media_id", "frame_idx", "channel", F.col("bin").cast("int").alias("bin"), F.round(F.col("n") / top, 9).alias("value"))


def histogram_hs(images: DataFrame, h_bins: int = 16, s_bins: int = 8) -> DataFrame:
    """(media_id, frame_idx, h_bin, s_bin, value): counts over hue in [0, 180) and saturation in [0, 255), scaled by the frame's largest; bins without a pixel are left out."""
    p = images.select("media_id", F.col("idx").alias("frame_idx"), F.explode("rgb").alias("p")).select("media_id", "frame_idx", "p.*")
    p = p.withColumn("top", F.greatest("r", "g", "b")).withColumn("d", (F.col("top") - F.least("r", "g", "b")).cast("double"))
    r, g, b, d = (F.col(c) for c in "rgbd")
    sixth = (g - b) / d
    hue = 30.0 * F.when(d == 0, 0.0).when(F.col("top") == r, sixth - 6 * F.floor(sixth / 6)).when(F.col("top") == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    p = p.withColumn("hue", hue).withColumn("sat", F.when(F.col("top") == 0, 0.0).otherwise(d / F.col("top") * 255)).filter("hue < 180 and sat < 255")
    counts = p.groupBy("media_id", "frame_idx", F.floor(F.col("hue") / (180.0 / h_bins)).cast("int").alias("h_bin"), F.floor(F.col("sat") / (255.0 / s_bins)).cast("int").alias("s_bin")).agg(F.count("*").alias("n"))
    return counts.select("media_id", "frame_idx", "h_bin", "s_bin", F.round(F.col("n") / F.max("n").over(Window.partitionBy("media_id", "frame_idx")), 9).alias("value"))


def channel_plane(images: DataFrame, name: str) -> DataFrame:
    """(media_id, idx, channel, width, height, pixels): one of R, G, B, Y, U, V of images whose `rgb` is an array of (r, g, b)."""

    def value(p: Column) -> Column:
        if name in "RGB":
            return p[name.lower()].cast("int")
        y = 0.299 * p["r"] + 0.587 * p["g"] + 0.114 * p["b"]
        v = {"Y": y, "U": (p["b"] - y) * 0.564 + 128, "V": (p["r"] - y) * 0.713 + 128}[name]
        return F.least(F.greatest(F.rint(v), F.lit(0)), F.lit(255)).cast("int")

    return images.select("media_id", "idx", F.lit(name).alias("channel"), "width", "height", F.transform("rgb", value).alias("pixels"))


def normalized(images: DataFrame, top: float = 255.0) -> DataFrame:
    """Pixels scaled to 0..top; zeros where all are equal."""
    low, high = F.array_min("pixels"), F.array_max("pixels")
    return images.withColumn("pixels", F.transform("pixels", lambda x: F.when(high > low, (x - low) / (high - low).cast("double") * top).otherwise(0.0)))


def resized(images: DataFrame, width: int, height: int) -> DataFrame:
    """Bilinear, pixel centres aligned."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from ..functions import pixels

        for b in batches:
            out = [pixels.resize(np.array(p, np.float64).reshape(h, w), width, height).ravel() for p, w, h in zip(b.column("pixels").to_pylist(), b.column("width").to_pylist(), b.column("height").to_pylist())]
            n = len(out)
            yield pa.RecordBatch.from_arrays([b.column("media_id"), b.column("idx"), pa.array([width] * n, pa.int32()), pa.array([height] * n, pa.int32()), pa.array([x.tolist() for x in out], pa.list_(pa.float64()))], names=["media_id", "idx", "width", "height", "pixels"])

    return images.select("media_id", "idx", "width", "height", "pixels").mapInArrow(run, "media_id long, idx long, width int, height int, pixels array<double>")


def to_bgr(frames: DataFrame) -> DataFrame:
    """Planar 4:2:0 frames (width, height, data) in video range as BGR24 (BT.601); NULL for sides that don't convert."""

    def run(batches):
        import pyarrow as pa

        from ..functions import pixels

        for b in batches:
            found = [pixels.video_range_bgr(d, w, h) for d, w, h in zip(b.column("data").to_pylist(), b.column("width").to_pylist(), b.column("height").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("media_id"), b.column("idx"), b.column("width"), b.column("height"), pa.array([None if x is None else x.tobytes() for x in found], pa.binary())], names=["media_id", "idx", "width", "height", "data"])

    return frames.select("media_id", "idx", "width", "height", "data").mapInArrow(run, "media_id long, idx long, width int, height int, data binary")


def bgr_sums(frames: DataFrame) -> DataFrame:
    """(media_id, idx, b, g, r): the sums of the channels of to_bgr()."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            sums = np.array([np.frombuffer(x or b"", np.uint8).reshape(-1, 3).sum(0, dtype=np.int64) for x in b.column("data").to_pylist()], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("media_id"), b.column("idx"), *(pa.array(sums[:, i]) for i in range(3))], names=["media_id", "idx", "b", "g", "r"])

    return to_bgr(frames).mapInArrow(run, "media_id long, idx long, b long, g long, r long")


def yuv_to_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """Full range, products cut toward zero."""
    u, v = u - 128, v - 128
    clamp = lambda c: F.greatest(F.least(c, F.lit(255)), F.lit(0)).cast("int")
    return clamp(y + (v * 1.402).cast("int")), clamp(y - (u * 0.344136 + v * 0.714136).cast("int")), clamp(y + (u * 1.772).cast("int"))


def _measured(images: DataFrame, schema: str, measure) -> DataFrame:
    """A row of measure(plane) for each frame, whose pixels are a row-major array."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = [part.split()[0] for part in schema.split(", ")]
        kinds = {"int": pa.int32(), "double": pa.float64(), "long": pa.int64(), "binary": pa.binary()}
        types = [kinds[part.split()[1]] for part in schema.split(", ")]
        for b in batches:
            rows = [measure(np.array(p, np.uint8).reshape(h, w)) for p, w, h in zip(b.column("pixels").to_pylist(), b.column("width").to_pylist(), b.column("height").to_pylist())]
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("media_id"), b.column("idx")] + [pa.array(list(c), t) for c, t in zip(cols, types)], names=["media_id", "idx", *names])

    return images.select("media_id", "idx", "width", "height", "pixels").mapInArrow(run, f"media_id long, idx long, {schema}")


def edges(images: DataFrame, low: float = 100, high: float = 200) -> DataFrame:
    """Edge pixels of each frame and their share."""
    from ..functions import pixels

    def measure(p):
        n = int(pixels.canny(p, low, high).sum())
        return n, n / p.size

    return _measured(images, "edge_pixel_count int, edge_ratio double", measure)


def contours(images: DataFrame, low: float = 100, high: float = 200) -> DataFrame:
    """Connected edge outlines of each frame and the box around them."""
    from ..functions import pixels

    def measure(p):
        e = pixels.canny(p, low, high)
        return (pixels.components(e)[0], *pixels.bounding_box(e))

    return _measured(images, "contour_count int, x int, y int, box_width int, box_height int", measure)


def spectra(images: DataFrame) -> DataFrame:
    """Of the 2-D Fourier transform of each frame: the sum of the log picture and the energy."""
    from ..functions import pixels

    def measure(p):
        shown, _, total, energy = pixels.dft2d(p)
        return total, energy, shown.tobytes()

    return _measured(images, "spectrum_sum double, energy double, magnitude binary", measure)


def face_landmarks(faces: DataFrame) -> DataFrame:
    """Estimated eyes, nose and mouth corners as fixed shares of the box, cut to whole pixels."""
    at = lambda fx, fy: F.struct((F.col("x") + (F.col("width") * fx).cast("int")).alias("x"), (F.col("y") + (F.col("height") * fy).cast("int")).alias("y"))
    return faces.select("*", at(0.3, 0.4).alias("left_eye"), at(0.7, 0.4).alias("right_eye"), at(0.5, 0.6).alias("nose"), at(0.35, 0.8).alias("left_mouth"), at(0.65, 0.8).alias("right_mouth"))


def detections_to_faces(detections: DataFrame, least: float = 0.5) -> DataFrame:
    """Network detections (confidence, x1, y1, x2, y2 as shares of the frame) above the confidence, as pixel boxes."""
    d = detections.filter(F.col("confidence") > least)
    x1, y1, x2, y2 = ((F.col(c) * F.col(side)).cast("int") for c, side in (("x1", "frame_width"), ("y1", "frame_height"), ("x2", "frame_width"), ("y2", "frame_height")))
    return d.select("media_id", "frame_idx", "confidence", x1.alias("x"), y1.alias("y"), (x2 - x1).alias("width"), (y2 - y1).alias("height"))


def detect_faces(images: DataFrame, detector) -> DataFrame:
    """Boxes found by `detector`, a function from a plane to (x, y, width, height, confidence) rows. No model is shipped: without one this is not available."""
    if detector is None:
        raise NotImplementedError("face detection needs a detector")

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = [(m, i, k, *map(int, box[:4]), float(box[4])) for m, i, w, h, p in pdf[["media_id", "idx", "width", "height", "pixels"]].itertuples(index=False) for k, box in enumerate(detector(np.array(p, np.uint8).reshape(h, w)))]
            yield pd.DataFrame(rows, columns=["media_id", "frame_idx", "face_idx", "x", "y", "width", "height", "confidence"])

    return images.mapInPandas(run, "media_id long, frame_idx long, face_idx int, x int, y int, width int, height int, confidence double")


def face_stats(faces: DataFrame, last: int = 100) -> DataFrame:
    """Faces of each media and the mean number over its last frames."""
    per = faces.groupBy("media_id", "frame_idx").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("frame_idx")))
    per = per.withColumn("_k", nth)
    return per.groupBy("media_id").agg(F.sum("n").alias("total_faces"), F.round(F.avg(F.when(F.col("_k") <= last, F.col("n"))), 9).alias("recent_mean"))


def decode_raw(frames: DataFrame) -> DataFrame:
    """Raw frames (width, height, format, data) as grey pixel arrays."""

    def run(batches):
        import pandas as pd

        from ..functions import pixels

        for pdf in batches:
            grey = [pixels.grey(pixels.to_rgb(d, w, h, f)).ravel().astype("int32").tolist() for w, h, f, d in pdf[["width", "height", "format", "data"]].itertuples(index=False)]
            yield pd.DataFrame({"media_id": pdf["media_id"], "idx": pdf["idx"], "width": pdf["width"], "height": pdf["height"], "pixels": grey})

    return frames.mapInPandas(run, "media_id long, idx long, width int, height int, pixels array<int>")
