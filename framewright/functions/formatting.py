"""Scalar functions on columns: timestamps, durations, rates and labels as the media reports show them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of flag bits, picture types and bits of a sample by codec.
FLAG_NAMES = {1: "KEY", 2: "CORRUPT", 4: "DISCARD", 8: "TRUSTED", 16: "DISPOSABLE"}
PICTURE_NAMES = {1: "I", 2: "P", 3: "B"}
PICTURE_NAMES_ALL = PICTURE_NAMES | {4: "S", 5: "SI", 6: "SP", 7: "BI"}
PCM_BITS = {f"pcm_{kind}{bits}{order}": bits for kind, widths in (("s", (16, 24, 32)), ("u", (16, 24, 32)), ("f", (32, 64))) for bits in widths for order in ("le", "be")} | {"pcm_s8": 8, "pcm_u8": 8}
# Public codes of color range, field order, primaries, transfer and matrix, and their names.
COLOR_RANGES = {1: "Limited", 2: "Full"}
SCAN_TYPES = {1: "Progressive", 2: "Interlaced", 3: "Interlaced", 4: "Interlaced", 5: "Interlaced"}
PRIMARIES = {1: "BT.709", 4: "bt470m", 5: "bt470bg", 6: "smpte170m", 7: "smpte240m", 8: "film", 9: "BT.2020", 10: "smpte428", 11: "smpte431", 12: "Display P3", 22: "ebu3213"}
TRANSFERS = {1: "BT.709", 4: "bt470m", 5: "bt470bg", 6: "smpte170m", 7: "smpte240m", 8: "linear", 9: "log100", 10: "log316", 11: "iec61966-2-4", 12: "bt1361e", 13: "iec61966-2-1", 14: "bt2020-10", 15: "bt2020-12", 16: "PQ", 17: "smpte428", 18: "HLG"}
SPACES = {0: "gbr", 1: "BT.709", 4: "fcc", 5: "bt470bg", 6: "smpte170m", 7: "smpte240m", 8: "ycgco", 9: "BT.2020 (non-constant)", 10: "BT.2020 (constant)", 11: "smpte2085", 14: "ictcp"}


def lookup(code: Column, names: dict, default: Column | None = None) -> Column:
    """The name of a code, from a map literal; default (NULL) where there is none."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), code)
    return found if default is None else F.coalesce(found, default)


def packet_timestamp(pts: Column, dts: Column, num: Column, den: Column) -> Column:
    """Seconds: pts, else dts, times the time base; NULL without either or with a zero denominator."""
    return F.coalesce(pts, dts).cast("double") * num / F.when(den != 0, den)


def duration_text(ms: Column) -> Column:
    """'1 h 2 min 3 s'; hours and minutes only where there are any; empty for 0 or less."""
    h, m, s = F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60
    parts = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit(" h "))).otherwise(""), F.when((h > 0) | (m > 0), F.concat(m.cast("string"), F.lit(" min "))).otherwise(""), s.cast("string"), F.lit(" s"))
    return F.when(ms > 0, parts).otherwise("")


def clamp_ms(ms: Column) -> Column:
    return F.least(F.greatest(ms, F.lit(0)), F.lit(2147483647)).cast("int")


def pcm_bits(codec: Column) -> Column:
    return lookup(codec, PCM_BITS, F.lit(0))


def pcm_duration_ms(size: Column, rate: Column, channels: Column, bits: Column) -> Column:
    """Length of raw PCM; channels of 0 or less count as 1; NULL if a second has no bytes."""
    per_second = (rate.cast("long") * F.when(channels > 0, channels).otherwise(1) * F.floor(bits / 8)).cast("long")
    return F.floor(size.cast("long") * 1000 / F.when(per_second > 0, per_second)).cast("long")


def fixed(x: Column, places: int = 2) -> Column:
    """x with so many places as C's printf writes it: rounded by the exact binary value, exact ties to the even digit (format_string() rounds decimal digits, ties up). For |x| * 10 ** places below 2 ** 53."""
    scale = 10**places
    a = F.abs(x.cast("double"))
    n = F.floor(a * F.lit(float(scale)))
    split = a * F.lit(134217729.0)
    high = split - (split - a)  # the upper 26 bits: products of either half with scale are exact, so the sign of `over` is too
    over = (high * F.lit(float(scale)) - (n + F.lit(0.5))) + (a - high) * F.lit(float(scale))
    n = n + F.when((over > 0) | ((over == 0) & (n % 2 == 1)), 1).otherwise(0)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), places, "0"))


def rounded_number(x: Column) -> Column:
    """x rounded to two places as DuckDB's round() does, by its product with 100 in double precision, ties away from zero; as a JSON number without an exponent. For |x| below 2 ** 53 / 100."""
    n = F.round(F.abs(x.cast("double")) * F.lit(100.0), 0).cast("long")
    places = F.regexp_replace(F.lpad((n % 100).cast("string"), 2, "0"), "0$", "")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 100).cast("string"), F.lit("."), F.when(places == "", "0").otherwise(places))


def bitrate_info(bps: Column) -> Column:
    return F.when(bps > 0, F.concat(F.floor(bps / 1000).cast("string"), F.lit(" kb/s"))).otherwise("")


def bitrate_report(bps: Column) -> Column:
    whole = lambda unit, name: F.concat(F.floor(bps / unit).cast("string"), F.lit(name))
    return F.when(bps >= 1_000_000, whole(1_000_000, " Mbps")).when(bps >= 1000, whole(1000, " Kbps")).otherwise(F.concat(bps.cast("string"), F.lit(" bps")))


def frame_rate(fps: Column) -> Column:
    return F.when(fps > 0, F.format_string("%.3f FPS", fps)).otherwise("")


def pixels(n: Column) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(" pixels"))).otherwise("")


def fourcc(tag: Column) -> Column:
    """The four characters of a little-endian tag, NUL as a blank; empty for 0."""
    byte = lambda i: F.shiftright(tag, 8 * i).bitwiseAND(F.lit(255))
    chars = [F.when(byte(i) == 0, " ").otherwise(F.char(byte(i).cast("long"))) for i in range(4)]
    return F.when(tag == 0, "").otherwise(F.concat(*chars))


def flag_text(flags: Column) -> Column:
    names = F.concat_ws("|", *[F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in FLAG_NAMES.items()])
    return F.when(names == "", "-").otherwise(names)


def picture_name(code: Column) -> Column:
    return lookup(code, PICTURE_NAMES, F.lit("?"))


def clock(seconds: Column) -> Column:
    """hh:mm:ss of whole seconds."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def html_escape(text: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]  # & first
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def file_size_mib(size: Column) -> Column:
    return F.format_string("%.1f MiB", size / 1048576.0)


def sampling_khz(rate: Column) -> Column:
    return F.format_string("%.6f kHz", rate / 1000.0)


def chroma_subsampling(log2_w: Column, log2_h: Column, is_rgb: Column) -> Column:
    name = F.when((log2_w == 0) & (log2_h == 0), "4:4:4").when((log2_w == 1) & (log2_h == 0), "4:2:2").when((log2_w == 1) & (log2_h == 1), "4:2:0").otherwise("")
    return F.when(is_rgb, "").otherwise(name)


def bit_depth(depth: Column) -> Column:
    return F.when(depth > 0, F.concat(depth.cast("string"), F.lit(" bits"))).otherwise("")


def audio_bit_rate(bit_rate: Column, rate: Column, channels: Column, bits: Column) -> Column:
    return F.when(bit_rate > 0, bit_rate).otherwise(rate.cast("long") * channels * bits)


def display_aspect(width: Column, height: Column, num: Column, den: Column) -> Column:
    """Width over height of the displayed picture; a sample aspect ratio of 0 counts as 1."""
    square = (num <= 0) | (den <= 0)
    return F.format_string("%.3f", width * F.when(square, 1).otherwise(num) / (height * F.when(square, 1).otherwise(den)))


def container_id(brand: Column, compatible: Column) -> Column:
    some = F.coalesce(compatible, F.lit("")) != ""
    return F.when(F.coalesce(brand, F.lit("")) == "", "").when(some, F.concat(brand, F.lit(" ("), compatible, F.lit(")"))).otherwise(brand)


def metadata(tags: Column, *keys: str) -> Column:
    """The first of the keys that the map has, else empty."""
    return F.coalesce(*[F.try_element_at(tags, F.lit(k)) for k in keys], F.lit(""))


def hdr_class(transfer: Column, has_mastering: Column, has_light_level: Column) -> Column:
    return F.when((transfer == "PQ") & (has_mastering | has_light_level), "HDR10").when(transfer == "PQ", "PQ").when(transfer == "HLG", "HLG").otherwise("")


def mastering_primaries(rx, ry, gx, gy, bx, by, wx, wy) -> Column:
    return F.format_string("R(%.4f,%.4f) G(%.4f,%.4f) B(%.4f,%.4f) WP(%.4f,%.4f)", rx, ry, gx, gy, bx, by, wx, wy)


def mastering_luminance(low: Column, high: Column) -> Column:
    return F.format_string("%.1f - %.1f cd/m2", low, high)


def export_name(index: Column, pts: Column, ts: Column, extension: Column) -> Column:
    """frame_00000001[_pts_P][_tsms_T].ext, T the time in rounded milliseconds."""
    ms = F.floor(ts * 1000 + 0.5).cast("long")
    return F.concat(F.format_string("frame_%08d", index), F.coalesce(F.concat(F.lit("_pts_"), pts.cast("string")), F.lit("")), F.coalesce(F.concat(F.lit("_tsms_"), ms.cast("string")), F.lit("")), F.lit("."), extension)


def media_route(path: Column) -> Column:
    """raw_image, raw_pcm or demuxer by the file's suffix."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix.isin("yuv", "nv12", "rgb", "bgr", "yuy2", "raw"), "raw_image").when(suffix == "pcm", "raw_pcm").otherwise("demuxer")


def name_geometry(name: Column) -> tuple[Column, Column]:
    """Width and height in a file name: 640x480, else w640...h480, else 1920x1080."""
    got = lambda pattern, i: F.nullif(F.regexp_extract(name, pattern, i), F.lit("")).cast("int")
    both, tagged = r"(\d{2,5})\s*[xX]\s*(\d{2,5})", r"[wW](\d{2,5}).*[hH](\d{2,5})"
    return F.coalesce(got(both, 1), got(tagged, 1), F.lit(1920)), F.coalesce(got(both, 2), got(tagged, 2), F.lit(1080))


def name_pixel_format(name: Column) -> Column:
    n = F.lower(name)
    has = lambda *xs: reduce(lambda a, b: a | b, [n.contains(x) for x in xs])
    return F.when(has("nv12"), "NV12").when(has("yuy2"), "YUY2").when(has("rgb24", "_rgb") | n.endswith(".rgb"), "RGB24").when(has("bgr24", "_bgr") | n.endswith(".bgr"), "BGR24").otherwise("YUV420P")


def frame_bytes(width: Column, height: Column, fmt: Column) -> Column:
    """Bytes of a frame; NULL for odd sides that the format can't have."""
    area = width.cast("long") * height
    odd, wide = (width % 2 != 0) | (height % 2 != 0), width % 2 != 0
    return F.when(fmt.isin("YUV420P", "NV12"), F.when(~odd, F.floor(area * 3 / 2))).when(fmt == "YUY2", F.when(~wide, area * 2)).otherwise(area * 3).cast("long")


def raw_frames(size: Column, per_frame: Column) -> Column:
    """Whole frames in a file, a rest ignored; NULL if there is not even one."""
    return F.when(size >= per_frame, F.floor(size / per_frame)).cast("long")
