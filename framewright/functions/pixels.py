"""Pixel arithmetic in numpy: unpacking raw frames, colour conversion, histograms, edges, contours, spectra."""

from __future__ import annotations

import numpy as np


def yuv_to_rgb(y, u, v):
    """Full-range conversion with products cut toward zero, clamped to 0..255."""
    y, u, v = (np.asarray(a, np.int32) for a in (y, u, v))
    u, v = u - 128, v - 128
    r = y + np.trunc(1.402 * v).astype(np.int32)
    g = y - np.trunc(0.344136 * u + 0.714136 * v).astype(np.int32)
    b = y + np.trunc(1.772 * u).astype(np.int32)
    return np.clip(np.stack([r, g, b], axis=-1), 0, 255).astype(np.uint8)


def frame_size(width: int, height: int, fmt: str) -> int:
    """Bytes of a raw frame; ValueError for sides the format can't have."""
    if width <= 0 or height <= 0:
        raise ValueError("a frame needs a width and a height")
    if fmt in ("YUV420P", "NV12"):
        if width % 2 or height % 2:
            raise ValueError(f"{fmt} needs even sides")
        return width * height * 3 // 2
    if fmt == "YUY2":
        if width % 2:
            raise ValueError("YUY2 needs an even width")
        return width * height * 2
    if fmt in ("RGB24", "BGR24"):
        return width * height * 3
    raise ValueError(f"unknown pixel format {fmt}")


def planes(data: bytes, width: int, height: int, fmt: str):
    """Y, U, V planes at full resolution (chroma repeated); only for YUV formats."""
    a = np.frombuffer(data, np.uint8, frame_size(width, height, fmt))
    n = width * height
    y = a[:n].reshape(height, width)
    if fmt == "YUY2":
        q = a.reshape(height, width // 2, 4)
        return q[:, :, 0::2].reshape(height, width), q[:, :, 1].repeat(2, axis=1), q[:, :, 3].repeat(2, axis=1)
    if fmt == "YUV420P":
        u, v = a[n : n + n // 4], a[n + n // 4 : n + n // 2]
    else:
        u, v = a[n : n + n // 2 : 2], a[n + 1 : n + n // 2 : 2]
    half = lambda p: p.reshape(height // 2, width // 2).repeat(2, axis=0).repeat(2, axis=1)
    return y, half(u), half(v)


def to_rgb(data: bytes, width: int, height: int, fmt: str):
    """A raw frame as (height, width, 3) RGB."""
    if fmt in ("RGB24", "BGR24"):
        a = np.frombuffer(data, np.uint8, frame_size(width, height, fmt)).reshape(height, width, 3)
        return a if fmt == "RGB24" else a[:, :, ::-1]
    return yuv_to_rgb(*planes(data, width, height, fmt))


def video_range_bgr(data: bytes, width: int, height: int):
    """Planar 4:2:0 in video range to BGR (BT.601); None for odd sides, as only even ones convert."""
    if width % 2 or height % 2 or width <= 0 or height <= 0:
        return None
    y, u, v = (p.astype(np.float64) for p in planes(data, width, height, "YUV420P"))
    y, u, v = 1.164 * np.maximum(y - 16, 0), u - 128, v - 128
    bgr = np.stack([y + 2.018 * u, y - 0.813 * v - 0.391 * u, y + 1.596 * v], axis=-1)
    return np.clip(np.rint(bgr), 0, 255).astype(np.uint8)


def grey(rgb):
    """BT.601 luma, rounded."""
    return np.rint(rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114).astype(np.uint8)


def channel(data: bytes, width: int, height: int, fmt: str, name: str):
    """One of R, G, B, Y, U, V of a frame as a plane; Y, U, V of a packed format by conversion."""
    if name in "RGB":
        return to_rgb(data, width, height, fmt)[:, :, "RGB".index(name)]
    if fmt in ("RGB24", "BGR24"):
        r, g, b = (to_rgb(data, width, height, fmt)[..., i].astype(float) for i in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        return np.clip(np.rint({"Y": y, "U": (b - y) * 0.564 + 128, "V": (r - y) * 0.713 + 128}[name]), 0, 255).astype(np.uint8)
    return planes(data, width, height, fmt)["YUV".index(name)]


def histogram(plane, bins: int = 256):
    """Counts of 0..255 over the largest count; zeros for an empty plane."""
    n = np.bincount(np.asarray(plane, np.uint8).ravel(), minlength=bins).astype(np.float32)
    return n / n.max() if n.max() > 0 else n


def hue_saturation(rgb):
    """Hue in 0..180 and saturation in 0..255."""
    c = rgb.astype(np.float64)
    top, low = c.max(-1), c.min(-1)
    d = top - low
    safe = np.where(d == 0, 1, d)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    h = np.where(top == r, (g - b) / safe % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) * 30
    return np.where(d == 0, 0, h), np.where(top == 0, 0, d / np.where(top == 0, 1, top) * 255)


def hs_histogram(rgb, h_bins: int = 16, s_bins: int = 8):
    """Counts over hue in [0, 180) and saturation in [0, 255), scaled by the largest."""
    h, s = hue_saturation(rgb)
    inside = (h < 180) & (s < 255)
    n, _, _ = np.histogram2d(h[inside], s[inside], bins=(h_bins, s_bins), range=((0, 180), (0, 255)))
    return n / n.max() if n.max() > 0 else n


def canny(plane, low: float = 100, high: float = 200):
    """Edges: 3 by 3 Sobel with repeated borders, |gx| + |gy|, suppression along the gradient, hysteresis by 8-neighbours."""
    p = np.pad(np.asarray(plane, np.int32), 1, mode="edge")
    a, b, c = p[:-2], p[1:-1], p[2:]
    gx = (a[:, 2:] + 2 * b[:, 2:] + c[:, 2:]) - (a[:, :-2] + 2 * b[:, :-2] + c[:, :-2])
    gy = (c[:, :-2] + 2 * c[:, 1:-1] + c[:, 2:]) - (a[:, :-2] + 2 * a[:, 1:-1] + a[:, 2:])
    m = np.abs(gx) + np.abs(gy)
    q = np.pad(m, 1)
    at = lambda dy, dx: q[1 + dy : q.shape[0] - 1 + dy, 1 + dx : q.shape[1] - 1 + dx]
    ax, ay = np.abs(gx), np.abs(gy)
    flat, steep = ay <= ax * 0.41421356, ay >= ax * 2.41421356
    same = (gx >= 0) == (gy >= 0)
    one = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(same, at(-1, -1), at(-1, 1))))
    two = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(same, at(1, 1), at(1, -1))))
    thin = (m > one) & (m >= two) & (m > low)
    strong = thin & (m > high)
    while True:
        s = np.pad(strong, 1)
        near = np.zeros_like(strong)
        for dy in range(3):
            for dx in range(3):
                near |= s[dy : dy + strong.shape[0], dx : dx + strong.shape[1]]
        grown = thin & near
        if (grown == strong).all():
            return strong
        strong = grown


def components(mask):
    """8-connected components of a mask: how many, and their labels (0 outside)."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        p = np.pad(label, 1)
        best = label
        for dy in range(3):
            for dx in range(3):
                best = np.maximum(best, p[dy : dy + h, dx : dx + w])
        best = np.where(mask, best, 0)
        if (best == label).all():
            return len(np.unique(label[mask])), label
        label = best


def bounding_box(mask):
    """x, y, width, height around all set pixels; zeros if there are none."""
    ys, xs = np.nonzero(mask)
    return (int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1) if len(xs) else (0, 0, 0, 0)


def min_max(a, top: float = 255.0):
    """Scaled to 0..top; zeros if all values are equal."""
    a = np.asarray(a, np.float64)
    d = a.max() - a.min()
    return (a - a.min()) / d * top if d > 0 else np.zeros_like(a)


def resize(plane, width: int, height: int):
    """Bilinear, pixel centres aligned."""
    p = np.asarray(plane, np.float64)
    at = lambda n, m: np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
    y, x = at(height, p.shape[0]), at(width, p.shape[1])
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, p.shape[0] - 1), np.minimum(x0 + 1, p.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    return (p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx) * (1 - fy) + (p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx) * fy


def dft_size(n: int) -> int:
    """The smallest size from n up with no prime factor above 5."""
    while True:
        m = n
        for f in (2, 3, 5):
            while m % f == 0:
                m //= f
        if m == 1:
            return n
        n += 1


def dft2d(plane):
    """Log magnitude (padded, cropped to even sides, quadrants swapped, 0..255), phase, sum of the picture, and the true energy (Parseval)."""
    p = np.asarray(plane, np.float64)
    h, w = dft_size(p.shape[0]), dft_size(p.shape[1])
    f = np.fft.fft2(p, (h, w))
    log = np.log1p(np.abs(f))[: h & -2, : w & -2]
    shown = np.rint(min_max(np.roll(log, (log.shape[0] // 2, log.shape[1] // 2), (0, 1)))).astype(np.uint8)
    return shown, np.angle(f), float(shown.sum()), float((np.abs(f) ** 2).sum() / (h * w))


def rdft_column(samples, out: int = 255):
    """A spectrogram column: parabolic window 1 - w^2, sqrt(w * |X|) capped."""
    x = np.asarray(samples, np.float64)
    n = len(x)
    w = (np.arange(n) - (n - 1) / 2) / max((n - 1) / 2, 1)
    spectrum = np.fft.rfft(x * (1 - w**2))[: n // 2]
    return np.minimum(np.sqrt(np.abs(spectrum) / max(np.sqrt(n), 1)), out).astype(np.int32)
