import numpy as np
import pytest

from framewright.functions import pixels


def test_formats_agree_on_a_grey_frame():
    w, h = 4, 2
    y = np.arange(8, dtype=np.uint8) * 30
    grey = bytes([128])
    i420 = y.tobytes() + grey * 4
    nv12 = y.tobytes() + grey * 4
    yuy2 = b"".join(bytes([a]) + grey for a in y)
    frames = [pixels.to_rgb(d, w, h, f) for d, f in ((i420, "YUV420P"), (nv12, "NV12"), (yuy2, "YUY2"))]
    assert all((f == y.reshape(h, w)[..., None]).all() for f in frames)
    rgb = np.random.default_rng(1).integers(0, 256, (h, w, 3), dtype=np.uint8)
    assert (pixels.to_rgb(rgb.tobytes(), w, h, "BGR24") == rgb[..., ::-1]).all()


def test_odd_sides_are_rejected():
    for w, h, f in ((3, 2, "YUV420P"), (3, 2, "YUY2"), (0, 2, "RGB24")):
        with pytest.raises(ValueError):
            pixels.frame_size(w, h, f)
    assert pixels.video_range_bgr(b"", 3, 2) is None


def test_video_range_ends():
    black = bytes([16] * 4 + [128, 128])
    white = bytes([235] * 4 + [128, 128])
    assert pixels.video_range_bgr(black, 2, 2).max() == 0 and pixels.video_range_bgr(white, 2, 2).min() == 255


def test_canny_and_contours_find_two_squares():
    p = np.zeros((40, 60), np.uint8)
    p[5:20, 5:20], p[10:30, 35:55] = 255, 255
    e = pixels.canny(p)
    n, _ = pixels.components(e)
    x, y, w, h = pixels.bounding_box(e)
    assert n == 2 and 3 <= x <= 5 and 3 <= y <= 5 and 53 <= x + w <= 57
    assert pixels.canny(np.full((8, 8), 7)).sum() == 0


def test_histograms():
    assert pixels.histogram(np.array([1, 1, 2]))[[0, 1, 2]].tolist() == [0, 1, 0.5]
    red = np.full((2, 2, 3), (255, 0, 0), np.uint8)
    assert pixels.hue_saturation(red)[0].max() == 0 and pixels.hs_histogram(red).sum() == 0  # full saturation lies outside


def test_fourier():
    p = np.random.default_rng(2).integers(0, 256, (8, 10)).astype(float)
    shown, phase, total, energy = pixels.dft2d(p)
    assert shown.shape == (8, 10) and energy == pytest.approx((p**2).sum()) and total == shown.sum()
    assert pixels.dft_size(7) == 8 and pixels.dft_size(11) == 12


def test_resize_keeps_constants_and_min_max_range():
    assert np.allclose(pixels.resize(np.full((3, 5), 9), 7, 4), 9)
    assert pixels.min_max([1, 3]).tolist() == [0, 255] and pixels.min_max([2, 2]).tolist() == [0, 0]
