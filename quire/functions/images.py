"""Image kernels on numpy arrays of height, width and three channels, for use inside Arrow batches."""

from __future__ import annotations

import numpy as np


def crop(image: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """P5: the pixels of a box (x1, y1, x2, y2); an empty one is an error."""
    x1, y1, x2, y2 = box
    x1, y1, x2, y2 = max(0, x1), max(0, y1), min(image.shape[1], x2), min(image.shape[0], y2)
    if x1 >= x2 or y1 >= y2:
        raise ValueError(f"the box {box} is empty")
    return image[y1:y2, x1:x2]


def inside(points: list[tuple[float, float]], width: int, height: int) -> np.ndarray:
    """Which pixel centres lie within a polygon (even-odd rule), an edge at a time over all pixels."""
    xs, ys = np.arange(width) + 0.5, np.arange(height) + 0.5
    out = np.zeros((height, width), bool)
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        rows = (ay > ys) != (by > ys)
        if rows.any():
            at = ax + (ys[rows] - ay) / (by - ay) * (bx - ax)
            out[rows] ^= xs[None, :] < at[:, None]
    return out


def mask_white(image: np.ndarray, polygon: list[tuple[float, float]]) -> np.ndarray:
    """White outside the polygon; fewer than three points leave the image as it is."""
    if len(polygon) < 3:
        return image
    keep = inside(polygon, image.shape[1], image.shape[0])
    return np.where(keep[:, :, None], image, np.array(255, image.dtype))


def crop_region(image: np.ndarray, box: tuple[int, int, int, int], polygon: list[tuple[float, float]]) -> np.ndarray:
    """The crop with its polygon (in the image's pixels) masked; a mask that fails leaves the plain crop."""
    part = crop(image, box)
    try:
        return mask_white(part, [(x - max(0, box[0]), y - max(0, box[1])) for x, y in polygon])
    except (TypeError, ValueError, ZeroDivisionError):
        return part


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres aligned; float32."""

    def taps(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), (at - low).astype(np.float32)

    y0, y1, fy = taps(image.shape[0], height)
    x0, x1, fx = taps(image.shape[1], width)
    rows = image.astype(np.float32)
    rows = rows[y0] * (1 - fy)[:, None, None] + rows[y1] * fy[:, None, None]
    return rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]


def layout_input(image: np.ndarray, side: int = 800) -> np.ndarray:
    """M1: resized to a square, scaled to 0 to 1, channels first."""
    return (resize(image, side, side) / 255.0).transpose(2, 0, 1)


def normalise(image: np.ndarray, mean: tuple[float, ...], std: tuple[float, ...]) -> np.ndarray:
    """M9: channels scaled to 0 to 1, less their mean, over their deviation."""
    return (image.astype(np.float32) / 255.0 - np.array(mean, np.float32)) / np.array(std, np.float32)


def patchify(frames: np.ndarray, patch: int = 14, merge: int = 2, t_patch: int = 2) -> tuple[np.ndarray, tuple[int, int, int]]:
    """(frames, channels, height, width) to rows of flattened patches, ordered by merged block, and the grid (t, h, w).

    A single frame is repeated to fill the temporal patch.
    """
    if frames.shape[0] % t_patch:
        frames = np.concatenate([frames, np.repeat(frames[-1:], t_patch - frames.shape[0] % t_patch, axis=0)])
    t, h, w = frames.shape[0] // t_patch, frames.shape[2] // patch, frames.shape[3] // patch
    if h % merge or w % merge or frames.shape[2] % patch or frames.shape[3] % patch:
        raise ValueError("sides must be multiples of patch * merge")
    c = frames.shape[1]
    x = frames.reshape(t, t_patch, c, h // merge, merge, patch, w // merge, merge, patch)
    x = x.transpose(0, 3, 6, 4, 7, 2, 1, 5, 8)
    return x.reshape(t * h * w, c * t_patch * patch * patch), (t, h, w)
