"""Statistics, hashes and main colours of small RGBA rasters with numpy, for stacks of rasters of one size at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenfold.functions.types import struct_of

FIELDS = (
    "phash string, ahash string, brightness double, contrast double, luma_variance double, warmth double, highlights double, saturation double, colorfulness double, "
    "blue_top_ratio double, green_ratio double, edge_density double, top_hexes array<string>, top_weights array<double>"
)
NAMES = [x.split()[0] for x in FIELDS.split(", ")]
MASK = 0xFFFFFFFF


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over the UTF-16 units of a text."""
    out = 0x811C9DC5
    for unit in np.frombuffer(text.encode("utf-16-le"), "<u2").tolist():
        out = (out ^ unit) * 0x01000193 & MASK
    return out


def mulberry32(seed: int):
    """A generator of numbers from 0 to 1, with 32 bits of state."""
    state = seed & MASK
    while True:
        state = state + 0x6D2B79F5 & MASK
        t = (state ^ state >> 15) * (state | 1) & MASK
        t = (t + ((t ^ t >> 7) * (t | 61) & MASK) & MASK) ^ t
        yield ((t ^ t >> 14) & MASK) / 4294967296


def luma(rgb: np.ndarray) -> np.ndarray:
    """0 to 1."""
    return rgb @ np.array([0.2126, 0.7152, 0.0722]) / 255


def hsv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, g, b = np.moveaxis(rgb / 255, -1, 0)
    high, span = rgb.max(axis=-1) / 255, np.ptp(rgb / 255, axis=-1)
    d = np.where(span == 0, 1, span)
    hue = 60 * np.select([span == 0, high == r, high == g], [0, (g - b) / d, (b - r) / d + 2], (r - g) / d + 4)
    return hue % 360, np.where(high == 0, 0, span / np.where(high == 0, 1, high)), high


def _linear(c: np.ndarray) -> np.ndarray:
    return np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)


#: Of each byte.
LINEAR = _linear(np.arange(256) / 255)


def lab(rgb: np.ndarray) -> np.ndarray:
    line = LINEAR[rgb] if rgb.dtype == np.uint8 else _linear(rgb / 255)
    t = line @ np.array([[0.4124564, 0.2126729, 0.0193339], [0.3575761, 0.7151522, 0.119192], [0.1804375, 0.072175, 0.9503041]]) / np.array([0.95047, 1, 1.08883])
    x, y, z = np.moveaxis(np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116), -1, 0)
    return np.stack([116 * y - 16, 500 * (x - y), 200 * (y - z)], axis=-1)


def box_resample(grid: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of the boxes that the new cells cover (one source cell at least), of a grid with or without channels."""

    def edges(old: int, new: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.arange(new) * old // new
        return low, np.maximum(low + 1, (np.arange(new) + 1) * old // new)

    (top, bottom), (left, right) = edges(grid.shape[0], height), edges(grid.shape[1], width)
    total = np.zeros((grid.shape[0] + 1, grid.shape[1] + 1, *grid.shape[2:]))
    total[1:, 1:] = grid.cumsum(axis=0, dtype=float).cumsum(axis=1)
    sums = total[np.ix_(bottom, right)] - total[np.ix_(top, right)] - total[np.ix_(bottom, left)] + total[np.ix_(top, left)]
    size = (bottom - top)[:, None] * (right - left)[None, :]
    return sums / size.reshape(*size.shape, *([1] * (grid.ndim - 2)))


def _hex(bits: np.ndarray) -> list[str]:
    """16 digits for each row of 64 bits."""
    return [x.tobytes().hex() for x in np.packbits(bits, axis=1)]


def _cells(gray: np.ndarray, side: int) -> np.ndarray:
    """Means of `side` x `side` boxes of each raster of a stack (n x height x width)."""
    n, height, width = gray.shape
    if height % side == 0 and width % side == 0:
        rows = gray.reshape(n, side, height // side, width).sum(axis=2)
        return rows.reshape(n, side, side, width // side).sum(axis=3) / (height // side * (width // side))
    return np.moveaxis(box_resample(np.moveaxis(gray, 0, -1), side, side), -1, 0)


def phash(gray: np.ndarray) -> list[str]:
    """64 bits for each raster: which of the 8 x 8 lowest cosine coefficients of 32 x 32 cells are over the median of all but the first."""
    n = np.arange(32)
    basis = np.cos((2 * n[None, :] + 1) * n[:8, None] * np.pi / 64)
    block = (basis @ _cells(gray, 32) @ basis.T).reshape(len(gray), 64)
    return _hex(block > np.sort(block[:, 1:], axis=1)[:, [31]])


def ahash(gray: np.ndarray) -> list[str]:
    cells = _cells(gray, 8).reshape(len(gray), 64)
    return _hex(cells > cells.mean(axis=1, keepdims=True))


def edge_density(gray: np.ndarray, least: float = 0.15) -> np.ndarray:
    """Share of inner cells of each raster whose Sobel gradient is over `least`."""
    if min(gray.shape[1:]) < 3:
        return np.zeros(len(gray))
    across = gray[:, :, 2:] - gray[:, :, :-2]
    down = gray[:, 2:] - gray[:, :-2]
    gx = across[:, :-2] + 2 * across[:, 1:-1] + across[:, 2:]
    gy = down[:, :, :-2] + 2 * down[:, :, 1:-1] + down[:, :, 2:]
    return (np.sqrt(gx * gx + gy * gy) > least).mean(axis=(1, 2))


def main_colors(stack: np.ndarray, seeds: list[int], k: int = 5, rounds: int = 10) -> tuple[list[list[str]], list[list[float]]]:
    """The three largest of `k` clusters in Lab of each raster (k-means from seeded pixels): mean colours and shares.

    Pixels of one colour are one weighted point, which is all that k-means can tell of them. A round moves the clusters of all rasters; those of
    a raster that has come to rest stay as they are.
    """
    n, size = len(stack), stack.shape[1] * stack.shape[2]
    pixels, k = stack.reshape(n, size, 3).astype(np.int64), min(k, size)
    coded = (pixels[..., 0] << 16 | pixels[..., 1] << 8 | pixels[..., 2]) + (np.arange(n)[:, None] << 24)
    colors, counts = np.unique(coded, return_counts=True)
    row = colors >> 24
    first = np.searchsorted(row, np.arange(n))
    slot = np.arange(len(colors)) - first[row]
    shape = (n, int(slot.max()) + 1)  # rasters with fewer colours are filled up with points without weight

    def spread(values: np.ndarray) -> np.ndarray:
        out = np.zeros(shape)
        out[row, slot] = values
        return out

    channels = np.stack([colors >> 16 & 255, colors >> 8 & 255, colors & 255], axis=-1).astype(np.uint8)
    points, weights, chosen = np.stack([spread(x) for x in np.moveaxis(lab(channels), -1, 0)]), spread(counts), np.zeros((n, k), np.int64)
    for at_row, seed in enumerate(seeds):
        random, taken = mulberry32(seed), []
        for _ in range(k):
            at = int(next(random) * size)
            while at in taken:
                at = (at + 1) % size
            taken.append(at)
        chosen[at_row] = taken
    rows = np.arange(n)[:, None]
    centres = points[:, rows, slot[np.searchsorted(colors, coded[rows, chosen])]]
    own, base, weighted = np.zeros(shape, np.uint8), rows * k, points * weights

    def sums(values: np.ndarray) -> np.ndarray:
        return np.bincount((base + own).ravel(), weights=values.ravel(), minlength=n * k).reshape(n, k)

    for turn in range(rounds):
        best, nearest = np.full(shape, np.inf), np.zeros(shape, np.uint8)
        for c in range(k):
            far = (points[0] - centres[0][:, [c]]) ** 2
            far += (points[1] - centres[1][:, [c]]) ** 2
            far += (points[2] - centres[2][:, [c]]) ** 2
            closer = far < best
            np.copyto(best, far, where=closer)
            np.copyto(nearest, c, where=closer)
        moved, own = (nearest != own).any(), nearest
        sizes = sums(weights)
        centres = np.stack([np.where(sizes > 0, sums(x) / np.maximum(sizes, 1), old) for x, old in zip(weighted, centres)])
        if turn and not moved:
            break
    means = np.floor(np.stack([sums(spread(channels[:, c]) * weights) for c in range(3)], axis=-1) / np.maximum(sizes, 1)[..., None] + 0.5).astype(int)
    hexes, shares = [], []
    for at_row, order in enumerate(np.argsort(-sizes, axis=1, kind="stable")[:, :3].tolist()):
        held = [c for c in order if sizes[at_row, c]]
        hexes.append(["#" + bytes(means[at_row, c].tolist()).hex() for c in held])
        shares.append([float(sizes[at_row, c] / size) for c in held])
    return hexes, shares


def _tinted(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Saturation, and which pixels are blue and green. Blue is the largest channel of all hues of 190 to 250, green that of 70 to 160."""
    r, g, b = r / 255, g / 255, b / 255
    high = np.maximum(np.maximum(r, g), b)
    span = high - np.minimum(np.minimum(r, g), b)
    saturation = span / np.where(high == 0, 1, high)
    most_red, most_green = high == r, high == g
    greenish = most_green & ~most_red
    hue = 60 * (np.where(greenish, b - r, r - g) / np.where(span == 0, 1, span) + np.where(greenish, 2, 4))
    blue = ~(most_red | most_green) & (hue >= 190) & (hue <= 250) & (saturation > 0.2) & (high > 0.4)
    green = greenish & (hue >= 70) & (hue <= 160) & (saturation > 0.25) & (high > 0.15)
    return saturation, blue, green


def _mean_and_var(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(axis=(1, 2))
    off = x - mean[:, None, None]
    off *= off
    return mean, off.mean(axis=(1, 2))


def features(stack: np.ndarray, seeds: list[int], names: tuple[str, ...] = tuple(NAMES)) -> dict:
    """A column for each of `names` (of NAMES), from a stack (n x height x width x 3) of rasters. What none of them needs isn't worked out."""
    wanted, out, all_ = set(names), {}, (1, 2)
    r, g, b = np.moveaxis(stack, -1, 0).astype(float, order="C")
    gray = (0.2126 * r + 0.7152 * g + 0.0722 * b) / 255
    if "phash" in wanted:
        out["phash"] = phash(gray)
    if "ahash" in wanted:
        out["ahash"] = ahash(gray)
    if wanted & {"brightness", "contrast", "luma_variance", "warmth", "highlights"}:
        mean, var = _mean_and_var(gray)
        out |= {"brightness": mean, "contrast": np.sqrt(var), "luma_variance": var, "warmth": (r.mean(axis=all_) - b.mean(axis=all_)) / 255, "highlights": (gray > 0.85).mean(axis=all_)}
    if "colorfulness" in wanted:
        (rg, rg_var), (yb, yb_var) = _mean_and_var(r - g), _mean_and_var((r + g) / 2 - b)
        out["colorfulness"] = np.sqrt(rg_var + yb_var) + 0.3 * np.hypot(rg, yb)
    if wanted & {"saturation", "blue_top_ratio", "green_ratio"}:
        saturation, blue, green = _tinted(r, g, b)
        out |= {"saturation": saturation.mean(axis=all_), "blue_top_ratio": blue[:, : max(1, stack.shape[1] // 2)].mean(axis=all_), "green_ratio": green.mean(axis=all_)}
    if "edge_density" in wanted:
        out["edge_density"] = edge_density(gray)
    if wanted & {"top_hexes", "top_weights"}:
        out["top_hexes"], out["top_weights"] = main_colors(stack, seeds)
    return {name: out[name] for name in names}


#: Pixels of a stack: few enough for its planes to stay in a core's cache.
STACK = 1 << 15


def features_udf(*names: str):
    """A UDF of rasters (rgba, width, height, seed) to a struct of `names`; null for a null or empty raster."""
    own_fields = [x for x in FIELDS.split(", ") if x.split()[0] in names]
    own_names = tuple(x.split()[0] for x in own_fields)

    @F.pandas_udf(struct_of(", ".join(own_fields)))
    def pixel_features(rgba: pd.Series, width: pd.Series, height: pd.Series, seed: pd.Series) -> pd.DataFrame:
        out = {name: np.full(len(rgba), None, object) for name in own_names}
        raws, seeds = rgba.to_numpy(object), seed.to_numpy()
        real = pd.DataFrame({"w": width, "h": height})[np.fromiter((x is not None and len(x) > 0 for x in raws), bool, len(raws))]
        for (w, h), rows in real.groupby(["w", "h"]).groups.items():
            most, rows = max(1, STACK // int(w * h)), rows.to_numpy()
            for start in range(0, len(rows), most):
                own = rows[start : start + most]
                stack = np.frombuffer(b"".join(raws[own]), np.uint8).reshape(len(own), int(h), int(w), 4)[..., :3]
                for name, values in features(stack, [int(x) for x in seeds[own]], own_names).items():
                    held = np.empty(len(own), object)
                    held[:] = list(values)
                    out[name][own] = held
        return pd.DataFrame(out).astype({x.split()[0]: "float64" for x in own_fields if x.endswith(" double")})

    return pixel_features


pixel_features = features_udf(*NAMES)
