"""PNG images as arrays and back, for use on single files: the kinds that need no colour management, with numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# The first bytes of a file, and the channels of each colour type that is read here (grey, colour, palette, with alpha).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 6: 4}


def _header(head: bytes) -> tuple[int, int, int, int, int] | None:
    """(width, height, bits, colour type, interlaced) from the first 29 bytes."""
    if len(head) < 29 or head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        return None
    width, height, bits, kind, _, _, laced = struct.unpack(">IIBBBBB", head[16:29])
    return width, height, bits, kind, laced


def readable(head: bytes) -> bool:
    """Whether `decode` reads files that begin like this: 8 bits, not interlaced, and no grey with alpha."""
    found = _header(head)
    return found is not None and found[2] == 8 and found[3] in CHANNELS and not found[4] and found[0] > 0 and found[1] > 0


def _chunks(data: bytes):
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if at + 12 + size > len(data):
            return
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Rows without their filters. Bytes depend on those to the left and above, so they are worked out along diagonals, all rows at once."""
    filters, raw = lines[:, 0], lines[:, 1:]
    if not filters.any():
        return raw
    height, width = raw.shape[0], raw.shape[1] // step
    pixels = raw.reshape(height, width, step).astype(np.int16)
    out = np.zeros((height + 1, width + 1, step), np.int16)  # with a row above and a column to the left, of zeros
    kind = filters[:, None]
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + up - corner
        far = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
        nearest = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
        own = kind[y]
        out[y + 1, x + 1] = (pixels[y, x] + np.select([own == 1, own == 2, own == 3, own == 4], [left, up, (left + up) >> 1, nearest], 0)) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, -1)


def decode(data: bytes) -> np.ndarray | None:
    """Height x width x 3 (red first) or, if grey, x 1; alpha is left out. None if the file isn't `readable` or is broken."""
    if not readable(data):
        return None
    width, height, _, kind, _ = _header(data)
    step, packed, palette, ended = CHANNELS[kind], [], None, False
    for name, body in _chunks(data):
        if name == b"IDAT":
            packed.append(body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3) if len(body) % 3 == 0 else None
        ended |= name == b"IEND"
    try:
        flat = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error:
        return None
    if not ended or len(flat) != height * (1 + width * step):
        return None
    lines = flat.reshape(height, -1)
    if lines[:, 0].max() > 4:
        return None
    grid = _unfiltered(lines, step).reshape(height, width, step)
    if kind != 3:
        return grid[..., :3]
    return None if palette is None or grid.max() >= len(palette) else palette[grid[..., 0]]


def encode(rgb: np.ndarray) -> bytes:
    """A PNG file of height x width x 3 bytes, without filters."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height, width, _ = rgb.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rgb.reshape(height, -1).astype(np.uint8)], axis=1)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")
