"""Columns of integers as compressed bytes, for messages between tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length of non-negative integers: byte planes, empty high planes left out, compressed."""
    head, body = [], []
    for c in columns:
        c = np.ascontiguousarray(c, np.uint64)
        width = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
        head.append(width)
        body.append(c.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    raw = b"".join(body)
    return bytes([len(columns), *head]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    k = blob[0]
    widths = list(blob[1: k + 1])
    size = int.from_bytes(blob[k + 1: k + 9], "little")
    raw = np.frombuffer(pa.decompress(blob[k + 9:], size, codec="zstd", asbytes=True), np.uint8)
    n, at, out = size // sum(widths), 0, []
    for width in widths:
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = raw[at: at + n * width].reshape(width, n).T
        out.append(full.view(np.uint64).ravel())
        at += n * width
    return out


def joined(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "little") + a + b


def halves(blob: bytes) -> tuple[bytes, bytes]:
    cut = 8 + int.from_bytes(blob[:8], "little")
    return blob[8:cut], blob[cut:]
