"""Integer arrays as short binary values: byte planes, compressed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """``delta``: the values rise; store the steps between them."""
    if delta and len(values):
        values = np.append(values[:1], np.diff(values))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpack(data: bytes, n: int, kind: type, delta: bool = False) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, dtype=kind)
    planes = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), dtype=np.uint8).reshape(width, n)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if delta else values
