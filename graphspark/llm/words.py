"""Vectorised tokenising of Arrow string arrays: whole texts, no Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTES = np.arange(256, dtype=np.uint8)

#: ASCII upper case to lower case; all other bytes stay.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of words that white space (space, tab to carriage return) ends.
NOT_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Bytes of words made of digits, letters and all that is not ASCII.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)

SLICE_BYTES = 4 << 20


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the offsets of each text in them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def string_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings of the given byte lengths that follow each other in ``data``."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def tokenise(texts: pa.Array, word: np.ndarray, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All maximal runs of the bytes for which ``word`` holds, and the number of them in each text."""
    data, offsets = raw(texts)
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(len(offsets) - 1, np.int64)
    inside = word[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    # A run ends where the bytes that belong to words stop or where the next one starts.
    total = int(np.count_nonzero(inside))
    rank = np.cumsum(inside)[starts] - 1 if len(starts) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(rank, total))
    kept = (LOWER[data] if lower else data)[inside]
    counts = np.diff(np.searchsorted(starts, offsets))
    return string_array(kept, lengths), counts


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of ``rows`` rows at most whose texts hold about ``most`` bytes; a longer text comes alone."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    # Both numbers rise along the rows, so their sum changes wherever one of them does.
    part = (np.cumsum(sizes) - sizes) // most + np.arange(len(sizes)) // rows
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the values of each text's tokens."""
    total = np.zeros(len(values) + 1, dtype=values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def trim() -> None:
    """Gives memory that a finished task no longer needs back to the system; workers live on and serve other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library; its allocator decides
        pass
