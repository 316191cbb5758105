"""Views of Arrow text columns as flat bytes, shared by the operators that run in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; one longer document is a chunk of its own.
CHUNK_BYTES = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column in one array, and the offset of each row plus the end; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return body, at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of each chunk of a text column."""
    body, offsets = flat(column)
    for first, last in chunks(offsets, limit):
        at = offsets[first:last + 1]
        yield first, last, body[at[0]:at[-1]], at - at[0]


def word_spans(body: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each run of word bytes, and the row it is in. Runs never cross rows."""
    mask = is_word[body]
    edge = np.zeros(len(body) + 1, bool)
    if len(body):
        edge[0], edge[-1] = mask[0], mask[-1]
        edge[1:-1] = mask[1:] != mask[:-1]
        inner = offsets[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(body))])
        split = inner[mask[inner] & mask[inner - 1]]
    else:
        split = np.zeros(0, np.int64)
    bounds = np.flatnonzero(edge)
    if len(split):  # a run that goes on over the end of a row is two runs
        bounds = np.sort(np.concatenate([bounds, split, split]))
    starts, ends = bounds[0::2], bounds[1::2]
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each bit of the input changes half of the output bits."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    return values


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def powers(count: int, base: int = int(_BASE)) -> np.ndarray:
    """base^0 .. base^(count-1) modulo 2^64."""
    out = np.full(count, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, alike for equal content wherever it stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    base = int(_BASE)
    inverse = pow(base, -1, 1 << 64)
    # sum of (byte + 1) * base^position, brought back to the span's start
    prefix = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers(len(body)), out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * powers(len(body) + 1, inverse)[starts]
    return mixed(raw + length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
