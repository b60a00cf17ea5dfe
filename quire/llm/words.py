"""Words and word hashes of whole Arrow batches, computed over the batch's bytes at once.

A word is a run of bytes other than blank and 0x09-0x0D.  All functions work on the concatenated
UTF-8 bytes of a batch; ``batches`` keeps such a batch to a bounded number of bytes.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
BATCH_BYTES = 1 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Masks for the first n bytes of a little-endian 64-bit word.
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S32, _S29 = np.uint64(32), np.uint64(29)

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return the memory that this Python worker has freed to the system: idle workers keep what they hold
    while others run the next stage."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all others."""
    h = (h ^ (h >> _S32)) * _M2
    h = (h ^ (h >> _S29)) * _M1
    return h ^ (h >> _S32)


def batches(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES):
    """Slices of ``batch`` whose ``column`` holds at most ``limit`` bytes, or one row."""
    _, ends = text_bytes(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null counts as empty), and where each row ends in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def padded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A copy of the bytes, and a view of the eight bytes from each position on as one number."""
    room = np.zeros(len(data) + 16, np.uint8)
    room[: len(data)] = data
    return room, np.ndarray((len(data) + 8,), "<u8", room, strides=(1,))


def span_hash(eight: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a round; only spans with bytes left go on."""
    h = lengths.astype(np.uint64) * _M1
    live, at, left = None, starts, lengths
    k = 0
    while len(at):
        words = eight[at] & _MASK[np.minimum(left, 8)]
        if live is None:
            h = mix(h ^ words)
        else:
            h[live] = mix(h[live] * _M2 ^ words)
        more = np.flatnonzero(left > 8)
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
        k += 1
    return h


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of all words, and where each row's words end in that list."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    inside = ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    # A row's end cuts a word that would run on into the next row.
    cuts = ends[(ends > 0) & (ends < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    return starts, lengths, np.searchsorted(starts, ends, side="left")


def word_hashes(column: pa.Array, lower: bool = False):
    """Hashes of all words of a string column, and where each row's words end; also the raw spans."""
    data, ends = text_bytes(column)
    starts, lengths, word_ends = words(data, ends)
    room, eight = padded(_LOWER[data] if lower else data)
    return span_hash(eight, starts, lengths), word_ends, room, starts, lengths


def rows_of(ends: np.ndarray) -> np.ndarray:
    """Row number of each element, given where each row's elements end."""
    counts = np.diff(ends, prepend=0)
    return np.repeat(np.arange(len(ends)), counts)


def window_hashes(hashes: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` elements within a row, and the index of each run's first element.

    Built by doubling: a run of 2k elements hashes the two runs of k; an odd width adds one element.
    """
    if len(hashes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grown, size = hashes, 1
    for bit in bin(width)[3:]:
        grown, size = mix(grown[: len(grown) - size] * _M2 + grown[size:]), 2 * size
        if bit == "1":
            grown, size = mix(grown[:-1] * _M2 + hashes[size : size + len(grown) - 1]), size + 1
    begins = np.concatenate([[0], ends[:-1]])
    rows = rows_of(ends)[: len(grown)]
    fits = np.flatnonzero(np.arange(len(grown)) + width <= ends[rows]) if len(begins) else np.zeros(0, np.int64)
    return grown[fits], fits
