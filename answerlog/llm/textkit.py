"""Words, lines and shingles of Arrow text columns as numpy arrays.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r, so words of
the UTF-8 bytes are the words of the text. Everything here is a function of one Arrow
batch inside a task; a text is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
BLOCK = 4 << 20  # more than this is not worked on at once
PART = 1 << 17  # where many arrays of a block live side by side
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SHINGLE = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    dtype=np.uint64,
)


Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Return memory that nothing holds any more to the system. Workers outlive their tasks,
    and what one stage leaves would be missing in the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same work on batches, which gives its memory back at the end."""

    def run(batches: Batches) -> Batches:
        yield from work(batches)
        give_back()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the splitmix64 steps), so every bit depends on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if lower:
        values[65:91] = values[97:123]
    return values


_BYTES = {False: _table(False), True: _table(True)}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..size of the base modulo 2**64 and of its inverse, kept for blocks."""
    kept = _POWERS.get(0)
    if kept is None or len(kept[0]) <= size:
        size = max(PART, size + size // 8 if size <= BLOCK else size)  # so growing is rare
        up, down = np.empty(size + 1, np.uint64), np.empty(size + 1, np.uint64)
        up[0] = down[0] = 1
        up[1:], down[1:] = np.uint64(_BASE), np.uint64(_BASE_INVERSE)
        kept = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 2 * BLOCK:
            _POWERS[0] = kept
    return kept


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the n+1 offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def document_blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes; a longer text is a range of its own."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), count)
        yield first, last
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and the first word of every text (n+1 values)."""
    inside = ~WHITE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    starts[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = offsets[1:][np.diff(offsets) > 0] - 1
    ends[lasts] = inside[lasts]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(begin, offsets)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of the byte ranges [begin, end)."""
    up, down = powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[lower][data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the first word of every text. Long texts go in pieces cut at
    white space, so the space needed beside the hashes stays a few blocks."""
    found, counts = [np.empty(0, np.uint64)], []
    for first, last in document_blocks(offsets):
        low, high = int(offsets[first]), int(offsets[last])
        if high - low <= 2 * BLOCK:
            part = data[low:high]
            begin, end, heads = word_bounds(part, offsets[first : last + 1] - low)
            found.append(span_hashes(part, begin, end, lower))
            counts.append(np.diff(heads))
            continue
        number = 0
        while low < high:
            cut = min(low + BLOCK, high)
            while cut < high:
                white = np.flatnonzero(WHITE[data[cut : cut + BLOCK]])
                if len(white):
                    cut += int(white[0])
                    break
                cut = min(cut + BLOCK, high)
            part = data[low:cut]
            begin, end, _ = word_bounds(part, np.array([0, len(part)]))
            found.append(span_hashes(part, begin, end, lower))
            number += len(begin)
            low = cut
        counts.append(np.array([number]))
    heads = np.zeros(len(offsets), np.int64)
    if counts:
        np.cumsum(np.concatenate(counts), out=heads[1:])
    return np.concatenate(found), heads


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words, by its first word."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    total = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        factor = _SHINGLE[j % 5 : j % 5 + 1] * np.uint64(2 * (j // 5) + 1)
        total += words[j : len(words) - width + 1 + j] * factor
    return mix(total)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of every text, A-Z lower-cased; with fewer words than
    ``width`` the whole sequence is one shingle, without words there is none."""
    data, offsets = text_bytes(column)
    for first, last in document_blocks(offsets, PART):
        low = offsets[first]
        words, heads = word_hashes(data[low : offsets[last]], offsets[first : last + 1] - low, True)
        runs = window_hashes(words, width)
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            elif b > a:
                yield mix((words[a:b] * _SHINGLE[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.empty(0, np.uint64)
