"""Words and lines of whole Arrow text columns as spans of their UTF-8 bytes.

A character class that holds only ASCII characters, or none of them and everything above
ASCII, can be tested byte by byte, so a word of such a class is a run of bytes. Equal words
are found by the exact dictionary of an Arrow array, never by a hash alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 22  # bytes tested at once; bounds the scratch arrays, not the text
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    """A mask over bytes; each range includes its ends."""
    mask = np.zeros(256, bool)
    for low, high in ranges:
        mask[low:high + 1] = True
    return mask


LETTERS = bytes_in((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
ALPHANUMERIC = bytes_in((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
NOT_SPACE = ~bytes_in((0x20, 0x20), (0x09, 0x0D))


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of every longest run of bytes ``inside``; a run never crosses texts."""
    starts, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for begin in range(0, len(data), SEGMENT):
        end = min(len(data), begin + SEGMENT)
        flags = np.zeros(end - begin + 2, bool)
        low, high = max(begin - 1, 0), min(end + 1, len(data))
        flags[low - begin + 1:high - begin + 1] = inside[data[low:high]]
        cut = np.zeros(end - begin + 1, bool)
        cut[offsets[np.searchsorted(offsets, begin):np.searchsorted(offsets, end, "right")] - begin] = True
        here = flags[1:-1]
        starts.append(np.flatnonzero(here & (~flags[:-2] | cut[:-1])) + begin)
        ends.append(np.flatnonzero(here & (~flags[2:] | cut[1:])) + begin + 1)
    return np.concatenate(starts), np.concatenate(ends)


def per_text(starts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of spans per text, text index per span)."""
    counts = np.diff(np.searchsorted(starts, offsets))
    return counts, np.repeat(np.arange(len(counts)), counts)


def encoded(joined: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(code per span, dictionary) of spans whose bytes stand one after the other in ``joined``."""
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(joined))])
    found = column.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def encoded_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray, lower: bool) -> tuple[np.ndarray, pa.Array]:
    """(code per word, dictionary of words) of the runs that :func:`spans` gives for ``inside``."""
    joined = data[inside[data]]
    return encoded(LOWER[joined] if lower else joined, ends - starts)


def as_strings(words: pa.Array) -> pa.Array:
    """Binary words as strings, as they are."""
    kind = pa.large_string()
    return pa.Array.from_buffers(kind, len(words), words.buffers(), offset=words.offset).cast(pa.string())


def running_total(values: np.ndarray) -> np.ndarray:
    """0 and the sums of the first 1, 2, 3 ... values."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out
