"""Words and word n-grams of whole Arrow text columns as numpy hash arrays.

Texts are handled as the UTF-8 bytes of the Arrow column, without one Python object per
word. Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19  # bytes hashed at once; bounds the scratch arrays, not the text
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (a new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _space_separated() -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, value of the byte) for words [^\\x20\\x09-\\x0D]+ with A-Z lowered."""
    inside = np.ones(256, bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    lowered = np.arange(256, dtype=np.uint64)
    lowered[ord("A"):ord("Z") + 1] += np.uint64(32)
    return inside, mix(lowered * _STEP + np.uint64(1))


SPACED = _space_separated()


def alphanumeric() -> tuple[np.ndarray, np.ndarray]:
    """The same for words of ASCII letters and digits and of bytes above ASCII."""
    inside = np.zeros(256, bool)
    inside[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return inside, SPACED[1]


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets have one entry more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    if offsets is None or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[wide.offset:wide.offset + len(wide) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES = [_powers(_BASE, 1), _powers(_BASE_INVERSE, 1)]


def _tables(count: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES[0]) < count:
        _TABLES[:] = _powers(_BASE, count), _powers(_BASE_INVERSE, count)
    return _TABLES[0], _TABLES[1]


def _hash_segment(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    up, down = _tables(max(SEGMENT, len(data)) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def words(data: np.ndarray, offsets: np.ndarray, kind: tuple[np.ndarray, np.ndarray] = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, word offsets per text). Words never cross texts."""
    word_byte, value = kind
    hashes, starts_all = [], []
    begin, total = 0, len(data)
    cuts = np.zeros(total + 1, bool)
    cuts[offsets] = True
    while begin < total:
        end = min(total, begin + SEGMENT)
        if end < total:  # end the segment where no word is cut
            back = end
            while back > begin and word_byte[data[back - 1]] and not cuts[back]:
                back -= 1
            if back > begin:
                end = back
            else:
                while end < total and word_byte[data[end]] and not cuts[end]:
                    end += 1
        part = data[begin:end]
        inside = word_byte[part]
        fresh = inside.copy()
        fresh[1:] &= ~inside[:-1] | cuts[begin + 1:end]
        starts = np.flatnonzero(fresh)
        closing = inside.copy()
        closing[:-1] &= ~inside[1:] | cuts[begin + 1:end]
        hashes.append(_hash_segment(part, starts, np.flatnonzero(closing) + 1, value))
        starts_all.append(starts + begin)
        begin = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts = np.concatenate(starts_all)
    return np.concatenate(hashes), np.searchsorted(starts, offsets).astype(np.int64)


def ngrams(hashes: np.ndarray, offsets: np.ndarray, n: int, whole_when_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every word n-gram in text order.

    With ``whole_when_short`` a text of 1 to n - 1 words gives its whole sequence as one.
    """
    counts = np.diff(offsets)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(hashes)) - np.repeat(offsets[:-1], counts)
    length = np.repeat(np.minimum(counts, n), counts) if whole_when_short else np.full(len(hashes), n)
    ok = place + length <= np.repeat(counts, counts)
    at, length = np.flatnonzero(ok), length[ok]
    out = mix(length.astype(np.uint64) * _STEP)
    for j in range(n):
        use = length > j
        if use.all():
            out = mix(out * _BASE + hashes[at + j])
        elif use.any():
            out[use] = mix(out[use] * _BASE + hashes[at[use] + j])
    return out, text[at]


def per_text_sum(values: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Wrapping 64-bit sums of ``values`` per text; ``text`` is ascending."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    edges = np.searchsorted(text, np.arange(texts + 1))
    return sums[edges[1:]] - sums[edges[:-1]]


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 48-bit keys as 32-bit gaps, with the rare wide gap spelled out."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    wide = gaps >= np.uint64(0xFFFFFFFF)
    small = np.where(wide, np.uint64(0xFFFFFFFF), gaps).astype(np.uint32)
    return np.uint64(len(keys)).tobytes() + small.tobytes() + gaps[wide].tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    count = int(np.frombuffer(blob, np.uint64, 1)[0])
    gaps = np.frombuffer(blob, np.uint32, count, 8).astype(np.uint64)
    wide = gaps == np.uint64(0xFFFFFFFF)
    if wide.any():
        gaps[wide] = np.frombuffer(blob, np.uint64, int(wide.sum()), 8 + 4 * count)
    return np.cumsum(gaps, dtype=np.uint64)
