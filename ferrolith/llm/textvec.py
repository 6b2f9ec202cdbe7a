"""Words and byte n-grams of many texts at once, as numpy arrays.

A batch of texts becomes one byte buffer; word boundaries, 64-bit word hashes and n-gram buckets are found by
array operations over it, so the cost per word is a few array steps and no Python loop runs over words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

#: White space bytes are 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower case for A to Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: For a word's last eight bytes or fewer: the bits that belong to it.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 1024


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: multiply and fold, twice."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD | 1)
        return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of ``data``, eight bytes of every span at a time."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    loads = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    size = ends - starts
    with np.errstate(over="ignore"):
        out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out = mix(out ^ (loads[starts] & MASKS[np.minimum(size, 8)]))
        todo, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(todo):
            out[todo] = mix(out[todo] ^ (loads[starts[todo] + at] & MASKS[np.minimum(size[todo] - at, 8)]))
            at += 8
            todo = todo[size[todo] > at]
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


@dataclass
class Words:
    """The words of a batch: bytes (A-Z lowered in ``low``), spans, hashes, each word's text and each text's range of words."""

    raw: np.ndarray
    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    """Split texts at white space; hashes are of the lowered bytes."""
    raw = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text_ends = 1 + np.cumsum(sizes + 1) - 1
    space = SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    low = LOWER[raw]
    bounds = np.concatenate(([0], np.searchsorted(starts, text_ends)))
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    return Words(raw, low, starts, ends, text, bounds, span_hashes(low, starts, ends))


def sums_by_range(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (rows) between consecutive ``bounds``; empty ranges give zero."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
