"""Arrow string columns as bytes: runs of a byte class, found for many texts at once and without a copy of the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ferrolith.llm.common import slices

#: Bytes of text in one step.
STEP = 4 << 20


def byte_class(characters: str, others: bool = False) -> np.ndarray:
    """A lookup table over bytes: true for these ASCII characters, and for all bytes from 0x80 on if ``others``."""
    table = np.zeros(256, bool)
    table[list(characters.encode("ascii"))] = True
    table[128:] = others
    return table


def steps(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For consecutive texts (range lo to hi): their UTF-8 bytes as they lie in the Arrow buffer, and where each begins and the last ends.

    Null texts are empty.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for lo, hi in slices(np.diff(offsets).tolist(), STEP):
        own = offsets[lo : hi + 1]
        yield lo, hi, data[own[0] : own[-1]], own - own[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of true bytes, none over the border of two texts."""
    edges = np.zeros(len(inside) + 1, bool)
    edges[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edges[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edges[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
