"""Runs of wanted signs in whole texts, found on the bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import own_buffers

#: Bytes with A-Z as a-z.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32


def alphanumeric(data: np.ndarray) -> np.ndarray:
    """0-9, a-z, A-Z and every code point beyond ASCII."""
    wanted = np.zeros(256, bool)
    wanted[48:58] = wanted[65:91] = wanted[97:123] = wanted[128:] = True
    return wanted[data]


def latin_letters(data: np.ndarray) -> np.ndarray:
    """a-z, A-Z and U+00C0 to U+00FF, whose two bytes in UTF-8 are C3 and one more."""
    wanted = np.zeros(256, bool)
    wanted[65:91] = wanted[97:123] = wanted[0xC3] = True
    keep = wanted[data]
    keep[1:] |= data[:-1] == 0xC3
    return keep


def runs(texts: pa.Array, wanted) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All maximal runs of wanted bytes, with A-Z lower-cased, in order, and the number of each one's text. A null text has
    none, and no run goes over the end of its text."""
    col = own_buffers(texts)
    ends = np.frombuffer(col.buffers()[1], np.int64)[: len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    data = FOLDED[data]
    keep = wanted(data)
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    first[heads] = keep[heads]
    start = np.flatnonzero(first)
    offsets = np.append((np.cumsum(keep) - 1)[start], keep.sum()).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[keep])])
    return found, np.searchsorted(ends, start, "right") - 1
