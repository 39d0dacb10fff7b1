"""Terms of texts: maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import _LOWER

#: Bytes of `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]`; every byte of a character beyond ASCII is one of them.
_TERM = np.zeros(256, bool)
_TERM[0x80:] = True
for a, b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _TERM[ord(a) : ord(b) + 1] = True


class Terms:
    """All terms of many texts: `start` and `end` in the bytes, and `at`, the index of each text's first term (and the end)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        n = len(data)
        self.inside = _TERM[data]
        first = np.zeros(n + 1, bool)
        first[offs] = True
        start, end = self.inside.copy(), self.inside.copy()
        start[1:] &= ~self.inside[:-1] | first[1:n]
        end[:-1] &= ~self.inside[1:] | first[1:n]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.at = np.searchsorted(self.start, offs)
        self.data = data

    def encoded(self) -> tuple[pa.Array, np.ndarray]:
        """(the distinct terms, the number of each term among them)."""
        joined = _LOWER[self.data[self.inside]]
        offs = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start, out=offs[1:])
        arr = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(offs), pa.py_buffer(joined)])
        coded = arr.dictionary_encode()
        return coded.dictionary, np.asarray(coded.indices).astype(np.int64)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one text."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    t = Terms(raw, np.array([0, len(raw)], np.int64))
    low = _LOWER[raw].tobytes()
    return [low[a:b] for a, b in zip(t.start.tolist(), t.end.tolist(), strict=True)]
