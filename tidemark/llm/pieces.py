"""Splitting texts into the pieces that byte-level BPE encodes alone, many texts at once.

FAST is the one pattern that has a columnar form here; any other goes through the regex engine and
gives the same kind of result. The columnar form works on runs of letters, numbers, white space and
the rest: a run is a piece; the last character of a run of white space before something else leaves
the run, and joins what follows if it is a blank; an apostrophe that stands alone in its run without
such a blank takes the letters of a contraction with it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

from .bpe_files import splitter
from .common import U64, mix, powers, prefix_hashes
from .packed import gather

#: The public pattern, and Unicode's White_Space.
FAST = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
REST, LETTER, NUMBER, SPACE = range(4)


@lru_cache(1)
def classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    usable = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, usable):
            out[[ord(c) for c in m[0]]] = kind
    out[WHITE] = SPACE
    return out


def _starts(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mask of the code points that start a piece; at: where texts begin, and the end."""
    n = len(cp)
    kind = classes()[cp]
    head = np.zeros(n + 1, bool)
    head[at] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # Where a run of white space meets something else in the same text, its last character leaves it.
    meet = np.flatnonzero(start[1:] & ~head[1:n] & (kind[:-1] == SPACE)) + 1
    start[meet - 1] = True
    blank = cp[meet - 1] == 0x20
    start[meet[blank]] = False
    # Contractions.
    p = np.flatnonzero((cp == 0x27) & start)
    p = p[(p + 1 < n)]
    p = p[(kind[p + 1] == LETTER) & ~head[p + 1]]
    a = cp[p + 1]
    nxt = np.minimum(p + 2, n - 1)
    b = np.where((p + 2 < n) & ~head[np.minimum(p + 2, n)], cp[nxt], 0)
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ~one & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
    for some, k in ((p[one], 2), (p[two], 3)):
        start[some + 1] = False
        then = some + k
        then = then[then < n]
        start[then[kind[then] == LETTER]] = True
    return start


class Pieces:
    """Pieces of many texts: start and end bytes, hash, and `at`, the index of each text's first piece."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, pattern: str):
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        if pattern == FAST:
            cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            own = offs[:-1][np.diff(offs) > 0]
            s = lead[_starts(cp, np.r_[np.searchsorted(lead, own), len(cp)])] if len(cp) else lead
        else:
            find, raw = splitter(pattern), data.tobytes()
            sizes = [len(x.encode()) for a, b in zip(offs[:-1], offs[1:], strict=True) for x in find(raw[a:b].decode())]
            s = np.cumsum([0, *sizes])[:-1]
        e = np.r_[s[1:], len(data)] if len(s) else s
        p, down = prefix_hashes(data), powers(len(data) + 1)[1]
        self.data, self.start, self.end, self.at = data, s, e, np.searchsorted(s, offs)
        self.at[-1] = len(s)
        self.hash = mix((p[e] - p[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))

    def same(self, one: np.ndarray, step: int = 1 << 20) -> bool:
        """Whether each piece has the bytes of the piece one[i]; pieces follow each other without a gap, so data is all of them."""
        size, first = self.end - self.start, self.start[one]
        if not np.array_equal(size, size[one]):
            return False
        cuts = np.unique(np.r_[np.searchsorted(self.start, np.arange(0, len(self.data), step)), len(size)])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if not np.array_equal(self.data[gather(first[a:b], size[a:b])], self.data[self.start[a] : self.end[b - 1]]):
                return False
        return True

    def distinct(self) -> tuple[list[bytes], np.ndarray]:
        """(bytes, inverse) of the distinct pieces: by hash, or by their bytes where two have one hash."""
        raw = self.data.tobytes()
        _, one, inverse = np.unique(self.hash, return_index=True, return_inverse=True)
        if self.same(one[inverse]):
            return [raw[a:b] for a, b in zip(self.start[one].tolist(), self.end[one].tolist(), strict=True)], inverse
        own: dict[bytes, int] = {}
        inverse = np.array([own.setdefault(raw[a:b], len(own)) for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)], np.int64)
        return list(own), inverse
