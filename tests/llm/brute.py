"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
sha = lambda b: hashlib.sha256(b).hexdigest()


def words(text):
    return (text or "").encode().split()


def op2_base(text):
    w = [x.decode() for x in words(text)]
    t = text or ""
    triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def covered(text, least):
    """(code points of words in repeats of `least` words or more, words of the longest repeat)."""
    w = words(text)
    best, cover = 0, set()
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            n = 0
            while j + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            if n >= least:
                best = max(best, n)
                cover |= set(range(i, i + n)) | set(range(j, j + n))
    return sum(len(w[i].decode()) for i in cover), best


def maximal_repeats(text, least):
    """Number of strings of `least` words or more that occur twice or more and less often when prolonged to either side."""
    w = words(text)
    count = Counter(tuple(w[i:j]) for i in range(len(w)) for j in range(i + least, len(w) + 1))
    sides = defaultdict(lambda: (set(), set()))
    for i in range(len(w)):
        for j in range(i + least, len(w) + 1):
            x = tuple(w[i:j])
            if count[x] > 1:
                sides[x][0].add(w[i - 1] if i else i - 1)
                sides[x][1].add(w[j] if j < len(w) else j)
    return sum(len(a) > 1 and len(b) > 1 for a, b in sides.values())


def op5(docs, bench, size=13):
    split = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    tok = lambda t: split.findall((t or "").encode().translate(LOW))
    wins = defaultdict(set)
    for i, t in bench:
        w = tok(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins[tuple(w[k : k + size])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, items = tok(t), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if got := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= got
        out.append((i, len(w), len(hit), len(items), sha(",".join(sorted(items)).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def op6_groups(docs):
    """(sets, number of each row's group)."""
    sets = []
    for i, t in docs:
        w = (t or "").encode().translate(LOW).split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[find(a)] = find(b)
    return sets, [find(a) for a in range(len(sets))]


def op6(docs):
    sets, group = op6_groups(docs)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[group[a]] = min(least.get(group[a], i), i)
    return [(i, len(s), least.get(group[a])) for a, (i, s) in enumerate(sets)]


def op8_kept(docs, size=13):
    """(id, words, mask of removed words) of each row."""
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            first[x] = min(first.get(x, float("inf")), key(i))
    out = []
    for i, t in docs:
        w = words(t)
        hit = {j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < key(i) for j in range(k, k + size)}
        out.append((i, w, [j in hit for j in range(len(w))]))
    return out


def op8(docs):
    return [(i, len(w), sum(m), sha(b" ".join(x for x, y in zip(w, m, strict=True) if not y))) for i, w, m in op8_kept(docs)]


def op9(docs, size=200):
    count = Counter(b[k : k + size] for _, t in docs for b in [(t or "").encode()] for k in range(len(b) - size + 1))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if count[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        runs = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out.append((i, len(b), sum(gone), runs, sha(bytes(x for x, y in zip(b, gone, strict=True) if not y))))
    return out
