"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re

import xxhash

SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def simhash(text):
    words = [w for w in SPACE.split(re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), (text or "").encode())) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def simhash_components(rows):
    prints = [(i, simhash(t)) for i, t in rows]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for n, (i, _) in enumerate(prints):
        r = find(n)
        least[r] = min(least.get(r, i), i)
    return {i: (f"{f:016x}", least[find(n)]) for n, (i, f) in enumerate(prints)}
