"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
from collections import Counter

import xxhash


def simhash(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [words[i : i + n] for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids_and_codes, radius=2):
    rows = [[i, code, i] for i, code in ids_and_codes]
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if (a[1] ^ b[1]).bit_count() <= radius and a[2] < b[2]:
                    b[2], changed = a[2], True
    return {(i, f"{code:016x}", top) for i, code, top in rows}


def removed(texts, window=35):
    """Per text: words, words removed, digest and text of the words kept."""
    split = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if counts[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((len(words), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out
