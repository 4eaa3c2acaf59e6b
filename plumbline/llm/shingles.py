"""Vectorised word-shingle sets.

Words are runs of characters other than space and \\x09-\\x0D, with A-Z lower-cased.  A
document's set holds its distinct ``width``-word shingles; a shorter document has its whole
word sequence as its one shingle; a document without words has an empty set.  A shingle is
represented by 64 mixed bits of its words, so two different shingles are confused with a
probability of about 2**-64 per pair.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROOT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_ROOT), -1, 2**64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes hashed at once, unless one text is longer.
_BLOCK = 1 << 18
_STEP = _BLOCK + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(root: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, root, np.uint64)]))


_UP, _DOWN = _powers(_ROOT, _STEP), _powers(_INVERSE, _STEP)


def blocks(texts: list[str | None]) -> list[tuple[list[int], bytes, np.ndarray]]:
    """Runs of texts joined by line feeds, with their numbers and first bytes."""
    out, own, parts, size = [], [], [], 0
    for k, text in enumerate(texts):
        if not text:
            continue
        data = text.encode("utf-8", "surrogatepass")
        if parts and size + len(data) > _BLOCK:
            out.append((own, parts))
            own, parts, size = [], [], 0
        own.append(k)
        parts.append(data)
        size += len(data) + 1
    if parts:
        out.append((own, parts))
    return [(own, b"\n".join(parts), np.cumsum([0, *(len(x) + 1 for x in parts[:-1])])) for own, parts in out]


def word_hashes(data: bytes, caps: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """One hash for each word of ``data`` (UTF-8), and the bytes at which the words begin.

    For each of ``caps`` an array of the hashes of the words' first so many bytes follows.
    """
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[raw], prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    n = raw.size
    up, down = (_UP, _DOWN) if n <= _STEP else (_powers(_ROOT, n), _powers(_INVERSE, n))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_FOLD[raw]] * up[:n], out=total[1:])
    to = [ends, *(np.minimum(ends, starts + c) for c in caps)]
    whole, *cut = [mix((total[e] - total[starts]) * down[starts] + (e - starts).astype(np.uint64)) for e in to]
    return whole, starts, *cut


def _rolled(w: np.ndarray, k: int) -> np.ndarray:
    h = np.full(w.size - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w[j : w.size - k + 1 + j])
    return h


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (null: empty)."""
    out = [np.empty(0, np.uint64)] * len(texts)
    for own, data, begins in blocks(texts):
        w, starts = word_hashes(data)
        first = np.append(np.searchsorted(starts, begins), w.size)
        rolled = _rolled(w, width) if w.size >= width else w[:0]
        for k, a, b in zip(own, first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                h = np.sort(rolled[a : b - width + 1])
                fresh = np.empty(h.size, bool)
                fresh[0] = True
                np.not_equal(h[1:], h[:-1], out=fresh[1:])
                out[k] = h[fresh]
            elif b > a:
                out[k] = _rolled(w[a:b], b - a)
    return out


def digest(hashes: np.ndarray) -> bytes:
    """128 bits that name a set; equal sets have equal digests."""
    a = np.bitwise_xor.reduce(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    b = np.sum(mix(hashes + np.uint64(0x1234567887654321)), dtype=np.uint64)
    return a.tobytes() + b.tobytes()
