"""Plain, slow versions of what the operators compute."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def spans(text: str | None, kinds) -> list[str]:
    found = []
    for rank, (name, pattern, check) in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            if check(m):
                found.append((m.start(), rank, name, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


SECRETS = (
    ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
)


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(d: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m[0])) <= 15),
)


def sha(listed: list[str]) -> str:
    return hashlib.sha256(",".join(listed).encode()).hexdigest()


def shingles(text: str | None, width: int) -> set[tuple[str, ...]]:
    words = WORD.findall(fold(text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def jaccard(docs: list[tuple[int, str | None]], width: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    """id -> (set size, component)."""
    sets = {i: shingles(t, width) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for k in range(len(words) - 4):
        windows[tuple(words[k : k + 5])].append(k)
    covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def edit_distance(pattern: bytes, text: bytes) -> int:
    """Least edits from ``pattern`` to any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for k, c in enumerate(pattern, 1):
        last, row[0] = row[0], k
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def checksum(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


def grams(text: str) -> Counter:
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    out = Counter()
    for word in low.split():
        padded = f" {word} "
        out.update(word)
        out.update(padded[k : k + 2] for k in range(len(padded) - 1))
        out.update(padded[k : k + 3] for k in range(len(padded) - 2))
    return out
