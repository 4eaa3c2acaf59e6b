"""Boolean trigram queries derived from regular expressions.

A query is a set of alternatives, each a set of trigrams that must all occur (lower-cased); None
asks for nothing.  A text without any alternative's trigrams can't match the expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

Query = frozenset[frozenset[str]] | None
_MOST = 64


def _least(terms) -> Query:
    terms = set(terms)
    if frozenset() in terms:
        return None
    return frozenset(t for t in terms if not any(o < t for o in terms))


def both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return min(a, b, key=len) if len(a) * len(b) > _MOST else _least(x | y for x, y in product(a, b))


def either(a: Query, b: Query) -> Query:
    return None if a is None or b is None or len(a) + len(b) > _MOST else _least(a | b)


def _of(strings: frozenset[str]) -> Query:
    if not strings or any(len(s) < 3 for s in strings):
        return None
    return _least(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings)


@dataclass(frozen=True)
class _Part:
    """What is known of the strings of an expression: all of them, or their beginnings and ends."""

    exact: frozenset[str] | None
    first: frozenset[str] = frozenset([""])
    last: frozenset[str] = frozenset([""])
    query: Query = None

    def open(self) -> "_Part":
        if self.exact is None:
            return self
        return _Part(None, self.exact, self.exact, _of(self.exact))


_EMPTY, _UNKNOWN = _Part(frozenset([""])), _Part(None)


def _joined(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= _MOST:
        return _Part(frozenset(x + y for x, y in product(a.exact, b.exact)))
    x, y = a.open(), b.open()
    cross = lambda p, q: frozenset(s + t for s, t in product(p, q)) if len(p) * len(q) <= _MOST else None
    middle = cross(x.last, y.first)
    query = both(both(x.query, y.query), _of(middle) if middle else None)
    first = cross(a.exact, y.first) if a.exact is not None else x.first
    last = cross(x.last, b.exact) if b.exact is not None else y.last
    return _Part(None, first or x.first, last or y.last, both(query, both(_of(first or x.first), _of(last or y.last))))


def _either(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= _MOST:
        return _Part(a.exact | b.exact)
    x, y = a.open(), b.open()
    return _Part(None, x.first | y.first, x.last | y.last, either(x.query, y.query))


def _class(items) -> _Part:
    chars: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            chars.add(chr(arg))
        elif op is C.RANGE and arg[1] - arg[0] < 8:
            chars.update(map(chr, range(arg[0], arg[1] + 1)))
        else:
            return _UNKNOWN
    return _Part(frozenset(c.lower() for c in chars)) if len(chars) <= 8 else _UNKNOWN


def _walk(nodes) -> _Part:
    out = _EMPTY
    for op, arg in nodes:
        if op is C.LITERAL:
            part = _Part(frozenset([chr(arg).lower()]))
        elif op is C.IN:
            part = _class(arg)
        elif op is C.SUBPATTERN:
            part = _walk(arg[-1])
        elif op is C.ATOMIC_GROUP:
            part = _walk(arg)
        elif op is C.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            part = parts[0]
            for p in parts[1:]:
                part = _either(part, p)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, inner = arg
            one = _walk(inner)
            part = _EMPTY
            for _ in range(min(least, 4)):
                part = _joined(part, one)
            if least == 0 and most == 1:
                part = _either(_EMPTY, one)
            elif most != least or least > 4:
                part = _joined(part, _UNKNOWN)
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            part = _EMPTY
        else:
            part = _UNKNOWN
        out = _joined(out, part)
    return out


def query(pattern: str) -> Query:
    """The trigram query of ``pattern``; None if no trigram is mandatory."""
    return _walk(_parser.parse(pattern)).open().query


def matches(q: Query, trigrams: set[str]) -> bool:
    return q is None or any(t <= trigrams for t in q)
