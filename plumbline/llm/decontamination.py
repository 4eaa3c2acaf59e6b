"""Benchmark decontamination under edit distance: CGK walks, bit sampling, exact verification.

A CGK walk reads a string by a random rule: at each step it writes the byte that it stands on and
then stays or goes on, as the step's bit for that byte says.  Two strings of small edit distance
give walks that agree at many steps: the Hamming distance of what is written stands for the edits.
Steps go in pairs with opposite bits, so that two steps always read a byte at least.

A window of an item's size begins at each STRIDE-th word of a text, and an item is embedded from each
of its words on, so that every window inside a copy has its counterpart.  Sampled stretches of
neighbouring steps are the keys of the tables, as walks agree in bursts between edits.  Items and
windows that share keys at as many words as the class asks for, with ends that fit, are candidates.
Repetitions of the walk are added until simulated copies, edited up to the limit, are found with
the wanted probability; items that can't be are searched for everywhere.  Candidates are thinned out
without loss, by the least edits of the item's stretches of up to 63 bytes, and then verified
exactly, by the least edit distance of the item to any stretch of the window.
"""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import columns, ship, slices

#: Bytes of items' texts in one block, whose index each Python worker builds; more items make more blocks.
BLOCK_BYTES = 1 << 20
#: Sampled stretches of a walk, and the steps from one to the next; their possible sizes, the largest that does is taken.
SITES, APART, SIZES = 7, 4, (20, 18, 16, 14, 12, 10, 8, 6, 4, 2)
#: Walks at most; the wanted probability that a copy edited up to the limit is found; copies simulated for it.
MOST_WALKS, RECALL, TRIALS = 4, 0.99, 400
#: Items of fewer words may be part of a word, and are searched for everywhere.
LEAST_WORDS = 4
#: Words of texts looked up at once, buckets for a key, bytes of a searched stretch at most, searches done at once.
LOOKUPS, SPARE, STRETCH, SEARCHES = 1 << 15, 32, 63, 2048
_PUNCTUATION = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_LONGEST = max(SIZES) + APART * (SITES - 1)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation and white space separate them."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split() if text else []


def least_edits(pattern: bytes, text: bytes) -> tuple[int, int]:
    """The least edit distance of ``pattern`` to any stretch of ``text``, and where that ends.

    Myers' bit vectors in one whole number: a column of the table for each symbol of the text.
    """
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    at: dict[int, int] = defaultdict(int)
    for k, c in enumerate(pattern):
        at[c] |= 1 << k
    up, down, score = full, 0, m
    best, end = m, 0
    for k, c in enumerate(text):
        eq = at.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(x | up)), up & x
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        y = eq | down
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(y | plus)), plus & y
        if score < best:
            best, end = score, k + 1
    return best, end


@lru_cache(maxsize=MOST_WALKS)
def _rules(walk: int) -> np.ndarray:
    """A number for each step and byte: its lowest bit says whether the walk goes on, the rest marks the step and byte."""
    rules = np.random.Generator(np.random.PCG64([walk, 7])).integers(0, 1 << 64, (_LONGEST + 2, 256), dtype=np.uint64)
    rules[1::2] = (rules[1::2] & ~np.uint64(1)) | (~rules[::2] & np.uint64(1))
    return rules


def embedded(data: np.ndarray, starts: np.ndarray, walk: int, wanted: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """At each of the ``wanted`` steps: the sums of what the walks from ``starts`` wrote before it, and the bytes they stand on."""
    at, total = starts.astype(np.int64), np.zeros(starts.size, np.uint64)
    one, last = np.uint64(1), max(wanted)
    byte, wrote = np.empty(starts.size, np.uint8), np.empty(starts.size, np.uint64)
    for k, rule in enumerate(_rules(walk)):
        if k in wanted:
            yield k, total, at
        if k == last:
            break
        data.take(at, out=byte, mode="clip")
        rule.take(byte, out=wrote, mode="clip")
        total += wrote
        wrote &= one
        at += wrote.view(np.int64)


@dataclass(frozen=True)
class Shape:
    """How the items of a class are looked up: steps of a key, every how many words, words that must agree, walks."""

    size: int
    stride: int
    together: int
    walks: int

    @property
    def wanted(self) -> set[int]:
        return {at + end for at in range(0, APART * SITES, APART) for end in (0, self.size)}


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one run of bytes, where each begins (and the last ends), and the beginning, text and number of each word."""
    begins = np.append(0, np.cumsum([len(x) + 1 for x in texts])).astype(np.int64)
    data = np.frombuffer(b" ".join(texts) + b" " * (_LONGEST + 1), np.uint8)
    head = data[: begins[-1]] != 32
    words = np.flatnonzero(head & np.append(True, ~head[:-1])) if head.size else np.empty(0, np.int64)
    text = np.searchsorted(begins, words, "right") - 1
    return data, begins, words, text, np.arange(words.size) - np.searchsorted(text, text)


class Tables:
    """The keys of one class of items, by walk."""

    def __init__(self, number: np.ndarray, patterns: list[bytes], edits: np.ndarray, shape: Shape):
        self.shape, self.edits = shape, edits
        data, begins, words, own, _ = joined(patterns)
        self.walks = []
        for walk in range(shape.walks):
            told = {k: (total.copy(), at.copy()) for k, total, at in embedded(data, words, walk, shape.wanted)}
            key, item, offset = [], [], []
            for at in range(0, APART * SITES, APART):
                (before, _), (after, place) = told[at], told[at + shape.size]
                whole = place <= begins[own + 1]  # the rest of the item is that long
                key.append((after - before)[whole])
                item.append(number[own[whole]])
                offset.append((words - begins[own])[whole])
            key = np.concatenate(key)
            self.bits = min(22, max(12, (SPARE * key.size).bit_length()))
            order = np.argsort(key, kind="stable")
            uses = np.bincount((key >> np.uint64(64 - self.bits)).view(np.int64), minlength=1 << self.bits)
            first = np.append(0, np.cumsum(uses)).astype(np.int32)
            self.walks.append((uses > 0, first, key[order], np.concatenate(item)[order].astype(np.int32), np.concatenate(offset)[order].astype(np.int32)))

    def hits(self, told: dict[int, np.ndarray], words: np.ndarray, walk: int, some: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word's place, item, offset in the item) of the keys that agree."""
        out, shift = [], np.uint64(64 - self.bits)
        marks, first, keys, items, offsets = self.walks[walk]
        for at in range(0, APART * SITES, APART):
            key = told[at + self.shape.size] - told[at]
            if some is not None:
                key = key[some]
            bucket = (key >> shift).view(np.int64)
            seen = np.flatnonzero(marks.take(bucket))
            bucket = bucket[seen]
            begin = first[bucket].astype(np.int64)
            n = first[bucket + 1] - begin
            place = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            word = np.repeat(seen, n)
            same = keys[place] == key[word]
            place, word = place[same], word[same]
            out.append((words[word], items[place], offsets[place]))
        return out

    def candidates(self, hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]], begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, begin, text): where items may begin, those with enough words that agree; begins are of a range of edits each."""
        word, item, offset = (np.concatenate(x) for x in zip(*hits))
        begin, text = word - offset, np.searchsorted(begins, word, "right") - 1
        order = np.lexsort((word, begin, text, item))
        word, item, begin, text = word[order], item[order], begin[order], text[order]
        if self.shape.together > 1:
            near = (np.diff(item) == 0) & (np.diff(text) == 0) & (np.diff(begin) <= self.edits[item[1:]]) & (np.diff(word) != 0)
            item, begin, text = item[1:][near], begin[1:][near], text[1:][near]
        wide = self.edits[item] + 1
        begin = begin // wide * wide
        fresh = np.append(True, (np.diff(item) != 0) | (np.diff(begin) != 0) | (np.diff(text) != 0))[: item.size]
        return item[fresh], begin[fresh], text[fresh]


def _edited(pattern: bytes, edits: int, rng: random.Random) -> bytes:
    """``pattern`` with so many bytes at random places left out, changed or added."""
    out = bytearray()
    chosen = set(rng.sample(range(len(pattern)), min(edits, len(pattern))))
    for k, c in enumerate(pattern):
        kind = rng.randrange(3) if k in chosen else 3
        if kind:
            out.append(c if kind > 1 else rng.randrange(97, 123))
        if kind == 2:
            out.append(rng.randrange(97, 123))
    return b" ".join(bytes(out).split())


def _found_by_walks(patterns: list[bytes], limit: float, shape: Shape) -> float:
    """The share of simulated copies that are candidates."""
    rng = random.Random(len(patterns))
    edits = np.array([int(limit * len(p)) for p in patterns], np.int64)
    tables = Tables(np.arange(len(patterns)), patterns, edits, shape)
    who = np.array([k % len(patterns) for k in range(max(TRIALS, len(patterns)))])
    texts = [b" ".join([*rng.choice(patterns).split()[: rng.randrange(8)], _edited(patterns[k], int(edits[k]), rng)]) for k in who]
    data, begins, words, _, rank = joined(texts)
    words = words[rank % shape.stride == 0]
    hits = []
    for walk in range(shape.walks):
        hits += tables.hits({k: total.copy() for k, total, _ in embedded(data, words, walk, shape.wanted)}, words, walk)
    item, _, text = tables.candidates(hits, begins)
    return len(set(text[who[text] == item].tolist())) / len(texts)


def shaped(patterns: list[bytes], limit: float) -> Shape | None:
    """The fewest walks and then the longest keys by which the items of a class are found with probability RECALL; None if nothing will do."""
    own = sorted(set(patterns))
    own = own[:: 1 + len(own) // TRIALS]
    words = min(len(p.split()) for p in own)
    stride, together = 2 if words >= 20 else 1, 2 if words >= 8 else 1
    for walks in (MOST_WALKS // 2, MOST_WALKS):
        for size in SIZES:
            shape = Shape(size, stride, together, walks)
            if _found_by_walks(own, limit, shape) >= RECALL:
                return shape
    return None


def shapes(texts: list[str], limit: float) -> dict[int, Shape | None]:
    """The shape of each class: the number of bits of the length of an item's words."""
    classes: dict[int, list[bytes]] = defaultdict(list)
    for t in texts:
        if len(w := words_of(t)) >= LEAST_WORDS:
            classes[len(p := b" ".join(w)).bit_length()].append(p)
    return {k: shaped(own, limit) if limit < 1 else None for k, own in sorted(classes.items())}


class Index:
    """The tables of all classes, and the stretches that are searched for."""

    def __init__(self, items: list[tuple[object, str]], limit: float = 0.2, known: dict[int, Shape | None] | None = None):
        self.items = [(i, w, b" ".join(w)) for i, t in items if (w := words_of(t))]
        self.limit = limit
        known = shapes([t for _, t in items], limit) if known is None else known
        self.size = np.array([len(p) for _, _, p in self.items], np.int64)
        self.most = np.array([int(limit * len(p)) for _, _, p in self.items], np.int64)
        classes: dict[int, list[int]] = defaultdict(list)
        self.always = []
        for k, (_, w, p) in enumerate(self.items):
            found = len(w) >= LEAST_WORDS and known[len(p).bit_length()]
            (classes[len(p).bit_length()] if found else self.always).append(k)
        self.tables = [Tables(np.array(own), [self.items[k][2] for k in own], self.most, known[c]) for c, own in classes.items()]
        cuts = [np.linspace(0, len(p), -(-len(p) // STRETCH) + 1).astype(int) for _, _, p in self.items]
        self.first = np.append(0, np.cumsum([c.size - 1 for c in cuts])).astype(int)
        stretches = [p[a:b] for (_, _, p), c in zip(self.items, cuts) for a, b in zip(c, c[1:])]
        self.offset = np.array([a for c in cuts for a in c[:-1]], np.int64)
        self.length = np.array([len(x) for x in stretches], np.int64)
        self.full = np.array([((1 << len(x)) - 1) << (64 - len(x)) for x in stretches], np.uint64)
        self.equal = np.repeat(~self.full[:, None], 256, 1)  # the lowest bits agree with every symbol
        for k, x in enumerate(stretches):
            for j, c in enumerate(x):
                self.equal[k, c] |= np.uint64(1 << (64 - len(x) + j))
        self.equal = self.equal.reshape(-1)

    def least(self, data: np.ndarray, stretch: np.ndarray, begin: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """The least edits of each stretch in the ``steps`` bytes from ``begin``, or fewer: Myers' bit vectors, many at once."""
        order = np.argsort(steps, kind="stable")
        out = np.zeros(stretch.size, np.int64)
        one, top = np.uint64(1), np.uint64(63)
        for at in range(0, order.size, SEARCHES):
            own = order[at : at + SEARCHES]
            s, where = stretch[own], begin[own]
            row, up, down, score = s * 256, self.full[s], np.zeros(own.size, np.uint64), self.length[s].view(np.uint64)
            best = score.copy()
            x, y, plus, minus = (np.empty_like(up) for _ in range(4))
            for _ in range(int(steps[own[-1]])):
                eq = self.equal.take(row + data.take(where))
                np.bitwise_and(eq, up, out=x)
                x += up
                x ^= up
                x |= eq
                np.bitwise_or(x, up, out=plus)
                np.invert(plus, out=plus)
                plus |= down
                np.bitwise_and(up, x, out=minus)
                np.right_shift(plus, top, out=y)
                score += y
                np.right_shift(minus, top, out=y)
                score -= y
                np.minimum(best, score, out=best)
                np.bitwise_or(eq, down, out=y)
                plus <<= one
                minus <<= one
                np.bitwise_or(y, plus, out=up)
                np.invert(up, out=up)
                up |= minus
                np.bitwise_and(plus, y, out=down)
                where += 1
            out[own] = best
        return out

    def near(self, data: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The numbers of the ranges in which the stretches' least edits together are few enough."""
        left, edits, k = np.arange(item.size), np.zeros(item.size, np.int64), 0
        out = [left[:0]]
        padded = np.append(data, np.zeros(STRETCH + 1 + int((high - low).max(initial=0)), np.uint8))
        while left.size:
            s = self.first[item[left]] + k
            first = np.clip(low[left] + self.offset[s], begin[left], end[left])
            last = np.clip(high[left] + self.offset[s] + self.length[s], first, end[left])
            edits[left] += self.least(padded, s, first, last - first)
            left = left[edits[left] <= self.most[item[left]]]
            k += 1
            done = self.first[item[left]] + k == self.first[item[left] + 1]
            out.append(left[done])
            left = left[~done]
        return np.concatenate(out)

    def found(self, texts: list[bytes]) -> set[tuple[int, int, int, int]]:
        """(text, item, begin, end) of the windows that are worth verifying."""
        data, begins, words, _, rank = joined(texts)
        hits: list[list] = [[] for _ in self.tables]
        for walk in range(max((t.shape.walks for t in self.tables), default=0)):
            own = [(t, h) for t, h in zip(self.tables, hits) if walk < t.shape.walks]
            wanted = set().union(*(t.shape.wanted for t, _ in own))
            stride = min(t.shape.stride for t, _ in own)
            taken = words[rank % stride == 0] if stride > 1 else words
            number = rank[rank % stride == 0] if stride > 1 else rank
            for at in range(0, taken.size, LOOKUPS):
                part, place = taken[at : at + LOOKUPS], number[at : at + LOOKUPS]
                told = {k: total.copy() for k, total, _ in embedded(data, part, walk, wanted)}
                for t, h in own:
                    some = None if t.shape.stride == stride else np.flatnonzero(place % t.shape.stride == 0)
                    h += t.hits(told, part if some is None else part[some], walk, some)
        out: set[tuple[int, int, int, int]] = set()
        some = np.flatnonzero(np.diff(begins) > 1)  # texts with words
        told = [(np.full(some.size, k), begins[some] - self.size[k], begins[some + 1], some) for k in self.always]
        for t, h in zip(self.tables, hits):
            if h:
                item, place, text = t.candidates(h, begins)
                told.append((item, place - self.most[item], place + 2 * self.most[item], text))
        for item, low, high, text in told:
            e = self.most[item]
            begin, end = np.clip(low, begins[text], begins[text + 1] - 1), np.clip(high + self.size[item], begins[text], begins[text + 1] - 1)
            fits = np.flatnonzero(end - begin >= self.size[item] - e)
            near = fits[self.near(data, item[fits], low[fits], high[fits], begin[fits], end[fits])]
            out.update(zip(text[near].tolist(), item[near].tolist(), (begin - begins[text])[near].tolist(), (end - begins[text])[near].tolist()))
        return out

    def matches(self, texts: list[str | None], limit: float) -> list[tuple[int, object, int, int, int]]:
        """(text, item id, first word, words, edits) of the best stretch for each item that a text holds."""
        whole = [b" ".join(words_of(t)) for t in texts]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, item, a, b in sorted(self.found(whole)):
            _, w, pattern = self.items[item]
            edits, end = least_edits(pattern, whole[n][a:b])
            if edits <= limit * len(pattern) and ((n, item) not in best or edits < best[n, item][2]):
                last = whole[n].count(b" ", 0, a + end)
                begin = max(0, last + 1 - len(w))
                best[n, item] = (begin, last + 1 - begin, edits)
        return [(n, self.items[k][0], *best[n, k]) for n, k in sorted(best)]


@lru_cache(maxsize=1)
def _index(items: tuple[tuple[object, str], ...], limit: float, known: tuple) -> Index:
    """The index of a block, kept by a worker from task to task."""
    return Index(list(items), limit, dict(known))


def _searched(block, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _index(*block.value[:1], limit, block.value[1])
        for batch in slices(batches, 2000):
            if found := own.matches(batch.column(1).to_pylist(), limit):
                c = list(zip(*found))
                item = pa.array(c[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(c[0])), item, *(pa.array(x, pa.int64()) for x in c[2:])], names=["_id", "_item", "word", "words", "edits"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", limit: float = 0.2) -> DataFrame:
    """One row per document and benchmark item that it holds.

    Columns: the two ids, ``word`` and ``words`` (the place of the item's best stretch, in words of
    lower-case letters, digits and non-ASCII characters) and ``edits``.  An item is held if it can
    be turned into a stretch of the text by at most ``limit`` times its length of byte edits, both
    with words parted by single blanks; of several such stretches one of the least edits found, the
    first of them, is told.  Copies with as many edits at random places are found with probability
    RECALL, those with fewer more often; what is told is exact.  Null and empty texts, and items
    without words, match nothing; repeated documents match each, equal rows of ``items`` once; null
    ids are kept; further columns are not read; without items or documents there are no rows.
    Items are dealt with in blocks of about BLOCK_BYTES, each with its own pass over the documents.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = columns(docs, id_col, text_col).where("_text is not null")
    bench = columns(items, item_id_col, item_text_col).where("_text is not null").distinct()
    kinds = rows.schema["_id"].dataType, bench.schema["_id"].dataType
    schema = T.StructType([T.StructField("_id", kinds[0]), T.StructField("_item", kinds[1]), *(T.StructField(x, T.LongType()) for x in ("word", "words", "edits"))])
    size = bench.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    out = None
    for block in range(blocks):
        own = bench.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)) == block).orderBy("_id", "_text").collect()
        texts = tuple((r["_id"], r["_text"]) for r in own)
        sent = spark.sparkContext.broadcast((texts, tuple(shapes([t for _, t in texts], limit).items())))
        found = rows.mapInArrow(_searched(sent, limit), schema)
        out = found if out is None else out.union(found)
    return out.select(F.col("_id").alias(id_col), F.col("_item").alias(item_id_col if item_id_col != id_col else f"{item_id_col}_item"), "word", "words", "edits")
