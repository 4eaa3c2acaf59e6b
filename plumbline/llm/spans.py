"""Positions of regular-expression matches, by DataFrame functions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of text kept on either side of a match.
AROUND = 48
_BLOCK = 128


@dataclass(frozen=True)
class Kind:
    """A kind of span: what finds it, and what a match must satisfy."""

    name: str
    pattern: str
    check: object = None  # Column of the match -> Column of boolean
    base: bool = True


def _running(xs: Column) -> Column:
    """Inclusive prefix sums of a short array."""
    add = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x))
    return F.aggregate(xs, F.array().cast("array<int>"), add)


def running(xs: Column) -> Column:
    """Inclusive prefix sums of a non-empty array of int, by blocks, so that long arrays stay cheap."""
    blocks = F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / _BLOCK).cast("int")), lambda k: _running(F.slice(xs, k * _BLOCK + 1, F.lit(_BLOCK))))
    totals = lambda b: _running(F.transform(b, lambda c: F.get(c, F.size(c) - 1)))
    shifted = lambda b: F.zip_with(b, F.concat(F.array(F.lit(0)), F.slice(totals(b), 1, F.size(b) - 1)), lambda c, t: F.transform(c, lambda x: x + t))
    return F.flatten(shifted(blocks))


def parts(text: Column, kind: Kind) -> Column:
    """struct(pieces, hits): the texts between the matches and the matches, or null if there are none."""
    return F.when(text.rlike(kind.pattern), F.struct(F.split(text, kind.pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hits")))


def located(found: Column, kind: Kind, rank: int) -> Column:
    """array<struct(start, rank, kind, end, hit, before, after)> of the good matches; code points, end exclusive."""
    pieces, hits = found["pieces"], found["hits"]
    steps = F.zip_with(F.slice(F.transform(pieces, lambda x: F.length(x)), F.lit(1), F.size(hits)), F.concat(F.array(F.lit(0)), F.slice(F.transform(hits, lambda x: F.length(x)), F.lit(1), F.size(hits) - 1)), lambda a, b: a + b)
    spans = F.transform(
        F.arrays_zip(hits.alias("hit"), running(steps).alias("start"), F.slice(pieces, F.lit(1), F.size(hits)).alias("b"), F.slice(pieces, F.lit(2), F.size(hits)).alias("a")),
        lambda z: F.struct(z["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (z["start"] + F.length(z["hit"])).alias("end"), z["hit"].alias("hit"), F.right(z["b"], F.lit(AROUND)).alias("before"), F.left(z["a"], F.lit(AROUND)).alias("after")),
    )
    if kind.check is not None:
        spans = F.filter(spans, lambda s: kind.check(s["hit"]))
    return F.when(found.isNotNull(), spans).otherwise(F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,hit:string,before:string,after:string>>"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
