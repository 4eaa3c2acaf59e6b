"""Language identification by rank-order profiles.

A profile is the list of the most frequent 1- to 3-grams of letters, words padded by blanks.  The
distance of a document from a language is the sum, over the document's profile, of how far each
gram is out of its place in the language's profile; absent grams count the profile's full length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import columns, ship

#: Grams in a profile; languages that may be learned.
PROFILE, MAX_LANGUAGES = 300, 1000
_SHIFT = np.int64(21)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a text, as numbers, and how often they occur."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(_letters()[code], code.astype(np.int64) + 1, np.int64(1))  # 1: a blank
    code = np.concatenate([[np.int64(1)], code, [np.int64(1)]])
    code = code[np.append(True, (code[1:] != 1) | (code[:-1] != 1))]
    if code.size < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = (code[:-1] << _SHIFT) | code[1:]
    three = (two[:-1] << _SHIFT) | code[2:]
    grams = np.concatenate([code[code != 1], two, three[code[1:-1] != 1]])
    return np.unique(grams, return_counts=True)


def profile(text: str | None) -> np.ndarray:
    """The grams of a text by falling count; ties in the order of the grams."""
    grams, counts = gram_counts(text)
    return grams[np.lexsort((grams, -counts))[:PROFILE]]


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    sizes: dict[str, int] = {}

    def pressed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, where = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        return grams, np.bincount(where, np.concatenate([x for _, x in parts]), grams.size).astype(np.int64)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = gram_counts(text.as_py())
            held.setdefault(lang, []).append(own)
            sizes[lang] = sizes.get(lang, 0) + own[0].size
            if sizes[lang] > 1 << 20:
                held[lang] = [pressed(held[lang])]
                sizes[lang] = 0
    for lang, parts in held.items():
        grams, counts = pressed(parts)
        for k in range(0, grams.size, 1 << 16):
            s = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * grams[s].size, pa.string()), pa.array(grams[s]), pa.array(counts[s])], names=["lang", "gram", "n"])


def learn(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text") -> dict[str, list[int]]:
    """The profile of each non-null language of ``docs``: PROFILE grams for MAX_LANGUAGES at most."""
    ship(docs.sparkSession)
    rows = docs.select(docs[lang_col].cast("string").alias("_lang"), docs[text_col].cast("string").alias("_text")).where("_lang is not null and _text is not null")
    counts = rows.mapInArrow(_learned, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PROFILE).select("lang", "gram", "place")
    rows_ = top.limit(PROFILE * MAX_LANGUAGES + 1).collect()
    if len(rows_) > PROFILE * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found: dict[str, list[tuple[int, int]]] = {}
    for r in rows_:
        found.setdefault(r["lang"], []).append((r["place"], r["gram"]))
    return {lang: [g for _, g in sorted(found[lang])] for lang in sorted(found)}


def _told(profiles: dict[str, list[int]]):
    langs = sorted(profiles)
    known = np.unique(np.concatenate([np.empty(0, np.int64), *(np.array(profiles[x], np.int64) for x in langs)]))
    place = np.full((len(langs), known.size + 1), -1, np.int64)
    for k, lang in enumerate(langs):
        place[k, np.searchsorted(known, np.array(profiles[lang], np.int64))] = np.arange(len(profiles[lang]))

    def one(text: str | None) -> tuple[str, float]:
        own = profile(text)
        if not own.size or not langs:
            return "und", 0.0
        at = np.searchsorted(known, own)
        at[at < known.size] = np.where(known[at[at < known.size]] == own[at < known.size], at[at < known.size], known.size)
        at = place[:, at]
        out = np.where(at < 0, PROFILE, np.abs(at - np.arange(own.size))).sum(1)
        best = int(np.argmin(out))
        return langs[best], 1.0 - float(out[best]) / (PROFILE * own.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [one(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in told], pa.string()), pa.array([x for _, x in told], pa.float64())], names=["_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: dict[str, list[int]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``lang_pred`` and ``score`` (1: its grams lie as in the language).

    Null and empty texts, and texts without letters, are ``und`` with score 0, as is everything
    if no language was learned.  Equal distances go to the first language in alphabetical order.
    Repeated rows are told each; null ids are kept; further columns are not read.
    """
    ship(docs.sparkSession)
    rows = columns(docs, id_col, text_col)
    schema = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_told(profiles), schema).withColumnRenamed("_id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of documents that is never learned from (a null id counts as empty)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
