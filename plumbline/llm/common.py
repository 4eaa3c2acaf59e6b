"""What the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.materialize import guarded, scratch, ship, table

__all__ = ["columns", "free", "guarded", "scratch", "sha256_of", "ship", "slices", "table"]


def columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator reads, under names of our own."""
    return docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))


def free(name: str, taken: list[str]) -> str:
    """``name`` with underscores in front until it is not among ``taken``, whatever the case."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` a few at a time, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
