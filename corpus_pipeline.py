"""A corpus pipeline: quality, near duplicates, decontamination, secrets, packing.

Each stage takes the documents that its predecessor kept.  All but the last return the columns of
``documents``; documents without a fault pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontamination, packing, quality, secret_scan
from plumbline.llm.common import free, guarded, table
from plumbline.llm.near_duplicates import jaccard_components
from plumbline.llm.queries import tokenizer


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a row's identity, its id, which may be null or repeated, and its text; and that column's name."""
    key = free("row_key", docs.columns)
    return docs.withColumn(key, F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("hash"))), key


def _without(docs: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key isn't in ``keys``."""
    gone = free("gone", docs.columns)
    keys = table(keys.select(F.col(key).alias(gone)).distinct(), "gone")
    return docs.join(guarded(keys), docs[key] == keys[gone], "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject, those without words (null and empty texts) among them.

    Rows equal in id and text stay or go together; null ids are documents like others; very long
    texts are judged whole; languages without a reference are left to the base rules.
    """
    own, key = _keyed(docs)
    return _without(own, key, quality.assess(own, id_col=key).where("not kept")).drop(key)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, 0.8): that of least id.

    Of rows equal in id and text one stays; of several texts with the least id, that of least hash;
    a null id is less than others.  Documents without words are nobody's duplicates.
    """
    own, key = _keyed(docs)
    told = jaccard_components(own, id_col=key, width=5, threshold=(80, 100))
    told = table(told.groupBy(key).agg(F.count("*").alias("rows"), F.first("component_id").alias("component_id")), "kept")
    left = _without(own, key, told.where(F.col("component_id") != F.col(key)))
    twice = told.where((F.col("rows") > 1) & (F.col("component_id") == F.col(key))).select(F.col(key).alias(free("twice", own.columns)))
    if twice.isEmpty():
        return left.drop(key)
    twice = table(twice, "twice")
    many, same = guarded(twice), left[key] == twice[twice.columns[0]]
    return left.join(many, same, "left_anti").union(left.join(many, same, "left_semi").dropDuplicates([key])).drop(key)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of ``benchmark`` with edits of up to a fifth of its length.

    Null and empty texts hold nothing and stay, as do all documents where there are no items; rows
    equal in id and text go together; one item is enough, whichever of several ties; texts are read whole.
    """
    own, key = _keyed(docs)
    return _without(own, key, decontamination.contaminated(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)).drop(key)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by [SECRET]; texts without secrets, null and empty ones among them, stay as they are.

    Spans that overlap become one [SECRET]; ``n_chars`` of a changed text is counted anew; repeated
    rows and null ids are kept, each row by itself; a secret of any length goes whole.
    """
    names = docs.columns
    out = secret_scan.scan(docs, keep=True)
    text = F.col("doc.text")
    clean = F.when(F.size("spans") > 0, secret_scan.redacted(text, F.col("spans"))).otherwise(text)
    out = out.select("doc", clean.alias("_clean"), (F.size("spans") > 0).alias("_changed"))
    kind = dict(docs.dtypes).get("n_chars")
    count = F.when(F.col("_changed"), F.length("_clean").cast(kind)).otherwise(F.col("doc.n_chars")).alias("n_chars") if kind else None
    return out.select(*(F.col("_clean").alias("text") if c == "text" else count if c == "n_chars" else F.col(f"doc.`{c}`").alias(c) for c in names))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents in sequences of 1024 tokens.

    A null or empty text is its end token alone; repeated rows and null ids are documents like
    others; a text longer than a sequence has pieces in several; no documents give no pieces.
    """
    return packing.pack(docs, tokenizer=tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", pack),
]

#: Trained tokenizers, edit distances and divergence verdicts are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = table(out, f"stage-{k}") if k + 1 < len(STAGES) else out
    return docs
