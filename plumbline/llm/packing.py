"""Packing by concatenating and cutting.

Pass one tokenises each partition and writes every document's ids with its place in the
partition.  Prefix sums over the partitions' token totals give each partition, and so each
document, a global offset.  Pass two cuts the one long stream into fixed windows: a document
yields one piece for each window that it touches.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import columns, guarded, ship, table

#: Characters beyond these are left to the tokenizers library, whose Unicode tables decide.
_RARE = re.compile("[^\x00-ɏ]")
_LONG = 200_000
_encoders: dict[str, Callable[[str], list[int]]] = {}


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _fast(spec: dict) -> Callable[[str], list[int]] | None:
    """An equal encoder of the tiktoken library, if the file is plain byte-level BPE in rank order."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["type"] != "BPE" or model.get("end_of_word_suffix") or model.get("ignore_merges") or model.get("dropout"):
        return None
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]):
        return None
    import tiktoken

    byte, special = _byte_of(), {x["content"]: x["id"] for x in spec["added_tokens"]}
    merged = [model["vocab"]["".join(x if isinstance(x, list) else x.split(" "))] for x in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])):
        return None
    ranks = {bytes(byte[c] for c in k): v for k, v in model["vocab"].items() if k not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode(text, allowed_special="all")


def encoder(path: str) -> Callable[[str], list[int]]:
    """The ids of a text as ``tokenizers`` gives them for the file, without added special tokens."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library, fast = Tokenizer.from_file(path), _fast(spec)
        slow = lambda text: library.encode(text, add_special_tokens=False).ids
        _encoders[path] = slow if fast is None else lambda text: slow(text) if len(text) > _LONG or _RARE.search(text) else fast(text)
    return _encoders[path]


def _tokenised(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            starts, counts, blobs = [], [], []
            for text in batch.column(1):
                ids = np.array([*encode(text.as_py() or ""), end_id], np.uint32)
                starts.append(at)
                counts.append(ids.size)
                blobs.append((ids.astype("<u2") if int(ids.max()) < 1 << 16 else ids.astype("<u4")).tobytes())
                at += ids.size
            n = len(starts)
            for k in range(0, n, 500):
                s = slice(k, k + 500)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(starts[s]), pa.int32()), batch.column(0)[s], pa.array(starts[s], pa.int64()), pa.array(counts[s], pa.int64()), pa.array(blobs[s], pa.binary())], names=["part", "_id", "at", "n", "ids"])

    return run


def unpacked(blob: bytes, n: int) -> np.ndarray:
    """The ids of a blob of ``n`` of them, in two or four bytes each."""
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype("<u4")


def _cut(window: int, with_ids: bool):
    names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            own: list[int] = []
            for k, (at, n, blob) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3))):
                data = unpacked(blob.as_py(), n).tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    piece = data[4 * start : 4 * (start + length)]
                    rows.append((start, length, zlib.crc32(piece), n, sequence, offset, np.frombuffer(piece, "<u4") if with_ids else None))
                    own.append(k)
                    start += length
            if rows:
                c = list(zip(*rows))
                ids = batch.column(0).take(pa.array(own))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in c[:6]), pa.array(c[6], pa.list_(pa.int64()))], names=names)

    return run


def pack(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its ids and then ``end_id``; null and empty texts are that id alone.  Only the
    last sequence may be shorter than ``window``.  Documents follow each other as they lie in the
    input's partitions; repeated rows are packed as often as they occur; null ids are kept;
    further columns are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = columns(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("_id", kind), T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    stream = table(rows.mapInArrow(_tokenised(tokenizer, end_id), schema), "token-stream")
    totals = sorted((r["part"], r["tokens"]) for r in stream.groupBy("part").agg(F.sum("n").alias("tokens")).toLocalIterator())  # a row for each partition
    before, offsets = 0, []
    for part, tokens in totals:
        offsets.append((part, before))
        before += tokens
    offsets = spark.createDataFrame(offsets, "part int, before long")
    placed = stream.join(guarded(offsets, len(totals)), "part").select("_id", (F.col("before") + F.col("at")).alias("at"), "n", "ids")
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = T.StructType([T.StructField("_id", kind), *(T.StructField(x, T.LongType()) for x in longs), T.StructField("ids", T.ArrayType(T.LongType()))])
    pieces = placed.mapInArrow(_cut(window, with_ids), out).withColumnRenamed("_id", id_col)
    return pieces if with_ids else pieces.drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) from pieces with ids; a group holds one window at most."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return pieces.groupBy("sequence_id").agg(F.flatten(parts).alias("ids"))
