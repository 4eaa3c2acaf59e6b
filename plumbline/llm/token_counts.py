"""Token counts by heap-and-linked-list byte-pair merging.

A piece starts as its byte symbols in a linked list; a heap gives the adjacent pair of lowest
rank, leftmost first; merging it may make two new pairs.  The count is the number of symbols
minus that of merges, and no ids are made.  Counts of words are remembered in a bounded cache.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import columns, ship

#: Words remembered by a worker; a full cache starts anew.
CACHE_WORDS = 1_000_000
#: Texts with other characters are normalised and split by the library's own components.
_RARE = re.compile("[^\t-\r -ɏ]")
_counters: dict[str, "Counter"] = {}


def _ranges(test) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if test(unicodedata.category(chr(c))))


class Counter:
    """Counts tokens as the ``tokenizers`` library does for a byte-level BPE file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("only plain byte-level BPE files are supported")
        self.end = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(x if isinstance(x, list) else x.split(" ")): k for k, x in enumerate(model["merges"])}
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.symbol = [chr(b) if b in plain else chr(next(rest)) for b in range(256)]
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.known = kinds == ["NFC", "Replace", "Lowercase"] and pre[0].get("pattern") == {"Regex": pattern} and pre[0].get("invert") is True
        letters, digits = _ranges(lambda c: c[0] == "L"), _ranges(lambda c: c[0] == "N")
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{letters}{digits}]+").findall
        self.cache: dict[str, int] = {}

    def merged(self, symbols: list[str]) -> int:
        """How many tokens ``symbols`` end as."""
        n = len(symbols)
        if n < 2:
            return n
        rank = self.ranks.get
        heap = [(r, i) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or not symbols[i] or rank((symbols[i], symbols[j])) != r:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return left

    def of_piece(self, data: bytes) -> int:
        symbols = [self.symbol[b] for b in data]
        if symbols:
            symbols[-1] += self.end
        return self.merged(symbols)

    def of_words(self, words: list[str]) -> int:
        cache, total = self.cache, 0
        for word in words:
            n = cache.get(word)
            if n is None:
                n = sum(self.of_piece(x.encode()) for x in self.pieces(word))
                if len(word) <= 64:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[word] = n
            total += n
        return total

    def of_part(self, text: str) -> int:
        if self.known and not _RARE.search(text):
            return self.of_words(text.lower().split())
        text = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        byte = {c: b for b, c in enumerate(self.symbol)}
        return sum(self.of_piece(bytes(byte[c] for c in x)) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(text))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.split is None or not (n := len(self.split.findall(text))):
            return self.of_part(text)
        return n + sum(map(self.of_part, filter(None, self.split.split(text))))


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            n = [count(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Null and empty texts have 0 bytes and 0 tokens.  Repeated rows are counted each; null ids are
    kept; further columns are not read; no rows give no rows.
    """
    ship(docs.sparkSession)
    rows = columns(docs, id_col, text_col).select("_id", F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long").alias("n_bytes"), "_text")
    kind = rows.schema["_id"].dataType
    schema = T.StructType([T.StructField("_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(_counted(tokenizer), schema).select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
