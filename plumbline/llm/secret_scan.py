"""Secret scans over a trigram inverted index, by DataFrame functions alone.

Each rule's expression yields a Boolean query of mandatory trigrams.  The index posts, for every
trigram that some rule asks for, the documents that have it (case folded).  Intersecting the
postings leaves each rule's candidates, whose whole texts are then verified.  Rules without
mandatory trigrams scan all texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import columns, guarded, sha256_of, table
from plumbline.llm.spans import Kind, counted, listed, located, parts
from plumbline.llm.trigrams import query

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_BEGIN, _END = (rf"-----{side} [A-Z0-9 ]*+(?<=PRIVATE KEY)-----" for side in ("BEGIN", "END"))
#: The rules, in the order in which spans of one start are listed.
RULES = (
    Kind("assign", _ASSIGN, lambda hit: F.length(F.regexp_extract(hit, _ASSIGN, 2)) >= 12),
    Kind("access", r"AKIA[A-Z0-9]{14,}+"),
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+"),
    # through the END line, or else through the lines of the key that follow at once
    Kind("private_key", _BEGIN + r"(?:(?:-?[A-Za-z0-9+/=:,.\\\s]++)*+" + _END + r"|(?:\s*+[A-Za-z0-9+/=]{16,}+)*+)", base=False),
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{36,}+", base=False),
    Kind("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+", base=False),
    Kind("google", r"AIza[A-Za-z0-9_-]{35}", base=False),
    Kind("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}+", base=False),
)


def queries(rules: tuple[Kind, ...] = RULES) -> dict[int, frozenset[frozenset[str]]]:
    """The Boolean trigram query of each rule that has one: alternatives, each of trigrams that must all occur."""
    return {k: q for k, r in enumerate(rules) if (q := query(r.pattern)) is not None}


def postings(rows: DataFrame, rules: tuple[Kind, ...] = RULES) -> DataFrame:
    """The inverted index (trigram, _id) of (_id, _text): a posting for each text and each trigram of it that some rule asks for.

    Written to the shared folder, sorted by trigram within its files, so that a reader of some
    trigrams skips the rest; it serves any rules that ask for these trigrams.
    """
    vocabulary = sorted({t for q in queries(rules).values() for term in q for t in term})
    low = rows.select("_id", F.lower("_text").alias("_low"))
    held = F.filter(F.array(*map(F.lit, vocabulary)), lambda t: F.contains(F.col("_low"), t))
    return table(low.select(F.explode(held).alias("trigram"), "_id").sortWithinPartitions("trigram"), "postings")


def candidates(index: DataFrame, rules: tuple[Kind, ...] = RULES) -> DataFrame:
    """(_id, rules): the numbers of the indexed rules that a document may match.

    The postings of the trigrams of each alternative are intersected: an id must come in all of
    them.  Alternatives of a rule are united.
    """
    asked = [(k, n, t, len(term)) for k, q in queries(rules).items() for n, term in enumerate(sorted(q, key=sorted)) for t in sorted(term)]
    terms = index.sparkSession.createDataFrame(asked, "rule int, term int, trigram string, needed long")  # some rows for each rule
    lists = index.where(F.col("trigram").isin(sorted({t for *_, t, _ in asked}))).distinct().join(F.broadcast(terms), "trigram")
    both = lists.groupBy("_id", "rule", "term", "needed").agg(F.count("*").alias("held")).where(F.col("held") == F.col("needed"))
    return both.groupBy("_id").agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Kind, ...] = RULES, keep: bool = False) -> DataFrame:
    """``id_col`` (or, with ``keep``, the whole row as ``doc``) and ``spans``: array<struct(start, rank, kind, end, hit, before, after)>.

    Spans are sorted by start and rule; code points, end exclusive.  Null and empty texts have
    none.  Repeated rows are scanned each; rows with one id share candidates, which only adds
    texts to verify; null ids are kept; further columns are not read without ``keep``.
    """
    rows = columns(docs, id_col, text_col)
    found = table(candidates(postings(rows, rules), rules).withColumnRenamed("_id", "_cid"), "secret-candidates")
    own = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"), *([F.struct(*(docs[c] for c in docs.columns)).alias("_doc")] if keep else []))
    own = own.join(guarded(found), own["_id"].eqNullSafe(found["_cid"]), "left")
    indexed = queries(rules).keys()
    text = F.col("_text")
    asked = lambda k: F.array_contains("rules", F.lit(k)) if k in indexed else F.lit(True)
    own = own.withColumns({f"_p{k}": F.when(asked(k), parts(text, r)) for k, r in enumerate(rules)})
    own = own.withColumns({f"_s{k}": located(F.col(f"_p{k}"), r, k) for k, r in enumerate(rules)})
    spans = F.array_sort(F.concat(*(F.col(f"_s{k}") for k in range(len(rules)))))
    return own.select(F.col("_doc").alias("doc") if keep else F.col("_id").alias(id_col), spans.alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts, the checksum of the base spans and the list of all spans."""
    spans = F.col("spans")
    n_base = sum(r.base for r in RULES)
    return found.select(id_col, *(counted(spans, r.name).alias(f"n_{r.name}") for r in RULES if r.base), sha256_of(listed(F.filter(spans, lambda s: s["rank"] < n_base))).alias("base_sha256"), listed(spans).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span, overlapping ones together, replaced by [SECRET]."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("[SECRET]")).alias("out"))
    ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
    done = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, done)).otherwise(text)
