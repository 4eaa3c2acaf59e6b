"""Quality rules by distribution divergence, by DataFrame functions alone.

Counts of a document's character classes and of common words are compared with those of each
language, summed over all documents, by Jensen-Shannon distance.  The nearest language counts, so
a wrong label does no harm, but a language without a reference is not judged by others.  Short texts, whose histograms say little, are left to the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import table

_WORD, _BLANK = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
#: Character classes that are counted by removal; blanks, symbols and other letters follow from totals.
CLASSES = {"upper": "[A-Z]+", "digit": "[0-9]+", "mark": r"""[.,;:!?'"()\-]+""", "foreign": r"[^\x00-\x7F]+"}
#: Common words of four languages.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it"),
    "de": ("der", "die", "und", "den", "von", "zu", "das", "ist"),
    "fr": ("de", "la", "le", "et", "les", "des", "que", "pour"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "por"),
}
_LIST = sorted({w for words in COMMON.values() for w in words})
#: Documents that make a language reference, and the guards and limits of the verdict.
REFERENCE_DOCS = 20
MIN_CHARS, MAX_CHAR_DISTANCE = 150, 0.32
MIN_WORDS, MAX_WORD_DISTANCE = 80, 0.285


def repeated_words(words: Column, hashes: Column) -> Column:
    """How many words lie in 5-word windows that occur more than once; ``hashes`` are the windows'.

    Equal hashes only say that there may be such windows: those are then compared as texts.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda k: F.struct(F.array_join(F.slice(words, k + 1, F.lit(5)), " ").alias("w"), k.alias("k")))
    ordered = F.array_sort(windows)

    def starts(s: Column) -> Column:
        same = lambda x, k, d: F.coalesce(F.get(s, k + d)["w"] == x["w"], F.lit(False))
        return F.transform(F.filter(F.transform(s, lambda x, k: F.struct(x["k"].alias("k"), (same(x, k, -1) | same(x, k, 1)).alias("again"))), lambda x: x["again"]), lambda x: x["k"])

    again = F.array_sort(F.flatten(F.transform(F.array(ordered), starts)))
    covered = lambda a: F.aggregate(F.zip_with(a, F.slice(a, F.lit(2), F.size(a)), lambda x, y: F.least(F.lit(5), F.coalesce(y - x, F.lit(5)))), F.lit(0), lambda n, x: n + x)
    total = F.get(F.transform(F.array(again), covered), F.lit(0))
    return F.when(F.size(hashes) > F.size(F.array_distinct(hashes)), total).otherwise(F.lit(0)).cast("long")


def measured(rows: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """The base counts and both histograms of each row (_id, _text)."""
    text = F.col("_text")
    own = rows.select("_id", *keep, F.coalesce(text, F.lit("")).alias("_text"))
    own = own.withColumn("_w", F.regexp_extract_all("_text", F.lit(_WORD), F.lit(0)))
    own = own.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(_BLANK))
    own = own.withColumn("_lines", lines)
    windows = F.transform(F.sequence(F.lit(0), F.size("_h") - 5), lambda k: F.xxhash64(*(F.get("_h", k + j) for j in range(5))))
    own = own.withColumn("_windows", F.when(F.size("_h") >= 5, windows).otherwise(F.array().cast("array<bigint>")))
    hits = F.filter(F.transform("_w", lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?")))), lambda x: x.isin(_LIST))
    own = own.withColumn("_hits", hits)
    size = lambda c: F.length(c).cast("long")
    removed = lambda p: size("_text") - size(F.regexp_replace("_text", p, ""))
    own = own.select(
        "_id",
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        size("_text").alias("n_chars"),
        size(F.array_join("_w", "")).alias("word_chars"),
        removed(r"[#*$%&|<>]+").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w"), F.col("_windows")).alias("n_repeat_words"),
        *(removed(p).alias(f"c_{c}") for c, p in CLASSES.items()),
        F.size("_hits").cast("long").alias("n_common"),
        F.array(*(F.size("_hits") - F.size(F.array_remove("_hits", w)) for w in _LIST)).cast("array<bigint>").alias("common"),
    )
    known = [F.col(f"c_{c}") for c in CLASSES]
    rest = F.col("word_chars") - F.col("n_symbols") - sum(known[1:], known[0])
    chars = F.array(F.col("n_chars") - F.col("word_chars"), F.col("n_symbols"), *known, rest)
    words = F.concat("common", F.array(F.col("n_words") - F.col("n_common")))
    return own.select("_id", *keep, "n_words", "n_chars", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", chars.alias("chars"), words.alias("words"))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x.cast("double"), total), F.lit(0.0)))


def divergence(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two arrays of shares: 0 (equal) to 1 (nothing in common)."""
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    each = F.zip_with(p, q, lambda x, y: half(x, (x + y) / 2) + half(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / 2))


def references(measures: DataFrame, lang_col: str) -> list[tuple[str, list[float], list[float]]]:
    """Each language of REFERENCE_DOCS documents and both its histograms: sums over all its documents."""
    n_chars, n_words = len(CLASSES) + 3, len(_LIST) + 1
    sums = [F.sum(F.get("chars", F.lit(k))).alias(f"c{k}") for k in range(n_chars)] + [F.sum(F.get("words", F.lit(k))).alias(f"w{k}") for k in range(n_words)]
    own = measures.where(F.col(lang_col).isNotNull()).groupBy(lang_col).agg(F.count("*").alias("n"), *sums).where(F.col("n") >= REFERENCE_DOCS)
    out = []
    for r in own.orderBy(F.desc("n"), lang_col).collect():
        c, w = [r[f"c{k}"] for k in range(n_chars)], [r[f"w{k}"] for k in range(n_words)]
        if sum(c) and sum(w):
            out.append((r[lang_col], [x / sum(c) for x in c], [x / sum(w) for x in w]))
    return out


def assess(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: the base counts, ``base_failed``, both distances and ``kept``.

    Base rules: fewer than 10 words, or over a fifth of the words in repeated 5-word windows.  A
    text of MIN_CHARS characters is also rejected for its distance from every language by character
    classes, one of MIN_WORDS words for that by common words.  Null and empty texts have no words
    and fail; repeated rows are judged each; null ids and languages are kept; without a ``lang_col``
    or languages of REFERENCE_DOCS documents only the base rules decide, as they do for documents of
    no language or one of fewer documents; further columns are not read.
    """
    lang = docs[lang_col].cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"), lang.alias("_lang"))
    seen = table(measured(rows, keep=("_lang",)), "quality")
    known = references(seen, "_lang")
    own = docs.sparkSession.createDataFrame([tuple([r[at] for r in known] for at in range(3))], "_names array<string>, _chars array<array<double>>, _words array<array<double>>")
    shares = seen.withColumns({"_c": _shares(F.col("chars")), "_d": _shares(F.col("words"))}).crossJoin(F.broadcast(own))  # one row
    nearest = lambda c, refs: F.coalesce(F.array_min(F.transform(refs, lambda r: divergence(F.col(c), r))), F.lit(0.0))
    told = shares.withColumns({"char_distance": nearest("_c", F.col("_chars")), "word_distance": nearest("_d", F.col("_words"))})
    judged = F.coalesce(F.array_contains("_names", F.col("_lang")), F.lit(False))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    odd = ((F.col("n_chars") >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)) | ((F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE))
    return told.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~(judged & odd)).alias("kept"), F.round("char_distance", 9).alias("char_distance"), F.round("word_distance", 9).alias("word_distance"))
