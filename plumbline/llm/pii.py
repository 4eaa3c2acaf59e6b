"""Personal data: expressions propose, checksums confirm, context words adjust the score.

By DataFrame functions alone, row by row, without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import sha256_of
from plumbline.llm.spans import Kind, counted, listed, located, parts


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a sum by Luhn's rule that 10 divides."""
    each = F.split(F.reverse(digits), "")
    one = lambda x, k: F.when(k % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2))
    return F.aggregate(F.transform(F.filter(each, lambda x: x != ""), one), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether an account number of letters and digits leaves 1 by mod 97, its first four last."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda x: x != ""), F.lit(0), step) == 1


def _card(hit: Column) -> Column:
    d = _digits(hit)
    return F.length(d).between(14, 19) & luhn(d)


def _iban(hit: Column) -> Column:
    return mod_97(F.regexp_replace(hit, " ", ""))


# The length of an IBAN by country, from the public registry of ISO 13616.
IBAN_COUNTRIES = {
    15: ("NO",),
    16: ("BE",),
    18: ("DK", "FI", "FK", "FO", "GL", "NL", "SD"),
    19: ("MK", "SI"),
    20: ("AT", "BA", "EE", "KZ", "LT", "LU", "MN", "XK"),
    21: ("CH", "CR", "HR", "LI", "LV"),
    22: ("BG", "BH", "DE", "GB", "GE", "IE", "ME", "RS", "VA"),
    23: ("AE", "GI", "IL", "IQ", "OM", "SO", "TL"),
    24: ("AD", "CZ", "DZ", "ES", "MD", "PK", "RO", "SA", "SE", "SK", "TN", "VG"),
    25: ("LY", "PT", "ST"),
    26: ("IS", "TR"),
    27: ("BI", "DJ", "FR", "GR", "IT", "MC", "MR", "SM"),
    28: ("AL", "AZ", "BY", "CY", "DO", "GT", "HU", "LB", "NI", "PL", "SV"),
    29: ("BR", "EG", "PS", "QA", "UA"),
    30: ("JO", "KW", "MU", "YE"),
    31: ("MT", "SC"),
    32: ("LC",),
    33: ("RU",),
}
_LOCAL = "A-Za-z0-9._%+-"
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: The kinds, in the order in which spans of one start are listed.  Look-behinds and possessive
#: repeats keep the leftmost matches of the plain expressions and make long runs cost one pass.
KINDS = (
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda hit: hit.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", _card),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda hit: F.length(_digits(hit)).between(10, 15)),
    Kind("iban", "(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(f"(?:{'|'.join(c)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_COUNTRIES.items()) + ")", _iban, base=False),
)
#: Score of a kind by itself and beside one of its words.
SCORES = {"email": (0.9, 1.0), "ip": (0.5, 0.8), "card": (0.8, 0.95), "phone": (0.6, 0.9), "iban": (0.9, 1.0)}
WORDS = {"email": "e-?mail|contact|write", "ip": r"\bip\b|address|host|server", "card": "card|credit|visa|payment", "phone": "phone|call|tel|mobile|fax", "iban": "iban|account|bank|konto"}


def scored(span: Column) -> Column:
    """The score of a span, by the words around it."""
    out = F.lit(0.5)
    around = F.lower(F.concat_ws(" ", span["before"], span["after"]))
    for kind, (alone, beside) in SCORES.items():
        out = F.when(span["kind"] == kind, F.when(around.rlike(WORDS[kind]), F.lit(beside)).otherwise(F.lit(alone))).otherwise(out)
    return out


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``spans``: array<struct(start, rank, kind, end, hit, before, after)>, and their ``scores``.

    Spans are sorted by start and kind; code points, end exclusive.  Null and empty texts have
    none; repeated rows are searched each; null ids are kept; further columns are not read.
    """
    own = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    own = own.withColumns({f"_p{k}": parts(F.col("_text"), kind) for k, kind in enumerate(KINDS)})
    own = own.withColumns({f"_s{k}": located(F.col(f"_p{k}"), kind, k) for k, kind in enumerate(KINDS)})
    own = own.withColumn("_spans", F.array_sort(F.concat(*(F.col(f"_s{k}") for k in range(len(KINDS))))))
    return own.select(F.col("_id").alias(id_col), F.col("_spans").alias("spans"), F.transform("_spans", scored).alias("scores"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts, the checksum of the base spans, the list of all spans and their scores."""
    spans = F.col("spans")
    n_base = sum(k.base for k in KINDS)
    return found.select(
        id_col,
        *(counted(spans, k.name).alias(f"n_{k.name}") for k in KINDS if k.base),
        sha256_of(listed(F.filter(spans, lambda s: s["rank"] < n_base))).alias("base_sha256"),
        listed(spans).alias("spans"),
        F.array_join(F.transform("scores", lambda x: F.format_string("%.2f", x)), ",").alias("scores"),
    )
