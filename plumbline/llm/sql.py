"""DuckDB SQL for the queries that SQL can express; plain expressions, no operator code."""

from __future__ import annotations

from plumbline.llm.pii import IBAN_COUNTRIES

_BLANKS = r"[^\x20\x09-\x0D]+"


def _found(rank: int, kind: str, pattern: str, check: str = "true") -> str:
    """Spans of one kind: pieces between matches give the places."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, hit, start, start + length(hit) AS stop, before, after FROM (
  SELECT doc_id, unnest(hits) AS hit, unnest(starts) AS start, unnest(pieces[1:len(hits)]) AS before, unnest(pieces[2:]) AS after FROM (
    SELECT *, list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)) AS starts FROM (
      SELECT doc_id, string_split_regex(t, '{p}') AS pieces, regexp_extract_all(t, '{p}') AS hits FROM d WHERE regexp_matches(t, '{p}')))) WHERE {check}"""


def _spans(parts: list[str], counts: list[str], n_base: int, extra: str = "") -> str:
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    counted = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in counts)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, {counted}, {listed} FILTER (WHERE rank < {n_base}) AS base, {listed} AS spans{extra and ', ' + extra} FROM s GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in counts)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans{", coalesce(scores, '') AS scores" if extra else ''} FROM d LEFT JOIN g USING (doc_id)"""


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SECRETS = _spans(
    [
        _found(0, "assign", _ASSIGN, "length(regexp_extract(hit, '" + _ASSIGN.replace("'", "''") + "', 2)) >= 12"),
        _found(1, "access", "AKIA[A-Z0-9]+", "length(hit) >= 18"),
        _found(2, "hex", "[0-9a-f]+", "length(hit) >= 16"),
        _found(3, "private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:(?:-?[A-Za-z0-9+/=:,.\\\s])*-----END [A-Z0-9 ]*PRIVATE KEY-----|(?:\s*[A-Za-z0-9+/=]{16,})*)"),
        _found(4, "github", "gh[pousr]_[A-Za-z0-9]{36,}"),
        _found(5, "slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
        _found(6, "google", "AIza[A-Za-z0-9_-]{35}"),
        _found(7, "jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    ],
    ["assign", "access", "hex"],
    3,
)

_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({_DIGITS}), i, 1)::INT ELSE substr(reverse({_DIGITS}), i, 1)::INT * 2 - CASE WHEN substr(reverse({_DIGITS}), i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_ACCOUNT = "regexp_replace(hit, ' ', '', 'g')"
_NUMBERS = f"list_transform(string_split(substr({_ACCOUNT}, 5) || substr({_ACCOUNT}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
_MOD_97 = f"list_reduce(list_prepend(0, {_NUMBERS}), lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1"
_AROUND = "lower(right(before, 48) || ' ' || left(after, 48))"
_WORDS = {"email": ("e-?mail|contact|write", 0.9, 1.0), "ip": (r"\bip\b|address|host|server", 0.5, 0.8), "card": ("card|credit|visa|payment", 0.8, 0.95), "phone": ("phone|call|tel|mobile|fax", 0.6, 0.9), "iban": ("iban|account|bank|konto", 0.9, 1.0)}
_SCORE = "CASE kind " + " ".join(f"WHEN '{k}' THEN CASE WHEN regexp_matches({_AROUND}, '{w}') THEN '{b:.2f}' ELSE '{a:.2f}' END" for k, (w, a, b) in _WORDS.items()) + " END"
PERSONAL = _spans(
    [
        _found(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        _found(1, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(hit, '.'), lambda x: x::HUGEINT)) <= 255"),
        _found(2, "card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
        _found(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
        _found(4, "iban", "|".join(f"(?:{'|'.join(c)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_COUNTRIES.items()), _MOD_97),
    ],
    ["email", "ip", "card", "phone"],
    4,
    f"string_agg({_SCORE}, ',' ORDER BY start, rank) AS scores",
)

JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANKS}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.y, r.c FROM r JOIN e ON r.doc_id = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.c), d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id"""

_COMMON = ["and", "das", "de", "den", "der", "des", "die", "el", "en", "et", "in", "is", "ist", "it", "la", "le", "les", "los", "of", "por", "pour", "que", "that", "the", "to", "und", "von", "y", "zu"]
_REMOVED = lambda p: f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))"
QUALITY = rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_BLANKS}') AS w FROM documents),
rep AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM (SELECT doc_id, unnest(ks) AS k FROM (SELECT doc_id, list(k) AS ks FROM (SELECT doc_id, k, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d)) GROUP BY doc_id, g HAVING count(*) > 1)), range(5) o(j) GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, len(w) AS n_words, length(t) AS n_chars, length(array_to_string(w, '')) AS word_chars, {_REMOVED('[#*$%&|<>]')} AS n_symbols,
 len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_BLANKS}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_BLANKS}')))) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
 {_REMOVED('[A-Z]')} AS upper, {_REMOVED('[0-9]')} AS digit, {_REMOVED('[.,;:!?' + "''" + '"()-]')} AS mark, {_REMOVED(r'[^\x00-\x7F]')} AS foreign_,
 list_filter(list_transform(w, lambda x: lower(rtrim(x, '.,;:!?'))), lambda x: list_contains({_COMMON}, x)) AS hits FROM d LEFT JOIN rep USING (doc_id)),
h AS (SELECT *, [n_chars - word_chars, n_symbols, upper, digit, mark, foreign_, word_chars - n_symbols - upper - digit - mark - foreign_] AS chars,
 list_append(list_transform({_COMMON}, lambda c: len(list_filter(hits, lambda x: x = c))), n_words - len(hits)) AS words FROM m),
bins AS (SELECT doc_id, lang, 'c' AS kind, unnest(chars) AS v, unnest(range(1, 8)) AS b FROM h UNION ALL SELECT doc_id, lang, 'w', unnest(words), unnest(range(1, {len(_COMMON) + 2})) FROM h),
docs AS (SELECT *, coalesce(v::DOUBLE / nullif(sum(v) OVER (PARTITION BY doc_id, kind), 0), 0) AS p FROM bins),
known AS (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= 20),
ref AS (SELECT lang, kind, b, sum(v)::DOUBLE / sum(sum(v)) OVER (PARTITION BY lang, kind) AS q FROM bins WHERE lang IN (FROM known) GROUP BY lang, kind, b),
js AS (SELECT doc_id, docs.kind, ref.lang, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS x FROM docs JOIN ref USING (kind, b) GROUP BY ALL),
near AS (SELECT doc_id, min(x) FILTER (WHERE kind = 'c') AS c, min(x) FILTER (WHERE kind = 'w') AS w FROM js GROUP BY doc_id),
f AS (SELECT h.*, near.c, near.w, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM h LEFT JOIN near USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(lang IN (FROM known WHERE lang IS NOT NULL) AND ((n_chars >= 150 AND c > 0.32) OR (n_words >= 80 AND w > 0.285)), false) AS kept, round(coalesce(c, 0), 9) AS char_distance, round(coalesce(w, 0), 9) AS word_distance FROM f"""

SQL = {"op1_secret_scan": SECRETS, "op2_pii": PERSONAL, "op3_ngram_jaccard": JACCARD, "op5_quality": QUALITY}
