"""Text expressions: entity decoding, whitespace/currency normalization, cuts.

``*_sql`` builders return Spark SQL text; the same-named functions without
the suffix return a Column for a column name or SQL expression.
"""

from __future__ import annotations

from pyspark.sql import Column

from pagefold.functions.core import _ids, col, let, lit

# --- fixed values: named entities decoded (others stay literal) -----------
NAMED_ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
    ("&apos;", "'"), ("&copy;", "©"), ("&reg;", "®"),
    ("&trade;", "™"), ("&middot;", "·"), ("&hellip;", "…"),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&euro;", "€"),
    ("&pound;", "£"), ("&yen;", "¥"), ("&cent;", "¢"),
    ("&laquo;", "«"), ("&raquo;", "»"), ("&bull;", "•"),
    ("&times;", "×"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"),
]
# Whitespace as JavaScript's \s sees it (the reference normalizes in JS).
JS_SPACE = r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
CURRENCY = "€$£¥"
# Currency rewrites (pattern, replacement), applied in order, three rounds.
CURRENCY_RULES = [
    (r"([€$£¥])\s+(\d+)\s*\.\s*(\d{1,2})", "$1$2.$3"),
    (r"(\d+)\s*\.\s*(\d{1,2})\s+([€$£¥])", "$1.$2$3"),
    (r"(?i)(\d+)\s+(\d{2})\s*([€$£¥])\s*/\s*(month|mo\.?|monthly)", "$3$1.$2 / $4"),
]
# --- end fixed values -------------------------------------------------------

NUMERIC_ENTITY = r"&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


def decode_entities_sql(x: str) -> str:
    """Decode the fixed named entities and all numeric entities; ``&amp;`` last.
    Text without ``&`` skips the work."""
    return let(x, lambda v: f"CASE WHEN instr({v}, '&') > 0 THEN {_decode_all(v)} ELSE {v} END")


def _decode_all(x: str) -> str:
    out = x
    for ent, ch in NAMED_ENTITIES:
        out = f"replace({out}, {lit(ent)}, {lit(ch)})"

    def numeric(o: str) -> str:
        n = next(_ids)
        ref, acc = f"_ref{n}", f"_acc{n}"
        body = f"regexp_extract({ref}, {lit(NUMERIC_ENTITY)}, 1)"
        cp = (f"CASE WHEN lower(substring({body}, 1, 1)) = 'x' "
              f"THEN try_cast(conv(substring({body}, 2, 8), 16, 10) AS BIGINT) "
              f"ELSE try_cast({body} AS BIGINT) END")
        one = let(cp, lambda c: (
            f"CASE WHEN {c} > 0 AND {c} <= 1114111 AND NOT ({c} >= 55296 AND {c} <= 57343) "
            f"THEN replace({acc}, {ref}, decode(unhex(lpad(hex({c}), 8, '0')), 'UTF-32')) ELSE {acc} END"))
        return (f"CASE WHEN instr({o}, '&#') > 0 THEN aggregate(array_distinct(regexp_extract_all({o}, "
                f"{lit(NUMERIC_ENTITY)}, 0)), {o}, ({acc}, {ref}) -> {one}) ELSE {o} END")

    return f"replace({let(out, numeric)}, '&amp;', '&')"


def squash_ws_sql(x: str) -> str:
    """Collapse JS whitespace (incl. nbsp) to one space and trim."""
    return f"regexp_replace(regexp_replace({x}, {lit(JS_SPACE)}, ' '), '^ | $', '')"


def normalize_text_sql(x: str) -> str:
    """nbsp -> space, collapse whitespace, trim, then three rounds of the
    three currency rewrites (``€ 4 . 49`` -> ``€4.49``)."""
    c = f"[{CURRENCY}]"
    return let(squash_ws_sql(x), lambda v: f"CASE WHEN {v} RLIKE {lit(c)} THEN {_currency_rounds(v)} ELSE {v} END")


def _currency_rounds(t: str) -> str:
    """The three currency rewrites, three rounds (all need a currency sign)."""
    for _ in range(3):
        for pat, rep in CURRENCY_RULES:
            t = f"regexp_replace({t}, {lit(pat)}, {lit(rep)})"
    return t


def truncate_sql(x: str, n) -> str:
    """Cut to ``n`` characters, the last one replaced by an ellipsis."""
    return let(x, lambda v: f"CASE WHEN length({v}) > ({n}) THEN concat(substring({v}, 1, ({n}) - 1), '…') ELSE {v} END")


def first_line_sql(x: str) -> str:
    """First sentence (up to ``.``/``!``/``?`` before a space) of the
    normalized text, cut at 120; the raw text when nothing is left."""
    def body(raw: str) -> str:
        return let(normalize_text_sql(raw), lambda norm: let(
            f"regexp_extract({norm}, {lit(r'^(.*?[.!?]) ')}, 1)",
            lambda head: f"CASE WHEN {head} != '' THEN {head} WHEN {norm} != '' THEN {norm} ELSE {raw} END"))
    return truncate_sql(let(x, body), 120)


def decode_entities(x: str) -> Column:
    return col(decode_entities_sql(x))


def squash_ws(x: str) -> Column:
    return col(squash_ws_sql(x))


def normalize_text(x: str) -> Column:
    return col(normalize_text_sql(x))


def truncate(x: str, n) -> Column:
    return col(truncate_sql(x, n))


def first_line(x: str) -> Column:
    return col(first_line_sql(x))
