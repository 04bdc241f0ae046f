"""HTML pages -> token table -> element coverage flags.

A page is exploded once into an ordered token table ``(page_id, pos, kind,
tag, attrs, text)``. Element extents come from same-tag depth computed with
windows; "inside element X" is a running count of X opens minus X closes.
Every window is partitioned by ``page_id`` (or by ``page_id`` plus more
keys), so after one ``repartition(page_id)`` of the pages the whole pipeline
runs without another shuffle: the explode keeps the page partitioning and
every later window / aggregate is satisfied by it.

Expressions are Spark SQL text (``selectExpr``): one JVM call per column.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from pagefold.functions.core import let, lit, nonempty
from pagefold.functions.text import decode_entities_sql, normalize_text_sql

# --- fixed values ----------------------------------------------------------
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link",
             "meta", "param", "source", "track", "wbr"]
RAW_TEXT_TAGS = ["script", "style", "noscript", "template", "title"]
BLOCK_TAGS = ["address", "article", "aside", "blockquote", "body", "dd", "details",
              "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
              "footer", "form", "header", "hr", "li", "main", "nav", "ol", "p",
              "pre", "section", "summary", "ul"]
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
# --- end fixed values -------------------------------------------------------

# Possessive quantifiers keep Java's regex from recursing on long tags.
TOKEN_RE = r"""<[a-zA-Z/!?](?:[^'">]++|"[^"]*+"|'[^']*+')*+>|[^<]++|<"""
STRIP_RE = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(
    f"<{t}\\b.*?(?:</{t}\\s*>|\\z)" for t in RAW_TEXT_TAGS)
ATTR_PAIR_RE = r"""[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?"""

W_PAGE = "PARTITION BY page_id ORDER BY pos"
RUN = f"({W_PAGE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
RUN_BEFORE = f"({W_PAGE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def sql_list(xs) -> str:
    return ", ".join(lit(x) for x in xs)


#: Bytes of HTML that one partition of the page exchange takes. A task holds its pages'
#: tokens in several sorts, each some ten times as large as the HTML.
PAGE_BYTES = 4 << 20
#: Estimates beyond are of inputs whose size Spark does not know.
LARGEST_INPUT = 1 << 50
#: How many times larger than its files a page table may be, for it to be small by their size.
COMPRESSION = 256


def page_partitions(pages: DataFrame) -> int:
    """Partitions of the page exchange, which every later step reuses.

    The stage after the exchange is CPU-bound (regular expressions and windows), so
    its partitions are sized by the HTML that the pages hold, and there are two for
    each core at least: adaptive execution, which sees only the compressed bytes,
    would leave cores idle. The scan's estimate is of compressed bytes too, so unless
    it is far too small to matter the HTML is measured, by one sum over the table.
    Bucketed page tables (``bucketBy(n, "page_id")``) are already distributed and the
    repartition is then free of a shuffle.
    """
    spark = pages.sparkSession
    least = 2 * spark.sparkContext.defaultParallelism
    size = int(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > LARGEST_INPUT:
        return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if size * COMPRESSION > least * PAGE_BYTES:
        size = pages.selectExpr("CAST(coalesce(sum(octet_length(html)), 0) AS BIGINT) AS size").first()["size"]
    return max(least, -(-size // PAGE_BYTES))


def strip_raw_sql(html: str) -> str:
    """Comments and raw-text elements (script, style, ...) removed."""
    return f"regexp_replace({html}, {lit(STRIP_RE)}, '')"


def from_body_sql(s: str) -> str:
    """From ``<body`` on if present (the walk starts at the body)."""
    return let(f"instr(lower({s}), '<body')", lambda at: f"CASE WHEN {at} > 0 THEN substring({s}, {at}) ELSE {s} END")


def parse_attrs_sql(raw: str) -> str:
    """Raw attribute text -> ``array<struct<k, v>>`` (names lower-cased,
    values unquoted but not entity-decoded; '' for bare attributes)."""
    return (f"transform(regexp_extract_all({raw}, {lit(ATTR_PAIR_RE)}, 0), _p -> named_struct("
            f"'k', lower(regexp_extract(_p, {lit(r'^[^\s=]+')}, 0)), "
            f"'v', regexp_replace(regexp_replace(_p, {lit(r'^[^\s=]+\s*=?\s*')}, ''), {lit('''^["']|["']$''')}, '')))")


def attr_sql(name: str, decode: bool = True, attrs: str = "attrs") -> str:
    """First value of attribute ``name`` ('' if bare, NULL if absent)."""
    hit = f"try_element_at(filter({attrs}, _a -> _a.k = {lit(name)}), 1).v"
    return decode_entities_sql(hit) if decode else hit


def has_attr_sql(name: str, attrs: str = "attrs") -> str:
    return f"coalesce(exists({attrs}, _a -> _a.k = {lit(name)}), false)"


def html_tokens(pages: DataFrame, repartition: bool = True, title: str | None = None) -> DataFrame:
    """Ordered token table of the visible document flow.

    Output ``page_id, url, pos, last_pos, kind (open|close|text), tag,
    attrs array<struct<k,v>>, text``. ``last_pos`` is the page's final
    position (the end of unclosed elements). Scripts, styles and comments are
    removed before the pages are exchanged.

    With ``title`` (SQL text over the page's columns) every page has one more
    row at ``pos`` -1, of kind ``page`` and that text, also where it has no tokens.
    """
    # Separate projections so each regex runs once per page.
    n = page_partitions(pages) if repartition else None
    p = pages.selectExpr("page_id", "url", f"{strip_raw_sql('html')} AS _s", *([f"{title} AS _title"] if title else []))
    p = p.selectExpr("page_id", "url", f"{from_body_sql('_s')} AS _b", *(["_title"] if title else []))
    p = p.repartition(n, "page_id") if n else p
    toks = f"regexp_extract_all(_b, {lit(TOKEN_RE)}, 0)"
    if title:
        p = p.selectExpr("page_id", "url", f"concat(array(coalesce(_title, '')), coalesce({toks}, array())) AS _toks")
        t = p.selectExpr("page_id", "url", "size(_toks) - 2 AS last_pos", "posexplode(_toks) AS (_at, tok)") \
             .selectExpr("page_id", "url", "_at - 1 AS pos", "last_pos", "tok")
    else:
        p = p.selectExpr("page_id", "url", f"{toks} AS _toks")
        # posexplode_outer: no inferred filter that would re-run the tokenizer
        # below the shuffle; empty pages yield a NULL token dropped below.
        t = p.selectExpr("page_id", "url", "size(_toks) - 1 AS last_pos", "posexplode_outer(_toks) AS (pos, tok)")
    kind = ("CASE WHEN pos < 0 THEN 'page' WHEN tok RLIKE '^<[a-zA-Z]' THEN 'open' WHEN tok RLIKE '^</[a-zA-Z]' THEN 'close' "
            "WHEN NOT startswith(tok, '<') OR tok = '<' THEN 'text' ELSE 'other' END")
    t = t.selectExpr("page_id", "url", "pos", "last_pos", f"{kind} AS kind", "tok")
    t = t.where("kind != 'other'").selectExpr(
        "page_id", "url", "pos", "last_pos", "kind",
        f"CASE WHEN kind IN ('open', 'close') THEN lower(regexp_extract(tok, {lit(r'^</?([a-zA-Z][^\s/>]*)')}, 1)) END AS tag",
        f"CASE WHEN kind = 'open' THEN {parse_attrs_sql(f'regexp_replace(tok, {lit(r'(?s)^<[a-zA-Z][^\s/>]*|/?>\z')}, {lit('')})')} END AS attrs",
        f"CASE kind WHEN 'text' THEN {decode_entities_sql('tok')} WHEN 'page' THEN tok END AS text")
    return t


def is_hidden_element_sql() -> str:
    style = f"coalesce({attr_sql('style', False)}, '')"
    return (f"({has_attr_sql('hidden')} OR lower(coalesce({attr_sql('aria-hidden', False)}, '')) = 'true' "
            f"OR (tag = 'input' AND lower(coalesce({attr_sql('type', False)}, '')) = 'hidden') "
            f"OR {style} RLIKE {lit(r'(?i)display\s*:\s*none|visibility\s*:\s*(hidden|collapse)')} "
            f"OR tag IN ('meta', 'link'))")


def is_action_element_sql() -> str:
    """``button``, ``role=button``, ``input type=button|submit|reset``."""
    role = f"lower(coalesce({attr_sql('role', False)}, ''))"
    itype = f"lower(coalesce({attr_sql('type', False)}, ''))"
    return f"(tag = 'button' OR {role} = 'button' OR (tag = 'input' AND {itype} IN ('button', 'submit', 'reset')))"


# Element kinds whose coverage ("inside an X") we track for every token.
COVER_KINDS = ["hidden", "heading", "table", "iframe", "a", "nav", "footer",
               "tr", "cell", "caption", "action", "label", "form", "cand"]
# --- fixed values: card candidates (T16) -----------------------------------
ITEM_SIGNATURE = r"(?i)card|product|plan|pricing|package|server|tile|box"
# --- end fixed values -------------------------------------------------------


def is_card_candidate_sql() -> str:
    """``article``, ``li`` or id/class/role matching the card signature; not
    body/main, nor what the walk consumes before it looks for cards."""
    sig = (f"concat_ws(' ', coalesce({attr_sql('id', False)}, ''), coalesce({attr_sql('class', False)}, ''), "
           f"coalesce({attr_sql('role', False)}, ''))")
    return f"(tag NOT IN ('body', 'main', 'table', 'iframe', 'br', {sql_list(HEADING_TAGS)}) AND (tag IN ('article', 'li') OR {sig} RLIKE {lit(ITEM_SIGNATURE)}))"


def _cover_conds() -> dict[str, str]:
    return {
        "hidden": is_hidden_element_sql(),
        "heading": f"tag IN ({sql_list(HEADING_TAGS)})",
        "table": "tag = 'table'",
        "iframe": "tag = 'iframe'",
        "a": "tag = 'a'",
        "nav": "tag = 'nav'",
        "footer": "tag = 'footer'",
        "tr": "tag = 'tr'",
        "cell": "tag IN ('td', 'th')",
        "caption": "tag = 'caption'",
        "action": is_action_element_sql(),
        "label": "tag = 'label'",
        "form": "tag = 'form'",
        "cand": is_card_candidate_sql(),
    }


def element_tokens(tokens: DataFrame, cover: Iterable[str] = COVER_KINDS) -> DataFrame:
    """T1+T2 base: add element extents and coverage counts to each token.
    Only the kinds in ``cover`` (and hidden) are looked for; the others count 0.

    Columns added: ``end`` (open rows: matching close or ``last_pos``),
    ``hidden_self``, ``in_<kind>`` coverage counts and ``<kind>_pos`` (the
    innermost open position of that kind) for ``COVER_KINDS``, ``visible``.
    The kinds an open tag starts are one bit mask, so a close learns them
    from its matching open with a single ``lag``.
    """
    base = tokens.columns
    conds = _cover_conds()
    cover = {"hidden", *cover}
    mask = " | ".join(f"(CASE WHEN {conds[k]} THEN {1 << i} ELSE 0 END)" for i, k in enumerate(COVER_KINDS) if k in cover)
    void = f"tag IN ({sql_list(VOID_TAGS)})"
    step = f"CASE WHEN {void} THEN 0 WHEN kind = 'open' THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END"
    s = f"sum({step}) OVER (PARTITION BY page_id, tag ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    t = tokens.selectExpr(*base,
                          f"CASE WHEN kind = 'open' THEN {mask} ELSE 0 END AS _m",
                          f"kind = 'open' AND {void} AS _void",
                          f"CASE WHEN kind = 'open' THEN {s} WHEN kind = 'close' THEN {s} + 1 END AS _lvl")
    # Same-tag depth: an open pairs with the next close on its level.
    w = "(PARTITION BY page_id, tag, _lvl ORDER BY pos)"
    t = t.selectExpr(
        *base, "_m", "_void", "_lvl",
        f"CASE WHEN _void THEN pos WHEN kind = 'open' THEN CASE WHEN coalesce(lead(kind) OVER {w} = 'close', false) "
        f"THEN lead(pos) OVER {w} ELSE last_pos END END AS end",
        f"CASE WHEN kind = 'close' AND coalesce(lag(kind) OVER {w} = 'open', false) THEN lag(_m) OVER {w} ELSE 0 END AS _cm")
    cols = []
    for i, k in enumerate(COVER_KINDS):
        if k not in cover:
            cols += [f"CAST(0 AS BIGINT) AS in_{k}", f"CAST(NULL AS INT) AS {k}_pos"]
            continue
        om = f"shiftright(_m, {i}) & 1"
        cm = f"CASE WHEN _void THEN {om} ELSE shiftright(_cm, {i}) & 1 END"
        cols.append(f"sum({om}) OVER {RUN} - coalesce(sum({cm}) OVER {RUN_BEFORE}, 0) AS in_{k}")
        if k != "hidden":
            cols.append(f"last(CASE WHEN ({om}) = 1 AND NOT _void THEN pos END, true) OVER {RUN} AS {k}_pos")
    t = t.selectExpr(*base, "_lvl", "end", "(_m & 1) = 1 AS hidden_self", *cols)
    return t.selectExpr("*", "in_hidden = 0 AS visible")


def visible_tokens(pages: DataFrame) -> DataFrame:
    """Element tokens with hidden subtrees removed."""
    return element_tokens(html_tokens(pages)).where("visible")


def text_piece_sql() -> str:
    """Text contributed by a token to the flow: normalized text, img alt/title."""
    alt = f"coalesce({nonempty(attr_sql('alt'))}, {attr_sql('title')}, '')"
    return (f"CASE WHEN kind = 'text' THEN {normalize_text_sql('text')} "
            f"WHEN kind = 'open' AND tag = 'img' THEN {normalize_text_sql(alt)} END")


def join_pieces_sql(pieces: str) -> str:
    """Sorted ``struct(pos, piece)`` list -> normalized text joined by spaces."""
    return normalize_text_sql(
        f"array_join(transform(filter(array_sort({pieces}), _q -> _q.piece != ''), _q -> _q.piece), ' ')")


RANGE_BUCKET = 256


def with_extents(et: DataFrame, counters: dict[str, str]) -> DataFrame:
    """Adds, for every condition of ``counters`` (name -> SQL), the number of tokens
    up to this one that satisfy it (``<name>_n``), and on open rows that number at the
    element's end (``<name>_end``). What an element holds of an ordered list is then
    a slice of it: no range join, however elements nest."""
    run = [f"sum(CAST(coalesce({cond}, false) AS INT)) OVER {RUN} AS {name}_n" for name, cond in counters.items()]
    t = et.selectExpr("*", *run)
    w = "(PARTITION BY page_id, tag, _lvl ORDER BY pos)"
    values = ", ".join(f"'{n}', {n}_n" for n in counters)
    t = t.selectExpr("*", f"lead(named_struct('pos', pos, {values})) OVER {w} AS _next",
                     *(f"max({n}_n) OVER (PARTITION BY page_id) AS _all_{n}" for n in counters))
    ends = [f"CASE WHEN kind = 'open' THEN CASE WHEN end = pos THEN {n}_n WHEN _next.pos = end THEN _next.{n} ELSE _all_{n} END END AS {n}_end" for n in counters]
    return t.selectExpr(*[c for c in t.columns if c != "_next" and not c.startswith("_all_")], *ends)


def span_join(spans: DataFrame, points: DataFrame, start: str = "start", end: str = "end",
              pos: str = "p_pos", page: str = "page_id", p_page: str = "p_page",
              bucket: int = RANGE_BUCKET) -> DataFrame:
    """Points strictly after ``start`` and at or before ``end`` of each span,
    on the same page.

    A range join as an equi-join: each span is exploded into the position
    buckets it covers (``pos div bucket``) and joined on (page, bucket), so
    the work is proportional to the matches plus span length / bucket —
    never all (span, point) pairs of a page.
    """
    s = spans.selectExpr("*", f"explode(sequence(CAST(({start} + 1) DIV {bucket} AS BIGINT), "
                              f"CAST({end} DIV {bucket} AS BIGINT))) AS _bk")
    p = points.selectExpr("*", f"CAST({pos} DIV {bucket} AS BIGINT) AS _pbk")
    from pyspark.sql import functions as F
    cond = ((F.col(page) == F.col(p_page)) & (F.col("_bk") == F.col("_pbk"))
            & (F.col(pos) > F.col(start)) & (F.col(pos) <= F.col(end)))
    return s.join(p, cond).drop("_bk", "_pbk")
