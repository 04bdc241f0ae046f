"""Composed content (T4-T22): flow, sections, links, actions, tables, items.

One pass turns the element-token table into *entries*: every token says
which entries it contributes text to (its paragraph block, innermost
heading, link, action, table cell), one ``groupBy(page_id, kind, key)``
builds the entries, and per-page windows in document order assign
sections, de-duplicate and apply the caps. All of it is keyed by
``page_id`` and reuses the single page repartition done by the tokenizer.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.functions.core import lit, nonempty
from pagefold.functions.text import decode_entities_sql, first_line_sql, normalize_text_sql, truncate_sql
from pagefold.functions.url import resolve_url_sql, same_site_sql
from pagefold.operators.html import (
    BLOCK_TAGS, COVER_KINDS, HEADING_TAGS, RUN, attr_sql, element_tokens, html_tokens,
    join_pieces_sql, sql_list, text_piece_sql, with_extents,
)

if TYPE_CHECKING:
    from pagefold.operators.frames import Shown


@dataclass(frozen=True)
class Limits:
    """Optional limits of a captured document; None leaves everything in.

    Counts and texts are cut for display only, after rows are de-duplicated,
    numbered and counted.
    """

    text: int | None = None             # characters of paragraph text of a page
    links: int | None = None
    link_text: int | None = None        # also the text of actions
    actions: int | None = None
    items: int | None = None
    item_text: int | None = None
    item_title: int | None = None
    item_links: int | None = None
    tables: int | None = None
    table_rows: int | None = None
    cell: int | None = None
    caption: int | None = None
    heading: int | None = None
    markdown_links: int | None = None
    markdown_actions: int | None = None
    markdown: int | None = None


NO_LIMITS = Limits()
# --- fixed values ----------------------------------------------------------
#: The limits of the acquisition tool's own documents.
CAPTURE_LIMITS = Limits(text=200000, links=1000, link_text=240, actions=500, items=300, item_text=1200, item_title=160, item_links=50,
                        tables=100, table_rows=100, cell=1000, caption=300, heading=1000,
                        markdown_links=200, markdown_actions=100, markdown=300000)
ITEM_MIN_TEXT = 20
LINK_KINDS = [  # first match wins, on lower(text + ' ' + absolute_url)
    ("login", r"login|log in|sign in|signin|account"),
    ("signup", r"signup|sign up|register|create account"),
    ("pricing", r"pricing|prices?|kosten|preis"),
    ("docs", r"docs?|documentation|tutorial|guide|manual|api"),
    ("product_detail", r"explore|plan|product|server|cloud|vps|package"),
]
# --- end fixed values -------------------------------------------------------

HEADINGS = sql_list(HEADING_TAGS)


def cut_sql(x: str, n: int | None) -> str:
    return x if n is None else truncate_sql(x, n)


def first_rows(column: str, n: int | None) -> str:
    return "true" if n is None else f"{column} < {int(n)}"

# Entry kinds link operators need: links, plus headings for section numbers.
LINK_KINDS_NEEDED = ("link", "heading")


#: Element kinds that the walk, and each entry kind, looks at.
WALK_COVER = ("heading", "table", "iframe")
ENTRY_COVER = {"link": ("a", "nav", "footer"), "action": ("action",), "item": ("cand",)}


#: What elements hold in order: text pieces, links (of the page itself) and table cells.
EXTENTS = {"piece": "piece != ''", "a": "kind = 'open' AND tag = 'a' AND in_iframe = 0", "cell": "kind = 'open' AND tag IN ('td', 'th')"}


def flow_tokens(pages: DataFrame, kinds=None, extents: bool = False, title: str | None = None) -> DataFrame:
    """Visible element tokens with walk scope, boundaries and block keys; with
    ``kinds``, only what these entry kinds need is looked for. ``extents`` adds
    what elements hold (``EXTENTS``) and the walked table around each token."""
    cover = COVER_KINDS if kinds is None else [*WALK_COVER, *(c for k in kinds for c in ENTRY_COVER.get(k, ()))]
    et = element_tokens(html_tokens(pages, title=title), cover).where("visible")
    # Tokens the content walk reaches: not inside a heading, table or iframe
    # (those are consumed whole), except their opening tag itself.
    opaque = "(in_heading + in_table + in_iframe)"
    self_opaque = f"(kind = 'open' AND (tag IN ({HEADINGS}) OR tag IN ('table', 'iframe')))"
    et = et.selectExpr("*", f"{text_piece_sql()} AS piece",
                       f"{opaque} = 0 OR ({self_opaque} AND {opaque} = 1) AS walked",
                       "CASE WHEN in_heading > 0 THEN heading_pos END AS _hkey")
    if extents:
        et = with_extents(et, EXTENTS)
        around = f"last(CASE WHEN kind = 'open' AND tag = 'table' AND walked THEN named_struct('pos', pos, 'end', end) END, true) OVER {RUN}"
        et = et.selectExpr("*", f"CASE WHEN in_table > 0 THEN {around} END AS _table").selectExpr(
            "*", "CASE WHEN pos <= _table.end THEN _table.pos END AS table_key")
    # A heading is a boundary only when it has text.
    et = et.selectExpr("*", "CASE WHEN _hkey IS NOT NULL THEN max(coalesce(piece != '', false)) "
                            "OVER (PARTITION BY page_id, _hkey) END AS heading_nonblank")
    boundary = (f"walked AND ((tag IN ({sql_list(BLOCK_TAGS)}) AND kind IN ('open', 'close')) "
                f"OR (kind = 'open' AND tag IN ('br', 'table', 'iframe')) "
                f"OR (kind = 'open' AND tag IN ({HEADINGS}) AND coalesce(heading_nonblank, false)))")
    et = et.selectExpr("*", f"{boundary} AS boundary")
    # Outermost enclosing card candidate (a nested candidate's text is part of
    # its parent's, so only top-level candidates can be accepted cards).
    return et.selectExpr("*", f"coalesce(last(CASE WHEN boundary THEN pos END, true) OVER {RUN}, -1) AS block_key",
                         f"CASE WHEN in_cand > 0 THEN last(CASE WHEN kind = 'open' AND in_cand = 1 AND cand_pos = pos "
                         f"THEN pos END, true) OVER {RUN} END AS item_key")


def _memberships_sql(kinds, extents: bool) -> str:
    """Array of (ekind, ekey) a token contributes to."""
    piece = "piece IS NOT NULL"
    plain = "in_heading = 0 AND in_table = 0 AND in_iframe = 0"
    table = ("table_key", f"table_key IS NOT NULL AND ({piece} OR (kind = 'open' AND tag IN ('table', 'tr', 'td', 'th', 'caption')))") if extents else (
        "pos", "kind = 'open' AND tag = 'table' AND walked")
    all_kinds = {
        "paragraph": ("block_key", f"walked AND {plain} AND {piece}"),
        "heading": ("heading_pos", f"in_heading > 0 AND ({piece} OR (kind = 'open' AND tag IN ({HEADINGS})))"),
        "link": ("a_pos", f"in_a > 0 AND ({piece} OR (kind = 'open' AND tag = 'a'))"),
        "action": ("action_pos", f"in_action > 0 AND ({piece} OR (kind = 'open' AND pos = action_pos))"),
        "table": table,
        "item": ("item_key", f"item_key IS NOT NULL AND ({piece} OR (kind = 'open' AND pos = item_key))"),
        "frame": ("pos", "kind = 'open' AND tag = 'iframe' AND walked"),
        "page": ("pos", "kind = 'page'"),
    }
    return "array_compact(array(" + ", ".join(
        f"CASE WHEN {cond} THEN named_struct('ekind', {lit(k)}, 'ekey', CAST({key} AS BIGINT)) END"
        for k, (key, cond) in all_kinds.items() if k in kinds) + "))"


ENTRY_KINDS = ("paragraph", "heading", "link", "action", "table")


def page_entries(pages: DataFrame, kinds: tuple[str, ...] = ENTRY_KINDS, extents: bool = False, title: str | None = None) -> DataFrame:
    """All content entries of every page, one row each, in one aggregate.

    Columns: page_id, url, ekind, ekey, epos, tag, attrs, walked, in_nav,
    in_footer, listed (outside iframe elements), text, item_heading; with
    ``extents`` also ``rows`` and ``caption`` of tables and ``a_n``, ``a_end``,
    the range of the page's links inside a card; with the kind frame also
    ``iframes``, url and attributes of the iframe's tokens.
    """
    ft = flow_tokens(pages, kinds, extents, title)
    ex = ft.selectExpr("*", f"explode({_memberships_sql(kinds, extents)}) AS _m").selectExpr(
        "*", "_m.ekind AS ekind", "_m.ekey AS ekey")
    owner = "kind IN ('open', 'page') AND pos = ekey"
    aggs = [
        "first(url) AS url",
        "min(CASE WHEN piece IS NOT NULL THEN pos END) AS _ppos",
        f"max(CASE WHEN {owner} THEN coalesce(tag, '') END) AS tag",
        f"max_by(attrs, CASE WHEN {owner} THEN 1 END) AS attrs",
        f"max(CASE WHEN {owner} THEN CAST(walked AS INT) END) AS _walked",
        f"max(CASE WHEN {owner} THEN in_nav END) AS in_nav",
        f"max(CASE WHEN {owner} THEN in_footer END) AS in_footer",
        f"max(CASE WHEN {owner} THEN in_iframe = 0 END) AS listed",
        "collect_list(CASE WHEN piece IS NOT NULL THEN named_struct('pos', pos, 'piece', piece) END) AS _pieces",
        "collect_list(CASE WHEN ekind = 'item' AND in_heading > 0 AND piece IS NOT NULL "
        "THEN named_struct('pos', pos, 'piece', piece, 'h', heading_pos) END) AS _hp"]
    extra = []
    if title:
        aggs.append("max(CASE WHEN kind = 'page' THEN text END) AS _title")
    if "frame" in kinds:
        aggs.append("collect_list(CASE WHEN ekind = 'frame' THEN named_struct('url', url, 'attrs', attrs) END) AS iframes")
        extra.append("iframes")
    if extents:
        inside = "ekind = 'table' AND kind = 'open'"
        span = "named_struct('pos', pos, 'n', {0}_n, 'end', {0}_end)"
        aggs += [*(f"max(CASE WHEN {owner} THEN {c} END) AS {c}" for c in ("a_n", "a_end")),
                 f"max(CASE WHEN {owner} THEN piece_n END) AS _p0", f"max(CASE WHEN {owner} THEN cell_n END) AS _c0",
                 f"collect_list(CASE WHEN {inside} AND tag IN ('td', 'th') THEN {span.format('piece')} END) AS _cells",
                 f"collect_list(CASE WHEN {inside} AND tag = 'tr' THEN {span.format('cell')} END) AS _trs",
                 f"min_by({span.format('piece')}, pos) FILTER (WHERE {inside} AND tag = 'caption' AND piece_end > piece_n) AS _cap"]
    ent = ex.groupBy("page_id", "ekind", "ekey").agg(*[F.expr(e) for e in aggs])
    if extents:
        # What a cell holds is a slice of the table's pieces, what a row holds one of its cells.
        text = lambda c: normalize_text_sql(f"array_join(slice(_sorted, CAST({c}.n - _p0 + 1 AS INT), CAST({c}.end - {c}.n AS INT)), ' ')")
        ent = ent.selectExpr("*", "transform(filter(array_sort(CASE WHEN ekind = 'table' THEN _pieces ELSE array() END), _q -> _q.piece != ''), "
                                  "_q -> _q.piece) AS _sorted")
        ent = ent.selectExpr("*", f"transform(array_sort(_cells), _c -> {text('_c')}) AS _texts")
        extra += ["a_n", "a_end", "filter(transform(array_sort(_trs), _r -> filter(slice(_texts, CAST(_r.n - _c0 + 1 AS INT), CAST(_r.end - _r.n AS INT)), "
                                 "_x -> _x != '')), _x -> size(_x) > 0) AS rows",
                 f"CASE WHEN ekind = 'table' THEN CASE WHEN _cap IS NULL THEN '' ELSE {text('_cap')} END END AS caption"]
    text_of = f"CASE WHEN ekind NOT IN ('table', 'frame') THEN {join_pieces_sql('_pieces')} ELSE '' END" if extents else join_pieces_sql("_pieces")
    text_of = f"CASE WHEN ekind = 'page' THEN _title ELSE {text_of} END" if title else text_of
    ent = ent.selectExpr(
        "page_id", "url", "ekind", "ekey",
        "CASE WHEN ekind = 'paragraph' THEN _ppos ELSE ekey END AS epos",
        "tag", "attrs", "coalesce(_walked = 1, ekind = 'paragraph') AS walked",
        "in_nav", "in_footer", "coalesce(listed, true) AS listed", f"{text_of} AS text",
        f"CASE WHEN ekind = 'item' AND size(_hp) > 0 THEN {join_pieces_sql('filter(_hp, _y -> _y.h = array_min(transform(_hp, _z -> _z.h)))')} "
        "END AS item_heading", *extra)
    # Owner rows are required except for paragraphs (keyed by block).
    return ent.where("ekind = 'paragraph' OR tag IS NOT NULL")


IS_HEAD = "(ekind = 'heading' AND walked AND text != '')"


def in_sections(ent: DataFrame, part: str = "page_id", within: str | None = None) -> DataFrame:
    """Entries with their section: ``section_no`` (headings of the page up to
    here) and ``section_heading``. With ``within`` (a part of the page: a frame)
    an entry belongs to the last heading of its own part."""
    w = "(PARTITION BY {0} ORDER BY epos, ekind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    if within is None:
        return ent.selectExpr(
            "*", f"sum(CAST({IS_HEAD} AS INT)) OVER {w.format(part)} AS section_no",
            f"coalesce(last(CASE WHEN {IS_HEAD} THEN text END, true) OVER {w.format(part)}, 'Page') AS section_heading")
    ent = ent.selectExpr("*", f"CASE WHEN {IS_HEAD} THEN named_struct('n', sum(CAST({IS_HEAD} AS INT)) OVER {w.format(part)}, 'h', text) END AS _head")
    ent = ent.selectExpr("*", f"last(_head, true) OVER {w.format(f'{part}, {within}')} AS _section")
    return ent.selectExpr(*[c for c in ent.columns if c != "_head"], "coalesce(_section.n, 0) AS section_no", "coalesce(_section.h, 'Page') AS section_heading")


def content_entries(pages: DataFrame, kinds: tuple[str, ...] = ENTRY_KINDS, extents: bool = False, title: str | None = None,
                    frames: bool | Shown = False) -> DataFrame:
    """`page_entries` with section context (`in_sections`). With ``frames`` the
    entries of same-origin frames take their places inside the parent's (T23); what
    `frames.shown` found is taken as it is."""
    if frames:
        from pagefold.operators.frames import Shown, shown, spliced
        return in_sections(spliced(pages, frames if isinstance(frames, Shown) else shown(pages, kinds, extents, title)), within="instance")
    return in_sections(page_entries(pages, kinds, extents, title))


def flow(entries: DataFrame, limits: Limits = NO_LIMITS) -> DataFrame:
    """T6 core: heading / paragraph / table flow entries, consecutive equal
    paragraphs once. With ``limits.text`` the walk stops where that many
    characters of paragraphs are out."""
    f = entries.where("(ekind = 'heading' AND walked AND text != '') OR (ekind = 'paragraph' AND text != '') "
                      "OR ekind = 'table'")
    w = "(PARTITION BY page_id ORDER BY epos)"
    f = f.selectExpr("*", f"ekind = 'paragraph' AND coalesce(lag(ekind) OVER {w} = 'paragraph' "
                          f"AND lag(text) OVER {w} = text, false) AS _dup").where("NOT _dup").drop("_dup")
    f = f.selectExpr("*", "coalesce(sum(CASE WHEN ekind = 'paragraph' THEN length(text) + 1 ELSE 0 END) "
                          "OVER (PARTITION BY page_id ORDER BY epos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
                          " AS emitted_before")
    if limits.text is None:
        return f
    f = f.where(f"emitted_before < {limits.text}")
    cols = [c if c != "text" else
            f"CASE WHEN ekind = 'paragraph' THEN {truncate_sql('text', f'{limits.text} - emitted_before')} "
            "ELSE text END AS text" for c in f.columns]
    return f.selectExpr(*cols)


FLOW_KINDS_NEEDED = ("paragraph", "heading", "table")


def paragraphs(pages: DataFrame, limits: Limits = NO_LIMITS, frames: bool = False) -> DataFrame:
    """``(page_id, para_no, section_no, text)``."""
    f = flow(content_entries(pages, FLOW_KINDS_NEEDED, frames=frames), limits).where("ekind = 'paragraph'")
    return f.selectExpr("page_id", "CAST(row_number() OVER (PARTITION BY page_id ORDER BY epos) - 1 AS BIGINT) AS para_no",
                        "CAST(section_no AS BIGINT) AS section_no", "text")


def _href_sql() -> str:
    """Trimmed href, NULL when missing, empty, ``#`` or ``javascript:``."""
    from pagefold.functions.core import let
    return let(f"regexp_replace({attr_sql('href')}, {lit(r'^\s+|\s+$')}, '')", lambda r: (
        f"CASE WHEN {r} != '' AND {r} != '#' AND NOT startswith(lower({r}), 'javascript:') THEN {r} END"))


def sections(pages: DataFrame, limits: Limits = NO_LIMITS, frames: bool = False) -> DataFrame:
    """``(page_id, section_no, heading, level)``; the implicit ``Page``
    section (0) exists when a paragraph or a link precedes the first heading."""
    ent = content_entries(pages, ("paragraph", "heading", "link"), frames=frames)
    is_head = "(ekind = 'heading' AND walked AND text != '')"
    pre_para = "(ekind = 'paragraph' AND text != '' AND section_no = 0)"
    pre_link = f"(ekind = 'link' AND walked AND section_no = 0 AND {resolve_url_sql('url', _href_sql())} IS NOT NULL)"
    rows = ent.where(f"{is_head} OR {pre_para} OR {pre_link}").selectExpr(
        "page_id", "CAST(section_no AS BIGINT) AS section_no",
        f"CASE WHEN {is_head} THEN {cut_sql('text', limits.heading)} ELSE 'Page' END AS heading",
        f"CASE WHEN {is_head} THEN CAST(substring(tag, 2, 1) AS INT) ELSE 1 END AS level")
    return rows.dropDuplicates(["page_id", "section_no", "heading", "level"])


def section_text(pages: DataFrame, limits: Limits = NO_LIMITS, frames: bool = False) -> DataFrame:
    """Paragraphs grouped per section, in order, joined by newlines."""
    p = paragraphs(pages, limits, frames)
    return p.groupBy("page_id", "section_no").agg(
        *[F.expr(e) for e in [
            "count(*) AS n_paragraphs",
            "array_join(transform(array_sort(collect_list(named_struct('para_no', para_no, 'text', text))), "
            "_s -> _s.text), '\n') AS text"]])


def link_kind_sql(text: str, abs_url: str, in_footer: str, in_nav: str, same: str) -> str:
    """First matching rule wins; ancestors checked after the patterns."""
    from pagefold.functions.core import let
    return let(f"lower(concat_ws(' ', coalesce({text}, ''), coalesce({abs_url}, '')))", lambda j: (
        "CASE " + " ".join(f"WHEN {j} RLIKE {lit(p)} THEN {lit(n)}" for n, p in LINK_KINDS)
        + f" WHEN {in_footer} > 0 THEN 'footer' WHEN {in_nav} > 0 THEN 'nav' "
          f"WHEN {same} THEN 'unknown' ELSE 'external' END"))


_LINK_TEXT = "CASE WHEN full_text != '' THEN full_text ELSE absolute_url END"


def link_rows(ent: DataFrame, walked: str = "walked") -> DataFrame:
    """Every link occurrence that the walk reaches (before page-level dedupe and cap)."""
    l = ent.where(f"ekind = 'link' AND {walked}").selectExpr("*", f"{_href_sql()} AS url_raw").where("url_raw IS NOT NULL")
    l = l.selectExpr("*", f"{resolve_url_sql('url', 'url_raw')} AS absolute_url").where("absolute_url IS NOT NULL")
    l = l.selectExpr("*", f"{link_text_sql()} AS full_text", f"{same_site_sql('absolute_url', 'url')} AS same_site")
    return l.selectExpr(
        "*", f"{link_kind_sql('full_text', 'absolute_url', 'in_footer', 'in_nav', 'same_site')} AS kind",
        f"{_LINK_TEXT} AS link_text")


def link_text_sql() -> str:
    return normalize_text_sql(f"coalesce({nonempty('text')}, {nonempty(attr_sql('aria-label'))}, {nonempty(attr_sql('title'))}, url_raw)")


def links_from_entries(ent: DataFrame, limits: Limits = NO_LIMITS) -> DataFrame:
    l = link_rows(ent)
    l = l.selectExpr("*", "row_number() OVER (PARTITION BY page_id, absolute_url, link_text ORDER BY epos) AS _rn") \
         .where("_rn = 1")
    l = l.selectExpr("*", "CAST(row_number() OVER (PARTITION BY page_id ORDER BY epos) - 1 AS BIGINT) AS link_no") \
         .where(first_rows("link_no", limits.links))
    return l.selectExpr("page_id", "link_no", f"{cut_sql('link_text', limits.link_text)} AS text", "url_raw AS url",
                        "absolute_url", "same_site", "true AS visible",
                        f"{cut_sql('section_heading', limits.heading)} AS source_section",
                        "CAST(section_no AS BIGINT) AS section_no", "kind")


def links(pages: DataFrame, limits: Limits = NO_LIMITS, frames: bool = False) -> DataFrame:
    """Page links, first of each (absolute_url, text)."""
    return links_from_entries(content_entries(pages, LINK_KINDS_NEEDED, frames=frames), limits)


def section_links(pages: DataFrame, limits: Limits = NO_LIMITS, frames: bool = False) -> DataFrame:
    """Distinct (absolute_url, text) per section, first occurrence."""
    l = link_rows(content_entries(pages, LINK_KINDS_NEEDED, frames=frames))
    l = l.selectExpr("*", "row_number() OVER (PARTITION BY page_id, section_no, absolute_url, link_text "
                          "ORDER BY epos) AS _rn").where("_rn = 1")
    return l.selectExpr("page_id", "CAST(section_no AS BIGINT) AS section_no", "epos",
                        f"{cut_sql('link_text', limits.link_text)} AS text", "absolute_url")


def link_scope_counts(pages: DataFrame, listed: int | None = None) -> DataFrame:
    """Per page: all links, same-site, external, per kind, and how many a
    list of the first ``listed`` links leaves out."""
    l = links(pages)
    aggs = ["count(*) AS n_links", "count_if(same_site) AS n_same_site", "count_if(NOT same_site) AS n_external"]
    for k in [n for n, _ in LINK_KINDS] + ["footer", "nav", "unknown", "external"]:
        aggs.append(f"count_if(kind = {lit(k)}) AS kind_{k}")
    g = l.groupBy("page_id").agg(*[F.expr(a) for a in aggs])
    omitted = "CAST(0 AS BIGINT)" if listed is None else f"greatest(n_links - {int(listed)}, 0)"
    return g.selectExpr("*", f"{omitted} AS n_omitted")


def action_text_sql() -> str:
    return normalize_text_sql(f"coalesce({nonempty('text')}, {nonempty(attr_sql('aria-label'))}, "
                              f"{nonempty(attr_sql('title'))}, {nonempty(attr_sql('value'))}, '')")


def action_kind_sql() -> str:
    return (f"CASE WHEN tag = 'a' THEN 'link' WHEN tag = 'input' THEN coalesce({nonempty('lower(' + attr_sql('type') + ')')}, 'input') "
            f"ELSE coalesce({nonempty(attr_sql('role'))}, tag) END")


def actions(pages: DataFrame, limits: Limits = NO_LIMITS, frames: bool = False) -> DataFrame:
    """Buttons and button-like inputs with text; dedupe (kind, text, url)."""
    a = content_entries(pages, ("action", "heading"), frames=frames).where("ekind = 'action' AND walked")
    a = a.selectExpr("page_id", "epos", f"{action_text_sql()} AS full_text", f"{action_kind_sql()} AS kind",
                     f"CASE WHEN tag = 'a' THEN {resolve_url_sql('url', _href_sql())} END AS absolute_url",
                     "section_heading").where("full_text != ''")
    a = a.selectExpr("*", "row_number() OVER (PARTITION BY page_id, kind, full_text, absolute_url ORDER BY epos) AS _rn") \
         .where("_rn = 1")
    a = a.selectExpr("*", "CAST(row_number() OVER (PARTITION BY page_id ORDER BY epos) - 1 AS BIGINT) AS action_no") \
         .where(first_rows("action_no", limits.actions))
    return a.selectExpr("page_id", "action_no", f"{cut_sql('full_text', limits.link_text)} AS text", "kind", "absolute_url",
                        "true AS visible", f"{cut_sql('section_heading', limits.heading)} AS source_section")


def table_cells(pages: DataFrame, limits: Limits = NO_LIMITS, frames: bool = False) -> DataFrame:
    """``(page_id, table_no, row_no, cells[])`` plus caption: rows of the
    tables that the walk reaches, in the document's order. Every ``tr`` inside is a
    row, every ``td``/``th`` inside a ``tr`` one of its cells with all text inside,
    also of tables nested in it; blank cells and rows without cells are left out."""
    t = content_entries(pages, ("table", "heading"), extents=True, frames=frames).where("ekind = 'table' AND size(rows) > 0")
    t = t.selectExpr("*", "CAST(row_number() OVER (PARTITION BY page_id ORDER BY epos) - 1 AS BIGINT) AS table_no").where(first_rows("table_no", limits.tables))
    cells = "cells" if limits.cell is None else f"transform(cells, _c -> {truncate_sql('_c', limits.cell)})"
    return (t.selectExpr("page_id", "table_no", f"{cut_sql('caption', limits.caption)} AS caption", f"{cut_sql('section_heading', limits.heading)} AS source_section",
                         "posexplode(rows) AS (row_no, cells)").where(first_rows("row_no", limits.table_rows))
            .selectExpr("page_id", "table_no", "CAST(row_no AS BIGINT) AS row_no", f"{cells} AS cells", "caption", "source_section"))


def visible_text(pages: DataFrame, limits: Limits = NO_LIMITS) -> DataFrame:
    """T4: per page, all visible text pieces joined by one space."""
    et = element_tokens(html_tokens(pages)).where("visible AND in_iframe = 0") \
        .selectExpr("page_id", "pos", f"{text_piece_sql()} AS piece")
    g = et.groupBy("page_id").agg(F.expr(
        "collect_list(CASE WHEN piece IS NOT NULL THEN named_struct('pos', pos, 'piece', piece) END) AS _p"))
    text = join_pieces_sql("_p")
    return g.selectExpr("page_id", f"{text if limits.text is None else f'substring({text}, 1, {limits.text})'} AS text")


def page_title_sql(html: str = "html") -> str:
    raw = (f"regexp_extract(regexp_replace({html}, {lit(r'(?s)<!--.*?(?:-->|\z)')}, ''), "
           f"{lit(r'(?is)<title\b[^>]*>(.*?)</title\s*>')}, 1)")
    return normalize_text_sql(decode_entities_sql(raw))


def page_title(pages: DataFrame) -> DataFrame:
    """T5: first ``<title>`` text, entity-decoded and normalized, else ''."""
    return pages.selectExpr("page_id", f"{page_title_sql()} AS title")


def item_title_sql() -> str:
    return f"coalesce({nonempty('item_heading')}, {first_line_sql('text')})"


def card_links_sql(limits: Limits = NO_LIMITS, links: str = "_links", card: str = "_i") -> str:
    """The links inside a card: a slice of the page's links by their order, those in
    headings and tables too; of anchors without a target only what they hold. Every
    anchor counts once, equal ones are not merged."""
    held = f"slice({links}, CAST({card}.a_n + 1 AS INT), CAST({card}.a_end - {card}.a_n AS INT))"
    found = f"filter({held}, _l -> _l.absolute_url IS NOT NULL)"
    found = found if limits.item_links is None else f"slice({found}, 1, {int(limits.item_links)})"
    return (f"transform({found}, _l -> named_struct('text', _l.text, 'url', _l.url, 'absolute_url', _l.absolute_url, 'same_site', _l.same_site, "
            f"'visible', true, 'source_section', {card}.source_section, 'kind', _l.kind))")


ALL_LINKS = ("array_sort(collect_list(CASE WHEN ekind = 'link' AND listed THEN named_struct('epos', epos, 'text', {0}, 'url', url_raw, "
             "'absolute_url', absolute_url, 'same_site', same_site, 'kind', kind) END))")


def items(pages: DataFrame, limits: Limits = NO_LIMITS) -> DataFrame:
    """Outermost card-like elements with >= 20 characters of text, and the
    links inside.

    A nested candidate's text is part of its parent's, so the accepted
    (outermost, >= 20 characters) cards are the top-level candidates that
    reach 20 characters. Each token feeds the entry of its outermost
    enclosing candidate, so a card is one more entry kind, and its links are a
    slice of the page's links: no span join.
    Title = text of the first heading inside, else the first sentence; dedupe
    on (title, text).
    """
    ent = marked(content_entries(pages, ("heading", "item", "link"), extents=True), ("item", "link"))
    card = (f"CASE WHEN {CARD} AND _rn = 1 THEN named_struct('start', epos, 'title', title, 'text', text, 'a_n', a_n, 'a_end', a_end, "
            f"'source_section', {cut_sql('section_heading', limits.heading)}) END")
    page = ent.groupBy("page_id").agg(F.expr(f"array_sort(collect_list({card})) AS _cards"),
                                      F.expr(f"{ALL_LINKS.format(cut_sql('link_text', limits.link_text))} AS _links"))
    it = page.selectExpr("page_id", "_links", "posexplode(_cards) AS (_n, _i)").where(first_rows("_n", limits.items))
    return it.selectExpr("page_id", "CAST(_n AS BIGINT) AS item_no", "'card' AS kind", f"{cut_sql('_i.title', limits.item_title)} AS title",
                         f"{cut_sql('_i.text', limits.item_text)} AS text", "_i.start AS start", "_i.source_section AS source_section",
                         f"{card_links_sql(limits)} AS links")


CARD = f"ekind = 'item' AND walked AND length(text) >= {ITEM_MIN_TEXT}"


def marked(ent: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Entries with what links, actions and cards are told by (url_raw,
    absolute_url, link_text, same_site, kind, title), null for others, and ``_rn``,
    ``_srn``: the how manieth of its equals on the page and in its section."""
    have = [k for k in ("link", "action", "item") if k in kinds]
    target = "ekind = 'link'" + (" OR (ekind = 'action' AND tag = 'a')" if "action" in have else "")
    full = [f"WHEN ekind = 'link' THEN {link_text_sql()}"] + ([f"WHEN ekind = 'action' THEN {action_text_sql()}"] if "action" in have else [])
    m = ent.selectExpr("*", f"CASE WHEN {target} THEN {_href_sql()} END AS url_raw")
    m = m.selectExpr("*", f"CASE WHEN url_raw IS NOT NULL THEN {resolve_url_sql('url', 'url_raw')} END AS absolute_url")
    m = m.selectExpr("*", f"CASE {' '.join(full)} END AS full_text", f"CASE WHEN ekind = 'link' AND absolute_url IS NOT NULL THEN {same_site_sql('absolute_url', 'url')} END AS same_site",
                     *([f"CASE WHEN {CARD} THEN {item_title_sql()} END AS title"] if "item" in have else []))
    link = f"WHEN ekind = 'link' AND absolute_url IS NOT NULL THEN {link_kind_sql('full_text', 'absolute_url', 'in_footer', 'in_nav', 'same_site')}"
    m = m.selectExpr("*", f"CASE {link} {f"WHEN ekind = 'action' THEN {action_kind_sql()}" if 'action' in have else ''} END AS kind",
                     f"CASE WHEN ekind = 'link' THEN {_LINK_TEXT} END AS link_text")
    # Only what can be listed competes; the rest has a key of its own.
    one = ["CASE WHEN ekind = 'link' AND walked AND absolute_url IS NOT NULL THEN named_struct('k', 'link', 'x', absolute_url, 'y', link_text, 'z', '', 'o', 0L)"]
    if "action" in have:
        one.append("WHEN ekind = 'action' AND walked AND full_text != '' THEN named_struct('k', 'action', 'x', kind, 'y', full_text, 'z', coalesce(absolute_url, ''), 'o', 0L)")
    if "item" in have:
        one.append(f"WHEN {CARD} THEN named_struct('k', 'item', 'x', title, 'y', text, 'z', '', 'o', 0L)")
    m = m.selectExpr("*", f"{' '.join(one)} ELSE named_struct('k', ekind, 'x', '', 'y', '', 'z', '', 'o', epos) END AS _key")
    return m.selectExpr("*", "row_number() OVER (PARTITION BY page_id, _key ORDER BY epos) AS _rn",
                        "row_number() OVER (PARTITION BY page_id, _key, section_no ORDER BY epos) AS _srn")


def escape_md_sql(x: str) -> str:
    return f"replace(replace({x}, '[', '\\\\['), ']', '\\\\]')"


def inline_frames(pages: DataFrame, _ft: DataFrame | None = None) -> DataFrame:
    """Iframes of each page with their resolved ``src``; a same-origin
    frame whose URL is a page of the table is inlined (``frame_page_id``)
    under a level-3 ``Frame: <src>`` heading. Found by a self left join on
    the absolute URL; cross-origin frames only warn."""
    ft = (flow_tokens(pages.where("contains(lower(html), '<iframe')"), ()) if _ft is None else _ft).where("kind = 'open' AND tag = 'iframe' AND walked")
    fr = ft.selectExpr("page_id", "pos AS iframe_pos", "url", f"{attr_sql('src')} AS src_raw",
                       f"{resolve_url_sql('url', attr_sql('src'))} AS src")
    origin = "regexp_extract({0}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)"
    fr = fr.selectExpr("*", f"lower({origin.format('src')}) = lower({origin.format('url')}) AS same_origin")
    # Only same-origin frames look for their page; of several captures of one
    # URL the smallest page_id stands for it.
    targets = pages.groupBy(F.col("url").alias("own_src")).agg(F.min("page_id").alias("frame_page_id"))
    fr = fr.selectExpr("*", "CASE WHEN same_origin THEN src END AS own_src")
    own = fr.where("own_src IS NOT NULL").join(targets, "own_src", "left")
    j = own.unionByName(fr.where("own_src IS NULL").selectExpr("*", "CAST(NULL AS BIGINT) AS frame_page_id"), allowMissingColumns=True)
    return j.selectExpr("page_id", "iframe_pos", "src_raw", "src", "coalesce(same_origin, false) AS same_origin", "frame_page_id",
                        "frame_page_id IS NOT NULL AS inlined",
                        "concat('Frame: ', coalesce(src, 'same-origin iframe')) AS frame_heading")


def inline_frame_flow(pages: DataFrame) -> DataFrame:
    """T23 content: for each same-origin iframe whose page is in the table,
    the frame page's flow (headings, paragraphs) placed under a level-3
    ``Frame: <src>`` heading at the iframe's position; the parent's section
    resumes after it. Rows: ``(page_id, iframe_pos, frame_heading, entry_no,
    kind, level, text)`` with ``entry_no`` 0 the frame heading itself."""
    fr = inline_frames(pages).where("inlined")
    child = flow(content_entries(pages, FLOW_KINDS_NEEDED)).where("ekind IN ('heading', 'paragraph')").selectExpr(
        "page_id AS frame_page_id", "epos", "ekind", "CAST(substring(tag, 2, 1) AS INT) AS level", "text")
    body = fr.join(child, "frame_page_id").selectExpr(
        "page_id", "iframe_pos", "frame_heading",
        "CAST(row_number() OVER (PARTITION BY page_id, iframe_pos ORDER BY epos) AS BIGINT) AS entry_no",
        "ekind AS kind", "CASE WHEN ekind = 'heading' THEN level END AS level", "text")
    head = fr.selectExpr("page_id", "iframe_pos", "frame_heading", "CAST(0 AS BIGINT) AS entry_no",
                         "'heading' AS kind", "3 AS level", "frame_heading AS text")
    return head.unionByName(body)


def first_heading(pages: DataFrame, cut: int | None = None) -> DataFrame:
    """The first visible heading with text in each page (headings in
    tables count; hidden ones do not), cut at ``cut`` characters if given."""
    ent = content_entries(pages, ("heading",))
    h = ent.where("ekind = 'heading' AND text != ''")
    return h.groupBy("page_id").agg(F.expr(f"min_by({cut_sql('text', cut)}, epos) AS first_heading"))
