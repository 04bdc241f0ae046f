"""Whole documents of a page: warnings (T22), JSON (T20) and markdown.

Everything a document holds is an entry of its page, so a document is one
aggregate: entries are marked (`content.marked`), gathered by section and then by
page with a filtered ordered collection for each kind, and projected.  Entries,
windows and both aggregates are keyed by page_id and follow the single exchange of
the pages; only the iframes, which need the table of URLs, are joined at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.functions.text import normalize_text_sql, truncate_sql
from pagefold.operators.content import (
    ALL_LINKS, CARD, ENTRY_KINDS, FLOW_KINDS_NEEDED, IS_HEAD, Limits, NO_LIMITS, card_links_sql, content_entries, cut_sql, marked, page_title_sql,
)
from pagefold.operators.frames import Shown, frame_warnings, shown


def escape_md_sql(x: str) -> str:
    return f"replace(replace({x}, '[', '\\\\['), ']', '\\\\]')"


def _first(array: str, n: int | None) -> str:
    return array if n is None else f"slice({array}, 1, {int(n)})"


def in_flow(ent: DataFrame, limits: Limits = NO_LIMITS) -> DataFrame:
    """Entries with ``_flow``: whether they are part of the flow (headings,
    paragraphs and tables, consecutive equal paragraphs once, up to ``limits.text``
    characters of paragraphs), ``_shown`` (a paragraph's text, cut there) and
    ``_out`` (characters of paragraphs up to here)."""
    e = ent.selectExpr("*", f"{IS_HEAD} OR (ekind = 'paragraph' AND text != '') OR ekind = 'table' AS _is_flow")
    w = "(PARTITION BY page_id, _is_flow ORDER BY epos, ekind)"
    e = e.selectExpr("*", f"_is_flow AND NOT (ekind = 'paragraph' AND coalesce(lag(ekind) OVER {w} = 'paragraph' AND lag(text) OVER {w} = text, false)) AS _kept")
    size = "CASE WHEN _kept AND ekind = 'paragraph' THEN length(text) + 1 ELSE 0 END"
    e = e.selectExpr("*", f"sum({size}) OVER (PARTITION BY page_id ORDER BY epos, ekind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _out")
    if limits.text is None:
        return e.selectExpr("*", "_kept AS _flow", "text AS _shown")
    before = f"(_out - {size})"
    return e.selectExpr("*", f"_kept AND {before} < {limits.text} AS _flow",
                        f"CASE WHEN ekind = 'paragraph' THEN {truncate_sql('text', f'{limits.text} - {before}')} ELSE text END AS _shown")


def table_md_sql(rows: str = "rows", caption: str = "caption") -> str:
    """A padded pipe table below its caption."""
    width = f"array_max(transform({rows}, _r -> size(_r)))"
    esc = f"replace({normalize_text_sql('_c')}, '|', '\\\\|')"
    padded = f"transform({rows}, _r -> transform(concat(_r, array_repeat('', {width} - size(_r))), _c -> {esc}))"
    md = ("concat(array(concat('| ', array_join(_p[0], ' | '), ' |'), concat('| ', array_join(transform(_p[0], _h -> '---'), ' | '), ' |')), "
          "transform(slice(_p, 2, size(_p)), _r -> concat('| ', array_join(_r, ' | '), ' |')))")
    lines = f"element_at(transform(array({padded}), _p -> {md}), 1)"
    return (f"array_join(concat(CASE WHEN {caption} != '' THEN array(concat('**', {escape_md_sql(caption)}, '**'), '') ELSE array() END, {lines}), '\\n')")


def _collect(name: str, when: str, *fields: str) -> F.Column:
    return F.expr(f"collect_list(CASE WHEN {when} THEN named_struct('o', epos, {', '.join(fields)}) END) AS {name}")


def _cut_tables(limits: Limits) -> str:
    rows = "rows" if limits.table_rows is None else f"slice(rows, 1, {int(limits.table_rows)})"
    return rows if limits.cell is None else f"transform({rows}, _r -> transform(_r, _c -> {truncate_sql('_c', limits.cell)}))"


#: Entry kinds of a document.
DOCUMENT_KINDS = (*ENTRY_KINDS, "item", "page")


def shown_documents(pages: DataFrame, frames: bool) -> bool | Shown:
    """With ``frames``, what documents show, found once for their parts and warnings."""
    return shown(pages, DOCUMENT_KINDS, True, page_title_sql()) if frames else False


def page_parts(pages: DataFrame, limits: Limits = NO_LIMITS, frames: bool | Shown = False) -> DataFrame:
    """One row a page: page_id, url, title, and in page order sections, flow
    (markdown lines), links, actions, items, tables, has_flow, written
    (characters of paragraphs)."""
    ent = content_entries(pages, DOCUMENT_KINDS, extents=True, title=page_title_sql(), frames=frames)
    # The title's row has no section of its own.
    m = in_flow(marked(ent, ("link", "action", "item")).selectExpr("*", *([] if frames else ["'' AS instance"])), limits)
    source = cut_sql("section_heading", limits.heading)
    heading = cut_sql("text", limits.heading)
    link_text = cut_sql("link_text", limits.link_text)
    link = "ekind = 'link' AND walked AND absolute_url IS NOT NULL"
    level = "CAST(substring(tag, 2, 1) AS INT)"
    m = m.selectExpr("*", f"{_cut_tables(limits)} AS _rows", f"{cut_sql('caption', limits.caption)} AS _caption")
    line = (f"CASE ekind WHEN 'heading' THEN concat(repeat('#', least(6, greatest(2, {level} + 1))), ' ', {escape_md_sql('text')}, '\\n') "
            f"WHEN 'paragraph' THEN concat(_shown, '\\n') WHEN 'table' THEN concat({table_md_sql('_rows', '_caption')}, '\\n') END")
    by_section = m.groupBy("page_id", "section_no").agg(
        F.expr("max(CASE WHEN ekind = 'page' THEN named_struct('url', url, 'title', text) END) AS _page"),
        F.expr(f"max(CASE WHEN {IS_HEAD} THEN named_struct('heading', {heading}, 'level', {level}) END) AS _head"),
        _collect("_paras", "_flow AND ekind = 'paragraph'", "'t', _shown"),
        F.expr("bool_or(ekind = 'paragraph' AND text != '') AS _said"), F.expr(f"bool_or({link}) AS _linked"),
        _collect("_slinks", f"{link} AND _srn = 1", f"'text', {link_text}", "'absolute_url', absolute_url"),
        _collect("_lines", "_flow AND (ekind <> 'table' OR size(rows) > 0)", f"'l', {line}"),
        F.expr("bool_or(_flow) AS _flowing"), F.expr("max(CASE WHEN _flow AND ekind = 'paragraph' THEN _out END) AS _written"),
        _collect("_links", f"{link} AND _rn = 1", f"'text', {link_text}", "'url', url_raw", "'absolute_url', absolute_url", "'same_site', same_site", "'visible', true",
                 f"'source_section', {source}", "'kind', kind"),
        F.expr(ALL_LINKS.format(link_text).replace("named_struct('epos'", "named_struct('instance', instance, 'epos'") + " AS _anchors"),
        _collect("_actions", "ekind = 'action' AND walked AND full_text != '' AND _rn = 1", f"'text', {cut_sql('full_text', limits.link_text)}", "'kind', kind", "'visible', true",
                 f"'source_section', {source}", "'absolute_url', absolute_url"),
        _collect("_cards", f"{CARD} AND _rn = 1", "'title', title", "'text', text", "'a_n', a_n", "'a_end', a_end", "'instance', instance", f"'source_section', {source}"),
        _collect("_tables", "ekind = 'table' AND size(rows) > 0", "'caption', _caption", "'rows', _rows", f"'source_section', {source}"),
    )
    said = ("transform(array_sort(_paras), _x -> _x.t)", "transform(array_sort(_slinks), _x -> named_struct('text', _x.text, 'absolute_url', _x.absolute_url))")
    section = (f"CASE WHEN _head IS NOT NULL OR _said OR _linked THEN named_struct('o', section_no, 'heading', coalesce(_head.heading, 'Page'), "
               f"'level', coalesce(_head.level, 1), 'text', {said[0]}, 'links', {said[1]}) END")
    page = by_section.groupBy("page_id").agg(
        F.expr("max(_page) AS _page"), F.expr(f"array_sort(collect_list({section})) AS sections"),
        *(F.expr(f"array_sort(flatten(collect_list({c}))) AS {c}") for c in ("_lines", "_links", "_actions", "_cards", "_tables")),
        # cards slice the anchors of their own instance, in order
        F.expr("array_sort(flatten(collect_list(_anchors))) AS _anchors"),
        F.expr("bool_or(_flowing) AS has_flow"), F.expr("max(_written) AS written"))
    drop = lambda c, names: f"transform({c}, _x -> named_struct({', '.join(f"'{n}', _x.{n}" for n in names)}))"
    anchors = "filter(_anchors, _a -> _a.instance = _i.instance)" if frames else "_anchors"
    card = (f"named_struct('kind', 'card', 'title', {cut_sql('_i.title', limits.item_title)}, 'text', array({cut_sql('_i.text', limits.item_text)}), "
            f"'links', {card_links_sql(limits, anchors)}, 'source_section', _i.source_section)")
    return page.selectExpr(
        "page_id", "_page.url AS url", "_page.title AS title",
        drop("sections", ("heading", "level", "text", "links")) + " AS sections",
        "transform(_lines, _x -> _x.l) AS flow",
        _first(drop("_links", ("text", "url", "absolute_url", "same_site", "visible", "source_section", "kind")), limits.links) + " AS links",
        _first(drop("_actions", ("text", "kind", "visible", "source_section", "absolute_url")), limits.actions) + " AS actions",
        f"transform({_first('_cards', limits.items)}, _i -> {card}) AS items",
        _first(drop("_tables", ("caption", "rows", "source_section")), limits.tables) + " AS tables",
        "coalesce(has_flow, false) AS has_flow", "coalesce(written, 0) AS written")


def _with_warnings(pages: DataFrame, parts: DataFrame, limits: Limits, frames: bool | Shown) -> DataFrame:
    unseen = frame_warnings(pages, frames).groupBy("page_id").agg(F.expr(
        "transform(array_sort(collect_list(named_struct('o', path, 'code', code, 'detail', detail))), _x -> named_struct('code', _x.code, 'detail', _x.detail)) AS _w"))
    own = ["CASE WHEN NOT has_flow THEN named_struct('code', 'content_empty', 'detail', 'no visible composed content captured') END"]
    if limits.text is not None:
        own.append(f"CASE WHEN written >= {limits.text} THEN named_struct('code', 'content_truncated', 'detail', 'content text capped at {limits.text} characters') END")
    return parts.join(unseen, "page_id", "left").selectExpr(
        *parts.columns, f"concat(coalesce(_w, array()), array_compact(array({', '.join(own)}))) AS warnings")


def content_warnings(pages: DataFrame, limits: Limits = NO_LIMITS, frames: bool = False) -> DataFrame:
    """``(page_id, warning_no, code, detail)``: ``iframe_cross_origin`` /
    ``iframe_unavailable`` per iframe in page order (a same-origin frame whose
    page is not in the table is unavailable), then ``content_empty`` (no flow)
    and ``content_truncated`` (``limits.text`` reached)."""
    frames = shown(pages, (*FLOW_KINDS_NEEDED, "page"), title="''") if frames else False
    ent = in_flow(content_entries(pages, (*FLOW_KINDS_NEEDED, "page"), title="''", frames=frames), limits)
    parts = ent.groupBy("page_id").agg(F.expr("bool_or(_flow) AS has_flow"), F.expr("coalesce(max(CASE WHEN _flow AND ekind = 'paragraph' THEN _out END), 0) AS written"))
    return _with_warnings(pages, parts, limits, frames).selectExpr("page_id", "posexplode(warnings) AS (_n, w)").selectExpr(
        "page_id", "CAST(_n AS BIGINT) AS warning_no", "w.code AS code", "w.detail AS detail")


def content_json(pages: DataFrame, limits: Limits = NO_LIMITS, frames: bool = False) -> DataFrame:
    """One nested document per page: schema_version, page, sections (with
    their paragraphs and links), items (with theirs), tables, links, actions,
    warnings."""
    frames = shown_documents(pages, frames)
    doc = _with_warnings(pages, page_parts(pages, limits, frames), limits, frames)
    return doc.selectExpr(
        "page_id", "1 AS schema_version",
        "named_struct('url', url, 'final_url', url, 'title', title, 'ready_state', 'complete', 'capture', 'browser_composed_content') AS page",
        "sections", "items", "tables", "links", "actions", "warnings")


_LF = "'\\n'"


def flow_markdown(pages: DataFrame, limits: Limits = NO_LIMITS, frames: bool = False) -> DataFrame:
    """The "Visible Content" block of T21 per page with flow: headings at level+1
    (clamped 2..6, brackets escaped), paragraphs, pipe tables; one blank
    line after each entry."""
    return page_parts(pages, limits, frames).where("has_flow").selectExpr("page_id", f"array_join(flow, {_LF}) AS flow_md")


def content_markdown(pages: DataFrame, limits: Limits = NO_LIMITS, frames: bool = False) -> DataFrame:
    """The markdown document per page: header block, visible content
    (headings at level+1 clamped to 2..6, paragraphs, pipe tables), links,
    actions, warnings; ``[``/``]`` escaped, 3+ newlines collapsed."""
    frames = shown_documents(pages, frames)
    doc = _with_warnings(pages, page_parts(pages, limits, frames), limits, frames)

    def block(title: str, rows: str, line: str, most: int | None, what: str) -> str:
        listed = f"array_join(transform({_first(rows, most)}, _x -> {line}), {_LF})"
        more = "''" if most is None else (f"CASE WHEN size({rows}) > {int(most)} THEN concat('\\n- … ', CAST(size({rows}) - {int(most)} AS STRING), "
                                          f"' more {what} omitted') ELSE '' END")
        return f"CASE WHEN size({rows}) > 0 THEN concat('## {title}\\n\\n', {listed}, {more}, '\\n') END"

    scope = "CASE WHEN _x.same_site THEN 'same-site' ELSE 'external' END"
    meta = (f"array_join(filter(array(_x.kind, CASE WHEN _x.kind = {scope} THEN '' ELSE {scope} END, "
            "CASE WHEN _x.source_section != '' THEN concat('source: ', _x.source_section) ELSE '' END), _m -> _m != ''), ', ')")
    link = (f"concat('- [', {escape_md_sql("CASE WHEN _x.text != '' THEN _x.text ELSE _x.absolute_url END")}, '](', _x.absolute_url, ')', "
            f"CASE WHEN {meta} != '' THEN concat(' — ', {meta}) ELSE '' END)")
    action = f"concat('- ', {escape_md_sql('_x.text')}, ' — ', _x.kind, CASE WHEN _x.source_section != '' THEN concat(', source: ', _x.source_section) ELSE '' END)"
    head = escape_md_sql("CASE WHEN title != '' THEN title WHEN url != '' THEN url ELSE 'Page Content' END")
    header = (f"concat('# ', {head}, '\\n\\n', "
              "'URL: ', url, '\\n', 'Final URL: ', url, '\\n', CASE WHEN title != '' THEN concat('Title: ', title, '\\n') ELSE '' END, "
              "'Ready State: complete\\n\\n## Visible Content\\n\\n')")
    body = f"CASE WHEN has_flow THEN array_join(flow, {_LF}) ELSE '_No visible composed content captured._' END"
    md = (f"concat_ws({_LF}, concat({header}, {body}), {block('Links', 'links', link, limits.markdown_links, 'links')}, "
          f"{block('Actions', 'actions', action, limits.markdown_actions, 'actions')}, "
          f"{block('Warnings', 'warnings', "concat('- ', _x.code, ': ', _x.detail)", None, '')})")
    md = f"regexp_replace({md}, '\\n{{3,}}', '\\n\\n')"
    return doc.selectExpr("page_id", f"{md if limits.markdown is None else f'substring({md}, 1, {limits.markdown})'} AS markdown")
