"""Queries for whole documents (T20, T21) and frames in frames."""

from __future__ import annotations

from pagefold.operators import content as C
from pagefold.operators import documents as DOC
from pagefold.plans import duck as D
from pagefold.plans.adapters import nested_pages_select, table_pages_html
from pagefold.plans.q_content import _ACT_KIND, _ACT_TEXT, CARDS_D, PAGE_TITLE_D, TABLES_D
from pagefold.plans.registry import register
from pagefold.plans.sqlutil import select_items

_LF = "chr(10)"


def _md(x: str) -> str:
    return f"replace(replace({x}, '[', '\\['), ']', '\\]')"


def _json(parts: str, order: str) -> str:
    return f"coalesce(CAST(to_json(list({parts} ORDER BY {order})) AS VARCHAR), '[]')"


_LINK = "'text': link_text, 'url': url_raw, 'absolute_url': absolute_url, 'same_site': same_site, 'visible': true, 'source_section': {0}, 'kind': kind"


def document_sql(pages: str, frames: bool) -> str:
    """The arrays of every page's document as JSON text (needs ``pages``)."""
    return f"""{D.tokens_cte(pages)}, {D.flow_cte(pages if frames else None)}, {TABLES_D}, {CARDS_D},
_l0 AS ({D.link_rows_sql()}),
_l1 AS (SELECT *, row_number() OVER (PARTITION BY page_id, absolute_url, link_text ORDER BY epos) AS _rn,
        row_number() OVER (PARTITION BY page_id, section_no, absolute_url, link_text ORDER BY epos) AS _srn FROM _l0),
_links AS (SELECT page_id, {_json('{' + _LINK.format('section_heading') + '}', 'epos')} AS links FROM _l1 WHERE _rn = 1 GROUP BY page_id),
_sh AS (SELECT DISTINCT page_id, section_no, heading, level FROM (
  SELECT page_id, section_no, text AS heading, CAST(substr(tag, 2, 1) AS INTEGER) AS level FROM ent WHERE ekind = 'heading' AND walked AND text != ''
  UNION ALL SELECT page_id, section_no, 'Page', 1 FROM ent WHERE ekind = 'paragraph' AND text != '' AND section_no = 0
  UNION ALL SELECT page_id, section_no, 'Page', 1 FROM _l0 WHERE section_no = 0)),
_sp AS (SELECT page_id, section_no, list(text ORDER BY epos) AS texts FROM flow WHERE ekind = 'paragraph' GROUP BY ALL),
_sl AS (SELECT page_id, section_no, list({{'text': link_text, 'absolute_url': absolute_url}} ORDER BY epos) AS links FROM _l1 WHERE _srn = 1 GROUP BY ALL),
_secs AS (SELECT page_id, {_json("{'heading': heading, 'level': level, 'text': coalesce(texts, []), 'links': coalesce(links, [])}", 'section_no')} AS sections
          FROM _sh LEFT JOIN _sp USING (page_id, section_no) LEFT JOIN _sl USING (page_id, section_no) GROUP BY page_id),
_a0 AS (SELECT page_id, epos, section_heading, {_ACT_TEXT} AS full_text, {_ACT_KIND} AS kind, url, tag,
        CASE WHEN tag = 'a' THEN {D.href_sql()} END AS href FROM ent WHERE ekind = 'action' AND walked),
_a1 AS ({D.resolve_stage_sql("SELECT * FROM _a0 WHERE full_text != ''", 'url', 'href', 'absolute_url')}),
_a2 AS (SELECT *, row_number() OVER (PARTITION BY page_id, kind, full_text, absolute_url ORDER BY epos) AS _rn FROM _a1),
_acts AS (SELECT page_id, {_json("{'text': full_text, 'kind': kind, 'visible': true, 'source_section': section_heading, 'absolute_url': absolute_url}", 'epos')} AS actions
          FROM _a2 WHERE _rn = 1 GROUP BY page_id),
_tr AS (SELECT page_id, table_pos, list(cells ORDER BY row_no) AS rows FROM _b GROUP BY ALL),
_tabs AS (SELECT e.page_id, {_json("{'caption': coalesce(caption, ''), 'rows': rows, 'source_section': e.section_heading}", 'e.epos')} AS tables
          FROM ent e JOIN _tr ON _tr.page_id = e.src AND _tr.table_pos = e.ekey LEFT JOIN _cap ON _cap.page_id = e.src AND _cap.table_pos = e.ekey
          WHERE e.ekind = 'table' GROUP BY e.page_id),
_ck AS (SELECT page_id, item_no, list({{{_LINK.format('source_section')}}} ORDER BY ekey) AS links FROM _cl GROUP BY ALL),
_its AS (SELECT page_id, {_json("{'kind': 'card', 'title': title, 'text': [text], 'links': coalesce(links, []), 'source_section': source_section}", 'item_no')} AS items
         FROM _cn LEFT JOIN _ck USING (page_id, item_no) GROUP BY page_id),
_doc AS (SELECT p.page_id, coalesce(sections, '[]') AS sections, coalesce(items, '[]') AS items, coalesce(tables, '[]') AS tables, coalesce(links, '[]') AS links,
         coalesce(actions, '[]') AS actions FROM {pages} p LEFT JOIN _secs USING (page_id) LEFT JOIN _its USING (page_id) LEFT JOIN _tabs USING (page_id)
         LEFT JOIN _links USING (page_id) LEFT JOIN _acts USING (page_id))"""


def _as_json(doc, *more):
    text = lambda c: f"to_json({c}, map('ignoreNullFields', 'false')) AS {c}"
    return doc.selectExpr("page_id", *(text(c) for c in ("sections", "items", "tables", "links", "actions")), *more)


@register("t20_content_json", f"""WITH tp AS (SELECT page_id, url, {table_pages_html()} AS html FROM pages), {document_sql('tp', False)},
_ti AS (SELECT page_id, {PAGE_TITLE_D} AS title FROM tp)
SELECT _doc.*, title, CASE WHEN page_id IN (SELECT page_id FROM flow) THEN '' ELSE 'content_empty' END AS warnings FROM _doc JOIN _ti USING (page_id)""")
def t20(t):
    """Composed content document per page, its arrays as JSON text."""
    doc = DOC.content_json(t("pages").selectExpr("page_id", "url", f"{table_pages_html()} AS html"))
    return _as_json(doc, "page.title AS title", "array_join(transform(warnings, _w -> _w.code), ' ') AS warnings")


def _nested_pages(t):
    return t("pages").selectExpr(*select_items(nested_pages_select("STRING")))


NESTED_D = f"np AS (SELECT {nested_pages_select('VARCHAR')} FROM pages)"
_NOT_ENTERED = ("SELECT i.root AS page_id, i.url, list_append(i.path, f.pos) AS path, f.raw_src, f.same FROM inst i JOIN _fr f ON f.page_id = i.src "
                "WHERE f.child IS NULL OR list_contains(i.chain, f.child)")
#: Iframes of every page shown that are not entered, in page order.
NESTED_WARNINGS_D = f"""_nw AS ({D.resolve_stage_sql(_NOT_ENTERED, 'url', 'raw_src', 'src')}),
_nl AS (SELECT page_id, list(CASE WHEN same THEN 'iframe_unavailable: iframe content unavailable: ' || coalesce(src, '(no src)')
  ELSE 'iframe_cross_origin: cross-origin iframe not traversed: ' || coalesce(src, '') END ORDER BY path) AS warnings FROM _nw GROUP BY page_id)"""


@register("t20_content_json_frames", f"""WITH RECURSIVE {NESTED_D}, {document_sql('np', True)}, {NESTED_WARNINGS_D}
SELECT _doc.*, coalesce(array_to_string(warnings, chr(10)), '') AS warnings FROM _doc LEFT JOIN _nl USING (page_id)""")
def t20f(t):
    """Documents of nested_pages with their same-origin frames in place (frames in frames, a cycle)."""
    return _as_json(DOC.content_json(_nested_pages(t), frames=True), "array_join(transform(warnings, _w -> concat(_w.code, ': ', _w.detail)), '\\n') AS warnings")


@register("t6_paragraphs_frames", f"""WITH RECURSIVE {NESTED_D}, {D.tokens_cte('np')}, {D.flow_cte('np')}
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY epos) - 1 AS BIGINT) AS para_no, section_no, text FROM flow WHERE ekind = 'paragraph'""")
def t6f(t):
    """Paragraphs of nested_pages: a frame's are numbered inside its parent's, whose section resumes after it."""
    return C.paragraphs(_nested_pages(t), frames=True)


@register("t21_markdown_frames", f"""WITH RECURSIVE {NESTED_D}, {D.tokens_cte('np')}, {D.flow_cte('np')}, {TABLES_D},
_w AS (SELECT page_id, table_pos, max(len(cells)) AS width FROM _b GROUP BY ALL),
_pr AS (SELECT _b.page_id, _b.table_pos, row_no, '| ' || array_to_string(list_transform(list_resize(cells, width, ''), lambda c: replace(c, '|', '\\|')), ' | ') || ' |' AS line, width
        FROM _b JOIN _w USING (page_id, table_pos)),
_tm AS (SELECT page_id, table_pos, string_agg(CASE WHEN row_no = 0 THEN line || {_LF} || '| ' || array_to_string(list_resize(['---'], width, '---'), ' | ') || ' |' ELSE line END, {_LF} ORDER BY row_no) AS md
        FROM _pr GROUP BY ALL),
_tc AS (SELECT _tm.page_id, _tm.table_pos, CASE WHEN coalesce(caption, '') != '' THEN '**' || {_md('caption')} || '**' || {_LF} || {_LF} ELSE '' END || md AS md FROM _tm LEFT JOIN _cap USING (page_id, table_pos)),
_fl AS (SELECT f.page_id, f.epos, CASE ekind WHEN 'heading' THEN repeat('#', least(6, greatest(2, CAST(substr(tag, 2, 1) AS INTEGER) + 1))) || ' ' || {_md('text')}
        WHEN 'paragraph' THEN text ELSE md END AS line FROM flow f LEFT JOIN _tc ON _tc.page_id = f.src AND _tc.table_pos = f.ekey AND f.ekind = 'table')
SELECT page_id, string_agg(line || {_LF}, {_LF} ORDER BY epos) AS flow_md FROM _fl WHERE line IS NOT NULL GROUP BY page_id""")
def t21n(t):
    """Markdown 'Visible Content' of nested_pages with their frames in place."""
    return DOC.flow_markdown(_nested_pages(t), frames=True)
