"""Queries for the page -> composed content operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.functions.text import decode_entities_sql, first_line_sql, normalize_text_sql
from pagefold.functions.url import resolve_url_sql, same_site_sql
from pagefold.operators import content as C
from pagefold.operators import html as H
from pagefold.plans import duck as D
from pagefold.plans.adapters import href_forms_values, link_pages_html, table_pages_html
from pagefold.plans.registry import register


def _link_pages(t):
    return t("pages").selectExpr("page_id", "url", f"{link_pages_html()} AS html")


LINK_PAGES_CTE = f"lp AS (SELECT page_id, url, {link_pages_html()} AS html FROM pages)"


@register("t1_html_tokens", f"""WITH {D.tokens_cte()}
SELECT page_id, CAST(pos AS BIGINT) AS pos, kind, tag, text FROM tok""")
def t1(t):
    """Token table of every page (document order, from <body> on)."""
    return H.html_tokens(t("pages")).selectExpr("page_id", "CAST(pos AS BIGINT) AS pos", "kind", "tag", "text")


@register("t2_hidden_filter", f"""WITH {LINK_PAGES_CTE}, {D.tokens_cte('lp')}
SELECT page_id, CAST(pos AS BIGINT) AS pos, text FROM et WHERE kind = 'text' AND in_hidden = 0""")
def t2(t):
    """Visible text tokens of link_pages (hidden subtrees removed)."""
    return H.visible_tokens(_link_pages(t)).where("kind = 'text'") \
        .selectExpr("page_id", "CAST(pos AS BIGINT) AS pos", "text")


@register("t3_normalize_text", f"""
SELECT doc_id, md5({D.norm(D.decode('text'))}) AS text_md5, length({D.norm(D.decode('text'))}) AS n_chars FROM documents""")
def t3(t):
    """Entity decoding + whitespace/currency normalization of whole documents."""
    n = normalize_text_sql(decode_entities_sql("text"))
    return t("documents").selectExpr("doc_id", f"{n} AS _n").selectExpr(
        "doc_id", "md5(_n) AS text_md5", "CAST(length(_n) AS BIGINT) AS n_chars")


@register("t4_visible_text", f"""WITH {D.tokens_cte()},
_v AS (SELECT page_id, pos, {D.text_piece()} AS piece FROM et WHERE in_hidden = 0 AND in_iframe = 0)
SELECT page_id, {D.join_pieces("coalesce(list({'pos': pos, 'piece': piece}) FILTER (WHERE piece IS NOT NULL), [])")} AS text
FROM _v GROUP BY page_id""")
def t4(t):
    """Visible text per page (text nodes joined by one space)."""
    return C.visible_text(t("pages"))


PAGE_TITLE_D = D.norm(D.decode("regexp_extract(regexp_replace(html, '(?s)<!--.*?(?:-->|\\z)', '', 'g'), '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)"))


@register("t5_page_title", f"SELECT page_id, {PAGE_TITLE_D} AS title FROM pages")
def t5(t):
    """Document title per page."""
    return C.page_title(t("pages"))


@register("t6_paragraphs", f"""WITH {D.tokens_cte()}, {D.flow_cte()}
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY epos) - 1 AS BIGINT) AS para_no,
       section_no, text FROM flow WHERE ekind = 'paragraph'""")
def t6(t):
    """Paragraph flow: block boundaries, consecutive-duplicate drop, text cap."""
    return C.paragraphs(t("pages"))


@register("t7_sections", f"""WITH {D.tokens_cte()}, {D.flow_cte()},
_l AS ({D.link_rows_sql()})
SELECT DISTINCT page_id, section_no, heading, level FROM (
  SELECT page_id, section_no, text AS heading, CAST(substr(tag, 2, 1) AS INTEGER) AS level
    FROM ent WHERE ekind = 'heading' AND walked AND text != ''
  UNION ALL SELECT page_id, section_no, 'Page', 1 FROM ent WHERE ekind = 'paragraph' AND text != '' AND section_no = 0
  UNION ALL SELECT page_id, section_no, 'Page', 1 FROM _l WHERE section_no = 0)""")
def t7(t):
    """Sections opened by non-empty headings, plus the implicit Page section."""
    return C.sections(t("pages"))


@register("t8_section_text", f"""WITH {D.tokens_cte()}, {D.flow_cte()},
_p AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY epos) - 1 AS BIGINT) AS para_no, section_no, text
       FROM flow WHERE ekind = 'paragraph')
SELECT page_id, section_no, count(*) AS n_paragraphs,
       array_to_string(list(text ORDER BY para_no), chr(10)) AS text FROM _p GROUP BY page_id, section_no""")
def t8(t):
    """Paragraph text per section, in order."""
    return C.section_text(t("pages"))


@register("t9_links", f"""WITH {LINK_PAGES_CTE}, {D.tokens_cte('lp')}, {D.flow_cte()}
{D.links_sql()}""")
def t9(t):
    """Links of link_pages: skip rules, dedupe on (absolute_url, text), kinds."""
    return C.links(_link_pages(t))


@register("t10_resolve_url", f"""WITH h(href, form_no) AS (VALUES {href_forms_values()}),
_x AS (SELECT p.page_id, h.form_no, p.url, h.href FROM pages p, h)
SELECT page_id, CAST(form_no AS BIGINT) AS form_no, absolute_url FROM ({D.resolve_stage_sql('SELECT * FROM _x', 'url', 'href', 'absolute_url')})""")
def t10(t):
    """Fixed relative-reference forms resolved against every page URL."""
    from pagefold.plans.adapters import HREF_FORMS
    from pagefold.functions.core import lit
    forms = ", ".join(f"named_struct('href', {lit(h)}, 'form_no', {i})" for i, h in enumerate(HREF_FORMS))
    x = t("pages").selectExpr("page_id", "url", f"inline(array({forms}))")
    return x.selectExpr("page_id", "CAST(form_no AS BIGINT) AS form_no", f"{resolve_url_sql('url', 'href')} AS absolute_url")


@register("t11_same_site", f"""WITH {LINK_PAGES_CTE}, {D.tokens_cte('lp')}, {D.flow_cte()},
_l AS ({D.links_sql()})
SELECT page_id, link_no, absolute_url, same_site, {D.registrable(D.host('absolute_url'))} AS site FROM _l""")
def t11(t):
    """Same-site flag and registrable-ish site of each link target."""
    from pagefold.functions.url import registrable_ish_sql, url_host_sql
    return C.links(_link_pages(t)).selectExpr(
        "page_id", "link_no", "absolute_url", "same_site", f"{registrable_ish_sql(url_host_sql('absolute_url'))} AS site")


@register("t12_link_kind_counts", f"""WITH {LINK_PAGES_CTE}, {D.tokens_cte('lp')}, {D.flow_cte()},
_l AS ({D.links_sql()})
SELECT kind, same_site, count(*) AS n_links FROM _l GROUP BY kind, same_site""")
def t12(t):
    """Link kinds (first rule wins) counted over all link_pages."""
    return C.links(_link_pages(t)).groupBy("kind", "same_site").agg(F.count("*").alias("n_links"))


@register("t13_section_links", f"""WITH {LINK_PAGES_CTE}, {D.tokens_cte('lp')}, {D.flow_cte()},
_l AS ({D.link_rows_sql()}),
_r AS (SELECT *, row_number() OVER (PARTITION BY page_id, section_no, absolute_url, link_text ORDER BY epos) AS _rn FROM _l)
SELECT page_id, section_no, epos, link_text AS text, absolute_url FROM _r WHERE _rn = 1""")
def t13(t):
    """Distinct links per section (a repeat in a later section reappears)."""
    return C.section_links(_link_pages(t))


@register("t14_link_scope_counts", f"""WITH {LINK_PAGES_CTE}, {D.tokens_cte('lp')}, {D.flow_cte()},
_l AS ({D.links_sql()})
SELECT page_id, count(*) AS n_links, CAST(count_if(same_site) AS BIGINT) AS n_same_site,
  CAST(count_if(NOT same_site) AS BIGINT) AS n_external,
  {", ".join(f"CAST(count_if(kind = '{k}') AS BIGINT) AS kind_{k}" for k in ["login", "signup", "pricing", "docs", "product_detail", "footer", "nav", "unknown", "external"])},
  greatest(count(*) - 200, 0) AS n_omitted
FROM _l GROUP BY page_id""")
def t14(t):
    """Per-page link counts by scope and kind, and links omitted past 200."""
    return C.link_scope_counts(_link_pages(t), listed=200)


#: Cards of every page shown, and the links inside them by element extents (needs ``ft``, ``ent``, ``inst``).
CARDS_D = f"""_c AS (SELECT page_id AS c_page, pos AS start, "end" FROM ft WHERE kind = 'open' AND walked AND tag NOT IN ('body', 'main', 'table', 'iframe', 'br', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6') AND
       (tag IN ('article', 'li') OR regexp_matches(concat_ws(' ', coalesce({D.attr('id', False)}, ''), coalesce({D.attr('class', False)}, ''),
        coalesce({D.attr('role', False)}, '')), '(?i)card|product|plan|pricing|package|server|tile|box'))),
_j AS (SELECT * FROM _c JOIN (SELECT page_id, pos, piece, in_heading, heading_pos FROM ft WHERE piece IS NOT NULL) p
       ON p.page_id = _c.c_page AND p.pos > _c.start AND p.pos <= _c."end"),
_a AS (SELECT page_id, start, "end", list({{'pos': pos, 'piece': piece}}) AS _all, min(CASE WHEN in_heading > 0 THEN heading_pos END) AS hpos
       FROM _j GROUP BY page_id, start, "end"),
_h AS (SELECT page_id, start, heading_pos AS hpos, list({{'pos': pos, 'piece': piece}}) AS _h FROM _j WHERE in_heading > 0
       GROUP BY page_id, start, heading_pos),
_cb AS (SELECT _a.page_id, _a.start, _a."end", {D.join_pieces('_all')} AS text,
       CASE WHEN _h._h IS NOT NULL THEN {D.join_pieces('_h._h')} END AS htext
       FROM _a LEFT JOIN _h ON _a.page_id = _h.page_id AND _a.start = _h.start AND _a.hpos = _h.hpos),
_co AS (SELECT *, max("end") OVER (PARTITION BY page_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _me
       FROM _cb WHERE length(text) >= 20),
_ct AS (SELECT *, CASE WHEN nullif(htext, '') IS NOT NULL THEN htext ELSE
         (CASE WHEN regexp_extract({D.norm('text')}, '^(.*?[.!?]) ', 1) != '' THEN regexp_extract({D.norm('text')}, '^(.*?[.!?]) ', 1)
               WHEN {D.norm('text')} != '' THEN {D.norm('text')} ELSE text END) END AS _title0 FROM _co WHERE _me IS NULL OR _me < start),
_cu AS (SELECT *, CASE WHEN nullif(htext, '') IS NOT NULL THEN htext ELSE {D.trunc('_title0', 120)} END AS title FROM _ct),
_ci AS (SELECT i.root AS page_id, array_to_string(i.path, '/') AS inst, list_append(i.path, CAST(c.start AS BIGINT)) AS path, c.start, c."end", c.title, c.text
        FROM _cu c JOIN inst i ON i.src = c.page_id),
_cd AS (SELECT *, row_number() OVER (PARTITION BY page_id, title, text ORDER BY path) AS _rn FROM _ci),
_cn AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY path) - 1 AS item_no,
        coalesce((SELECT arg_max(h.text, h.ekey) FROM ent h WHERE h.page_id = _cd.page_id AND h.inst = _cd.inst AND h.ekind = 'heading' AND h.walked
                  AND h.text != '' AND h.ekey < _cd.start), 'Page') AS source_section FROM _cd WHERE _rn = 1),
_al AS ({D.link_rows_sql('true')}),
_cl AS (SELECT n.page_id, n.item_no, n.source_section, l.ekey, l.link_text, l.url_raw, l.absolute_url, l.same_site, l.kind FROM _cn n
        JOIN _al l ON l.page_id = n.page_id AND l.inst = n.inst AND l.ekey > n.start AND l.ekey <= n."end")"""


@register("t16_items", f"""WITH tp AS (SELECT page_id, url, {table_pages_html()} AS html FROM pages), {D.tokens_cte('tp')}, {D.flow_cte()}, {CARDS_D},
_cs AS (SELECT page_id, item_no, string_agg(link_text || ' ' || absolute_url || ' ' || kind || ' ' || same_site, chr(10) ORDER BY ekey) AS links FROM _cl GROUP BY ALL)
SELECT page_id, CAST(item_no AS BIGINT) AS item_no, 'card' AS kind, title, text, CAST(start AS BIGINT) AS start, source_section, coalesce(links, '') AS links
FROM _cn LEFT JOIN _cs USING (page_id, item_no)""")
def t16(t):
    """Card items (article / li / card-like), outermost accepted only, with the links inside."""
    return C.items(_table_pages(t)).selectExpr(
        "page_id", "item_no", "kind", "title", "text", "CAST(start AS BIGINT) AS start", "source_section",
        "array_join(transform(links, _l -> concat_ws(' ', _l.text, _l.absolute_url, _l.kind, CAST(_l.same_site AS STRING))), '\\n') AS links")


@register("t17_first_line", f"""
SELECT doc_id, CASE WHEN _h != '' THEN {D.trunc('_h', 120)} WHEN _n != '' THEN {D.trunc('_n', 120)} ELSE {D.trunc('text', 120)} END AS first_line
FROM (SELECT doc_id, text, {D.norm('text')} AS _n, regexp_extract({D.norm('text')}, '^(.*?[.!?]) ', 1) AS _h FROM documents)""")
def t17(t):
    """First sentence (<= 120 characters) of every document."""
    return t("documents").selectExpr("doc_id", f"{first_line_sql('text')} AS first_line")


@register("t24_page_fingerprint", f"""WITH {D.tokens_cte()},
_n AS (SELECT page_id, count(*) FILTER (WHERE kind = 'open') AS n_elements FROM tok GROUP BY page_id),
_p AS (SELECT page_id, sha256(html) AS html_sha256, length(html) AS html_len FROM pages)
SELECT _p.page_id, html_sha256, html_len, coalesce(n_elements, 0) AS n_elements,
       count(*) OVER (PARTITION BY html_sha256) AS n_same_html FROM _p LEFT JOIN _n USING (page_id)""")
def t24(t):
    """Change fingerprint per page (sha-256, lengths, element count) and exact-duplicate group sizes."""
    p = t("pages")
    n = H.html_tokens(p).where("kind = 'open'").groupBy("page_id").agg(F.count("*").alias("n_elements"))
    fp = p.selectExpr("page_id", "sha2(html, 256) AS html_sha256", "CAST(length(html) AS BIGINT) AS html_len")
    out = fp.join(n, "page_id", "left").selectExpr("page_id", "html_sha256", "html_len",
                                                     "coalesce(n_elements, 0) AS n_elements")
    dup = out.groupBy("html_sha256").agg(F.count("*").alias("n_same_html"))
    return out.join(dup, "html_sha256").select("page_id", "html_sha256", "html_len", "n_elements", "n_same_html")


def _action_pages(t):
    from pagefold.plans.adapters import action_pages_html
    return t("pages").selectExpr("page_id", "url", f"{action_pages_html()} AS html")


def _action_pages_cte():
    from pagefold.plans.adapters import action_pages_html
    return f"ap AS (SELECT page_id, url, {action_pages_html()} AS html FROM pages)"


_ACT_TEXT = D.norm(f"coalesce(nullif(text, ''), nullif({D.attr('aria-label')}, ''), nullif({D.attr('title')}, ''), "
                   f"nullif({D.attr('value')}, ''), '')")
_ACT_KIND = (f"CASE WHEN tag = 'a' THEN 'link' WHEN tag = 'input' THEN coalesce(nullif(lower({D.attr('type')}), ''), 'input') "
             f"ELSE coalesce(nullif({D.attr('role')}, ''), tag) END")


@register("t15_actions", f"""WITH {_action_pages_cte()}, {D.tokens_cte('ap')}, {D.flow_cte()},
_a0 AS (SELECT page_id, epos, section_heading, {_ACT_TEXT} AS full_text, {_ACT_KIND} AS kind, url, tag,
        CASE WHEN tag = 'a' THEN {D.href_sql()} END AS href FROM ent WHERE ekind = 'action' AND walked),
_a1 AS ({D.resolve_stage_sql("SELECT * FROM _a0 WHERE full_text != ''", 'url', 'href', 'absolute_url')}),
_a2 AS (SELECT *, full_text AS text FROM _a1),
_a3 AS (SELECT *, row_number() OVER (PARTITION BY page_id, kind, text, absolute_url ORDER BY epos) AS _rn FROM _a2),
_a4 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY epos) - 1 AS action_no FROM _a3 WHERE _rn = 1)
SELECT page_id, CAST(action_no AS BIGINT) AS action_no, text, kind, absolute_url, true AS visible,
       section_heading AS source_section FROM _a4""")
def t15(t):
    """Buttons, role=button and button-like inputs of action_pages; dedupe (kind, text, url)."""
    return C.actions(_action_pages(t))


def _table_pages(t):
    return t("pages").selectExpr("page_id", "url", f"{table_pages_html()} AS html")


#: Rows of the tables that the walk reaches, by element extents (needs ``ft``).
TABLES_D = f"""_o AS (SELECT page_id, pos, "end", tag, walked FROM ft WHERE kind = 'open' AND in_table > 0 AND tag IN ('table', 'tr', 'td', 'th', 'caption')),
_t AS (SELECT o.page_id, o.pos, o.tag, {D.join_pieces("list({'pos': p.pos, 'piece': p.piece})")} AS text
       FROM _o o JOIN ft p ON p.page_id = o.page_id AND p.pos BETWEEN o.pos AND o."end" WHERE p.piece IS NOT NULL GROUP BY ALL),
_r AS (SELECT r.page_id, r.pos, list(c.text ORDER BY c.pos) AS cells
       FROM _o r JOIN _t c ON c.page_id = r.page_id AND c.pos BETWEEN r.pos AND r."end"
       WHERE r.tag = 'tr' AND c.tag IN ('td', 'th') AND c.text != '' GROUP BY r.page_id, r.pos),
_b AS (SELECT b.page_id, b.pos AS table_pos, r.cells, row_number() OVER (PARTITION BY b.page_id, b.pos ORDER BY r.pos) - 1 AS row_no,
       dense_rank() OVER (PARTITION BY b.page_id ORDER BY b.pos) - 1 AS table_no
       FROM _o b JOIN _r r ON r.page_id = b.page_id AND r.pos BETWEEN b.pos AND b."end" WHERE b.tag = 'table' AND b.walked),
_cap AS (SELECT b.page_id, b.pos AS table_pos, arg_min(c.text, c.pos) AS caption FROM _o b JOIN _t c ON c.page_id = b.page_id
         AND c.pos BETWEEN b.pos AND b."end" WHERE b.tag = 'table' AND b.walked AND c.tag = 'caption' AND c.text != '' GROUP BY ALL)"""


@register("t19_tables", f"""WITH tp AS (SELECT page_id, url, {table_pages_html()} AS html FROM pages), {D.tokens_cte('tp')}, {D.flow_cte()}, {TABLES_D},
_th AS (SELECT page_id, epos, section_heading FROM ent WHERE ekind = 'table')
SELECT _b.page_id, CAST(table_no AS BIGINT) AS table_no, CAST(row_no AS BIGINT) AS row_no, array_to_string(cells, ' | ') AS cells, coalesce(caption, '') AS caption,
       section_heading AS source_section
FROM _b LEFT JOIN _cap USING (page_id, table_pos) JOIN _th ON _th.page_id = _b.page_id AND _th.epos = table_pos""")
def t19(t):
    """Table rows of table_pages (cells joined by ' | '), nested tables included."""
    return C.table_cells(_table_pages(t)).selectExpr("page_id", "table_no", "row_no", "array_join(cells, ' | ') AS cells",
                                                     "caption", "source_section")


@register("t18_first_heading", f"""WITH {LINK_PAGES_CTE}, {D.tokens_cte('lp')}, {D.flow_cte()}
SELECT page_id, arg_min(text, epos) AS first_heading FROM ent
WHERE ekind = 'heading' AND text != '' GROUP BY page_id""")
def t18(t):
    """First visible non-empty heading of every link_pages page."""
    return C.first_heading(_link_pages(t))
