"""Interactive-node observation of pages.

Element order, limits and references come from windows over the element
token table (keyed by page). Node text is a range join of node spans with
text tokens keyed by ``page_id`` (co-partitioned, no shuffle); label names
are an equi-join on ``(page_id, for = id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.functions.core import lit, nonempty
from pagefold.functions.text import squash_ws_sql
from pagefold.functions.url import resolve_url_sql
from pagefold.operators.html import attr_sql, element_tokens, has_attr_sql, html_tokens, join_pieces_sql, span_join, text_piece_sql

# --- fixed values ----------------------------------------------------------
NODE_LIMIT, SCAN_LIMIT = 100, 2000      # the observer's own limits; pass them to apply them
NAME_CUT = 160                          # characters of a name, label or text, likewise
SEMANTIC_TAGS = ["button", "input", "textarea", "select", "summary", "iframe"]
DISABLEABLE = ["button", "input", "select", "textarea", "optgroup", "option", "fieldset"]
FORM_FIELDS = ["button", "fieldset", "input", "object", "output", "select", "textarea"]
DISALLOWED_LABELS = ["login", "captcha", "paywall", "important", "best", "likely"]
# --- end fixed values -------------------------------------------------------


def trimmed_sql(x: str, cut: int | None = None) -> str:
    return squash_ws_sql(x) if cut is None else f"substring({squash_ws_sql(x)}, 1, {int(cut)})"


def role_sql() -> str:
    """Explicit role, else by tag and input type."""
    itype = f"lower(coalesce({attr_sql('type', False)}, 'text'))"
    size = f"coalesce(try_cast({attr_sql('size', False)} AS INT), 0)"
    return (f"coalesce({nonempty(attr_sql('role', False))}, CASE tag WHEN 'a' THEN 'link' WHEN 'button' THEN 'button' "
            f"WHEN 'select' THEN CASE WHEN {has_attr_sql('multiple')} OR {size} > 1 THEN 'listbox' ELSE 'combobox' END "
            f"WHEN 'textarea' THEN 'textbox' WHEN 'iframe' THEN 'iframe' "
            f"WHEN 'input' THEN CASE {itype} WHEN 'checkbox' THEN 'checkbox' WHEN 'radio' THEN 'radio' "
            f"WHEN 'submit' THEN 'button' WHEN 'button' THEN 'button' ELSE 'textbox' END ELSE tag END)")


def actions_sql() -> str:
    """Mechanical actions by tag/type/role."""
    itype = f"lower(coalesce({attr_sql('type', False)}, ''))"
    return (f"CASE WHEN tag = 'input' AND {itype} IN ('checkbox', 'radio') THEN array('check', 'focus') "
            f"WHEN tag IN ('input', 'textarea') THEN array('fill', 'focus') WHEN tag = 'select' THEN array('select', 'focus') "
            f"WHEN tag IN ('a', 'button') OR {attr_sql('role', False)} = 'button' THEN array('click', 'focus') "
            f"WHEN {has_attr_sql('contenteditable')} THEN array('fill', 'focus') ELSE array('click') END")


def semantic_sql() -> str:
    return (f"((tag = 'a' AND {has_attr_sql('href')}) OR tag IN ({', '.join(lit(t) for t in SEMANTIC_TAGS)}) "
            f"OR {has_attr_sql('role')} OR {has_attr_sql('tabindex')} OR {attr_sql('contenteditable', False)} = 'true')")


def _elements(pages: DataFrame, node_limit: int | None, scan_limit: int | None) -> DataFrame:
    et = element_tokens(html_tokens(pages))
    el = et.where("kind = 'open' AND tag NOT IN ('body', 'html')")
    el = el.selectExpr("*", f"{semantic_sql()} AS semantic",
                       "row_number() OVER (PARTITION BY page_id ORDER BY pos) AS e_no")
    el = el.selectExpr("*", "sum(CAST(semantic AS INT)) OVER (PARTITION BY page_id ORDER BY pos "
                            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sem_no")
    limits = " AND ".join(["semantic", *(f"{c} <= {int(n)}" for c, n in (("e_no", scan_limit), ("sem_no", node_limit)) if n is not None)])
    return el.selectExpr("*", f"{limits} AS emitted")


def observation_nodes(pages: DataFrame, node_limit: int | None = None, scan_limit: int | None = None, name_cut: int | None = None) -> DataFrame:
    """One row per emitted node: ref ``obs-<n>``, role, name, text,
    visible, enabled, actions, href, src, input type, checked, value flag,
    ``#id`` selector hint and its uniqueness.  ``name_cut`` keeps as many
    characters of names and texts."""
    el = _elements(pages, node_limit, scan_limit)
    ids = el.where(f"{attr_sql('id', False)} IS NOT NULL").groupBy("page_id", F.expr(f"{attr_sql('id', False)} AS _id")) \
            .agg(F.count("*").alias("_n_id"))
    nodes = el.where("emitted")
    # Node text: visible text pieces inside the node span (range join keyed by page).
    pieces = element_tokens(html_tokens(pages)).where("visible").selectExpr(
        "page_id AS p_page", "pos AS p_pos", f"{text_piece_sql()} AS piece").where("piece IS NOT NULL")
    spans = nodes.selectExpr("page_id", "pos", "end")
    txt = span_join(spans, pieces, start="pos").groupBy("page_id", "pos").agg(
        F.expr("collect_list(named_struct('pos', p_pos, 'piece', piece)) AS _p"))
    txt = txt.selectExpr("page_id", "pos", f"{join_pieces_sql('_p')} AS _text")
    labels = label_texts(pages, name_cut)
    # The value of a select: its first selected option, else (drop-downs only) its first.
    options = el.where("tag = 'option'").selectExpr(
        "page_id AS p_page", "pos AS p_pos", f"{has_attr_sql('selected')} AS chosen",
        # an option without a value attribute counts by its text, which static options have
        f"CASE WHEN {has_attr_sql('value')} THEN {attr_sql('value')} ELSE 'text' END AS value")
    selects = nodes.where("tag = 'select'").selectExpr(
        "page_id", "pos", "end", f"{has_attr_sql('multiple')} OR coalesce(try_cast({attr_sql('size', False)} AS INT), 0) > 1 AS listed")
    chosen = span_join(selects, options, start="pos").groupBy("page_id", "pos").agg(F.expr(
        "coalesce(min_by(value, CASE WHEN chosen THEN p_pos END), CASE WHEN NOT any_value(listed) THEN min_by(value, p_pos) END) AS _selected"))
    n = nodes.join(txt, ["page_id", "pos"], "left").join(chosen, ["page_id", "pos"], "left")
    n = n.selectExpr("*", f"{attr_sql('id', False)} AS _id")
    n = n.join(labels, ["page_id", "_id"], "left").join(ids, ["page_id", "_id"], "left")
    itype = f"lower(coalesce({attr_sql('type', False)}, 'text'))"
    name = (f"coalesce({nonempty(trimmed_sql(attr_sql('aria-label'), name_cut))}, {nonempty(trimmed_sql(attr_sql('alt'), name_cut))}, "
            f"{nonempty(trimmed_sql(attr_sql('title'), name_cut))}, {nonempty('_label')}, {nonempty(trimmed_sql('_text', name_cut))})")
    disabled = (f"(tag IN ({', '.join(lit(t) for t in DISABLEABLE)}) AND {has_attr_sql('disabled')}) "
                f"OR coalesce({attr_sql('aria-disabled', False)} = 'true', false)")
    value_flag = (f"CASE WHEN tag = 'input' THEN CASE WHEN {itype} IN ('checkbox', 'radio') THEN coalesce({attr_sql('value')}, 'on') != '' "
                  f"ELSE coalesce({attr_sql('value')}, '') != '' END "
                  f"WHEN tag IN ('button', 'option') THEN coalesce({attr_sql('value')}, '') != '' "
                  f"WHEN tag = 'textarea' THEN coalesce(_text, '') != '' WHEN tag = 'select' THEN coalesce(_selected, '') != '' "
                  f"WHEN tag = 'li' THEN coalesce(try_cast({attr_sql('value', False)} AS INT), 0) != 0 END")
    return n.selectExpr(
        "page_id", "CAST(sem_no - 1 AS BIGINT) AS node_no", "concat('obs-', CAST(sem_no - 1 AS STRING)) AS ref",
        "'main' AS frame_id", "tag", f"{role_sql()} AS role", f"{name} AS name", f"{nonempty(trimmed_sql('_text', name_cut))} AS text",
        "visible", f"NOT ({disabled}) AS enabled", f"{actions_sql()} AS actions",
        f"CASE WHEN tag IN ('a', 'area') AND {has_attr_sql('href')} THEN {resolve_url_sql('url', attr_sql('href'))} END AS href",
        f"CASE WHEN tag IN ('iframe', 'img', 'script', 'embed', 'source', 'audio', 'video', 'track', 'input') AND {has_attr_sql('src')} "
        f"THEN {resolve_url_sql('url', attr_sql('src'))} END AS src",
        f"CASE WHEN tag = 'input' THEN {itype} END AS input_type",
        f"CASE WHEN tag = 'input' AND {itype} IN ('checkbox', 'radio') THEN {has_attr_sql('checked')} END AS checked",
        f"CASE WHEN {value_flag} THEN true END AS value_redacted",
        "CASE WHEN _id IS NOT NULL AND _id != '' THEN concat('#', _id) END AS selector_hint",
        "CASE WHEN _id IS NOT NULL AND _id != '' THEN _n_id = 1 END AS selector_hint_unique",
        "pos", "end")


def label_texts(pages: DataFrame, name_cut: int | None = None) -> DataFrame:
    """First label text per (page, for) — N4's ``label[for=id]``."""
    et = element_tokens(html_tokens(pages))
    lab = et.where("in_label > 0").selectExpr(
        "page_id", "label_pos", "pos", "kind", "tag", f"CASE WHEN kind = 'open' AND pos = label_pos THEN {attr_sql('for', False)} END AS _for",
        f"CASE WHEN visible THEN {text_piece_sql()} END AS piece")
    g = lab.groupBy("page_id", "label_pos").agg(
        F.expr("max(_for) AS _id"),
        F.expr("collect_list(CASE WHEN piece IS NOT NULL THEN named_struct('pos', pos, 'piece', piece) END) AS _p"))
    g = g.where("_id IS NOT NULL").selectExpr("page_id", "_id", "label_pos", f"{trimmed_sql(join_pieces_sql('_p'), name_cut)} AS _label")
    return g.groupBy("page_id", "_id").agg(F.expr("min_by(_label, label_pos) AS _label"))


def observation_forms(pages: DataFrame, node_limit: int | None = None, scan_limit: int | None = None) -> DataFrame:
    """``form-<n>`` per form in document order, its action (absolute;
    the page URL when absent) and the refs of its emitted fields."""
    el = _elements(pages, node_limit, scan_limit)
    forms = el.where("tag = 'form'").selectExpr(
        "page_id", "pos AS f_pos", "end AS f_end", f"{attr_sql('id', False)} AS f_id",
        "CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS BIGINT) AS form_no",
        f"coalesce({resolve_url_sql('url', nonempty(attr_sql('action')))}, url) AS action")
    fields = el.where(f"emitted AND tag IN ({', '.join(lit(t) for t in FORM_FIELDS)}) AND NOT "
                      f"(tag = 'input' AND lower(coalesce({attr_sql('type', False)}, '')) = 'image')") \
               .selectExpr("page_id AS n_page", "pos AS n_pos", "sem_no", f"{nonempty(attr_sql('form', False))} AS owner")
    # A field belongs to the form it names (the first of that id), else to the one around it.
    inside = span_join(forms, fields.where("owner IS NULL"), start="f_pos", end="f_end", pos="n_pos", p_page="n_page")
    first = forms.where("f_id IS NOT NULL").groupBy("page_id", "f_id").agg(F.min("form_no").alias("form_no"))
    named = fields.where("owner IS NOT NULL").join(first, (F.col("n_page") == F.col("page_id")) & (F.col("owner") == F.col("f_id")))
    own = inside.select("page_id", "form_no", "sem_no").unionByName(named.select("page_id", "form_no", "sem_no"))
    j = forms.join(own, ["page_id", "form_no"], "left")
    g = j.groupBy("page_id", "form_no", "action").agg(F.expr(
        "transform(array_sort(collect_list(CASE WHEN sem_no IS NOT NULL THEN sem_no END)), _s -> concat('obs-', CAST(_s - 1 AS STRING))) AS field_refs"))
    return g.selectExpr("page_id", "form_no", "concat('form-', CAST(form_no AS STRING)) AS ref", "action", "field_refs")


def observation_frames(pages: DataFrame, node_limit: int | None = None, scan_limit: int | None = None) -> DataFrame:
    """``main`` plus ``iframe-<n>`` for every iframe that the walk emits
    (it stops at the first limit)."""
    el = _elements(pages, node_limit, scan_limit).where("tag = 'iframe' AND emitted")
    ifr = el.selectExpr("page_id", "CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS frame_no",
                        f"coalesce({resolve_url_sql('url', attr_sql('src'))}, '') AS url")
    ifr = ifr.selectExpr("page_id", "frame_no", "concat('iframe-', CAST(frame_no - 1 AS STRING)) AS frame_id", "url")
    main = pages.selectExpr("page_id", "CAST(0 AS BIGINT) AS frame_no", "'main' AS frame_id", "url")
    return main.unionByName(ifr)


def observation_truncated(pages: DataFrame, node_limit: int, scan_limit: int) -> DataFrame:
    """The first limit hit per page (node or scan), with counts; pages
    within both limits have no row."""
    el = _elements(pages, node_limit, scan_limit)
    g = el.groupBy("page_id").agg(
        F.expr("count(*) AS n_elements"),
        F.expr(f"min(CASE WHEN semantic AND sem_no = {node_limit + 1} THEN e_no END) AS _node_hit"),
        F.expr(f"count_if(semantic AND e_no <= {scan_limit}) AS _sem_in_scan"))
    node = f"_node_hit IS NOT NULL AND _node_hit <= {scan_limit}"
    return g.where(f"({node}) OR n_elements > {scan_limit}").selectExpr(
        "page_id", f"CASE WHEN {node} THEN 'node_limit_exceeded' ELSE 'scan_limit_exceeded' END AS reason",
        f"{node_limit} AS node_limit", f"{scan_limit} AS scan_limit",
        f"CAST(CASE WHEN {node} THEN _node_hit ELSE {scan_limit} END AS BIGINT) AS scanned",
        f"CAST(CASE WHEN {node} THEN {node_limit} ELSE least(_sem_in_scan, {node_limit}) END AS BIGINT) AS emitted_nodes")


def observation_empty(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pages with zero emitted nodes get ``observation_empty``."""
    return pages.select("page_id").join(nodes.select("page_id").distinct(), "page_id", "left_anti") \
                .selectExpr("page_id", "'observation' AS artifact", "'observation_empty' AS code")


def label_audit(nodes: DataFrame, fields=("role", "name", "text", "selector_hint")) -> DataFrame:
    """Nodes whose string fields contain an interpretive word."""
    words = ", ".join(lit(w) for w in DISALLOWED_LABELS)
    conds = " OR ".join(f"exists(array({words}), _w -> contains(lower(coalesce({f}, '')), _w))" for f in fields)
    return nodes.where(conds)
