"""Queries for the observation operators (N2-N8, N10, N11) over form_pages.

form_pages puts one of three hand-written blocks after ``<body>`` by
``page_id % 3``. The oracles state what the block must yield as plain rows, and
take the nodes of the page itself (its links, numbered behind the block's) from
the element table of the page without the block.
"""

from __future__ import annotations

from pagefold.operators import observation as N
from pagefold.plans.q_observation import OWN_LINKS_D
from pagefold.plans.registry import register

# --- fixed values: the blocks and what they must yield -----------------------
BLOCKS = [
    '<form id="f1" action="https://forms.example.org/go"><label for="who">Your <b>name</b></label><input id="who" value="Ada">'
    '<input type="checkbox" id="ok" checked><input type="submit" id="send" aria-label="Send it" disabled>'
    '<select id="day"><option value="">any</option><option value="2" selected>Tue</option></select></form>'
    '<textarea id="far" form="f1">x</textarea><li id="tip" role="option">Tip</li>',
    '<div id="menu" role="button" tabindex="0">Open menu</div><select id="many" multiple><option value="1">a</option></select>'
    '<iframe id="map" src="https://maps.example.org/m" title="Map"></iframe><form><input id="blank"></form>',
    '<button id="dup">One</button><button id="dup">Login here</button><p contenteditable="true" id="note">Note</p>'
    '<summary id="more" aria-disabled="true">More</summary>',
]
# block, selector, role, actions, name, enabled, checked, value_redacted, unique
NODES = [
    (0, "#who", "textbox", "fill,focus", "Your name", True, None, True, True),
    (0, "#ok", "checkbox", "check,focus", None, True, True, True, True),
    (0, "#send", "button", "fill,focus", "Send it", False, None, None, True),
    (0, "#day", "combobox", "select,focus", "any Tue", True, None, True, True),
    (0, "#far", "textbox", "fill,focus", "x", True, None, True, True),
    (0, "#tip", "option", "click", "Tip", True, None, None, True),
    (1, "#menu", "button", "click,focus", "Open menu", True, None, None, True),
    (1, "#many", "listbox", "select,focus", "a", True, None, None, True),
    (1, "#map", "iframe", "click", "Map", True, None, None, True),
    (1, "#blank", "textbox", "fill,focus", None, True, None, None, True),
    (2, "#dup", "button", "click,focus", "One", True, None, None, False),
    (2, "#dup", "button", "click,focus", "Login here", True, None, None, False),
    (2, "#note", "p", "fill,focus", "Note", True, None, None, True),
    (2, "#more", "summary", "click", "More", False, None, None, True),
]
FORMS = [(0, 0, "https://forms.example.org/go", "obs-0,obs-1,obs-2,obs-3,obs-4"), (1, 0, None, "obs-3")]
NO_NODES = "<html><body><p>Nothing to press.</p></body></html>"
# --- end fixed values --------------------------------------------------------


def form_pages_html() -> str:
    block = "CASE page_id % 3 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BLOCKS)) + " END"
    return f"replace(html, '<body>', concat('<body>', {block}))"


def _form_pages(t):
    return t("pages").selectExpr("page_id", "url", f"{form_pages_html()} AS html")


def _literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (bool, int)) else f"'{x}'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)


_NODE_COLS = ["selector_hint", "role", "actions", "name", "enabled", "checked", "value_redacted", "selector_hint_unique"]
_BLOCK_ROWS = [(n[0], sum(m[0] == n[0] for m in NODES[:i]), *n[1:]) for i, n in enumerate(NODES)]
#: Every node of form_pages: the block's in front, the page's own links behind them.
ALL_NODES_D = f"""{OWN_LINKS_D},
_bk(block, nth, {', '.join(_NODE_COLS)}) AS (VALUES {_values(_BLOCK_ROWS)}),
_sz AS (SELECT page_id, CASE WHEN contains(html, '<body>') THEN n ELSE 0 END AS shift FROM pages JOIN (SELECT block, count(*) AS n FROM _bk GROUP BY block) ON page_id % 3 = block),
nodes AS (SELECT page_id, CAST(nth AS BIGINT) AS node_no, {', '.join(_NODE_COLS)}, name AS text FROM pages JOIN _bk ON page_id % 3 = block WHERE contains(html, '<body>')
  UNION ALL SELECT page_id, shift + link_no, NULL, 'link', 'click,focus', name, true, NULL, NULL, NULL, text FROM own JOIN _sz USING (page_id))"""


def _all(*cols) -> str:
    return f"{ALL_NODES_D}\nSELECT page_id, node_no, {', '.join(cols)} FROM nodes"


def _nodes(t, *cols):
    return N.observation_nodes(_form_pages(t)).selectExpr("page_id", "node_no", *cols)


@register("n2_observation_role", _all("selector_hint", "role"))
def n2(t):
    """Role of every interactive node."""
    return _nodes(t, "selector_hint", "role")


@register("n3_observation_actions", _all("selector_hint", "actions"))
def n3(t):
    """Mechanical actions of every interactive node."""
    return _nodes(t, "selector_hint", "array_join(actions, ',') AS actions")


@register("n4_accessible_name", _all("selector_hint", "name"))
def n4(t):
    """Accessible names: aria-label, title, label text, own text."""
    return _nodes(t, "selector_hint", "name")


@register("n5_node_state", _all("selector_hint", "enabled", "checked", "value_redacted"))
def n5(t):
    """Enabled, checked and value flags."""
    return _nodes(t, "selector_hint", "enabled", "checked", "value_redacted")


@register("n6_selector_hint", _all("selector_hint", "selector_hint_unique"))
def n6(t):
    """``#id`` selector hints and whether they are unique on the page."""
    return _nodes(t, "selector_hint", "selector_hint_unique")


@register("n7_observation_forms", f"""SELECT page_id, CAST(form_no AS BIGINT) AS form_no, 'form-' || CAST(form_no AS VARCHAR) AS ref,
  coalesce(action, url) AS action, refs FROM pages JOIN (VALUES {_values(FORMS)}) e(block, form_no, action, refs)
  ON page_id % 3 = e.block WHERE contains(html, '<body>')""")
def n7(t):
    """Forms with their action and the nodes that belong to them, ``form=`` owners too."""
    return N.observation_forms(_form_pages(t)).selectExpr("page_id", "form_no", "ref", "action", "array_join(field_refs, ',') AS refs")


@register("n8_observation_frames", """SELECT page_id, CAST(0 AS BIGINT) AS frame_no, 'main' AS frame_id, url FROM pages
UNION ALL SELECT page_id, 1, 'iframe-0', 'https://maps.example.org/m' FROM pages WHERE page_id % 3 = 1 AND contains(html, '<body>')""")
def n8(t):
    """The main frame and every iframe of the page."""
    return N.observation_frames(_form_pages(t))


@register("n10_observation_empty", """SELECT page_id, 'observation' AS artifact, 'observation_empty' AS code FROM pages
WHERE page_id % 4 = 0 OR (NOT contains(html, '<a ') AND NOT contains(html, '<iframe'))""")
def n10(t):
    """Pages without an interactive node (every fourth page is replaced by one)."""
    p = t("pages").selectExpr("page_id", "url", f"CASE WHEN page_id % 4 = 0 THEN '{NO_NODES}' ELSE html END AS html")
    return N.observation_empty(p, N.observation_nodes(p))


@register("n11_label_audit", f"""{ALL_NODES_D}
SELECT page_id, node_no, selector_hint, name FROM nodes WHERE regexp_matches(concat_ws(' ', role, name, text, selector_hint), '(?i){'|'.join(N.DISALLOWED_LABELS)}')""")
def n11(t):
    """Nodes whose fields hold an interpretive word."""
    return N.label_audit(N.observation_nodes(_form_pages(t))).select("page_id", "node_no", "selector_hint", "name")
