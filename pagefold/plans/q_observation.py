"""Queries for the observation operators."""

from __future__ import annotations

from pagefold.operators import observation as N
from pagefold.plans import duck as D
from pagefold.plans.registry import register

NAME_D = D.squash("{x}")


def _name(x: str) -> str:
    return NAME_D.replace("{x}", x)


NODES_D = f"""WITH {D.tokens_cte()},
_el AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS e_no,
  (tag = 'a' AND {D.has_attr('href')}) OR tag IN ('button', 'input', 'textarea', 'select', 'summary', 'iframe') OR {D.has_attr('role')}
  OR {D.has_attr('tabindex')} OR {D.attr('contenteditable', False)} = 'true' AS semantic FROM et WHERE kind = 'open' AND tag NOT IN ('body', 'html')),
_s AS (SELECT *, sum(CAST(semantic AS INTEGER)) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sem_no FROM _el),
_n AS (SELECT * FROM _s WHERE semantic),
_pc AS (SELECT page_id AS p_page, pos AS p_pos, {D.text_piece()} AS piece FROM et WHERE in_hidden = 0),
_tx AS (SELECT _n.page_id, _n.pos, {D.join_pieces("list({'pos': p_pos, 'piece': piece})")} AS _text FROM _n JOIN _pc
  ON p_page = _n.page_id AND p_pos > _n.pos AND p_pos <= _n."end" WHERE piece IS NOT NULL GROUP BY _n.page_id, _n.pos)"""


#: The links of the raw pages, the only interactive nodes there.
OWN_LINKS_D = NODES_D + f""",
own AS (SELECT _n.page_id, CAST(sem_no - 1 AS BIGINT) AS link_no,
  coalesce(nullif({_name(D.attr('aria-label'))}, ''), nullif({_name(D.attr('alt'))}, ''), nullif({_name(D.attr('title'))}, ''),
  nullif({_name('_text')}, '')) AS name, nullif({_name('_text')}, '') AS text, in_hidden = 0 AS visible,
  regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || {D.attr('href')} AS href
  FROM _n LEFT JOIN _tx USING (page_id, pos))"""


@register("n1_observation_nodes", OWN_LINKS_D + """
SELECT page_id, link_no AS node_no, 'obs-' || CAST(link_no AS VARCHAR) AS ref, 'link' AS role, name, text, visible, href FROM own""")
def n1(t):
    """Interactive nodes of every page (the raw pages hold a[href] nav links) with their whole names and texts."""
    return N.observation_nodes(t("pages")).selectExpr("page_id", "node_no", "ref", "role", "name", "text", "visible", "href")


@register("n9_observation_truncated", NODES_D.split(",\n_n AS")[0] + """,
_g AS (SELECT page_id, count(*) AS n_elements, min(CASE WHEN semantic AND sem_no = 4 THEN e_no END) AS nh,
  count_if(semantic AND e_no <= 20) AS sis FROM _s GROUP BY page_id)
SELECT page_id, CASE WHEN nh IS NOT NULL AND nh <= 20 THEN 'node_limit_exceeded' ELSE 'scan_limit_exceeded' END AS reason,
  3 AS node_limit, 20 AS scan_limit, CAST(CASE WHEN nh IS NOT NULL AND nh <= 20 THEN nh ELSE 20 END AS BIGINT) AS scanned,
  CAST(CASE WHEN nh IS NOT NULL AND nh <= 20 THEN 3 ELSE least(sis, 3) END AS BIGINT) AS emitted_nodes
FROM _g WHERE (nh IS NOT NULL AND nh <= 20) OR n_elements > 20""")
def n9(t):
    """First observation limit hit per page, with limits lowered to 3 nodes / 20 elements."""
    return N.observation_truncated(t("pages"), 3, 20)


