"""DuckDB SQL text builders used by the oracles (RE2 regexes, 1-based lists).

These restate the operator semantics in DuckDB's dialect so the oracle is
computed by a different engine from the same definitions.
"""

from __future__ import annotations

import re

from pagefold.functions.text import CURRENCY_RULES, JS_SPACE, NAMED_ENTITIES, NUMERIC_ENTITY
from pagefold.operators.html import BLOCK_TAGS, HEADING_TAGS, RAW_TEXT_TAGS, VOID_TAGS


def q(s: str) -> str:
    """DuckDB string literal (standard SQL: quotes doubled, no escapes)."""
    return "'" + s.replace("'", "''") + "'"


def qlist(xs) -> str:
    return ", ".join(q(x) for x in xs)


def rx(s: str) -> str:
    """Java regex -> RE2: drop possessive quantifiers."""
    return s.replace("++", "+").replace("*+", "*").replace("?+", "?")


def decode(x: str) -> str:
    out = x
    for ent, ch in NAMED_ENTITIES:
        out = f"replace({out}, {q(ent)}, {q(ch)})"
    num = (f"list_reduce(list_distinct(regexp_extract_all({out}, {q(NUMERIC_ENTITY)}, 0)), "
           f"lambda acc, r: CASE WHEN (CASE WHEN lower(substr(r, 3, 1)) = 'x' THEN "
           f"TRY_CAST(('0x' || regexp_extract(r, {q(NUMERIC_ENTITY)}, 1)[2:]) AS BIGINT) "
           f"ELSE TRY_CAST(regexp_extract(r, {q(NUMERIC_ENTITY)}, 1) AS BIGINT) END) BETWEEN 1 AND 1114111 "
           f"THEN replace(acc, r, chr(CAST(CASE WHEN lower(substr(r, 3, 1)) = 'x' THEN "
           f"TRY_CAST(('0x' || regexp_extract(r, {q(NUMERIC_ENTITY)}, 1)[2:]) AS BIGINT) "
           f"ELSE TRY_CAST(regexp_extract(r, {q(NUMERIC_ENTITY)}, 1) AS BIGINT) END AS INTEGER))) ELSE acc END, {out})")
    out = f"CASE WHEN strpos({out}, '&#') > 0 THEN {num} ELSE {out} END"
    return f"replace({out}, '&amp;', '&')"


def squash(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {q(JS_SPACE)}, ' ', 'g'), '^ | $', '', 'g')"


def _duck_replacement(rep: str) -> str:
    """Java ``$n`` group references -> RE2 ``\\n``."""
    return re.sub(r"[$]([0-9])", lambda m: "\\" + m.group(1), rep)


def norm(x: str) -> str:
    t = squash(x)
    for _ in range(3):
        for pat, rep in CURRENCY_RULES:
            t = f"regexp_replace({t}, {q(pat)}, {q(_duck_replacement(rep))}, 'g')"
    return t


def trunc(x: str, n) -> str:
    return f"(CASE WHEN length({x}) > ({n}) THEN substr({x}, 1, ({n}) - 1) || '…' ELSE {x} END)"


def attr(name: str, decode_it: bool = True, attrs: str = "attrs") -> str:
    v = f"(list_filter({attrs}, lambda a: a.k = {q(name)})[1]).v"
    return decode(v) if decode_it else v


def has_attr(name: str, attrs: str = "attrs") -> str:
    return f"coalesce(len(list_filter({attrs}, lambda a: a.k = {q(name)})) > 0, false)"


def nonempty(x: str) -> str:
    return f"nullif({x}, '')"


URL_RE = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
SCHEME_RE = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"


def host(u: str) -> str:
    return f"lower(regexp_extract({u}, {q(r'^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)')}, 1))"


def registrable(h: str) -> str:
    parts = f"list_filter(string_split(lower({h}), '.'), lambda x: x != '')"
    return (f"(CASE WHEN len({parts}) <= 2 THEN array_to_string({parts}, '.') "
            f"ELSE array_to_string({parts}[-2:], '.') END)")


def same_site(a: str, b: str) -> str:
    return (f"coalesce(regexp_matches({a}, {q(URL_RE)}) AND regexp_matches({b}, {q(URL_RE)}) AND "
            f"{registrable(host(a))} = {registrable(host(b))}, false)")


def fold_dots(path: str) -> str:
    segs = f"string_split(substr({path}, 2), '/')"
    folded = (f"list_reduce({segs}, lambda acc, s: CASE WHEN s = '..' THEN acc[1:len(acc) - 1] "
              f"WHEN s = '.' THEN acc ELSE list_append(acc, s) END, []::VARCHAR[])")
    return (f"(CASE WHEN len({folded}) = 0 THEN '/' ELSE '/' || array_to_string({folded}, '/') || "
            f"CASE WHEN {segs}[-1] IN ('.', '..') THEN '/' ELSE '' END END)")


def resolve_stage_sql(src: str, base: str, href: str, out: str, keep: str = "*") -> str:
    """SELECT adding column ``out`` = href resolved against base (3 subqueries)."""
    r = q(URL_RE)
    h = f"regexp_replace(regexp_replace({href}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '[\\t\\n\\r]', '', 'g')"
    s1 = (f"SELECT {keep}, {h} AS _h, regexp_extract({base}, {r}, 1) AS _bs, regexp_extract({base}, {r}, 2) != '' AS _bha, "
          f"regexp_extract({base}, {r}, 3) AS _ba, CASE WHEN regexp_extract({base}, {r}, 4) = '' THEN '/' "
          f"ELSE regexp_extract({base}, {r}, 4) END AS _bp, regexp_extract({base}, {r}, 5) AS _bq, "
          f"regexp_matches({base}, {r}) AS _bok FROM ({src})")
    origin = "_bs || '://' || _ba"
    target = (f"CASE WHEN regexp_matches(_h, {q(SCHEME_RE)}) THEN _h WHEN NOT (_bok AND _bha) THEN NULL "
              f"WHEN starts_with(_h, '//') THEN _bs || ':' || _h WHEN starts_with(_h, '/') THEN {origin} || _h "
              f"WHEN starts_with(_h, '?') THEN {origin} || _bp || _h "
              f"WHEN starts_with(_h, '#') THEN {origin} || _bp || _bq || _h "
              f"WHEN _h = '' THEN {origin} || _bp || _bq "
              f"ELSE {origin} || regexp_replace(_bp, '[^/]*$', '') || _h END")
    s2 = f"SELECT * EXCLUDE (_h, _bs, _bha, _ba, _bp, _bq, _bok), {target} AS _t FROM ({s1})"
    s3 = (f"SELECT * EXCLUDE (_t), regexp_matches(_t, {r}) AS _tok, lower(regexp_extract(_t, {r}, 1)) AS _ts, "
          f"regexp_extract(_t, {r}, 2) != '' AS _tha, regexp_extract(_t, {r}, 3) AS _ta, regexp_extract(_t, {r}, 4) AS _tp, "
          f"regexp_extract(_t, {r}, 5) AS _tq, regexp_extract(_t, {r}, 6) AS _tf, _t FROM ({s2})")
    hp = "regexp_replace(_ta, '^[^@]*@', '')"
    hst = f"lower(regexp_extract({hp}, {q(r'^(\[[^\]]*\]|[^:]*)')}, 1))"
    port = f"regexp_extract({hp}, {q(r'^(?:\[[^\]]*\]|[^:]*):(\d*)$')}, 1)"
    dport = "CASE _ts WHEN 'http' THEN '80' WHEN 'https' THEN '443' WHEN 'ws' THEN '80' WHEN 'wss' THEN '443' WHEN 'ftp' THEN '21' END"
    port_out = f"CASE WHEN {port} = '' OR {port} = {dport} THEN '' ELSE ':' || {port} END"
    path = f"CASE WHEN _tp = '' THEN '/' ELSE {fold_dots('_tp')} END"
    special = ("_ts IN ('http', 'https', 'ws', 'wss', 'ftp')")
    res = (f"CASE WHEN NOT coalesce(_tok, false) THEN NULL WHEN {special} AND _tha AND {hst} != '' THEN "
           f"replace(_ts || '://' || regexp_extract(_ta, '^([^@]*@)?', 1) || {hst} || {port_out} || {path} || _tq || _tf, ' ', '%20') "
           f"WHEN {special} THEN NULL ELSE _ts || ':' || regexp_replace(_t, {q(SCHEME_RE)}, '') END")
    return f"SELECT * EXCLUDE (_tok, _ts, _tha, _ta, _tp, _tq, _tf, _t), {res} AS {out} FROM ({s3})"


TOKEN_RE = rx(r"""<[a-zA-Z/!?](?:[^'">]++|"[^"]*+"|'[^']*+')*+>|[^<]++|<""")
STRIP_RE = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(f"<{t}\\b.*?(?:</{t}\\s*>|\\z)" for t in RAW_TEXT_TAGS)
ATTR_PAIR_RE = rx(r"""[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
RUN = "(PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
RUN_BEFORE = "(PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
COVER = ["hidden", "heading", "table", "iframe", "a", "nav", "footer", "tr", "cell", "caption", "action", "label", "form"]


def tokens_cte(pages: str = "pages") -> str:
    """CTEs ``tok`` (T1) and ``et`` (element tokens with coverage)."""
    void = f"tag IN ({qlist(VOID_TAGS)})"
    hidden = (f"({has_attr('hidden')} OR lower(coalesce({attr('aria-hidden', False)}, '')) = 'true' OR "
              f"(tag = 'input' AND lower(coalesce({attr('type', False)}, '')) = 'hidden') OR "
              f"regexp_matches(coalesce({attr('style', False)}, ''), {q(r'(?i)display\s*:\s*none|visibility\s*:\s*(hidden|collapse)')}) "
              f"OR tag IN ('meta', 'link'))")
    action = (f"(tag = 'button' OR lower(coalesce({attr('role', False)}, '')) = 'button' OR (tag = 'input' AND "
              f"lower(coalesce({attr('type', False)}, '')) IN ('button', 'submit', 'reset')))")
    conds = {"hidden": hidden, "heading": f"tag IN ({qlist(HEADING_TAGS)})", "table": "tag = 'table'",
             "iframe": "tag = 'iframe'", "a": "tag = 'a'", "nav": "tag = 'nav'", "footer": "tag = 'footer'",
             "tr": "tag = 'tr'", "cell": "tag IN ('td', 'th')", "caption": "tag = 'caption'", "action": action,
             "label": "tag = 'label'", "form": "tag = 'form'"}
    mask = " | ".join(f"(CASE WHEN {conds[k]} THEN {1 << i} ELSE 0 END)" for i, k in enumerate(COVER))
    cover_cols = []
    for i, k in enumerate(COVER):
        om = f"((_m >> {i}) & 1)"
        cm = f"(CASE WHEN _void THEN {om} ELSE ((_cm >> {i}) & 1) END)"
        cover_cols.append(f"sum({om}) OVER {RUN} - coalesce(sum({cm}) OVER {RUN_BEFORE}, 0) AS in_{k}")
        if k != "hidden":
            cover_cols.append(f"last_value(CASE WHEN {om} = 1 AND NOT _void THEN pos END IGNORE NULLS) OVER {RUN} AS {k}_pos")
    base = "page_id, url, pos, last_pos, kind, tag, attrs, text"
    s = f"sum(CASE WHEN {void} THEN 0 WHEN kind = 'open' THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id, tag ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    w = "(PARTITION BY page_id, tag, _lvl ORDER BY pos)"
    return f"""
_p0 AS (SELECT page_id, url, regexp_replace(html, {q(STRIP_RE)}, '', 'g') AS s FROM {pages}),
_p1 AS (SELECT page_id, url, CASE WHEN strpos(lower(s), '<body') > 0 THEN substr(s, strpos(lower(s), '<body')) ELSE s END AS b FROM _p0),
_p2 AS (SELECT page_id, url, regexp_extract_all(b, {q(TOKEN_RE)}, 0) AS toks FROM _p1),
_t0 AS (SELECT page_id, url, len(toks) - 1 AS last_pos, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos FROM _p2),
_t1 AS (SELECT *, CASE WHEN regexp_matches(tok, '^<[a-zA-Z]') THEN 'open' WHEN regexp_matches(tok, '^</[a-zA-Z]') THEN 'close'
          WHEN NOT starts_with(tok, '<') OR tok = '<' THEN 'text' ELSE 'other' END AS kind FROM _t0),
tok AS (SELECT page_id, url, pos, last_pos, kind,
          CASE WHEN kind != 'text' THEN lower(regexp_extract(tok, {q(r'^</?([a-zA-Z][^\s/>]*)')}, 1)) END AS tag,
          CASE WHEN kind = 'open' THEN list_transform(regexp_extract_all(regexp_replace(tok, {q(r'(?s)^<[a-zA-Z][^\s/>]*|/?>\z')}, '', 'g'), {q(ATTR_PAIR_RE)}, 0),
             lambda p: {{'k': lower(regexp_extract(p, {q(r'^[^\s=]+')}, 0)), 'v': regexp_replace(regexp_replace(p, {q(r'^[^\s=]+\s*=?\s*')}, ''), {q('''^["']|["']$''')}, '', 'g')}}) END AS attrs,
          CASE WHEN kind = 'text' THEN {decode('tok')} END AS text
        FROM _t1 WHERE kind != 'other'),
_e0 AS (SELECT {base}, CASE WHEN kind = 'open' THEN {mask} ELSE 0 END AS _m, kind = 'open' AND coalesce({void}, false) AS _void,
          CASE WHEN kind = 'open' THEN {s} WHEN kind = 'close' THEN {s} + 1 END AS _lvl FROM tok),
_e1 AS (SELECT {base}, _m, _void,
          CASE WHEN _void THEN pos WHEN kind = 'open' THEN CASE WHEN coalesce(lead(kind) OVER {w} = 'close', false) THEN lead(pos) OVER {w} ELSE last_pos END END AS "end",
          CASE WHEN kind = 'close' AND coalesce(lag(kind) OVER {w} = 'open', false) THEN lag(_m) OVER {w} ELSE 0 END AS _cm FROM _e0),
et AS (SELECT {base}, "end", (_m & 1) = 1 AS hidden_self, {", ".join(cover_cols)} FROM _e1)
"""


def text_piece() -> str:
    alt = f"coalesce({nonempty(attr('alt'))}, {attr('title')}, '')"
    return f"CASE WHEN kind = 'text' THEN {norm('text')} WHEN kind = 'open' AND tag = 'img' THEN {norm(alt)} END"


def join_pieces(pieces: str) -> str:
    return norm(f"array_to_string(list_transform(list_filter(list_sort({pieces}), lambda z: z.piece != ''), lambda z: z.piece), ' ')")


def flow_cte(frames: str | None = None) -> str:
    """CTEs ``ft`` (flow tokens), ``ent`` (content entries) and ``flow``; needs ``et``.
    With ``frames`` (the name of the page table) same-origin frames are spliced in."""
    H = qlist(HEADING_TAGS)
    opaque = "(in_heading + in_table + in_iframe)"
    self_opaque = f"(kind = 'open' AND (tag IN ({H}) OR tag IN ('table', 'iframe')))"
    boundary = (f"walked AND ((tag IN ({qlist(BLOCK_TAGS)}) AND kind IN ('open', 'close')) "
                f"OR (kind = 'open' AND tag IN ('br', 'table', 'iframe')) "
                f"OR (kind = 'open' AND tag IN ({H}) AND coalesce(heading_nonblank, false)))")
    piece = "piece IS NOT NULL"
    plain = "in_heading = 0 AND in_table = 0 AND in_iframe = 0"

    def m(kind, key, cond):
        return f"CASE WHEN {cond} THEN {{'ekind': {q(kind)}, 'ekey': CAST({key} AS BIGINT)}} END"

    mem = "list_filter([" + ", ".join([
        m("paragraph", "block_key", f"walked AND {plain} AND {piece}"),
        m("heading", "heading_pos", f"in_heading > 0 AND ({piece} OR (kind = 'open' AND tag IN ({H})))"),
        m("link", "a_pos", f"in_a > 0 AND ({piece} OR (kind = 'open' AND tag = 'a'))"),
        m("action", "action_pos", f"in_action > 0 AND ({piece} OR (kind = 'open' AND pos = action_pos))"),
        m("cell", "cell_pos", f"in_cell > 0 AND in_table > 0 AND ({piece} OR (kind = 'open' AND tag IN ('td', 'th')))"),
        m("caption", "caption_pos", f"in_caption > 0 AND in_table > 0 AND ({piece} OR (kind = 'open' AND tag = 'caption'))"),
        m("table", "pos", "kind = 'open' AND tag = 'table' AND walked"),
    ]) + "], lambda x: x IS NOT NULL)"
    owner = "kind = 'open' AND pos = ekey"
    is_head = "(ekind = 'heading' AND walked AND text != '')"
    w = "(PARTITION BY page_id ORDER BY epos, ekind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
_f0 AS (SELECT *, {text_piece()} AS piece, {opaque} = 0 OR ({self_opaque} AND {opaque} = 1) AS walked,
          CASE WHEN in_heading > 0 THEN heading_pos END AS _hkey FROM et WHERE in_hidden = 0),
_f1 AS (SELECT *, CASE WHEN _hkey IS NOT NULL THEN max(coalesce(piece != '', false)) OVER (PARTITION BY page_id, _hkey) END AS heading_nonblank FROM _f0),
_f2 AS (SELECT *, {boundary} AS boundary FROM _f1),
ft AS (SELECT *, coalesce(last_value(CASE WHEN boundary THEN pos END IGNORE NULLS) OVER {RUN}, -1) AS block_key FROM _f2),
_x0 AS (SELECT *, unnest({mem}) AS _m FROM ft),
_x1 AS (SELECT *, _m.ekind AS ekind, _m.ekey AS ekey FROM _x0),
_n0 AS (SELECT page_id, ekind, ekey, first(url) AS url,
          min(CASE WHEN piece IS NOT NULL THEN pos END) AS _ppos,
          max(CASE WHEN {owner} THEN tag END) AS tag,
          first(attrs) FILTER (WHERE {owner}) AS attrs,
          max(CASE WHEN {owner} THEN CAST(walked AS INT) END) AS _walked,
          max(CASE WHEN {owner} THEN in_nav END) AS in_nav,
          max(CASE WHEN {owner} THEN in_footer END) AS in_footer,
          max(CASE WHEN {owner} THEN table_pos END) AS table_pos,
          max(CASE WHEN {owner} THEN tr_pos END) AS tr_pos,
          coalesce(list({{'pos': pos, 'piece': piece}}) FILTER (WHERE piece IS NOT NULL), []) AS _pieces
        FROM _x1 GROUP BY page_id, ekind, ekey),
_n1 AS (SELECT page_id, url, ekind, ekey, CASE WHEN ekind = 'paragraph' THEN _ppos ELSE ekey END AS epos, tag, attrs,
          coalesce(_walked = 1, ekind = 'paragraph') AS walked, in_nav, in_footer, table_pos, tr_pos,
          {join_pieces('_pieces')} AS text FROM _n0 WHERE ekind = 'paragraph' OR tag IS NOT NULL),
{_spliced(frames, is_head, w)}
_fl0 AS (SELECT *, ekind = 'paragraph' AND coalesce(lag(ekind) OVER (PARTITION BY page_id ORDER BY epos) = 'paragraph'
          AND lag(text) OVER (PARTITION BY page_id ORDER BY epos) = text, false) AS _dup
        FROM ent WHERE (ekind = 'heading' AND walked AND text != '') OR (ekind = 'paragraph' AND text != '') OR ekind = 'table'),
_fl1 AS (SELECT *, coalesce(sum(CASE WHEN ekind = 'paragraph' THEN length(text) + 1 ELSE 0 END)
          OVER (PARTITION BY page_id ORDER BY epos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS emitted_before
        FROM _fl0 WHERE NOT _dup),
flow AS (SELECT * FROM _fl1)
"""


def _spliced(pages: str | None, is_head: str, w: str) -> str:
    """CTE ``ent`` from ``_n1``: with sections, and its instance and source page."""
    if pages is None:
        return f"""inst AS (SELECT DISTINCT page_id AS root, url, page_id AS src, []::BIGINT[] AS path FROM _p0),
ent AS (SELECT *, page_id AS src, '' AS inst, CAST(sum(CAST({is_head} AS INT)) OVER {w} AS BIGINT) AS section_no,
          coalesce(last_value(CASE WHEN {is_head} THEN text END IGNORE NULLS) OVER {w}, 'Page') AS section_heading
        FROM _n1),"""
    origin = "lower(regexp_extract({0}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1))"
    wi = w.replace("page_id", "page_id, inst")
    return f"""_i0 AS (SELECT page_id, pos, url, {attr('src')} AS raw_src FROM ft WHERE kind = 'open' AND tag = 'iframe' AND walked),
_i1 AS ({resolve_stage_sql('SELECT * FROM _i0', 'url', 'raw_src', 'own_src')}),
_i2 AS (SELECT *, coalesce({origin.format('own_src')} = {origin.format('url')}, false) AS same FROM _i1),
_fr AS (SELECT _i2.page_id, CAST(pos AS BIGINT) AS pos, raw_src, same, CASE WHEN same THEN p.page_id END AS child FROM _i2
        LEFT JOIN (SELECT url, min(page_id) AS page_id FROM {pages} GROUP BY url) p ON p.url = _i2.own_src),
inst AS (SELECT page_id AS root, url, page_id AS src, []::BIGINT[] AS path, [page_id] AS chain, NULL::VARCHAR AS raw_src FROM {pages}
  UNION ALL SELECT i.root, i.url, f.child, list_append(i.path, f.pos), list_append(i.chain, f.child), f.raw_src
  FROM inst i JOIN _fr f ON f.page_id = i.src WHERE f.child IS NOT NULL AND NOT list_contains(i.chain, f.child)),
_lab AS ({resolve_stage_sql("SELECT root, url, src, path, raw_src FROM inst WHERE len(path) > 0", 'url', 'raw_src', 'label')}),
_s0 AS (SELECT i.root AS page_id, i.url, n.src, n.* EXCLUDE (page_id, url, src, epos), list_append(i.path, CAST(n.epos AS BIGINT)) AS path, array_to_string(i.path, '/') AS inst
        FROM (SELECT *, page_id AS src FROM _n1) n JOIN inst i ON i.src = n.src
  UNION ALL BY NAME SELECT root AS page_id, url, src, 'heading' AS ekind, -2 AS ekey, 'h3' AS tag, true AS walked, 0 AS in_nav, 0 AS in_footer,
        'Frame: ' || coalesce(label, 'same-origin iframe') AS text, path, array_to_string(path, '/') AS inst FROM _lab),
_s1 AS (SELECT * EXCLUDE (path), row_number() OVER (PARTITION BY page_id ORDER BY path, ekind) AS epos FROM _s0),
_s2 AS (SELECT *, CASE WHEN {is_head} THEN {{'n': sum(CAST({is_head} AS INT)) OVER {w}, 'h': text}} END AS _hd FROM _s1),
_s3 AS (SELECT *, last_value(_hd IGNORE NULLS) OVER {wi} AS _sec FROM _s2),
ent AS (SELECT * EXCLUDE (_hd, _sec), CAST(coalesce(_sec.n, 0) AS BIGINT) AS section_no, coalesce(_sec.h, 'Page') AS section_heading FROM _s3),
"""


def href_sql() -> str:
    r = f"regexp_replace({attr('href')}, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN {r} != '' AND {r} != '#' AND NOT starts_with(lower({r}), 'javascript:') THEN {r} END"


def link_kind(text: str, abs_url: str, in_footer: str, in_nav: str, same: str) -> str:
    from pagefold.operators.content import LINK_KINDS
    j = f"lower(concat_ws(' ', coalesce({text}, ''), coalesce({abs_url}, '')))"
    return ("CASE " + " ".join(f"WHEN regexp_matches({j}, {q(p)}) THEN {q(n)}" for n, p in LINK_KINDS)
            + f" WHEN {in_footer} > 0 THEN 'footer' WHEN {in_nav} > 0 THEN 'nav' WHEN {same} THEN 'unknown' ELSE 'external' END")


def link_rows_sql(walked: str = "walked") -> str:
    """SELECT over ``ent`` producing link occurrences (before dedupe/cap)."""
    src = f"SELECT *, {href_sql()} AS url_raw FROM ent WHERE ekind = 'link' AND {walked}"
    res = resolve_stage_sql(f"SELECT * FROM ({src}) WHERE url_raw IS NOT NULL", "url", "url_raw", "absolute_url")
    full = norm(f"coalesce(nullif(text, ''), nullif({attr('aria-label')}, ''), nullif({attr('title')}, ''), url_raw)")
    s1 = f"SELECT *, {full} AS full_text, {same_site('absolute_url', 'url')} AS same_site FROM ({res}) WHERE absolute_url IS NOT NULL"
    lt = "(CASE WHEN full_text != '' THEN full_text ELSE absolute_url END)"
    return (f"SELECT *, {link_kind('full_text', 'absolute_url', 'in_footer', 'in_nav', 'same_site')} AS kind, "
            f"{lt} AS link_text FROM ({s1})")


def links_sql() -> str:
    s1 = f"SELECT *, row_number() OVER (PARTITION BY page_id, absolute_url, link_text ORDER BY epos) AS _rn FROM ({link_rows_sql()})"
    s2 = f"SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY epos) - 1 AS link_no FROM ({s1}) WHERE _rn = 1"
    return (f"SELECT page_id, CAST(link_no AS BIGINT) AS link_no, link_text AS text, url_raw AS url, absolute_url, same_site, "
            f"true AS visible, section_heading AS source_section, section_no, kind FROM ({s2})")
