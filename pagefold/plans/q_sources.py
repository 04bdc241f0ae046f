"""Queries for sources/sinks (S1, S4, S6), result assembly (C16) and the
composed content documents (T20-T23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold import dims
from pagefold.operators import content as C
from pagefold.operators import documents as DOC
from pagefold.operators import readiness as RD
from pagefold.operators.assemble import assemble_results, main_outcomes
from pagefold.operators.events import RESPONDED, SENT
from pagefold.plans import duck as D
from pagefold.plans.adapters import frame_pages_html, table_pages_html
from pagefold.plans.q_content import PAGE_TITLE_D, TABLES_D
from pagefold.plans.q_events import CE, cap_events
from pagefold.plans.q_readiness import BACKOFF_MS, CODE_CASE, RETRIES, RETRY_D, SPANS_D, stage_events
from pagefold.plans.q_rules import PV, _variants, d_classify_body, d_shell
from pagefold.plans.sqlutil import select_items
from pagefold.plans.registry import register
from pagefold.sources import io as S


@register("s1_read_pages", "SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS html_bytes FROM pages")
def s1(t):
    """Page table read with column pruning."""
    return t("pages").selectExpr("page_id", "url", "CAST(octet_length(html) AS BIGINT) AS html_bytes")


RESULTS_SELECT = ("concat('req-', CAST(page_id AS {s})) AS request_id, url AS request_url, "
                  "CASE WHEN page_id % 2 = 0 THEN concat('/out/req-', CAST(page_id AS {s}), '/body.html') END AS body_file, "
                  "CASE WHEN page_id % 3 = 0 THEN concat('/out/req-', CAST(page_id AS {s}), '/text.txt') END AS text_file, "
                  "concat('/out/req-', CAST(page_id AS {s}), '/network.json') AS network_file")
ART_VALUES = ", ".join(f"('{a}', '{f}')" for a, f in dims.ARTIFACTS[:9])


@register("s6_artifact_manifest", f"""WITH r AS (SELECT {RESULTS_SELECT.format(s='VARCHAR')} FROM pages),
a(artifact, filename) AS (VALUES {ART_VALUES})
SELECT request_id, artifact, filename AS expected_filename,
  CASE artifact WHEN 'body' THEN body_file WHEN 'text' THEN text_file WHEN 'network' THEN network_file END AS file,
  (CASE artifact WHEN 'body' THEN body_file WHEN 'text' THEN text_file WHEN 'network' THEN network_file END) IS NOT NULL AS present
FROM r, a""")
def s6(t):
    """Per acquisition x default artifact: expected file name and presence."""
    r = t("pages").selectExpr(*select_items(RESULTS_SELECT.format(s="STRING")))
    return S.artifact_manifest(r)


@register("s2_capture_dirs", """SELECT 'req-' || CAST(page_id AS VARCHAR) AS request_id, url AS main_url, CAST(length(html) AS BIGINT) AS html_chars, page_id % 3 AS failed_total FROM pages""")
def s2(t):
    """Network artifacts of every page written as a folder tree into the shared folder, and read back."""
    from pagefold.streaming.streams import scratch_path
    body = "to_json(named_struct('schema_version', 1, 'main_url', url, 'summary', named_struct('html_chars', CAST(length(html) AS BIGINT), 'failed_total', page_id % 3)))"
    files = t("pages").selectExpr("concat('req-', CAST(page_id AS STRING)) AS request_id", "explode(array('network', 'console')) AS artifact", f"{body} AS content")
    root = scratch_path(files.sparkSession, "capture-dirs")
    S.write_capture_dirs(files, root)
    back = S.read_capture_dirs(files.sparkSession, root, "network", "schema_version int, main_url string, summary struct<html_chars: bigint, failed_total: bigint>")
    return back.selectExpr("request_id", "main_url", "summary.html_chars AS html_chars", "summary.failed_total AS failed_total")


_S4_BODY = """CASE WHEN page_id % 2 = 0 THEN '"body_file":"/out/' || r || '/body.html",' ELSE '' END || '"code":"' || c || '","network_file":"/out/' || r
  || '/network.json","request_id":"' || r || '","request_url":"' || url || '"' || CASE WHEN page_id % 3 = 0 THEN ',"text_file":"/out/' || r || '/text.txt"' ELSE '' END
  || ',"token_secret":"***"'"""


@register("s4_results_jsonl", f"""WITH x AS (SELECT *, 'req-' || CAST(page_id AS VARCHAR) AS r, CASE WHEN page_id % 4 = 0 THEN 'other' ELSE 'fetch' END AS c FROM pages)
SELECT CASE WHEN page_id % 4 = 0 THEN '{{"code":"fetch","result":{{' || {_S4_BODY} || '}}}}' ELSE '{{' || {_S4_BODY} || '}}' END AS value FROM x""")
def s4(t):
    """Result rows as sorted-key JSON envelopes (code 'fetch'; a payload with another code is nested; secrets masked)."""
    r = t("pages").selectExpr(*select_items(RESULTS_SELECT.format(s="STRING")),
                              "CASE WHEN page_id % 4 = 0 THEN 'other' END AS code", "concat('t', CAST(page_id AS STRING)) AS token_secret")
    return S.envelope_json(r, "fetch")


_W = "{{'artifact': {0}, 'code': {1}, 'detail': {2}}}"


@register("c16_assemble_results", f"""WITH {PV}, {SPANS_D},
st AS (SELECT fetch_id, max(greatest(start_ms, coalesce(end_ms, start_ms))) AS until, min(start_ms) AS since FROM spans GROUP BY fetch_id),
sl AS (SELECT fetch_id, any_value(until - since) AS duration_ms, list({{'name': stage, 'status': status, 'duration_ms': coalesce(end_ms, until) - start_ms}}
  ORDER BY start_ms, stage, status, end_ms NULLS FIRST) AS stages FROM spans JOIN st USING (fetch_id) GROUP BY fetch_id),
rt AS ({RETRY_D}),
{CE},
mr AS (SELECT session_id, arg_min(request_id, seq) AS request_id FROM ce WHERE method = '{SENT}' AND resource_type = 'Document' GROUP BY session_id),
ev AS (SELECT ce.* FROM ce JOIN mr USING (session_id, request_id)),
sd AS (SELECT session_id, arg_max({{'r': request_id, 'u': coalesce(url, ''), 'q': seq}}, seq) AS l, count_if(has_redirect) - arg_min(CAST(has_redirect AS INTEGER), seq) AS redirects
  FROM ev WHERE method = '{SENT}' GROUP BY session_id),
mo AS (SELECT sd.session_id, l.r AS rid, l.u AS main_url, redirects, arg_max_null(status, ev.seq) AS main_status FROM sd LEFT JOIN ev
  ON ev.session_id = sd.session_id AND ev.method = '{RESPONDED}' AND ev.seq > l.q GROUP BY ALL),
ar AS (SELECT page_id, 'req-' || CAST(page_id AS VARCHAR) AS request_id, '/out/req-' || CAST(page_id AS VARCHAR) AS dir FROM pages),
er(error_code, retryable) AS (VALUES {', '.join(f"('{c}', {str(c in dims.RETRYABLE_CODES).lower()})" for c in dims.ERROR_CODES)}),
j AS (SELECT pv.page_id, ar.request_id, dir, url AS request_url, coalesce(nullif(main_url, ''), url) AS final_url, coalesce(main_status, status) AS status, main_status, rid, redirects,
  coalesce(pv.error_code, CASE WHEN outcome = 'failed' THEN final_code END) AS error_code, {d_classify_body()} AS page_kind, html, outcome, terminal_try, waited_ms, duration_ms, stages,
  CASE WHEN pv.error_code = 'invalid_argument' THEN 'error' ELSE 'browser' END AS decision,
  CASE WHEN pv.error_code = 'invalid_argument' THEN NULL WHEN pv.error_code IS NOT NULL THEN 'http_failed_' || pv.error_code WHEN status >= 400 THEN 'http_status_' || CAST(status AS VARCHAR)
    WHEN {d_classify_body()} IS NOT NULL THEN {d_classify_body()} WHEN {d_shell()} THEN 'empty_html_shell' ELSE 'requested_content_artifact' END AS reason
  FROM pv JOIN ar USING (page_id) LEFT JOIN sl ON sl.fetch_id = pv.page_id LEFT JOIN rt ON rt.request_id = pv.page_id LEFT JOIN mo ON mo.session_id = 's' || CAST(pv.page_id AS VARCHAR)),
w AS (SELECT page_id, list_sort(list_filter([
  CASE WHEN trim(html) = '' THEN {_W.format("'rendered_html'", "'artifact_empty'", "'rendered_html artifact size check'")} END,
  CASE WHEN page_kind IS NOT NULL THEN {_W.format("'content'", "page_kind", "'challenge page'")} END,
  CASE WHEN rid IS NULL THEN {_W.format("'network'", "'artifact_capture_failed'", "'main document network request was not observed'")} END,
  CASE WHEN rid IS NOT NULL AND main_status IS NULL THEN {_W.format("'network'", "'artifact_capture_failed'", "'main request ' || rid || ' had no response status'")} END,
  CASE WHEN rid IS NULL AND page_id % 2 = 1 THEN {_W.format("'body'", "'artifact_capture_failed'", "'cannot write body_file: main document request was not observed'")} END,
  CASE WHEN page_id % 5 = 0 THEN {_W.format("'console'", "'artifact_tiny'", "CAST(length(pages_html) AS VARCHAR)")} END], lambda x: x IS NOT NULL)) AS warnings
  FROM j JOIN (SELECT page_id, html AS pages_html FROM pages) USING (page_id))
SELECT request_id, request_url, final_url, status, CAST(to_json({{'render_mode': 'auto', 'render_decision': decision, 'render_used': decision = 'browser', 'escalation_reason': reason,
  'main_request_observed': rid IS NOT NULL, 'redirects': redirects, 'attempts': terminal_try, 'waited_ms': waited_ms, 'duration_ms': duration_ms, 'stages': coalesce(stages, [])}}) AS VARCHAR) AS trace,
  page_kind, CASE WHEN page_kind IS NOT NULL THEN 'human_takeover' END AS next_action, error_code, retryable, outcome, CAST(to_json(warnings) AS VARCHAR) AS warnings,
  CASE WHEN page_id % 2 = 0 THEN dir || '/body.html' END AS body_file, CASE WHEN page_id % 3 = 0 THEN dir || '/text.txt' END AS text_file, dir || '/network.json' AS network_file
FROM j JOIN w USING (page_id) LEFT JOIN er USING (error_code)""")
def c16(t):
    """One wide result row per acquisition: plan, class, errors, warnings, files, stages, retries and the main request's end."""
    key = "concat('req-', CAST({0} AS STRING)) AS {1}"
    v = _variants(t).selectExpr(key.format("page_id", "request_id"), "concat('s', CAST(page_id AS STRING)) AS session_id", "url AS request_url", "status", "content_type", "html", "error_code")
    files = S.artifact_manifest(t("pages").selectExpr(*select_items(RESULTS_SELECT.format(s="STRING"))))
    spans = RD.stage_spans(stage_events(t)).withColumn("fetch_id", F.expr(key.format("fetch_id", "f")))
    tries = RD.retry_outcome(t("orders").selectExpr(key.format("o_custkey", "request_id"), "o_orderkey AS attempt_order", f"{CODE_CASE} AS code"), RETRIES, BACKOFF_MS)
    more = t("pages").where("page_id % 5 = 0").selectExpr(key.format("page_id", "request_id"), "'console' AS artifact", "'artifact_tiny' AS code", "CAST(length(html) AS STRING) AS detail")
    r = assemble_results(v, warnings=more, artifacts=files, stages=spans, retries=tries, main=main_outcomes(cap_events(t)))
    whole = "map('ignoreNullFields', 'false')"
    return r.selectExpr("request_id", "request_url", "final_url", "status", f"to_json(trace, {whole}) AS trace", "page_kind", "next_action", "error_code", "retryable", "outcome",
                        f"to_json(warnings, {whole}) AS warnings", "body_file", "text_file", "network_file")


def _md(x: str) -> str:
    return f"replace(replace({x}, '[', '\\['), ']', '\\]')"


_LF = "chr(10)"


@register("t21_content_markdown", f"""WITH tp AS (SELECT page_id, url, {table_pages_html()} AS html FROM pages), {D.tokens_cte('tp')}, {D.flow_cte()}, {TABLES_D},
_w AS (SELECT page_id, table_pos, max(len(cells)) AS w FROM _b GROUP BY ALL),
_p AS (SELECT page_id, table_pos, row_no, w, '| ' || array_to_string(list_transform(list_resize(cells, w, ''), lambda c: replace({D.norm('c')}, '|', '\\|')), ' | ') || ' |' AS l
       FROM _b JOIN _w USING (page_id, table_pos)),
_tm AS (SELECT page_id, table_pos, string_agg(l || CASE WHEN row_no = 0 THEN {_LF} || '|' || repeat(' --- |', w) ELSE '' END, {_LF} ORDER BY row_no) AS body FROM _p GROUP BY ALL),
_tb AS (SELECT page_id, table_pos, CASE WHEN caption IS NOT NULL THEN '**' || {_md('caption')} || '**' || {_LF} || {_LF} ELSE '' END || body AS md
        FROM _tm LEFT JOIN _cap USING (page_id, table_pos)),
_fl AS (SELECT f.page_id, epos, CASE ekind WHEN 'heading' THEN repeat('#', least(6, greatest(2, CAST(substr(tag, 2, 1) AS INTEGER) + 1))) || ' ' || {_md('text')}
        WHEN 'paragraph' THEN text ELSE md END AS line FROM flow f LEFT JOIN _tb ON _tb.page_id = f.page_id AND _tb.table_pos = f.epos AND f.ekind = 'table'),
_fm AS (SELECT page_id, string_agg(line || {_LF}, {_LF} ORDER BY epos) AS flow_md FROM _fl WHERE line IS NOT NULL GROUP BY page_id),
_ln AS (SELECT *, CASE WHEN same_site THEN 'same-site' ELSE 'external' END AS scope FROM ({D.links_sql()})),
_lm AS (SELECT page_id, string_agg('- [' || {_md('text')} || '](' || absolute_url || ') — ' || kind || CASE WHEN kind = scope THEN '' ELSE ', ' || scope END
        || ', source: ' || source_section, {_LF} ORDER BY link_no) AS links_md FROM _ln GROUP BY page_id),
_h AS (SELECT page_id, url, {PAGE_TITLE_D} AS title FROM tp)
SELECT page_id, regexp_replace('# ' || {_md("CASE WHEN title != '' THEN title ELSE url END")} || {_LF} || {_LF} || 'URL: ' || url || {_LF} || 'Final URL: ' || url || {_LF}
  || CASE WHEN title != '' THEN 'Title: ' || title || {_LF} ELSE '' END || 'Ready State: complete' || {_LF} || {_LF} || '## Visible Content' || {_LF} || {_LF} || flow_md
  || coalesce({_LF} || '## Links' || {_LF} || {_LF} || links_md || {_LF}, ''), '\\n{{3,}}', {_LF} || {_LF}, 'g') AS markdown
FROM _h JOIN _fm USING (page_id) LEFT JOIN _lm USING (page_id)""")
def t21(t):
    """Markdown rendering of the composed content per page (nested tables, links)."""
    return DOC.content_markdown(t("pages").selectExpr("page_id", "url", f"{table_pages_html()} AS html"))


def _frame_pages(t):
    return t("pages").selectExpr("page_id", "url", f"{frame_pages_html()} AS html")


_ORIGIN = "lower(regexp_extract({0}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1))"
#: Frames of frame_pages with their own captured page, written from the element table.
FRAMES_CTE = f"""fp AS (SELECT page_id, url, {frame_pages_html()} AS html FROM pages),
{D.tokens_cte('fp')}, {D.flow_cte()},
_i0 AS (SELECT page_id, pos, url, {D.attr('src')} AS raw_src FROM ft WHERE kind = 'open' AND tag = 'iframe' AND walked),
_i1 AS ({D.resolve_stage_sql('SELECT * FROM _i0', 'url', 'raw_src', 'src')}),
_i2 AS (SELECT *, coalesce({_ORIGIN.format('src')} = {_ORIGIN.format('url')}, false) AS same FROM _i1),
_fr AS (SELECT _i2.page_id, _i2.pos, _i2.src, same, CASE WHEN same THEN p.page_id END AS child FROM _i2
        LEFT JOIN (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url) p ON p.url = _i2.src)"""


@register("t22_content_warnings", f"""WITH {FRAMES_CTE},
_e AS (SELECT page_id, 1 AS o, 0 AS pos, 'content_empty' AS code, 'no visible composed content captured' AS detail FROM pages
       WHERE page_id NOT IN (SELECT page_id FROM flow)
  UNION ALL SELECT page_id, 0, pos, CASE WHEN same THEN 'iframe_unavailable' ELSE 'iframe_cross_origin' END,
       CASE WHEN same THEN 'iframe content unavailable: ' ELSE 'cross-origin iframe not traversed: ' END || coalesce(src, CASE WHEN same THEN '(no src)' ELSE '' END)
       FROM _fr WHERE child IS NULL)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY o, pos) - 1 AS BIGINT) AS warning_no, code, detail FROM _e""")
def t22(t):
    """Content warnings of frame_pages: empty pages, unavailable and cross-origin frames."""
    return DOC.content_warnings(_frame_pages(t))


@register("t23_inline_frames", f"""WITH {FRAMES_CTE},
_k AS (SELECT _fr.page_id, _fr.pos, _fr.src, f.epos, f.ekind, f.tag, f.text,
       row_number() OVER (PARTITION BY _fr.page_id, _fr.pos ORDER BY f.epos) AS n
       FROM _fr JOIN flow f ON f.page_id = _fr.child WHERE f.ekind IN ('heading', 'paragraph'))
SELECT page_id, CAST(pos AS BIGINT) AS iframe_pos, 'Frame: ' || src AS frame_heading, CAST(0 AS BIGINT) AS entry_no, 'heading' AS kind,
       3 AS level, 'Frame: ' || src AS text FROM _fr WHERE child IS NOT NULL
UNION ALL SELECT page_id, CAST(pos AS BIGINT), 'Frame: ' || src, CAST(n AS BIGINT), ekind,
       CASE WHEN ekind = 'heading' THEN CAST(substr(tag, 2, 1) AS INTEGER) END, text FROM _k""")
def t23(t):
    """Same-origin frame content (join on the frame URL) under 'Frame: src' headings."""
    return C.inline_frame_flow(_frame_pages(t)).selectExpr("page_id", "CAST(iframe_pos AS BIGINT) AS iframe_pos", "frame_heading", "entry_no", "kind", "level", "text")


@register("t21_markdown_flow", f"""WITH {D.tokens_cte()}, {D.flow_cte()},
_l AS (SELECT page_id, epos, CASE ekind WHEN 'heading' THEN repeat('#', least(6, greatest(2, CAST(substr(tag, 2, 1) AS INTEGER) + 1)))
  || ' ' || replace(replace(text, '[', '\\['), ']', '\\]') || chr(10) WHEN 'paragraph' THEN text || chr(10) END AS line FROM flow)
SELECT page_id, string_agg(line, chr(10) ORDER BY epos) AS flow_md FROM _l WHERE line IS NOT NULL GROUP BY page_id""")
def t21f(t):
    """Markdown 'Visible Content' block (headings + paragraphs) of every page."""
    return DOC.flow_markdown(t("pages"))
