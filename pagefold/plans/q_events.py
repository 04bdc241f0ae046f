"""Queries for the capture event log (E1-E18) over the cap_events adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.functions.redact import ALWAYS_REDACTED, REDACTED_SUFFIXES, redact_headers_sql, redact_userinfo_sql
from pagefold.operators import events as E
from pagefold.plans import duck as D
from pagefold.plans.sqlutil import select_items
from pagefold.plans.registry import register

# --- fixed values: cap_events adapter (FIXTURES 2.1, 2.2) --------------------
METHOD_BY_TYPE = [("view", E.SENT), ("click", E.RESPONDED), ("purchase", E.FINISHED), ("error", E.FAILED),
                  ("signup", E.CACHED)]
RESOURCE_TYPES = ["Document", "XHR", "Fetch", "EventSource", "Script", "Image"]
STATUSES = [200, 302, 404, 503]
HEADER_NAMES = ["Cookie", "SET-COOKIE", "Authorization", "Proxy-Authorization", "X-Api-Token", "x-shared-secret",
                "Content-Type", "X-Trace-Id"]
CONSOLE_TYPES = ["log", "warning", "error", "info", "debug", "warn", "table"]
# --- end fixed values -------------------------------------------------------

K_SPARK = "CAST(get_json_object(props, '$.k') AS INT)"
K_DUCK = "CAST(json_extract(props, '$.k') AS INTEGER)"
TS_SPARK = "unix_millis(CAST(ts AS TIMESTAMP))"
TS_DUCK = "(epoch_us(ts) // 1000)"


def cap_events_select(k: str, ts: str) -> str:
    method = "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{m}'" for t, m in METHOD_BY_TYPE) + " END"
    rtype = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(RESOURCE_TYPES)) + " END"
    status = ("CASE WHEN event_type = 'click' THEN CASE event_id % 4 "
              + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(STATUSES)) + " END END")
    post = (f"CASE WHEN event_type = 'view' THEN CASE ({k}) % 4 "
            f"WHEN 0 THEN concat('{{\"operationName\":\"Op', CAST({k} AS STRING), '\",\"query\":\"q\"}}') "
            f"WHEN 1 THEN concat('{{\"a\":', CAST({k} AS STRING), '}}') WHEN 2 THEN 'not json' END END")
    return f"""concat('s', CAST(user_id AS STRING)) AS session_id, concat('r', CAST(({k}) % 8 AS STRING)) AS request_id,
  event_id AS seq, {ts} AS ts_ms, {method} AS method, {rtype} AS resource_type,
  CASE WHEN event_type = 'view' THEN concat('https://h', CAST(user_id AS STRING), '.example.com/p', CAST({k} AS STRING)) END AS url,
  CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END END AS http_method,
  {post} AS post_data,
  CASE WHEN event_type = 'view' THEN event_id % 5 = 0 END AS has_redirect,
  CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN 302 END AS redirect_status,
  {status} AS status,
  CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'text/html' END END AS mime_type,
  {ts} AS timestamp_ms,
  CASE WHEN event_type = 'purchase' THEN event_id * 10 END AS encoded_data_length,
  CASE WHEN event_type = 'error' THEN concat('net::ERR_', CAST(event_id % 3 AS STRING)) END AS error_text,
  CASE WHEN event_type = 'view' THEN concat('{{\"Authorization\":\"Bearer b', CAST(event_id AS STRING), '\",\"Accept\":\"a', CAST(event_id % 7 AS STRING), '\"}}') END AS request_headers,
  CASE WHEN event_type = 'click' THEN concat('{{\"Set-Cookie\":\"c=', CAST(event_id AS STRING), '\",\"x-run-token\":\"t\",\"Server\":\"s', CAST(event_id % 3 AS STRING), '\"}}') END AS response_headers,
  ({k}) AS k, event_id, user_id, event_type"""


def _duck_select(sel: str) -> str:
    return sel.replace("AS STRING)", "AS VARCHAR)")


def cap_events(t):
    return t("events").selectExpr(*select_items(cap_events_select(K_SPARK, TS_SPARK)))


CE = (f"ce AS (SELECT {_duck_select(cap_events_select(K_DUCK, TS_DUCK))}, NULL::VARCHAR AS protocol, "
      "NULL::VARCHAR AS remote_address FROM events)")
DUCK_FOLD = f"""
  arg_max(CASE method WHEN '{E.SENT}' THEN 'pending' WHEN '{E.RESPONDED}' THEN 'responded' WHEN '{E.FINISHED}' THEN 'finished' WHEN '{E.FAILED}' THEN 'failed' END, seq)
    FILTER (WHERE method != '{E.CACHED}') AS state,
  arg_max_null(coalesce(resource_type, 'Other'), seq) FILTER (WHERE method = '{E.SENT}') AS resource_type,
  arg_max_null(coalesce(url, ''), seq) FILTER (WHERE method = '{E.SENT}') AS url,
  arg_max_null(coalesce(http_method, 'GET'), seq) FILTER (WHERE method = '{E.SENT}') AS http_method,
  arg_max_null(timestamp_ms, seq) FILTER (WHERE method = '{E.SENT}') AS start_ms,
  arg_max_null(coalesce(has_redirect, false), seq) FILTER (WHERE method = '{E.SENT}') AS has_redirect,
  arg_max_null(status, seq) FILTER (WHERE method = '{E.RESPONDED}') AS status,
  arg_max(mime_type, seq) FILTER (WHERE method = '{E.RESPONDED}') AS mime_type,
  arg_max_null(timestamp_ms, seq) FILTER (WHERE method = '{E.FINISHED}') AS end_ms,
  arg_max(encoded_data_length, seq) FILTER (WHERE method = '{E.FINISHED}') AS encoded_data_length,
  arg_max_null(coalesce(error_text, ''), seq) FILTER (WHERE method = '{E.FAILED}') AS failure,
  count_if(method = '{E.CACHED}') > 0 AS served_from_cache,
  arg_max_null(post_data, seq) FILTER (WHERE method = '{E.SENT}') AS _post,
  arg_max_null(request_headers, seq) FILTER (WHERE method = '{E.SENT}') AS request_headers,
  arg_max_null(response_headers, seq) FILTER (WHERE method = '{E.RESPONDED}') AS response_headers"""
ENTRIES_D = f"""{CE},
_ls AS (SELECT session_id, request_id, max(seq) AS _last_send, count(*) AS n_sends FROM ce WHERE method = '{E.SENT}' GROUP BY ALL),
_sl AS (SELECT ce.*, _ls._last_send, _ls.n_sends FROM ce JOIN _ls USING (session_id, request_id) WHERE seq >= _last_send),
ne AS (SELECT session_id, request_id, {DUCK_FOLD}, first(n_sends) AS n_sends FROM _sl GROUP BY session_id, request_id)"""
ENTRY_COLS = ("session_id, request_id, state, resource_type, url, http_method, start_ms, status, mime_type, end_ms, "
              "encoded_data_length, failure, served_from_cache, CAST(n_sends AS BIGINT) AS n_sends")


def entries(t):
    return E.network_entries(cap_events(t))


#: Captured bodies: requests with a finished event of even id have a file.
BODIES = "concat('network/', session_id, '-', request_id, '.bin') AS body_file"


def entries_with_bodies(t):
    ev = cap_events(t)
    files = ev.where(f"method = '{E.FINISHED}' AND event_id % 2 = 0").selectExpr("session_id", "request_id", BODIES).distinct()
    return E.network_entries(ev, bodies=files)


BODY_FILES_D = f"_bf AS (SELECT DISTINCT session_id, request_id, {BODIES} FROM ce WHERE method = '{E.FINISHED}' AND event_id % 2 = 0)"
HINTS = "post_data_present, post_data_size_bytes, request_body_json_valid, graphql_operation_name, graphql_operation_type"


def hints_d(post: str) -> str:
    j = f"TRY_CAST({post} AS JSON)"
    return (f"{post} IS NOT NULL AS post_data_present, CAST(octet_length(encode({post})) AS BIGINT) AS post_data_size_bytes, "
            f"{post} IS NOT NULL AND {j} IS NOT NULL AS request_body_json_valid, "
            f"CASE WHEN json_type({j}, '$.operationName') = 'VARCHAR' THEN json_extract_string({j}, '$.operationName') END AS graphql_operation_name, "
            f"CASE WHEN json_exists({j}, '$.query') THEN 'request' END AS graphql_operation_type")


HEADERS_D = """CASE WHEN request_headers IS NOT NULL THEN '[redacted]' END AS authorization, json_extract_string(request_headers, '$.Accept') AS accept,
  CASE WHEN response_headers IS NOT NULL THEN '[redacted]' END AS set_cookie, CASE WHEN response_headers IS NOT NULL THEN '[redacted]' END AS run_token,
  json_extract_string(response_headers, '$.Server') AS server"""


HEADERS_S = ["request_headers['Authorization'] AS authorization", "request_headers['Accept'] AS accept",
             "response_headers['Set-Cookie'] AS set_cookie", "response_headers['x-run-token'] AS run_token", "response_headers['Server'] AS server"]


@register("e1_network_entries", f"""WITH {ENTRIES_D}, {BODY_FILES_D}
SELECT {ENTRY_COLS}, CASE WHEN has_redirect THEN request_id END AS redirect_from_request_id, {hints_d('_post')}, body_file, {HEADERS_D}
FROM ne LEFT JOIN _bf USING (session_id, request_id)""")
def e1(t):
    """Per-request fold: last send replaces the slot, last event wins per field;
    credential headers come redacted, request bodies as hints, captured ones with their file."""
    return entries_with_bodies(t).selectExpr(*[c.strip() for c in ENTRY_COLS.split(",")], "redirect_from_request_id",
                                             *HINTS.split(", "), "body_file", *HEADERS_S)


@register("e2_main_request", f"WITH {CE}\nSELECT session_id, arg_min(request_id, seq) AS main_request_id FROM ce "
                             f"WHERE method = '{E.SENT}' AND resource_type = 'Document' GROUP BY session_id")
def e2(t):
    """First Document request per session."""
    return E.main_request(cap_events(t))


@register("e3_redirect_hops", f"""WITH {CE},
_h AS (SELECT *, sum(CASE WHEN method = '{E.SENT}' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, request_id ORDER BY seq
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hop_no FROM ce),
_f AS (SELECT session_id, request_id, hop_no, {DUCK_FOLD} FROM _h WHERE hop_no > 0 GROUP BY session_id, request_id, hop_no),
_n AS (SELECT session_id, request_id, hop_no - 1 AS hop_no, coalesce(has_redirect, false) AS _nr, redirect_status AS _ns FROM _h WHERE method = '{E.SENT}')
SELECT session_id, request_id, CAST(hop_no AS BIGINT) AS hop_no, CASE WHEN coalesce(_nr, false) THEN 'finished' ELSE state END AS state,
  CASE WHEN coalesce(_nr, false) THEN _ns ELSE status END AS status, coalesce(_nr, false) AS redirected, resource_type, url,
  CASE WHEN has_redirect THEN request_id END AS redirect_from_request_id
FROM _f LEFT JOIN _n USING (session_id, request_id, hop_no)""")
def e3(t):
    """Every hop of every request; a redirecting resend finalizes the previous hop."""
    return E.redirect_hops(cap_events(t))


HDR_CASE = "CASE k % 8 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADER_NAMES)) + " END"
SENS_D = ("(lower(hname) IN (" + ", ".join(f"'{h}'" for h in ALWAYS_REDACTED) + ") OR "
          + " OR ".join(f"ends_with(lower(hname), '{s}')" for s in REDACTED_SUFFIXES) + ")")


@register("e4_redact_headers", f"""WITH {CE}, _x AS (SELECT session_id, seq, {HDR_CASE} AS hname, concat('v', CAST(event_id AS VARCHAR)) AS hval FROM ce)
SELECT session_id, seq, hname AS header, CASE WHEN {SENS_D} THEN '[redacted]' ELSE hval END AS value FROM _x""")
def e4(t):
    """Credential-bearing headers redacted (case-insensitive names and suffixes)."""
    x = cap_events(t).selectExpr("session_id", "seq", f"map({HDR_CASE}, concat('v', CAST(event_id AS STRING))) AS headers")
    x = x.selectExpr("session_id", "seq", f"{redact_headers_sql('headers')} AS headers")
    return x.selectExpr("session_id", "seq", "explode(headers) AS (header, value)")


@register("e5_payload_hints", f"""WITH {CE}, _x AS (SELECT session_id, seq, post_data, TRY_CAST(post_data AS JSON) AS j FROM ce WHERE method = '{E.SENT}')
SELECT session_id, seq, post_data IS NOT NULL AS post_data_present, CAST(octet_length(encode(post_data)) AS BIGINT) AS post_data_size_bytes,
  post_data IS NOT NULL AND j IS NOT NULL AS request_body_json_valid,
  CASE WHEN json_type(j, '$.operationName') = 'VARCHAR' THEN json_extract_string(j, '$.operationName') END AS graphql_operation_name,
  CASE WHEN json_exists(j, '$.query') THEN 'request' END AS graphql_operation_type FROM _x""")
def e5(t):
    """Request-body hints: presence, size, JSON validity, GraphQL name/type."""
    return cap_events(t).where(f"method = '{E.SENT}'").selectExpr("session_id", "seq", *E.payload_hints_sql())


@register("e7_network_summary", f"""WITH {ENTRIES_D}, {BODY_FILES_D},
_p AS (SELECT session_id, string_agg('"' || resource_type || '":' || n, ',' ORDER BY resource_type) AS pending FROM (
  SELECT session_id, resource_type, count(*) AS n FROM ne WHERE state IN ('pending', 'responded') GROUP BY ALL) GROUP BY session_id)
SELECT session_id, count(*) AS requests_total, CAST(count_if(status IS NOT NULL) AS BIGINT) AS responses_total,
  CAST(count_if(state = 'finished') AS BIGINT) AS finished_total,
  CAST(count_if(state = 'failed' OR failure IS NOT NULL) AS BIGINT) AS failed_total,
  CAST(count_if(state NOT IN ('finished', 'failed')) AS BIGINT) AS incomplete_total,
  CAST(count_if(state IN ('pending', 'responded')) AS BIGINT) AS inflight_total_at_capture,
  '{{' || coalesce(any_value(pending), '') || '}}' AS pending_by_resource_type, count(body_file) AS captured_body_files, true AS redacted
FROM ne LEFT JOIN _bf USING (session_id, request_id) LEFT JOIN _p USING (session_id) GROUP BY session_id""")
def e7(t):
    """Per-session network totals, with the types in flight as JSON."""
    return E.network_summary(entries_with_bodies(t)).withColumn("pending_by_resource_type", F.to_json("pending_by_resource_type"))


@register("e8_pending_by_resource_type", f"""WITH {ENTRIES_D}
SELECT session_id, resource_type, count(*) AS n_pending FROM ne WHERE state IN ('pending', 'responded') GROUP BY ALL""")
def e8(t):
    """In-flight requests per session and resource type."""
    return E.pending_by_resource_type(entries(t))


@register("e9_network_warnings", f"""WITH {ENTRIES_D},
_s AS (SELECT session_id, count_if(state IN ('pending', 'responded')) AS i,
       count_if(state IN ('pending', 'responded') AND resource_type IN ('XHR', 'Fetch', 'EventSource')) AS x FROM ne GROUP BY ALL)
SELECT session_id, 'network' AS artifact, 'network_not_idle' AS code FROM _s WHERE i > 0
UNION ALL SELECT session_id, 'network', 'pending_xhr_at_capture' FROM _s WHERE x > 0""")
def e9(t):
    """Readiness warnings from the network state at capture."""
    return E.network_warnings(entries(t))


@register("e10_body_capture_plan", f"""WITH {ENTRIES_D}
SELECT session_id, request_id, resource_type, mime_type FROM ne
WHERE state IN ('finished', 'failed') AND resource_type IN ('XHR', 'Fetch', 'EventSource')""")
def e10(t):
    """Bodies to capture in xhr mode (finished or failed XHR/Fetch/EventSource)."""
    return E.body_capture_plan(entries(t), "off", wait_auto=True)


@register("e16_recent_requests", f"""WITH {CE},
_r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS _rn FROM ce WHERE method IN ('{E.SENT}', '{E.RESPONDED}'))
SELECT session_id, seq, CASE WHEN method = '{E.SENT}' THEN 'request' ELSE 'response' END AS type, request_id, coalesce(url, '') AS url,
  CASE WHEN method = '{E.RESPONDED}' THEN coalesce(status, 0) END AS status, coalesce(resource_type, '') AS resource_type
FROM _r WHERE _rn <= 20""")
def e16(t):
    """Last 20 request/response records per session."""
    return E.recent_requests(cap_events(t), 20)


@register("e17_log_tail", f"""WITH _d AS (SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN []::VARCHAR[]
    ELSE string_split_regex(regexp_replace(text, '\\r?\\n$', ''), '\\r?\\n') END AS lines FROM documents),
_s AS (SELECT doc_id, lines, array_to_string(list_transform(lines[greatest(len(lines) - 19, 1):],
       lambda l: regexp_replace(l, {D.q(r"://([^/?#\s:@]*):[^/?#\s@]*@")}, '://\\1:***@', 'g')), ' | ') AS j FROM _d)
SELECT doc_id, CAST(len(lines[greatest(len(lines) - 199, 1):]) AS BIGINT) AS lines_kept,
  CASE WHEN length(j) > 2000 THEN '...' || right(j, 2000) ELSE j END AS summary FROM _s""")
def e17(t):
    """Log ring of the last 200 lines and the 20-line summary, per document."""
    return t("documents").selectExpr("doc_id", *E.log_tail_sql("text"))


@register("e18_redact_userinfo", f"""WITH {CE},
_l AS (SELECT seq, CASE WHEN event_id % 2 = 0 THEN concat('launch --proxy-server=http://u', CAST(user_id AS VARCHAR), ':p', CAST(k AS VARCHAR), '@proxy:8080 done')
       ELSE concat('http://u', CAST(user_id AS VARCHAR), '@host/x') END AS line FROM ce)
SELECT seq, regexp_replace(line, {D.q(r"://([^/?#\s:@]*):[^/?#\s@]*@")}, '://\\1:***@', 'g') AS line FROM _l""")
def e18(t):
    """Passwords of scheme://user:pass@ masked in log lines; the rest unchanged."""
    line = ("CASE WHEN event_id % 2 = 0 THEN concat('launch --proxy-server=http://u', CAST(user_id AS STRING), ':p', "
            "CAST(k AS STRING), '@proxy:8080 done') ELSE concat('http://u', CAST(user_id AS STRING), '@host/x') END")
    return cap_events(t).selectExpr("seq", f"{line} AS _line").selectExpr("seq", f"{redact_userinfo_sql('_line')} AS line")


CONSOLE_D = ("CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CONSOLE_TYPES)) + " END")
LEVEL_D = ("CASE WHEN event_type = 'error' THEN 'exception' ELSE CASE lower(ct) WHEN 'warning' THEN 'warn' WHEN 'warn' THEN 'warn' "
           "WHEN 'error' THEN 'error' WHEN 'info' THEN 'info' WHEN 'debug' THEN 'debug' ELSE 'log' END END")


@register("e13_console_level_counts", f"""WITH {CE}, _c AS (SELECT *, {CONSOLE_D} AS ct FROM ce)
SELECT session_id, {LEVEL_D} AS level, count(*) AS n FROM _c GROUP BY ALL""")
def e13(t):
    """Console events per session and level (errors become exceptions)."""
    c = cap_events(t).selectExpr(
        "session_id", "seq", "ts_ms", "event_type",
        f"CASE WHEN event_type = 'error' THEN '{E.EXCEPTION}' ELSE '{E.CONSOLE}' END AS method",
        f"{CONSOLE_D} AS console_type",
        "concat('[{\"type\":\"string\",\"value\":\"v', CAST(seq AS STRING), '\"}]') AS args",
        "'{\"text\":\"Uncaught\"}' AS exception_json", "CAST(NULL AS STRING) AS stack_url",
        "CAST(NULL AS INT) AS stack_line")
    return E.console_level_counts(E.console_events(c))
