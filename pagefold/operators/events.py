"""Capture event log -> network entries, summaries, console, frames.

Events are typed rows (``EVENT_SCHEMA``) keyed by ``(session_id,
request_id)`` and ordered by a unique ``seq``. Folds that the reference runs
as "last writer wins" over a per-request slot are expressed as aggregates
(``max_by(value, seq)``), which combine map-side, so a hot session or
request costs no single task more than its share. Where a row needs a
running value (hop number), the chunked scans of ``scan.py`` are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.functions.core import lit
from pagefold.functions.redact import SECRET_MASK, masked_sql, redact_headers_sql, redact_userinfo_sql
from pagefold.operators import scan

# --- fixed values ----------------------------------------------------------
SENT = "Network.requestWillBeSent"
RESPONDED = "Network.responseReceived"
FINISHED = "Network.loadingFinished"
FAILED = "Network.loadingFailed"
CACHED = "Network.requestServedFromCache"
CONSOLE = "Runtime.consoleAPICalled"
EXCEPTION = "Runtime.exceptionThrown"
WS_SENT = "Network.webSocketFrameSent"
WS_RECEIVED = "Network.webSocketFrameReceived"
WS_ERROR = "Network.webSocketFrameError"
SSE = "Network.eventSourceMessageReceived"
DOWNLOAD = "Browser.downloadWillBegin"
PAGE_DOWNLOAD = "Page.downloadWillBegin"
XHR_TYPES = ["XHR", "Fetch", "EventSource"]
NETWORK_BODY_MAX = 10 * 1024 * 1024
STORAGE_CAP = 262144
# Mime type beginnings -> extension of a captured network body.
BODY_EXTENSIONS = [("application/json", "json"), ("text/html", "html"), ("text/css", "css"), ("application/javascript", "js"),
                   ("text/javascript", "js"), ("text/plain", "txt"), ("image/png", "png"), ("image/jpeg", "jpg"), ("image/webp", "webp"),
                   ("image/svg", "svg"), ("text/event-stream", "txt")]
RECENT_CAP = 200
LOG_RING = 200
LOG_SUMMARY_LINES = 20
LOG_SUMMARY_CHARS = 2000
# --- end fixed values -------------------------------------------------------

EVENT_SCHEMA = [
    ("session_id", "string"), ("request_id", "string"), ("seq", "bigint"), ("ts_ms", "bigint"),
    ("method", "string"), ("resource_type", "string"), ("url", "string"), ("http_method", "string"),
    ("request_headers", "string"), ("post_data", "string"), ("has_redirect", "boolean"),
    ("redirect_status", "int"), ("status", "int"), ("mime_type", "string"), ("response_headers", "string"),
    ("protocol", "string"), ("remote_address", "string"), ("timestamp_ms", "bigint"),
    ("encoded_data_length", "bigint"), ("error_text", "string"),
    ("frame_id", "string"), ("loader_id", "string"), ("initiator", "string"),
]
KEY = ["session_id", "request_id"]


def conform_events(df: DataFrame) -> DataFrame:
    """Add absent event columns as typed NULLs (in schema order)."""
    have = set(df.columns)
    cols = [c if c in have else f"CAST(NULL AS {t}) AS {c}" for c, t in EVENT_SCHEMA]
    extra = [c for c in df.columns if c not in dict(EVENT_SCHEMA)]
    return df.selectExpr(*cols, *extra)


def _fold_fields(redact: bool) -> list[tuple[str, str, str]]:
    """(field, value, events that set it) of one request slot. Header values are
    redacted before they are folded, and of a request body only its hints are
    kept: no credential reaches a state, a shuffle or a sink."""
    sent, responded, finished, failed = (f"method = '{m}'" for m in (SENT, RESPONDED, FINISHED, FAILED))
    headers = lambda c: f"to_json({redact_headers_sql(header_map_sql(c))})" if redact else c
    hints = ", ".join(payload_hints_sql())
    return [
        ("state", f"CASE method WHEN '{SENT}' THEN 'pending' WHEN '{RESPONDED}' THEN 'responded' WHEN '{FINISHED}' THEN 'finished' "
                  f"ELSE 'failed' END", f"method IN ('{SENT}', '{RESPONDED}', '{FINISHED}', '{FAILED}')"),
        ("resource_type", "coalesce(resource_type, 'Other')", sent),
        ("url", "coalesce(url, '')", sent),
        ("http_method", "coalesce(http_method, 'GET')", sent),
        ("start_ms", "timestamp_ms", sent),
        ("has_redirect", "coalesce(has_redirect, false)", sent),
        ("status", "status", responded),
        ("mime_type", "mime_type", f"{responded} AND mime_type IS NOT NULL"),
        ("protocol", "protocol", f"{responded} AND protocol IS NOT NULL"),
        ("remote_address", "remote_address", f"{responded} AND remote_address IS NOT NULL"),
        ("end_ms", "timestamp_ms", finished),
        ("encoded_data_length", "encoded_data_length", f"{finished} AND encoded_data_length IS NOT NULL"),
        ("failure", "coalesce(error_text, '')", failed),
        ("payload", f"struct({hints})", sent),
        ("frame_id", "frame_id", sent),
        ("loader_id", "loader_id", sent),
        ("initiator", "initiator", sent),
        ("request_headers", headers("request_headers"), sent),
        ("response_headers", headers("response_headers"), responded),
    ]


def slot_states(events: DataFrame, keys: list = KEY, redact: bool = True) -> DataFrame:
    """The slot of each key as one associative aggregate: every field keeps its
    last value together with that event's ``seq``. Events may come in any order
    and combine map-side; no join, and no task holds a hot key. The same
    aggregate runs on a stream (where one of ``keys`` is a window)."""
    return events.groupBy(*keys).agg(
        F.expr(f"max(seq) FILTER (WHERE method = '{SENT}') AS _send"),
        F.expr(f"count_if(method = '{SENT}') AS n_sends"),
        F.expr(f"max(seq) FILTER (WHERE method = '{CACHED}') AS _cached"),
        *[F.expr(f"max_by(struct(seq AS q, {value} AS v), seq) FILTER (WHERE {when}) AS {name}") for name, value, when in _fold_fields(redact)])


def slot_entries(states: DataFrame, keys: list[str] = KEY, redact: bool = True) -> DataFrame:
    """Entries of slot states: what is older than the last send belongs to an
    earlier slot and becomes NULL; keys without a send vanish."""
    cols = []
    for name, _, _ in _fold_fields(redact):
        value = f"CASE WHEN {name}.q >= _send THEN {name}.v END"
        cols.append(f"{header_map_sql(value) if name.endswith('_headers') else value} AS {name}")
    out = states.where("_send IS NOT NULL").selectExpr(*keys, *cols, "coalesce(_cached >= _send, false) AS served_from_cache", "n_sends")
    return out.selectExpr(*[c for c in out.columns if c != "payload"], "payload.*", "CASE WHEN has_redirect THEN request_id END AS redirect_from_request_id",
                          f"{str(redact).lower()} AS redacted")


def network_entries(events: DataFrame, redact: bool = True, bodies: DataFrame | None = None) -> DataFrame:
    """One row per (session, request): the fold of its last send's slot.

    ``requestWillBeSent`` replaces the slot; keys without a send vanish.
    Header maps come with credential values redacted unless ``redact`` is off; a
    request body is told by its hints (E5). ``bodies`` (session_id, request_id,
    body_file) gives the files of captured bodies (E11); without it there are none.
    """
    entries = slot_entries(slot_states(conform_events(events), redact=redact), redact=redact)
    if bodies is None:
        return entries.selectExpr("*", "CAST(NULL AS STRING) AS body_file")
    files = bodies.where("body_file IS NOT NULL").groupBy(*KEY).agg(F.min("body_file").alias("body_file"))
    return entries.join(files, KEY, "left")


def main_request(events: DataFrame) -> DataFrame:
    """First Document request per session."""
    e = conform_events(events)
    return e.where(f"method = '{SENT}' AND resource_type = 'Document'").groupBy("session_id").agg(
        F.expr("min_by(request_id, seq) AS main_request_id"))


def redirect_hops(events: DataFrame) -> DataFrame:
    """Every hop of every request. A resend carrying ``redirectResponse``
    finalizes the previous hop (its status, ``finished``, ``redirected``).
    Hop numbers are a skew-safe running count of sends per key."""
    e = conform_events(events)
    e = scan.running_sum(e, KEY, "seq", f"CASE WHEN method = '{SENT}' THEN 1 ELSE 0 END", "hop_no")
    keys = [*KEY, "hop_no"]
    hops = slot_entries(slot_states(e.where("hop_no > 0"), keys), keys)
    nxt = e.where(f"method = '{SENT}'").selectExpr(
        *KEY, "hop_no - 1 AS hop_no", "coalesce(has_redirect, false) AS _next_redirect",
        "redirect_status AS _next_status")
    j = hops.join(nxt, KEY + ["hop_no"], "left")
    return j.selectExpr(
        *KEY, "CAST(hop_no AS BIGINT) AS hop_no",
        "CASE WHEN coalesce(_next_redirect, false) THEN 'finished' ELSE state END AS state",
        "CASE WHEN coalesce(_next_redirect, false) THEN _next_status ELSE status END AS status",
        "coalesce(_next_redirect, false) AS redirected", "resource_type", "url",
        "CASE WHEN has_redirect THEN request_id END AS redirect_from_request_id")


def payload_hints_sql(post: str = "post_data") -> list[str]:
    """E5: request body hints as SQL select items."""
    v = f"try_parse_json({post})"
    op = f"try_variant_get({v}, '$.operationName')"
    return [
        f"{post} IS NOT NULL AS post_data_present",
        f"CAST(octet_length({post}) AS BIGINT) AS post_data_size_bytes",
        f"{post} IS NOT NULL AND {v} IS NOT NULL AS request_body_json_valid",
        f"CASE WHEN schema_of_variant({op}) = 'STRING' THEN CAST({op} AS STRING) END AS graphql_operation_name",
        f"CASE WHEN try_variant_get({v}, '$.query') IS NOT NULL THEN 'request' END AS graphql_operation_type",
    ]


def header_map_sql(json: str) -> str:
    """JSON object text -> map<string,string>; non-strings keep their JSON text."""
    return f"from_json({json}, 'map<string,string>')"


def network_summary(entries: DataFrame) -> DataFrame:
    """Per-session totals; ``redacted`` says whether all entries are,
    ``captured_body_files`` counts entries with a ``body_file``, and
    ``pending_by_resource_type`` maps the types that are in flight to their
    numbers (E8, nested). Entries are counted by session and type first, so a hot
    session is combined map-side and its last step has one row a type."""
    files = "count(body_file)" if "body_file" in entries.columns else "CAST(0 AS BIGINT)"
    flag = "bool_and(redacted)" if "redacted" in entries.columns else "false"
    by_type = entries.groupBy("session_id", "resource_type").agg(*[F.expr(a) for a in [
        "count(*) AS _n", "count_if(status IS NOT NULL) AS _r", "count_if(state = 'finished') AS _d",
        "count_if(state = 'failed' OR failure IS NOT NULL) AS _f", "count_if(state IN ('pending', 'responded')) AS _p",
        f"{files} AS _b", f"{flag} AS _x"]])
    total = by_type.groupBy("session_id").agg(*[F.expr(a) for a in [
        "sum(_n) AS requests_total", "sum(_r) AS responses_total", "sum(_d) AS finished_total", "sum(_f) AS failed_total",
        "sum(_p) AS incomplete_total", "sum(_p) AS inflight_total_at_capture",
        "map_from_entries(sort_array(collect_list(CASE WHEN _p > 0 THEN struct(resource_type, _p) END))) AS pending_by_resource_type",
        "sum(_b) AS captured_body_files", "bool_and(_x) AS redacted"]])
    return total


def pending_by_resource_type(entries: DataFrame) -> DataFrame:
    """pending+responded entries per (session, resource type)."""
    return entries.where("state IN ('pending', 'responded')").groupBy("session_id", "resource_type").agg(
        F.count("*").alias("n_pending"))


def network_warnings(entries: DataFrame, readiness_timed_out: DataFrame | None = None) -> DataFrame:
    """``network_not_idle``, ``pending_xhr_at_capture`` (and
    ``readiness_timeout`` when a readiness table is given), one row each."""
    xhr = ", ".join(lit(x) for x in XHR_TYPES)
    s = entries.groupBy("session_id").agg(
        F.expr("count_if(state IN ('pending', 'responded')) AS _inflight"),
        F.expr(f"count_if(state IN ('pending', 'responded') AND resource_type IN ({xhr})) AS _xhr"))
    w = s.selectExpr("session_id", "explode(array_compact(array("
                     "CASE WHEN _inflight > 0 THEN 'network_not_idle' END, "
                     "CASE WHEN _xhr > 0 THEN 'pending_xhr_at_capture' END))) AS code")
    if readiness_timed_out is not None:
        w = w.unionByName(readiness_timed_out.where("timed_out").selectExpr("session_id", "'readiness_timeout' AS code"))
    return w.selectExpr("session_id", "'network' AS artifact", "code")


def body_capture_plan(entries: DataFrame, mode: str = "xhr", wait_auto: bool = False) -> DataFrame:
    """Request ids whose bodies are fetched: off / xhr / all; ``off``
    with wait auto behaves as xhr; only finished or failed requests."""
    if mode == "off" and wait_auto:
        mode = "xhr"
    if mode == "off":
        return entries.where("false").select(*KEY)
    cond = "state IN ('finished', 'failed')"
    if mode == "xhr":
        cond += " AND resource_type IN (" + ", ".join(lit(x) for x in XHR_TYPES) + ")"
    return entries.where(cond).select(*KEY, "resource_type", "mime_type")


def network_bodies(bodies: DataFrame, max_bytes: int = NETWORK_BODY_MAX) -> DataFrame:
    """Decode (base64 when flagged), cut at ``max_bytes`` (flagged only
    when over), JSON validity for json mime types, file extension by the mime
    type's beginning. Input columns:
    ``body`` string, ``base64_encoded`` boolean, ``mime_type`` string."""
    ext = "CASE " + " ".join(f"WHEN startswith(mime_type, {lit(p)}) THEN {lit(x)}" for p, x in BODY_EXTENSIONS) + " ELSE 'bin' END"
    raw = "CASE WHEN coalesce(base64_encoded, false) THEN try_to_binary(body, 'base64') ELSE CAST(body AS BINARY) END"
    b = bodies.selectExpr("*", f"{raw} AS _bytes")
    b = b.selectExpr("*", "_bytes IS NULL AND coalesce(base64_encoded, false) AS capture_failed",
                     f"substring(_bytes, 1, {int(max_bytes)}) AS body_bytes",
                     f"coalesce(octet_length(_bytes) > {int(max_bytes)}, false) AS truncated")
    return b.selectExpr("*", "CASE WHEN contains(lower(coalesce(mime_type, '')), 'json') THEN "
                             "try_parse_json(CAST(body_bytes AS STRING)) IS NOT NULL END AS json_valid", f"{ext} AS extension").drop("_bytes")


def console_events(events: DataFrame) -> DataFrame:
    """Console API calls and exceptions -> (level, text, url, line).

    Reads the CDP ``params`` JSON when the column is present (args,
    ``stackTrace.callFrames[0]``, ``exceptionDetails``); otherwise the
    columns ``console_type``, ``args`` (JSON array of remote objects),
    ``exception_json``, ``stack_url``, ``stack_line``. An argument
    contributes its string value, else its description, else its JSON
    value; arguments with none of these are skipped."""
    c = events.where(f"method IN ('{CONSOLE}', '{EXCEPTION}')")
    if "params" in events.columns:
        c = c.selectExpr(
            "*", "get_json_object(params, '$.type') AS console_type", "get_json_object(params, '$.args') AS args",
            "get_json_object(params, '$.exceptionDetails') AS exception_json",
            f"CASE WHEN method = '{EXCEPTION}' THEN get_json_object(params, '$.exceptionDetails.url') "
            "ELSE get_json_object(params, '$.stackTrace.callFrames[0].url') END AS stack_url",
            f"CAST(CASE WHEN method = '{EXCEPTION}' THEN get_json_object(params, '$.exceptionDetails.lineNumber') "
            "ELSE get_json_object(params, '$.stackTrace.callFrames[0].lineNumber') END AS INT) AS stack_line")
    arg_t = "array<struct<type:string,value:string,description:string>>"
    args = f"from_json(args, '{arg_t}')"
    text = (f"array_join(filter(transform({args}, _x -> coalesce(CASE WHEN _x.type = 'string' THEN _x.value END, "
            f"_x.description, _x.value)), _t -> _t IS NOT NULL), ' ')")
    level = ("CASE lower(coalesce(console_type, 'log')) WHEN 'warning' THEN 'warn' WHEN 'warn' THEN 'warn' "
             "WHEN 'error' THEN 'error' WHEN 'info' THEN 'info' WHEN 'debug' THEN 'debug' ELSE 'log' END")
    ex_text = ("coalesce(get_json_object(exception_json, '$.exception.description'), "
               "get_json_object(exception_json, '$.text'), 'exception')")
    return c.where(f"method != '{EXCEPTION}' OR exception_json IS NOT NULL").selectExpr(
        "session_id", "seq", "ts_ms",
        f"CASE WHEN method = '{EXCEPTION}' THEN 'exception' ELSE {level} END AS level",
        f"CASE WHEN method = '{EXCEPTION}' THEN {ex_text} ELSE coalesce({text}, '') END AS text",
        "stack_url AS url", "stack_line AS line_number")


def console_level_counts(console: DataFrame) -> DataFrame:
    """Events per (session, level)."""
    return console.groupBy("session_id", "level").agg(F.count("*").alias("n"))


def ws_frames(events: DataFrame) -> DataFrame:
    """WebSocket frames (sent / received / error); empty request ids dropped."""
    f = events.where(f"method IN ('{WS_SENT}', '{WS_RECEIVED}', '{WS_ERROR}') AND coalesce(request_id, '') != ''")
    return f.selectExpr("session_id", "request_id", "seq", "ts_ms",
                        f"CASE method WHEN '{WS_SENT}' THEN 'sent' WHEN '{WS_RECEIVED}' THEN 'received' ELSE 'error' END AS direction",
                        "coalesce(opcode, 1) AS opcode", "coalesce(mask, false) AS mask", "payload_data", "error_message")


def sse_messages(events: DataFrame) -> DataFrame:
    """Server-sent event messages; empty request ids dropped."""
    f = events.where(f"method = '{SSE}' AND coalesce(request_id, '') != ''")
    return f.selectExpr("session_id", "request_id", "seq", "ts_ms", "event_name", "data", "event_id")


def recent_requests(events: DataFrame, cap: int = RECENT_CAP) -> DataFrame:
    """The last ``cap`` request/response records per session, oldest
    first (``row_number() <= cap``: Spark applies the limit per map task
    before the shuffle, so a hot session ships at most ``cap`` rows per task)."""
    e = conform_events(events).where(f"method IN ('{SENT}', '{RESPONDED}')")
    r = e.selectExpr("*", "row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS _rn").where(f"_rn <= {int(cap)}")
    return r.selectExpr("session_id", "seq", f"CASE WHEN method = '{SENT}' THEN 'request' ELSE 'response' END AS type",
                        "request_id", "coalesce(url, '') AS url",
                        f"CASE WHEN method = '{RESPONDED}' THEN coalesce(status, 0) END AS status",
                        "coalesce(resource_type, '') AS resource_type")


def log_tail_sql(text: str, ring_lines: int = LOG_RING, summary_lines: int = LOG_SUMMARY_LINES,
                 summary_chars: int = LOG_SUMMARY_CHARS) -> list[str]:
    """Ring of the last ``ring_lines`` lines; summary of the last
    ``summary_lines`` joined by `` | `` (passwords in URLs masked), its last
    ``summary_chars`` characters with ``...``. The tail is the feature."""
    lines = f"CASE WHEN {text} IS NULL OR {text} = '' THEN array() ELSE split(regexp_replace({text}, '\\r?\\n$', ''), '\\r?\\n') END"
    ring = f"slice({lines}, greatest(size({lines}) - {ring_lines - 1}, 1), {ring_lines})"
    last = f"slice({lines}, greatest(size({lines}) - {summary_lines - 1}, 1), {summary_lines})"
    joined = f"array_join(transform({last}, _l -> {redact_userinfo_sql('_l')}), ' | ')"
    return [f"CAST(size({ring}) AS BIGINT) AS lines_kept",
            f"CASE WHEN length({joined}) > {summary_chars} THEN concat('...', right({joined}, {summary_chars})) "
            f"ELSE {joined} END AS summary"]


def redact_secret_fields(df: DataFrame, mask: str = SECRET_MASK) -> DataFrame:
    """Every field whose name ends in ``_secret`` is replaced by ``mask``,
    in nested structs, arrays and string-keyed maps too. The schema walk
    happens on the driver; the rewrite is one native projection."""
    cols = [f"CAST({lit(mask)} AS STRING) AS `{f.name}`" if f.name.endswith("_secret") else
            f"{masked_sql('`' + f.name + '`', f.dataType, mask)} AS `{f.name}`" for f in df.schema.fields]
    return df.selectExpr(*cols)


def download_navigations(events: DataFrame) -> DataFrame:
    """Sessions whose navigation became a download: a browser-level
    downloadWillBegin, a page-level one in the same session, or an
    ``is_download`` flag; a lone ERR_ABORTED is not a download. Browser-level
    events without a session are left out."""
    e = events.where("session_id IS NOT NULL").selectExpr("*", f"method IN ('{DOWNLOAD}', '{PAGE_DOWNLOAD}') OR coalesce(is_download, false) AS _dl")
    return e.groupBy("session_id").agg(F.expr("bool_or(_dl) AS is_download"))


def latest_download(files: DataFrame, before: DataFrame) -> DataFrame:
    """Newest complete file per directory not present before
    (left anti join on path; ``.crdownload`` partials excluded)."""
    new = files.where("NOT endswith(path, '.crdownload')").join(before.select("dir", "path"), ["dir", "path"], "left_anti")
    return new.groupBy("dir").agg(F.expr("max_by(path, mtime) AS path"))


def storage_snapshot_cap(df: DataFrame, cap: int = STORAGE_CAP) -> DataFrame:
    """When the serialized snapshot exceeds ``cap`` bytes, null the
    maps, empty the IndexedDB list and add a note."""
    size = "octet_length(to_json(named_struct('local_storage', local_storage, 'session_storage', session_storage, 'indexed_db', indexed_db)))"
    d = df.selectExpr("*", f"{size} > {int(cap)} AS _over")
    return d.selectExpr(
        *[c for c in df.columns if c not in ("local_storage", "session_storage", "indexed_db")],
        "CASE WHEN _over THEN NULL ELSE local_storage END AS local_storage",
        "CASE WHEN _over THEN NULL ELSE session_storage END AS session_storage",
        "CASE WHEN _over THEN array() ELSE indexed_db END AS indexed_db",
        f"CASE WHEN _over THEN concat('storage snapshot exceeded {int(cap)} bytes') END AS note")
