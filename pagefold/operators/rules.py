"""Classification, escalation planning and quality rules.

All rules are column expressions (``*_sql`` return Spark SQL text) applied
row-wise; the dimension lookups (error codes, public suffixes) are broadcast
joins against tables whose size is fixed or checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.session import cut_lineage
from pagefold import dims
from pagefold.functions.core import let, lit
from pagefold.functions.text import JS_SPACE
from pagefold.functions.url import url_host_sql

# --- fixed values ----------------------------------------------------------
CLOUDFLARE_MARKERS = ["cloudflare", "_cf_chl", "cf-chl", "challenges.cloudflare.com"]
CHECKING_PHRASES = ["checking your browser", "just a moment", "verify you are human",
                    "review the security of your connection"]
DENIED_PHRASES = ["access denied", "request blocked", "you have been blocked", "unusual traffic"]
CHALLENGE_MARKERS = ["captcha", "challenge-platform", "security check", "verify that you are not a robot"]
DNS_PHRASES = ["dns", "failed to lookup address information", "name or service not known",
               "nodename nor servname", "name does not resolve", "temporary failure in name resolution"]
TLS_PHRASES = ["tls", "ssl", "certificate", "cert"]
SHELL_MAX_BYTES = 32 * 1024
SHELL_MIN_VISIBLE = 200
TINY_THRESHOLD = 32
SENSITIVE_RISKS = ["network_redact_off_may_expose_tokens_or_pii", "capture_ws_may_expose_tokens_or_pii",
                   "capture_sse_may_expose_tokens_or_pii"]
# --- end fixed values -------------------------------------------------------

SHELL_STRIP_RE = r"(?s)<script.*?(?:</script>|\z)|<style.*?(?:</style>|\z)|<[^>]*(?:>|\z)|" + JS_SPACE


def _any_contains(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def classify_text_sql(haystack: str) -> str:
    """C1 on one lower-cased haystack: bot wall, security challenge or NULL."""
    def body(low: str) -> str:
        cf = _any_contains(low, CLOUDFLARE_MARKERS)
        turnstile = f"(contains({low}, 'cf-turnstile') OR (contains({low}, 'turnstile') AND {cf}))"
        checking = _any_contains(low, CHECKING_PHRASES)
        denied = _any_contains(low, DENIED_PHRASES)
        challenge = _any_contains(low, CHALLENGE_MARKERS)
        return (f"CASE WHEN {turnstile} OR ({cf} AND {checking}) THEN 'bot_wall_detected' "
                f"WHEN {denied} AND ({challenge} OR contains({low}, 'reference #')) THEN 'security_challenge_detected' END")
    return let(f"lower({haystack})", body)


def classify_page_sql(title: str = "NULL", text: str = "NULL", html: str = "html") -> str:
    """Title, text and html joined by newlines, then the rules."""
    hay = f"concat_ws('\\n', {title}, {text}, {html})"
    return classify_text_sql(hay)


def html_content_type_sql(ct: str) -> str:
    """C2 gate: ``text/html*`` or containing ``application/xhtml``."""
    return let(f"lower(coalesce({ct}, ''))", lambda c: f"(startswith({c}, 'text/html') OR contains({c}, 'application/xhtml'))")


def classify_body_sql(html: str = "html", ct: str = "content_type") -> str:
    """Classification of an HTTP body, only for HTML that is valid UTF-8."""
    return f"CASE WHEN {html_content_type_sql(ct)} AND is_valid_utf8({html}) THEN {classify_page_sql('NULL', 'NULL', html)} END"


def is_empty_shell_sql(html: str = "html", ct: str = "content_type") -> str:
    """Small HTML with a script and < 200 visible characters after <body."""
    def body(low: str) -> str:
        at = f"instr({low}, '<body')"
        visible = (f"CASE WHEN {at} = 0 THEN 0 ELSE length(regexp_replace(substring({low}, {at}), "
                   f"{lit(SHELL_STRIP_RE)}, '')) END")
        return (f"({html_content_type_sql(ct)} AND octet_length({html}) <= {SHELL_MAX_BYTES} "
                f"AND contains({low}, '<script') AND {visible} < {SHELL_MIN_VISIBLE})")
    return let(f"lower(coalesce({html}, ''))", body)


def render_plan_sql(mode: str, want_content: str, error_code: str = "error_code", status: str = "status",
                    html: str = "html", ct: str = "content_type") -> str:
    """C4: named_struct(render_decision, escalation_reason)."""
    def s(decision, reason):
        return f"named_struct('render_decision', {decision}, 'escalation_reason', {reason})"
    auto = (f"CASE WHEN {error_code} = 'invalid_argument' THEN {s(lit('error'), 'CAST(NULL AS STRING)')} "
            f"WHEN {error_code} IS NOT NULL THEN {s(lit('browser'), f'concat({lit("http_failed_")}, {error_code})')} "
            f"WHEN {status} >= 400 THEN {s(lit('browser'), f'concat({lit('http_status_')}, CAST({status} AS STRING))')} "
            f"WHEN {classify_body_sql(html, ct)} IS NOT NULL THEN {s(lit('browser'), classify_body_sql(html, ct))} "
            f"WHEN {is_empty_shell_sql(html, ct)} THEN {s(lit('browser'), lit('empty_html_shell'))} "
            f"WHEN {want_content} THEN {s(lit('browser'), lit('requested_content_artifact'))} "
            f"ELSE {s(lit('http_only'), 'CAST(NULL AS STRING)')} END")
    return (f"CASE {mode} WHEN 'none' THEN {s(lit('http_only'), 'CAST(NULL AS STRING)')} "
            f"WHEN 'always' THEN {s(lit('browser'), 'CAST(NULL AS STRING)')} ELSE {auto} END")


def classify_http_error_sql(is_timeout: str, is_connect: str, detail: str) -> str:
    """Transport error code from flags and the error text."""
    return let(f"lower(coalesce({detail}, ''))", lambda low: (
        f"CASE WHEN {is_timeout} THEN 'navigation_timeout' WHEN {_any_contains(low, DNS_PHRASES)} "
        f"THEN 'dns_resolution_failed' WHEN {_any_contains(low, TLS_PHRASES)} THEN 'tls_error' "
        f"WHEN {is_connect} THEN 'target_unreachable' ELSE 'io_error' END"))


def classify_navigation_error_sql(text: str) -> str:
    """Case-sensitive browser navigation error text -> error code."""
    return let(f"coalesce({text}, '')", lambda t: (
        f"CASE WHEN contains({t}, 'NAME_NOT_RESOLVED') OR contains({t}, 'ICANN_NAME_COLLISION') "
        f"THEN 'dns_resolution_failed' WHEN contains({t}, 'CERT_') OR contains({t}, 'SSL_') THEN 'tls_error' "
        f"WHEN contains({t}, 'CONNECTION_') OR contains({t}, 'ADDRESS_UNREACHABLE') THEN 'target_unreachable' "
        f"ELSE 'host_unreachable' END"))


def with_error_info(df: DataFrame, code_col: str = "error_code") -> DataFrame:
    """Attach default retryability and category (34-row broadcast dim)."""
    d = dims.error_codes_df(df.sparkSession).withColumnRenamed("error_code", "_code")
    return df.join(F.broadcast(d), df[code_col] == d["_code"], "left").drop("_code")


def trimmed_bytes_sql(x: str) -> str:
    return f"octet_length(regexp_replace(coalesce({x}, ''), {lit('^' + JS_SPACE + '|' + JS_SPACE + '$')}, ''))"


def size_warning_sql(x: str, threshold: int = TINY_THRESHOLD) -> str:
    """artifact_empty / artifact_tiny / NULL by trimmed byte length."""
    return let(trimmed_bytes_sql(x), lambda n: (
        f"CASE WHEN {n} = 0 THEN 'artifact_empty' WHEN {n} < {int(threshold)} THEN 'artifact_tiny' END"))


def body_cap(df: DataFrame, body: str, cap: int) -> DataFrame:
    """Keep a byte prefix; cap 0 = unlimited; exactly ``cap`` bytes is truncated too."""
    b = f"CAST({body} AS BINARY)"
    if cap <= 0:
        return df.selectExpr("*", f"{b} AS body_kept", "false AS truncated")
    return df.selectExpr("*", f"substring({b}, 1, {int(cap)}) AS body_kept",
                         f"octet_length({b}) >= {int(cap)} AS truncated")


def body_extension_sql(mime: str) -> str:
    """Primary mime type -> file extension, ``bin`` otherwise."""
    m = "map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in dims.MIME_EXTENSIONS.items()) + ")"
    return (f"CASE WHEN {mime} IS NULL THEN 'bin' ELSE coalesce(try_element_at({m}, "
            f"lower(trim(split_part({mime}, ';', 1)))), 'bin') END")


def stale_navigation_sql(request_url: str, initial_url: str, final_url: str, main_url: str,
                         has_dom: str, ready_state: str) -> str:
    """NULL (ok), navigation_stale or artifact_capture_failed."""
    from pagefold.functions.url import url_equal_ignoring_fragment_sql as same
    fin = f"trim({final_url})"
    stayed = f"({initial_url} IS NOT NULL AND {same(fin, initial_url)} AND NOT {same(request_url, initial_url)})"
    conflict = f"({main_url} IS NOT NULL AND {main_url} != '' AND NOT {same(fin, main_url)})"
    return (f"CASE WHEN {request_url} = 'about:blank' THEN NULL "
            f"WHEN {fin} = '' OR {fin} = 'about:blank' THEN 'navigation_stale' "
            f"WHEN {stayed} AND ({main_url} IS NULL OR {conflict}) THEN 'navigation_stale' "
            f"WHEN {main_url} IS NULL AND NOT {has_dom} AND {ready_state} = 'complete' THEN 'artifact_capture_failed' END")


def resolve_status_sql(main_status: str, nav_status: str) -> str:
    """Main entry status, else navigation-timing status in 100..599, else 0."""
    return (f"coalesce({main_status}, CASE WHEN {nav_status} BETWEEN 100 AND 599 THEN {nav_status} END, 0)")


def main_not_observed_sql(request_url: str, final_url: str, has_dom: str) -> str:
    return f"({request_url} = 'about:blank' OR {final_url} = 'about:blank' OR NOT coalesce({has_dom}, false))"


def review_queue(results: DataFrame, url: str = "request_url", kind: str = "page_kind") -> DataFrame:
    """C14: challenge pages need a human: next_action and unverified content."""
    return results.where(f"{kind} IN ('bot_wall_detected', 'security_challenge_detected')").selectExpr(
        "*", "'human_takeover' AS next_action", "false AS target_content_verified")


#: Suffix rules (a name and three flags each) that are broadcast; of more, Spark joins as it likes.
BROADCAST_RULES = 1 << 17


def suffix_rules(suffixes: DataFrame) -> DataFrame:
    """Public-suffix rules by the labels they name: ``plain`` (``co.uk``),
    ``wild`` (``*.ck``: one more label belongs to the suffix) and ``exception``
    (``!www.ck``: this name is no suffix after all), one row for each name."""
    r = suffixes.selectExpr("lower(trim(suffix)) AS _rule").where("_rule != ''")
    r = r.selectExpr("regexp_replace(_rule, '^(!|[*][.])', '') AS _name", "_rule")
    return r.groupBy("_name").agg(F.expr("bool_or(_rule = _name) AS plain"), F.expr("bool_or(startswith(_rule, '*.')) AS wild"),
                                  F.expr("bool_or(startswith(_rule, '!')) AS exception"))


def site_key(urls: DataFrame, suffixes: DataFrame, url: str = "url") -> DataFrame:
    """Registrable domain (eTLD+1) of each URL's host by a public-suffix table.

    The rules' precedence is the list's: an exception wins, then the longest
    matching rule (a wildcard is as long as what it matches), and with no match the
    last label is the suffix. The host's last 1, 2, ... labels (as many as the longest
    rule names) are looked up in the same small table, one join each, broadcast up
    to ``BROADCAST_RULES`` rules; URLs are then neither grouped nor exchanged. IPs and hosts that
    are a suffix map to the host; a URL without a host yields NULL with
    ``invalid_argument``.
    """
    rules = cut_lineage(suffix_rules(suffixes))
    about = rules.agg(F.max(F.size(F.split("_name", "\\."))).alias("deepest"), F.count("*").alias("n")).first()
    deepest, small = about["deepest"] or 0, about["n"] <= BROADCAST_RULES
    h = urls.selectExpr("*", f"regexp_replace({url_host_sql(url)}, '\\\\.+$', '') AS _host")
    h = h.selectExpr("*", "split(_host, '\\\\.') AS _labels")
    for d in range(1, deepest + 1):
        one = rules.selectExpr(f"_name AS _t{d}", f"struct(plain, wild, exception) AS _r{d}").where(f"size(split(_t{d}, '\\\\.')) = {d}")
        h = h.selectExpr("*", f"CASE WHEN size(_labels) >= {d} THEN array_join(slice(_labels, -{d}, {d}), '.') END AS _t{d}").join(F.broadcast(one) if small else one, f"_t{d}", "left")
    exceptions = [f"CASE WHEN _r{d}.exception THEN {d - 1} END" for d in range(deepest, 0, -1)]
    lengths = [f"CASE WHEN _r{d}.wild AND size(_labels) > {d} THEN {d + 1} WHEN _r{d}.plain THEN {d} END" for d in range(1, deepest + 1)]
    longest = f"coalesce({', '.join([*exceptions, f'greatest(1, 1, {", ".join(lengths)})' if lengths else '1'])})"
    ip = "(_host RLIKE '^[0-9.]+$' OR startswith(_host, '['))"
    site = (f"CASE WHEN _host = '' THEN NULL WHEN {ip} OR size(_labels) <= _n THEN _host ELSE array_join(slice(_labels, -(_n + 1), _n + 1), '.') END AS site_key")
    return h.selectExpr(*urls.columns, "_host", "_labels", f"{longest} AS _n").selectExpr(
        *urls.columns, site, "CASE WHEN _host = '' THEN 'invalid_argument' END AS site_key_error")


def sensitive_capture_sql(redact: str, capture_ws: str, capture_sse: str) -> str:
    """C17: risk tokens for redaction off, WebSocket and SSE capture."""
    r = SENSITIVE_RISKS
    return (f"array_compact(array(CASE WHEN NOT {redact} THEN {lit(r[0])} END, "
            f"CASE WHEN {capture_ws} THEN {lit(r[1])} END, CASE WHEN {capture_sse} THEN {lit(r[2])} END))")
