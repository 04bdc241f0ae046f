"""Queries for classification, planning and quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold import dims
from pagefold.functions.core import lit
from pagefold.operators import rules as R
from pagefold.operators.content import page_title_sql
from pagefold.operators.rules import (CHALLENGE_MARKERS, CHECKING_PHRASES, CLOUDFLARE_MARKERS, DENIED_PHRASES,
                                      DNS_PHRASES, TLS_PHRASES)
from pagefold.plans import duck as D
from pagefold.plans.sqlutil import select_items
from pagefold.plans.registry import register

# --- fixed values: page_variants adapter (FIXTURES 2.3) ---------------------
TURNSTILE = '<div class="cf-turnstile"></div>'
JUST_A_MOMENT = '<title>Just a moment...</title> Cloudflare'
DENIED_REF = 'Access Denied. Reference #18.'
DENIED_PLAIN = 'Access denied to admin area'
SPA_SHELL = '<html><body><div id="root"></div><script src="a.js"></script></body></html>'
NO_BODY = '<html><head><script src="x.js"></script></head></html>'
DETAILS = ["dns error: failed to lookup address information", "invalid peer certificate: UnknownIssuer",
           "tcp connect error: Connection refused", "net::ERR_NAME_NOT_RESOLVED",
           "net::ERR_CERT_AUTHORITY_INVALID", "net::ERR_CONNECTION_REFUSED"]
MIME_CYCLE = list(dict.fromkeys(dims.MIME_EXTENSIONS))[:13] + ["text/html; charset=utf-8", "application/x-unknown", None]
MODES = [("none", False), ("none", True), ("auto", False), ("auto", True), ("always", False), ("always", True)]
# --- end fixed values -------------------------------------------------------


def _q(s):
    return "NULL" if s is None else "'" + s + "'"


VARIANTS_SELECT = f"""page_id, url,
  CASE page_id % 10 WHEN 0 THEN concat({_q(TURNSTILE)}, html) WHEN 1 THEN concat({_q(JUST_A_MOMENT)}, html)
    WHEN 2 THEN concat({_q(DENIED_REF)}, html) WHEN 3 THEN concat({_q(DENIED_PLAIN)}, html)
    WHEN 4 THEN {_q(SPA_SHELL)} WHEN 5 THEN {_q(NO_BODY)} WHEN 6 THEN {_q(SPA_SHELL)}
    WHEN 7 THEN concat('<html><body><script>', repeat('x', 40000), '</script></body></html>') ELSE html END AS html,
  CASE page_id % 10 WHEN 1 THEN 'text/html; charset=utf-8' WHEN 5 THEN 'application/xhtml+xml'
    WHEN 6 THEN 'application/json' ELSE 'text/html' END AS content_type,
  CASE WHEN page_id % 10 = 8 THEN 503 ELSE 200 END AS status,
  CASE page_id % 13 WHEN 5 THEN 'dns_resolution_failed' WHEN 6 THEN 'invalid_argument' END AS error_code,
  CASE page_id % 6 {" ".join(f"WHEN {i} THEN {_q(d)}" for i, d in enumerate(DETAILS))} END AS detail,
  page_id % 7 = 0 AS is_timeout, page_id % 3 = 0 AS is_connect,
  CASE page_id % 16 {" ".join(f"WHEN {i} THEN {_q(m)}" for i, m in enumerate(MIME_CYCLE))} END AS mime"""


def _variants(t):
    return t("pages").selectExpr(*select_items(VARIANTS_SELECT))


PV = f"pv AS (SELECT {VARIANTS_SELECT} FROM pages)"


def _d_any(x, words):
    return "(" + " OR ".join(f"contains({x}, {D.q(w)})" for w in words) + ")"


def d_classify(hay: str) -> str:
    low = f"lower({hay})"
    cf = _d_any(low, CLOUDFLARE_MARKERS)
    turn = f"(contains({low}, 'cf-turnstile') OR (contains({low}, 'turnstile') AND {cf}))"
    return (f"CASE WHEN {turn} OR ({cf} AND {_d_any(low, CHECKING_PHRASES)}) THEN 'bot_wall_detected' "
            f"WHEN {_d_any(low, DENIED_PHRASES)} AND ({_d_any(low, CHALLENGE_MARKERS)} OR contains({low}, 'reference #')) "
            f"THEN 'security_challenge_detected' END")


def d_html_ct(ct: str) -> str:
    c = f"lower(coalesce({ct}, ''))"
    return f"(starts_with({c}, 'text/html') OR contains({c}, 'application/xhtml'))"


def d_classify_body(html="html", ct="content_type") -> str:
    return f"CASE WHEN {d_html_ct(ct)} THEN {d_classify(html)} END"


def d_shell(html="html", ct="content_type") -> str:
    low = f"lower(coalesce({html}, ''))"
    at = f"strpos({low}, '<body')"
    vis = f"CASE WHEN {at} = 0 THEN 0 ELSE length(regexp_replace(substr({low}, {at}), {D.q(R.SHELL_STRIP_RE)}, '', 'g')) END"
    return f"({d_html_ct(ct)} AND octet_length(encode({html})) <= 32768 AND contains({low}, '<script') AND {vis} < 200)"


TITLE_D = D.norm(D.decode("regexp_extract(regexp_replace(html, '(?s)<!--.*?(?:-->|\\z)', '', 'g'), '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)"))


@register("c1_classify_pages", f"""WITH {PV}
SELECT page_id, {d_classify(f"concat_ws(chr(10), {TITLE_D}, html)")} AS page_class FROM pv""")
def c1(t):
    """Bot-wall / security-challenge classification of title + html."""
    return _variants(t).selectExpr("page_id", f"{R.classify_page_sql(page_title_sql('html'), 'NULL', 'html')} AS page_class")


@register("c2_classify_body", f"""WITH {PV}
SELECT page_id, content_type, {d_classify_body()} AS body_class FROM pv""")
def c2(t):
    """HTTP-body classification gated on HTML content type and valid UTF-8."""
    return _variants(t).selectExpr("page_id", "content_type", f"{R.classify_body_sql()} AS body_class")


@register("c3_empty_shell", f"""WITH {PV}
SELECT page_id, {d_shell()} AS is_empty_shell FROM pv""")
def c3(t):
    """SPA empty-shell detection (<= 32 KiB, a script, < 200 visible chars)."""
    return _variants(t).selectExpr("page_id", f"{R.is_empty_shell_sql()} AS is_empty_shell")


def _d_plan():
    failed = "concat('http_failed_', error_code)"
    status = "concat('http_status_', CAST(status AS VARCHAR))"
    auto = (f"CASE WHEN error_code = 'invalid_argument' THEN {{'d': 'error', 'r': NULL}} "
            f"WHEN error_code IS NOT NULL THEN {{'d': 'browser', 'r': {failed}}} "
            f"WHEN status >= 400 THEN {{'d': 'browser', 'r': {status}}} "
            f"WHEN {d_classify_body()} IS NOT NULL THEN {{'d': 'browser', 'r': {d_classify_body()}}} "
            f"WHEN {d_shell()} THEN {{'d': 'browser', 'r': 'empty_html_shell'}} "
            f"WHEN want_content THEN {{'d': 'browser', 'r': 'requested_content_artifact'}} "
            f"ELSE {{'d': 'http_only', 'r': NULL}} END")
    return (f"CASE mode WHEN 'none' THEN {{'d': 'http_only', 'r': NULL}} WHEN 'always' THEN {{'d': 'browser', 'r': NULL}} "
            f"ELSE {auto} END")


MODES_VALUES = ", ".join(f"('{m}', {str(w).lower()})" for m, w in MODES)


@register("c4_render_plan", f"""WITH {PV}, m(mode, want_content) AS (VALUES {MODES_VALUES}),
x AS (SELECT *, {_d_plan()} AS plan FROM pv, m)
SELECT mode, want_content, plan.d AS render_decision, plan.r AS escalation_reason, count(*) AS n
FROM x GROUP BY ALL""")
def c4(t):
    """Render decision and escalation reason for every page x (mode, want)."""
    modes = ", ".join(f"named_struct('mode', '{m}', 'want_content', {str(w).lower()})" for m, w in MODES)
    x = _variants(t).selectExpr("*", f"inline(array({modes}))")
    x = x.selectExpr("mode", "want_content", f"{R.render_plan_sql('mode', 'want_content')} AS plan")
    return x.groupBy("mode", "want_content", F.col("plan.render_decision").alias("render_decision"),
                     F.col("plan.escalation_reason").alias("escalation_reason")).agg(F.count("*").alias("n"))


@register("c5_http_error", f"""WITH {PV}
SELECT page_id, CASE WHEN is_timeout THEN 'navigation_timeout' WHEN {_d_any('lower(detail)', DNS_PHRASES)} THEN 'dns_resolution_failed'
  WHEN {_d_any('lower(detail)', TLS_PHRASES)} THEN 'tls_error' WHEN is_connect THEN 'target_unreachable' ELSE 'io_error' END AS error_code FROM pv""")
def c5(t):
    """HTTP transport error classification from flags and detail text."""
    return _variants(t).selectExpr("page_id", f"{R.classify_http_error_sql('is_timeout', 'is_connect', 'detail')} AS error_code")


@register("c6_navigation_error", f"""WITH {PV}
SELECT page_id, CASE WHEN contains(detail, 'NAME_NOT_RESOLVED') OR contains(detail, 'ICANN_NAME_COLLISION') THEN 'dns_resolution_failed'
  WHEN contains(detail, 'CERT_') OR contains(detail, 'SSL_') THEN 'tls_error'
  WHEN contains(detail, 'CONNECTION_') OR contains(detail, 'ADDRESS_UNREACHABLE') THEN 'target_unreachable'
  ELSE 'host_unreachable' END AS error_code FROM pv""")
def c6(t):
    """Browser navigation error text -> error code (case-sensitive)."""
    return _variants(t).selectExpr("page_id", f"{R.classify_navigation_error_sql('detail')} AS error_code")


ERR_VALUES = ", ".join(f"('{c}', {str(c in dims.RETRYABLE_CODES).lower()}, '{dims.error_category(c)}')" for c in dims.ERROR_CODES)


@register("c7_error_info", f"""WITH {PV}, d(error_code, retryable, category) AS (VALUES {ERR_VALUES}),
x AS (SELECT page_id, coalesce(error_code, CASE WHEN contains(detail, 'NAME_NOT_RESOLVED') OR contains(detail, 'ICANN_NAME_COLLISION') THEN 'dns_resolution_failed'
  WHEN contains(detail, 'CERT_') OR contains(detail, 'SSL_') THEN 'tls_error'
  WHEN contains(detail, 'CONNECTION_') OR contains(detail, 'ADDRESS_UNREACHABLE') THEN 'target_unreachable'
  ELSE 'host_unreachable' END) AS error_code FROM pv)
SELECT x.page_id, x.error_code, d.retryable, d.category FROM x LEFT JOIN d USING (error_code)""")
def c7(t):
    """Error codes with default retryability and category (broadcast dimension)."""
    v = _variants(t).selectExpr("page_id", f"coalesce(error_code, {R.classify_navigation_error_sql('detail')}) AS error_code")
    return R.with_error_info(v).select("page_id", "error_code", "retryable", "category")


@register("c8_size_warning", f"""
SELECT doc_id, CASE WHEN _n = 0 THEN 'artifact_empty' WHEN _n < 32 THEN 'artifact_tiny' END AS text_warning,
       CASE WHEN _n = 0 THEN 'artifact_empty' WHEN _n < 1 THEN 'artifact_tiny' END AS html_warning, _n AS trimmed_bytes
FROM (SELECT doc_id, octet_length(encode(regexp_replace(coalesce(text, ''), {D.q('^' + R.JS_SPACE + '|' + R.JS_SPACE + '$')}, '', 'g'))) AS _n FROM documents)""")
def c8(t):
    """Empty / tiny artifact warnings by trimmed byte length (thresholds 32 and 1)."""
    return t("documents").selectExpr("doc_id", f"{R.trimmed_bytes_sql('text')} AS _n").selectExpr(
        "doc_id", "CASE WHEN _n = 0 THEN 'artifact_empty' WHEN _n < 32 THEN 'artifact_tiny' END AS text_warning",
        "CASE WHEN _n = 0 THEN 'artifact_empty' WHEN _n < 1 THEN 'artifact_tiny' END AS html_warning",
        "CAST(_n AS BIGINT) AS trimmed_bytes")


@register("c9_body_cap", """
SELECT page_id, CAST(least(octet_length(encode(html)), 4096) AS BIGINT) AS kept_bytes, octet_length(encode(html)) >= 4096 AS truncated,
       md5(encode(html)[1:4096]) AS kept_md5 FROM pages""")
def c9(t):
    """Page bodies capped at 4096 bytes; a body of exactly the cap is flagged."""
    return R.body_cap(t("pages"), "html", 4096).selectExpr(
        "page_id", "CAST(octet_length(body_kept) AS BIGINT) AS kept_bytes", "truncated", "md5(body_kept) AS kept_md5")


MIME_D = "CASE " + " ".join(f"WHEN lower(trim(split_part(mime, ';', 1))) = '{k}' THEN '{v}'" for k, v in dims.MIME_EXTENSIONS.items()) + " ELSE 'bin' END"


@register("c10_body_extension", f"""WITH {PV}
SELECT page_id, mime, CASE WHEN mime IS NULL THEN 'bin' ELSE {MIME_D} END AS extension FROM pv""")
def c10(t):
    """Body file extension from the content type."""
    return _variants(t).selectExpr("page_id", "mime", f"{R.body_extension_sql('mime')} AS extension")


@register("c11_url_equal_ignoring_fragment", f"""WITH fp AS (
  SELECT page_id, 0 AS pair, url AS a, url || '#x' AS b FROM pages
  UNION ALL SELECT p.page_id, 1, p.url, n.url FROM pages p JOIN pages n ON n.page_id = p.page_id + 1)
SELECT page_id, pair, CASE WHEN regexp_matches(a, {D.q(D.URL_RE)}) AND regexp_matches(b, {D.q(D.URL_RE)})
  THEN regexp_replace(a, '(?s)#.*$', '') = regexp_replace(b, '(?s)#.*$', '') ELSE a = b END AS same_url
FROM fp WHERE b IS NOT NULL""")
def c11(t):
    """URL equality with the fragment removed (self vs '#x', and vs the next page)."""
    from pagefold.functions.url import url_equal_ignoring_fragment_sql
    p = t("pages")
    self_pairs = p.selectExpr("page_id", "0 AS pair", "url AS a", "concat(url, '#x') AS b")
    # The next page by id, as an equi-join (no global ordering window).
    nxt = p.selectExpr("page_id", "url AS a").join(
        p.selectExpr("page_id - 1 AS page_id", "url AS b"), "page_id").selectExpr("page_id", "1 AS pair", "a", "b")
    return self_pairs.unionByName(nxt).selectExpr(
        "page_id", "pair", f"{url_equal_ignoring_fragment_sql('a', 'b')} AS same_url")


@register("c14_review_queue", f"""WITH {PV}
SELECT page_id, url AS request_url, {d_classify_body()} AS page_kind, 'human_takeover' AS next_action,
       false AS target_content_verified FROM pv WHERE {d_classify_body()} IS NOT NULL""")
def c14(t):
    """Pages classified as walls get a human-takeover next action."""
    v = _variants(t).selectExpr("page_id", "url AS request_url", f"{R.classify_body_sql()} AS page_kind")
    return R.review_queue(v)


SFX_VALUES = ", ".join(f"('{s}')" for s in dims.SAMPLE_PUBLIC_SUFFIXES)


#: Rules of all three kinds: the sample list, a wildcard, and as exceptions to it the sites of every seventh page below.
WILD_ZONE = "example.net"


@register("c15_site_key", f"""WITH h AS (SELECT page_id, url, regexp_replace({D.host('url')}, '\\.+$', '') AS host FROM pages),
x AS (SELECT *, string_split(host, '.') AS labels FROM h),
r AS (SELECT rule, string_split(regexp_replace(rule, '^(!|[*][.])', ''), '.') AS names FROM (
  SELECT col0 AS rule FROM (VALUES {SFX_VALUES}, ('*.{WILD_ZONE}'), ('!www.{WILD_ZONE}'))
  UNION SELECT '!' || array_to_string(labels[-3:], '.') FROM x WHERE page_id % 7 = 0 AND ends_with(host, '.{WILD_ZONE}'))),
m AS (SELECT x.page_id, CASE WHEN starts_with(rule, '!') THEN 1000 + len(names) - 1 WHEN starts_with(rule, '*') THEN len(names) + 1 ELSE len(names) END AS n
      FROM x JOIN r ON labels[-len(names):] = names AND len(labels) >= len(names) + CASE WHEN starts_with(rule, '*') THEN 1 ELSE 0 END),
b AS (SELECT page_id, max(n) % 1000 AS n FROM m GROUP BY page_id)
SELECT x.page_id, url, CASE WHEN host = '' THEN NULL WHEN regexp_matches(host, '^[0-9.]+$') OR starts_with(host, '[') OR len(labels) <= coalesce(n, 1) THEN host
  ELSE array_to_string(labels[-(coalesce(n, 1) + 1):], '.') END AS site_key, CASE WHEN host = '' THEN 'invalid_argument' END AS site_key_error
FROM x LEFT JOIN b USING (page_id)""")
def c15(t):
    """Registrable domain of every page URL by public-suffix rules (plain, wildcard, exception)."""
    from pagefold.functions.url import url_host_sql
    p = t("pages").select("page_id", "url")
    host = p.where("page_id % 7 = 0").selectExpr(f"split({url_host_sql('url')}, '\\\\.') AS l").where(f"endswith(array_join(l, '.'), '.{WILD_ZONE}')")
    own = host.selectExpr("concat('!', array_join(slice(l, -3, 3), '.')) AS suffix").distinct()
    fixed = p.sparkSession.sql(f"SELECT * FROM VALUES ('*.{WILD_ZONE}'), ('!www.{WILD_ZONE}') AS s(suffix)")
    return R.site_key(p, dims.public_suffixes_df(p.sparkSession).unionByName(fixed).unionByName(own))
