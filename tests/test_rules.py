"""Classification, shells, plans, site keys, stale navigation."""

from pagefold import dims
from pagefold.operators import rules as R

SHELL = "<html><head><title>Console</title></head><body class=dark><noscript></noscript><main id=mount></main><script type=module src=/m.mjs></script></body></html>"
NO_BODY = "<html><head><meta charset=utf-8><script>start()</script></head></html>"
ARTICLE = ("<html><body><h2>Tide tables</h2><div>" + "High water at the harbour wall is measured twice a day. " * 6
           + "</div><script>count(1)</script></body></html>")
STATIC = "<html><body><main id=mount></main></body></html>"
BIG = "<html><body><main id=mount></main><script>" + "var a=1;" * 9000 + "</script></body></html>"


def test_shells(spark):
    rows = [(SHELL, "text/html"), (NO_BODY, "text/html; charset=utf-8"), (ARTICLE, "text/html"),
            (SHELL, "application/json"), (SHELL, None), (STATIC, "text/html"), (BIG, "text/html")]
    df = spark.createDataFrame(rows, "html string, content_type string")
    got = [r.s for r in df.selectExpr(f"{R.is_empty_shell_sql()} AS s").collect()]
    assert got == [True, True, False, False, False, False, False]


def test_challenges(spark):
    rows = [('<div class="cf-turnstile"></div>',), ("<title>Access Denied</title>Reference #18.123",),
            ("Access denied to admin area",), ("Just a moment... cloudflare",)]
    df = spark.createDataFrame(rows, "html string")
    got = [r.c for r in df.selectExpr(f"{R.classify_page_sql('NULL', 'NULL', 'html')} AS c").collect()]
    assert got == ["bot_wall_detected", "security_challenge_detected", None, "bot_wall_detected"]


def test_render_plan_and_errors(spark):
    df = spark.createDataFrame([("auto", None, 200, SHELL, "text/html"), ("auto", "invalid_argument", 0, "", None),
                                ("auto", "tls_error", 0, "", None), ("auto", None, 503, ARTICLE, "text/html"),
                                ("auto", None, 200, ARTICLE, "text/html"), ("none", None, 200, SHELL, "text/html")],
                               "mode string, error_code string, status int, html string, content_type string")
    got = [(r.p.render_decision, r.p.escalation_reason)
           for r in df.selectExpr(f"{R.render_plan_sql('mode', 'false')} AS p").collect()]
    assert got == [("browser", "empty_html_shell"), ("error", None), ("browser", "http_failed_tls_error"),
                   ("browser", "http_status_503"), ("http_only", None), ("http_only", None)]
    d = spark.createDataFrame([("net::ERR_NAME_NOT_RESOLVED",), ("net::ERR_CERT_DATE_INVALID",),
                               ("net::ERR_CONNECTION_RESET",), ("net::ERR_ABORTED",)], "t string")
    assert [r.c for r in d.selectExpr(f"{R.classify_navigation_error_sql('t')} AS c").collect()] == [
        "dns_resolution_failed", "tls_error", "target_unreachable", "host_unreachable"]
    e = spark.createDataFrame([(True, False, "x"), (False, False, "dns error"), (False, True, "bad certificate"),
                               (False, True, "refused"), (False, False, "reset")], "t boolean, c boolean, d string")
    assert [r.c for r in e.selectExpr(f"{R.classify_http_error_sql('t', 'c', 'd')} AS c").collect()] == [
        "navigation_timeout", "dns_resolution_failed", "tls_error", "target_unreachable", "io_error"]


def test_error_dimension(spark):
    d = dims.error_codes_df(spark)
    assert d.count() == 34 and d.where("retryable").count() == 7


def test_site_key_rules_of_all_kinds(spark):
    rules = spark.createDataFrame([(x,) for x in ["org", "coop", "museum.coop", "*.isle", "!town.isle", "*.deep.coop", "!a.b.deep.coop", "b.deep.coop", "Shop.ORG "]], "suffix string")
    want = {
        "https://mail.velo.org/x": "velo.org", "https://VELO.Org.": "velo.org", "https://org/": "org",
        "https://a.b.museum.coop": "b.museum.coop", "https://museum.coop/": "museum.coop", "https://old.museum.example": "museum.example",
        "https://x.harbour.isle": "x.harbour.isle", "https://y.x.harbour.isle:8443/": "x.harbour.isle", "https://harbour.isle": "harbour.isle", "https://isle": "isle",
        "https://town.isle": "town.isle", "https://www.town.isle": "town.isle",              # the exception is a site itself
        "https://z.q.deep.coop": "z.q.deep.coop", "https://y.z.q.deep.coop": "z.q.deep.coop", "https://x.a.b.deep.coop": "a.b.deep.coop",
        "https://c.b.deep.coop": "c.b.deep.coop", "https://my.shop.org": "my.shop.org", "http://10.0.0.7:8080/a": "10.0.0.7", "http://[::1]/": "[::1]",
        "mailto:someone": None, "nothing": None}
    df = spark.createDataFrame([(u,) for u in want], "url string")
    got = {r.url: (r.site_key, r.site_key_error) for r in R.site_key(df, rules).collect()}
    assert got == {u: (k, None if k else "invalid_argument") for u, k in want.items()}


def test_site_key_neither_groups_nor_exchanges_the_urls(spark):
    df = spark.createDataFrame([("https://a.b.org",)], "url string")
    plan = R.site_key(df, spark.createDataFrame([("org",), ("b.org",)], "suffix string"))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning" not in plan
    assert R.site_key(df, spark.createDataFrame([], "suffix string")).first().site_key == "b.org"


def test_stale_navigation_and_misc(spark):
    df = spark.createDataFrame([("https://b.test/", "https://a.test/", "https://a.test/", None, True, "complete"),
                                ("about:blank", None, "", None, False, "complete"),
                                ("https://b.test/", None, "about:blank", None, False, "complete"),
                                ("https://b.test/", None, "https://b.test/", None, False, "complete")],
                               "req string, init string, fin string, main string, dom boolean, rs string")
    got = [r.s for r in df.selectExpr(f"{R.stale_navigation_sql('req', 'init', 'fin', 'main', 'dom', 'rs')} AS s").collect()]
    assert got == ["navigation_stale", None, "navigation_stale", "artifact_capture_failed"]
    m = spark.createDataFrame([("text/html; charset=utf-8",), ("IMAGE/PNG",), ("x/unknown",), (None,)], "m string")
    assert [r.e for r in m.selectExpr(f"{R.body_extension_sql('m')} AS e").collect()] == ["html", "png", "bin", "bin"]
    s = spark.createDataFrame([(False, True, False)], "r boolean, w boolean, s boolean")
    assert s.selectExpr(f"{R.sensitive_capture_sql('r', 'w', 's')} AS x").collect()[0].x == [
        "network_redact_off_may_expose_tokens_or_pii", "capture_ws_may_expose_tokens_or_pii"]
    w = spark.createDataFrame([("  ",), ("tiny",), ("x" * 40,)], "t string")
    assert [r.w for r in w.selectExpr(f"{R.size_warning_sql('t')} AS w").collect()] == ["artifact_empty", "artifact_tiny", None]
    b = R.body_cap(spark.createDataFrame([("abcd",), ("abc",), ("ab",)], "b string"), "b", 3).collect()
    assert [(bytes(r.body_kept), r.truncated) for r in b] == [(b"abc", True), (b"abc", True), (b"ab", False)]


def test_resolve_status_and_main_not_observed(spark):
    df = spark.createDataFrame([(200, 404, "https://a/", "https://a/", True), (None, 304, "https://a/", "about:blank", True),
                                (None, 0, "https://a/", "https://a/", False)],
                               "main int, nav int, req string, fin string, dom boolean")
    got = [(r.s, r.w) for r in df.selectExpr(f"{R.resolve_status_sql('main', 'nav')} AS s",
                                             f"{R.main_not_observed_sql('req', 'fin', 'dom')} AS w").collect()]
    assert got == [(200, False), (304, True), (0, True)]
