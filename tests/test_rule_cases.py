"""Hand-written cases of navigation, status, capture and cookie rules."""

import pytest

from pagefold.operators import cookies as K
from pagefold.operators import rules as R

# request, initial, final, main, has_dom, ready_state -> outcome
NAVIGATIONS = [
    ("https://b.example/", "https://a.example/", "https://a.example/#x", None, True, "complete", "navigation_stale"),
    ("https://b.example/", "https://a.example/", "https://a.example/", "https://b.example/", True, "complete", "navigation_stale"),
    ("https://b.example/", "https://a.example/", "https://b.example/", "https://b.example/", True, "complete", None),
    ("about:blank", None, "", None, False, "loading", None),
    ("https://b.example/", None, "about:blank", "https://b.example/", True, "complete", "navigation_stale"),
    ("https://b.example/", None, "https://b.example/", None, False, "complete", "artifact_capture_failed"),
    ("https://b.example/", None, "https://b.example/", None, False, "loading", None),
]
# main status, navigation status, has_dom -> status, main_not_observed
STATUSES = [(404, 200, True, 404, False), (None, 304, False, 304, True), (None, 99, None, 0, True), (None, None, True, 0, False)]
# line -> name, value, domain, host_only, path, expires, secure, http_only, same_site (request https://w.example.org/a/b)
LINES = [
    ("sid=1; Path=/; Secure; HttpOnly; SameSite=lax", ("sid", "1", "w.example.org", True, "/", None, True, True, "Lax")),
    (" t = a=b ; Domain=.example.org; Expires=Wed, 21 Oct 2026 07:28:00 GMT", ("t", "a=b", "example.org", False, "/a", 1792567680, False, False, None)),
    ("k=; max-age=60; samesite=NONE", ("k", "", "w.example.org", True, "/a", None, False, False, "None")),
    ("novalue; Path=/", None),
    ("=x", None),
]
# name, value, same_site, secure, partitioned -> reason, effective secure
EXPLICIT = [
    ("a", "1", None, None, None, None, False), (" ", "1", None, None, None, "empty_name", False), ("a=b", "1", None, True, None, "bad_name", True),
    ("a,b", "x\ty", None, None, None, None, False), ("a", "x;y", None, None, None, "bad_value", False),
    ("a", "1", "None", None, None, None, True), ("a", "1", "None", False, None, "samesite_none_requires_secure", True),
    ("a", "1", None, False, True, "partitioned_requires_secure", True), ("a", "1", None, None, True, None, True), (" pad ", "1", "Lax", True, False, None, True),
]


def _column(spark, rows, schema, *exprs):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"n int, {schema}")
    return [tuple(r)[1:] for r in d.selectExpr("n", *exprs).orderBy("n").collect()]


def test_navigations(spark):
    got = _column(spark, [r[:6] for r in NAVIGATIONS], "req string, init string, fin string, main string, dom boolean, rs string",
                  f"{R.stale_navigation_sql('req', 'init', 'fin', 'main', 'dom', 'rs')} AS outcome")
    assert got == [(r[6],) for r in NAVIGATIONS]


def test_statuses(spark):
    got = _column(spark, [(*r[:3], "https://a/") for r in STATUSES], "main int, nav int, dom boolean, u string",
                  f"{R.resolve_status_sql('main', 'nav')} AS status", f"{R.main_not_observed_sql('u', 'u', 'dom')} AS unseen")
    assert got == [r[3:] for r in STATUSES]


@pytest.mark.parametrize("flags,n", [((True, False, False), 0), ((False, False, False), 1), ((True, True, False), 1), ((False, True, True), 3)])
def test_sensitive_capture(spark, flags, n):
    (risks,), = _column(spark, [flags], "r boolean, w boolean, s boolean", f"{R.sensitive_capture_sql('r', 'w', 's')} AS risks")
    assert risks == [x for x, on in zip(R.SENSITIVE_RISKS, (not flags[0], *flags[1:])) if on] and len(risks) == n


def test_set_cookie_lines(spark):
    d = spark.createDataFrame([(i, line, "https://w.example.org/a/b") for i, (line, _) in enumerate(LINES)], "n int, set_cookie string, request_url string")
    got = {r[0]: tuple(r)[1:] for r in K.parse_set_cookie(d).select("n", *K.JAR_COLS).collect()}
    assert got == {i: want for i, (_, want) in enumerate(LINES) if want}


def test_explicit_cookies(spark):
    rows = [(*r[:5], None, None, "h", "/") for r in EXPLICIT]
    got = _column(spark, rows, "name string, value string, same_site string, secure boolean, partitioned boolean, domain string, cookie_path string, _host string, _path string",
                  f"{K.validate_cookie_sql()} AS reason", f"{K.effective_secure_sql()} AS sure")
    assert got == [r[5:] for r in EXPLICIT]
