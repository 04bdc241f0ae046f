"""Result rows assembled from their parts."""

import pytest

from pagefold.operators import events as E
from pagefold.operators.assemble import NO_BODY, UNSEEN, assemble_results, main_outcomes

ACQ = "request_id string, session_id string, request_url string, status int, content_type string, html string, error_code string"
PAGE = "<html><body>" + "word " * 60 + "</body></html>"


@pytest.fixture(scope="module")
def acq(spark):
    return spark.createDataFrame([
        ("a", "s1", "https://x.example/", 200, "text/html", PAGE, None),
        ("b", "s2", "https://y.example/", 200, "text/html", " ", None),
        ("c", None, "about:blank", None, None, None, "tls_error")], ACQ)


def _event(session, request, seq, method, kind=None, url=None, redirect=None, status=None):
    return (session, request, seq, seq, method, kind, url, redirect, status)


def _events(spark, rows):
    return spark.createDataFrame(rows, "session_id string, request_id string, seq long, ts_ms long, method string, resource_type string, url string, has_redirect boolean, status int")


def test_only_rules(acq):
    rows = {r.request_id: r for r in assemble_results(acq).collect()}
    assert rows["a"].final_url == "https://x.example/" and rows["a"].warnings == [] and rows["a"].trace.stages == []
    assert rows["a"].trace.main_request_observed is None
    assert [tuple(w)[:2] for w in rows["b"].warnings] == [("rendered_html", "artifact_empty")]
    assert rows["c"].error_code == "tls_error" and rows["c"].retryable is False and rows["c"].status is None


def test_all_parts(spark, acq):
    events = _events(spark, [
        _event("s1", "q", 1, E.SENT, "Script", "https://x.example/s.js"),
        _event("s1", "m", 2, E.SENT, "Document", "https://x.example/"),
        _event("s1", "m", 3, E.SENT, "Document", "https://x.example/2", True),
        _event("s1", "m", 4, E.SENT, "Document", "https://x.example/3", True),
        _event("s1", "m", 5, E.RESPONDED, status=203),
        _event("s1", "z", 6, E.SENT, "Document", "https://other.example/"),
        _event(None, "m", 1, E.SENT, "Document", "https://x.example/")])
    spans = spark.createDataFrame([("a", "load", 10, 40, "ok"), ("a", "wait", 20, None, "started"), ("zz", "load", 1, 2, "ok")],
                                  "fetch_id string, stage string, start_ms long, end_ms long, status string")
    files = spark.createDataFrame([("a", "body", "/a/body", True), ("b", "body", None, False), ("c", "body", None, False), ("b", "text", "/b/text.txt", True)],
                                  "request_id string, artifact string, file string, present boolean")
    tries = spark.createDataFrame([("a", 2, "success", "success", 250), ("b", 3, "failed", "host_unreachable", 500)],
                                  "request_id string, terminal_try long, outcome string, final_code string, waited_ms long")
    more = spark.createDataFrame([("a", "console", "artifact_tiny", None), ("a", "body", "artifact_tiny", "x"), ("nobody", "body", "artifact_tiny", "x")],
                                 "request_id string, artifact string, code string, detail string")
    rows = {r.request_id: r for r in assemble_results(acq, warnings=more, artifacts=files, stages=spans, retries=tries, main=main_outcomes(events)).collect()}
    assert set(rows) == {"a", "b", "c"}
    a, b, c = rows["a"], rows["b"], rows["c"]
    assert (a.final_url, a.status, a.trace.redirects, a.trace.attempts, a.error_code, a.body_file) == ("https://x.example/3", 203, 2, 2, None, "/a/body")
    assert (a.trace.duration_ms, [tuple(s) for s in a.trace.stages]) == (30, [("load", "ok", 30), ("wait", "started", 20)])
    assert [tuple(w) for w in a.warnings] == [("body", "artifact_tiny", "x"), ("console", "artifact_tiny", None)]
    assert (b.error_code, b.retryable, b.trace.main_request_observed, b.text_file, b.body_file) == ("host_unreachable", True, False, "/b/text.txt", None)
    assert [w.detail for w in b.warnings] == [NO_BODY, UNSEEN, "rendered_html artifact size check"]
    # about:blank has no main request to observe
    assert [w.detail for w in c.warnings] == [NO_BODY, "rendered_html artifact size check"]


def test_empty_parts(spark, acq):
    none = acq.where("false")
    assert assemble_results(none).collect() == []
    rows = assemble_results(acq, main=main_outcomes(_events(spark, []))).collect()
    assert len(rows) == 3 and all(r.trace.main_request_observed is False for r in rows)


def test_main_without_status(spark, acq):
    m = main_outcomes(_events(spark, [_event("s1", "m", 1, E.SENT, "Document", "https://x.example/")]))
    a = assemble_results(acq, main=m).where("request_id = 'a'").first()
    assert a.status == 200 and [w.detail for w in a.warnings] == ["main request m had no response status"]


def test_page_text_meets_no_join(acq):
    main = acq.selectExpr("session_id", "'m' AS main_request_id", "request_url AS main_url", "200 AS main_status", "1L AS redirects")
    plan = assemble_results(acq, main=main)._jdf.queryExecution().optimizedPlan().toString()
    head = plan[:plan.index("Join")]
    assert "html" not in head.replace("rendered_html", "")
