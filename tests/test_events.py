"""Event log folds on small restated fixtures."""

from pagefold.operators import events as E
from pagefold.operators import readiness as R
from pagefold.sources import io as S

COLS = "session_id string, request_id string, seq bigint, ts_ms bigint, method string, resource_type string, " \
       "status int, has_redirect boolean, redirect_status int, timestamp_ms bigint"


def ev(spark, rows):
    return spark.createDataFrame(rows, COLS)


def test_redirect_fold(spark):
    rows = [("s", "r1", 1, 1, E.SENT, "Document", None, False, None, 1),
            ("s", "r1", 2, 2, E.SENT, "Document", None, True, 302, 2),
            ("s", "r1", 3, 3, E.RESPONDED, None, 200, None, None, 3),
            ("s", "r1", 4, 4, E.FINISHED, None, None, None, None, 4),
            ("s", "r0", 5, 5, E.RESPONDED, None, 200, None, None, 5)]
    e = ev(spark, rows)
    entries = E.network_entries(e).collect()
    assert [(r.request_id, r.state, r.status, r.n_sends, r.redirect_from_request_id) for r in entries] == [
        ("r1", "finished", 200, 2, "r1")]
    hops = sorted((r.hop_no, r.status, r.redirected, r.state) for r in E.redirect_hops(e).collect())
    assert hops == [(1, 302, True, "finished"), (2, 200, False, "finished")]


def test_pending_xhr_warnings(spark):
    rows = [("s", "doc", 1, 1, E.SENT, "Document", None, False, None, 1),
            ("s", "doc", 2, 2, E.RESPONDED, None, 200, None, None, 2),
            ("s", "doc", 3, 3, E.FINISHED, None, None, None, None, 3),
            ("s", "x", 4, 4, E.SENT, "Fetch", None, False, None, 4)]
    e = ev(spark, rows)
    ent = E.network_entries(e)
    s = E.network_summary(ent).collect()[0]
    assert (s.requests_total, s.finished_total, s.inflight_total_at_capture) == (2, 1, 1)
    codes = sorted(r.code for r in E.network_warnings(ent).collect())
    assert codes == ["network_not_idle", "pending_xhr_at_capture"]
    tl = [r.inflight for r in R.inflight_timeline(e).orderBy("seq").collect()]
    assert tl == [1, 1, 0, 1]
    assert [r.main_request_id for r in E.main_request(e).collect()] == ["doc"]


def test_console(spark):
    df = spark.createDataFrame([
        ("s", 1, 1, E.CONSOLE, "log", '[{"type":"string","value":"hello"},{"type":"number","value":3}]', None),
        ("s", 2, 2, E.CONSOLE, "warning", '[{"type":"object","description":"Object"}]', None),
        ("s", 3, 3, E.EXCEPTION, None, None, '{"exception":{"description":"Error: boom"}}')],
        "session_id string, seq bigint, ts_ms bigint, method string, console_type string, args string, exception_json string")
    df = df.selectExpr("*", "CAST(NULL AS STRING) AS stack_url", "CAST(NULL AS INT) AS stack_line")
    got = [(r.level, r.text) for r in E.console_events(df).orderBy("seq").collect()]
    assert got == [("log", "hello 3"), ("warn", "Object"), ("exception", "Error: boom")]


def test_storage_cap_and_envelope(spark):
    big = "x" * 300 * 1024
    df = spark.createDataFrame([(1, {"k": "v"}, None, ["db"]), (2, {"k": big}, None, ["db"])],
                               "id int, local_storage map<string,string>, session_storage map<string,string>, indexed_db array<string>")
    got = {r.id: r for r in E.storage_snapshot_cap(df).collect()}
    assert got[1].local_storage == {"k": "v"} and got[1].note is None
    assert got[2].local_storage is None and got[2].indexed_db == [] and "262144" in got[2].note
    p = spark.createDataFrame([("other", "t", "a")], "code string, token_secret string, z string")
    j = S.envelope_json(E.redact_secret_fields(p), "fetch").collect()[0].value
    assert j == '{"code":"fetch","result":{"code":"other","token_secret":"***","z":"a"}}'


def test_network_bodies(spark):
    df = spark.createDataFrame([("eyJhIjoxfQ==", True, "application/json"), ("%%%", True, "text/plain"),
                                ("abcdef", False, "text/plain")], "body string, base64_encoded boolean, mime_type string")
    got = [(r.capture_failed, r.truncated, r.json_valid) for r in E.network_bodies(df, 4).collect()]
    assert got == [(False, True, False), (True, False, None), (False, True, None)]


def test_frames_downloads(spark):
    df = spark.createDataFrame([("s", "w1", 1, 1, E.WS_SENT, None, None, "hi", None),
                                ("s", "", 2, 2, E.WS_RECEIVED, 2, True, "x", None)],
                               "session_id string, request_id string, seq bigint, ts_ms bigint, method string, opcode int, "
                               "mask boolean, payload_data string, error_message string")
    f = E.ws_frames(df).collect()
    assert [(r.direction, r.opcode, r.mask) for r in f] == [("sent", 1, False)]
    d = spark.createDataFrame([("a", E.DOWNLOAD, False), ("b", E.FAILED, False)], "session_id string, method string, is_download boolean")
    assert sorted((r.session_id, r.is_download) for r in E.download_navigations(d).collect()) == [("a", True), ("b", False)]
    files = spark.createDataFrame([("d", "/d/a.pdf", 1), ("d", "/d/b.pdf", 5), ("d", "/d/c.crdownload", 9)], "dir string, path string, mtime long")
    before = spark.createDataFrame([("d", "/d/a.pdf")], "dir string, path string")
    assert [r.path for r in E.latest_download(files, before).collect()] == ["/d/b.pdf"]


def test_console_from_params(spark):
    import json
    rows = [("s", 1, 1, E.CONSOLE, json.dumps({"type": "warning", "args": [{"type": "string", "value": "a"}, {"type": "undefined"},
                                                                           {"type": "boolean", "value": True}],
                                               "stackTrace": {"callFrames": [{"url": "https://e.com/app.js", "lineNumber": 7}]}})),
            ("s", 2, 2, E.EXCEPTION, json.dumps({"exceptionDetails": {"text": "Uncaught", "url": "https://e.com/x.js",
                                                                      "lineNumber": 3}}))]
    df = spark.createDataFrame(rows, "session_id string, seq bigint, ts_ms bigint, method string, params string")
    got = [(r.level, r.text, r.url, r.line_number) for r in E.console_events(df).orderBy("seq").collect()]
    assert got == [("warn", "a true", "https://e.com/app.js", 7), ("exception", "Uncaught", "https://e.com/x.js", 3)]
