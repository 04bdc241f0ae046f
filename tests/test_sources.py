"""Readers and writers: capture dirs, event logs, envelopes, frames."""

import json
import os

from pagefold.operators import cookies as K
from pagefold.operators import events as E
from pagefold.sources import io as S


def test_capture_dirs_and_manifest(spark, tmp_path):
    for rid, status in [("req-1", 200), ("req-2", 404)]:
        d = tmp_path / rid
        d.mkdir()
        (d / "network.json").write_text(json.dumps({"schema_version": 1, "main_request_id": rid, "status": status}))
        (d / "console.json").write_text(json.dumps({"schema_version": 1, "events": []}))
    df = S.read_capture_dirs(spark, str(tmp_path), "network")
    assert sorted((r.request_id, r.status) for r in df.collect()) == [("req-1", 200), ("req-2", 404)]
    res = spark.createDataFrame([("req-1", "/o/req-1/network.json", None)], "request_id string, network_file string, body_file string")
    m = {r.artifact: r.present for r in S.artifact_manifest(res).collect()}
    assert len(m) == 9 and m["network"] is True and m["body"] is False and "storage" not in m


def test_event_log_reader_and_fold(spark, tmp_path):
    lines = [
        {"session_id": "s", "method": E.SENT, "seq": 1, "ts": 1000,
         "params": json.dumps({"requestId": "r1", "type": "Document", "timestamp": 1.5,
                               "request": {"url": "https://e.com/", "method": "GET", "postData": '{"query":"q"}'}})},
        {"session_id": "s", "method": E.RESPONDED, "seq": 2, "ts": 1001,
         "params": json.dumps({"requestId": "r1", "response": {"status": 200, "mimeType": "text/html",
                                                                "headers": {"Set-Cookie": "a=1", "X-N": 5}}})},
        {"session_id": "s", "method": E.FINISHED, "seq": 3, "ts": 1002,
         "params": json.dumps({"requestId": "r1", "timestamp": 2.25, "encodedDataLength": 42})},
    ]
    p = tmp_path / "events.jsonl"
    p.write_text("\n".join(json.dumps(x) for x in lines))
    ev = S.read_capture_events(spark, str(p))
    e = E.network_entries(ev).collect()[0]
    assert (e.state, e.status, e.mime_type, e.start_ms, e.end_ms, e.encoded_data_length) == ("finished", 200, "text/html", 1500, 2250, 42)
    hdr = ev.where("seq = 2").selectExpr(f"{E.header_map_sql('response_headers')} AS h").collect()[0].h
    assert hdr == {"Set-Cookie": "a=1", "X-N": "5"}
    hints = ev.where("seq = 1").selectExpr(*E.payload_hints_sql()).collect()[0]
    assert hints.request_body_json_valid and hints.graphql_operation_type == "request" and hints.graphql_operation_name is None


def test_frames_writer_and_sse(spark, tmp_path):
    ev = spark.createDataFrame([("s", "c1", 1, 1, E.SSE, "tick", "1", "a"), ("s", "c1", 2, 2, E.SSE, "tick", "2", "b"),
                                ("s", "", 3, 3, E.SSE, "x", "3", "c")],
                               "session_id string, request_id string, seq bigint, ts_ms bigint, method string, "
                               "event_name string, data string, event_id string")
    msgs = E.sse_messages(ev)
    assert msgs.count() == 2
    out = str(tmp_path / "frames")
    S.write_frames_jsonl(msgs, out)
    assert [r.data for r in spark.read.schema(msgs.schema).json(out).orderBy("seq").collect()] == ["1", "2"]


def test_connections_of_two_sessions_stay_apart_in_bounded_files(spark, tmp_path):
    frames = spark.range(100_000).selectExpr("concat('s', id % 2) AS session_id", "concat('c', id DIV 2) AS request_id", "id AS seq", "'sent' AS direction")
    hot = spark.range(20_000).selectExpr("'s0' AS session_id", "'hot' AS request_id", "id AS seq", "'sent' AS direction")
    out = tmp_path / "many"
    S.write_frames_jsonl(frames.unionByName(hot), str(out), files=8)
    files = sorted(out.glob("*.json"))
    assert 1 < len(files) <= 8 and sum(1 for _ in out.iterdir() if _.is_dir()) == 0
    rows = [json.loads(x) for f in files for x in f.read_text().splitlines()]
    keys = [(r["session_id"], r["request_id"], r["seq"]) for r in rows]
    assert keys == sorted(keys) and len(keys) == 120_000 and len({k[:2] for k in keys}) == 100_001
    assert max(sum(1 for _ in f.open()) for f in files) < 40_000


def test_capture_dirs_written_and_read(spark, tmp_path):
    rows = [(f"r{i}", a, json.dumps({"n": i, "a": a})) for i in range(20) for a in ("network", "console")] + [(None, "network", "{}"), ("r0", "network", None)]
    df = spark.createDataFrame(rows, "request_id string, artifact string, content string")
    for _ in range(2):                                         # a task that is run again
        S.write_capture_dirs(df, str(tmp_path))
    assert sorted(os.listdir(tmp_path / "r3")) == ["console.json", "network.json"]
    got = S.read_capture_dirs(spark, str(tmp_path), "console", "n int, a string").collect()
    assert sorted((r.request_id, r.n, r.a) for r in got) == sorted((f"r{i}", i, "console") for i in range(20))


def test_validate_and_secure(spark):
    df = spark.createDataFrame([("a", "1", None, None, False, None, False), ("", "1", None, None, False, None, False),
                                ("b", "1", "None", None, False, None, False), ("c", "1", None, "other.org", False, None, False),
                                ("d", "1", None, None, False, "/admin", False), ("e", "1", "None", None, True, None, True)],
                               "name string, value string, same_site string, domain string, secure boolean, "
                               "cookie_path string, partitioned boolean")
    df = df.selectExpr("*", "'example.com' AS _host", "'/x' AS _path")
    got = [(r.r, r.s) for r in df.selectExpr(f"{K.validate_cookie_sql()} AS r", f"{K.effective_secure_sql()} AS s").collect()]
    assert got == [(None, False), ("empty_name", False), ("samesite_none_requires_secure", True), ("domain_mismatch", False),
                   ("path_mismatch", False), (None, True)]
