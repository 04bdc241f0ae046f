"""Streaming queries (W1-W5): each runs the stream to completion
(``availableNow``) over the given tables into the shared checkpoint folder
and returns the resulting table; oracles are the batch definitions."""

from __future__ import annotations

from pagefold.plans import q_cookies as QK
from pagefold.plans import q_events as QE
from pagefold.plans.sqlutil import select_items
from pagefold.plans.registry import REGISTRY, register
from pagefold.operators.events import CONSOLE as E_CONSOLE, EXCEPTION as E_EXCEPTION, SENT as E_SENT
from pagefold.streaming import streams as S

SESSION_GAP = "1 hour"
SLOT_GAP, SLOT_GAP_US = "2 days", 2 * 86_400_000_000


def _stream(spark, sf_dir, table, files=None):
    """The table as a stream, ``files`` of its files a batch (None: all that are there)."""
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # A table is one file or a folder of files; as a pattern its path may name either.
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path[:-1] + "[t]")


def _cap_stream(spark, sf_dir, closing=False):
    """The events as a stream; with ``closing``, followed by one far later event
    (user -1), so that every window of the table closes and is returned. All files
    are one batch: their order says nothing of the events', and none may come late."""
    ev = _stream(spark, sf_dir, "events")
    if closing:
        path = S.scratch_path(spark, "closing-event")
        last = {"event_id": "CAST(-1 AS BIGINT)", "user_id": "-1", "event_type": "'view'", "ts": "TIMESTAMP '2200-01-01 00:00:00'", "props": "'{\"k\": 0}'"}
        spark.range(1).selectExpr(*[f"CAST({last.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS `{f.name}`" for f in ev.schema.fields]).write.parquet(path)
        ev = ev.unionByName(spark.readStream.schema(ev.schema).parquet(path))
    cols = select_items(QE.cap_events_select(QE.K_SPARK, QE.TS_SPARK))
    return ev.selectExpr(*cols, "CAST(ts AS TIMESTAMP) AS event_time")


def _run(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def _finished(q, df, spark, name):
    """Runs an append-mode stream to its end and reads what it wrote."""
    sink, ckpt = S.scratch_path(spark, f"{name}-sink"), S.scratch_path(spark, f"{name}-ckpt")
    _run(q.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    return spark.read.schema(df.schema).parquet(sink)


def w1(spark, sf_dir):
    """Network entries of every closed slot (a silence of two days) == E1 of each island of a request's events."""
    df = S.stream_network_entries(_cap_stream(spark, sf_dir, closing=True), SLOT_GAP, "0 seconds")
    out = _finished(df.writeStream, df, spark, "w1").where("session_id != 's-1'")
    return out.selectExpr(*[c.strip() for c in QE.ENTRY_COLS.split(",")], "redirect_from_request_id", *QE.HINTS.split(", "), *QE.HEADERS_S,
                          "unix_micros(slot.start) AS slot_start_us", "unix_micros(slot.end) AS slot_end_us")


def w2(spark, sf_dir):
    """All session windows (gap 1 hour) of every session."""
    sink, ckpt = S.scratch_path(spark, "w2-sink"), S.scratch_path(spark, "w2-ckpt")
    q = (S.stream_quiet_sessions(_cap_stream(spark, sf_dir, closing=True), SESSION_GAP, "0 seconds")
          .selectExpr("session_id", "w.start AS session_start", "w.end AS session_end", "n_events", "first_seq", "last_seq")
          .writeStream.outputMode("append").format("parquet").option("path", sink)
          .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    _run(q)
    return spark.read.parquet(sink).where("session_id != 's-1'").selectExpr("session_id", "CAST(unix_millis(session_start) AS BIGINT) AS start_ms",
                                               "CAST(unix_millis(session_end) AS BIGINT) AS end_ms", "n_events",
                                               "first_seq", "last_seq")


def w4(spark, sf_dir):
    """Streaming cookie jar (per-batch K2 appended, K2 over the log) == K2."""
    sink, ckpt = S.scratch_path(spark, "w4-sink"), S.scratch_path(spark, "w4-ckpt")
    pages = _stream(spark, sf_dir, "pages", files=1)
    obs = pages.selectExpr(*select_items(QK.cookie_obs_select(QK.HOST_S, QK.LAST2_S, "STRING")))
    _run(S.stream_cookie_jar(obs, sink, ckpt))
    return S.cookie_jar_from_log(spark, sink)


def w3(spark, sf_dir):
    """Requests in flight when their timer fired, per resource type and day: chained behind W1."""
    df = (S.stream_pending_counts(S.stream_network_entries(_cap_stream(spark, sf_dir, closing=True), SLOT_GAP, "0 seconds"), "1 day")
          .selectExpr("unix_millis(w.start) AS window_start_ms", "resource_type", "n_pending"))
    return _finished(df.writeStream, df, spark, "w3").where("window_start_ms < unix_millis(TIMESTAMP '2199-01-01 00:00:00')")


def w5(spark, sf_dir):
    """Console errors and exceptions from the stream, counted per session and level."""
    sink, ckpt = S.scratch_path(spark, "w5-sink"), S.scratch_path(spark, "w5-ckpt")
    c = _cap_stream(spark, sf_dir).selectExpr(
        "session_id", "seq", "ts_ms",
        f"CASE WHEN event_type = 'error' THEN '{E_EXCEPTION}' ELSE '{E_CONSOLE}' END AS method",
        f"{QE.CONSOLE_D} AS console_type", "concat('[{{\"type\":\"string\",\"value\":\"v', CAST(seq AS STRING), '\"}}]') AS args",
        "'{{\"text\":\"Uncaught\"}}' AS exception_json", "CAST(NULL AS STRING) AS stack_url", "CAST(NULL AS INT) AS stack_line")
    q = (S.stream_console_errors(c).writeStream.format("parquet").option("path", sink)
          .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    _run(q)
    return spark.read.parquet(sink).groupBy("session_id", "level").count().withColumnRenamed("count", "n")


def _register_streaming():
    REGISTRY_ITEMS = {
        "w1_stream_network_entries": (w1, W1_ORACLE),
        "w4_stream_cookie_jar": (w4, REGISTRY["k2_cookie_jar"].oracle),
        "w2_stream_quiet_sessions": (w2, W2_ORACLE),
        "w3_stream_inflight_counts": (w3, W3_ORACLE),
        "w5_stream_console_errors": (w5, W5_ORACLE),
    }
    from pagefold.plans.registry import Query
    from pagefold.session import ensure_session_defaults

    for name, (fn, oracle) in REGISTRY_ITEMS.items():
        def build(spark, sf_dir, _fn=fn):
            ensure_session_defaults(spark)
            return _fn(spark, sf_dir)
        REGISTRY[name] = Query(name, build, oracle, (fn.__doc__ or "").strip())


W2_ORACLE = f"""WITH {QE.CE},
_g AS (SELECT *, CASE WHEN lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms, seq) IS NULL
  OR ts_ms - lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms, seq) >= 3600000 THEN 1 ELSE 0 END AS _new FROM ce),
_i AS (SELECT *, sum(_new) OVER (PARTITION BY session_id ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _sid FROM _g),
_s AS (SELECT session_id, min(ts_ms) AS start_ms, max(ts_ms) + 3600000 AS end_ms, count(*) AS n_events, min(seq) AS first_seq,
  max(seq) AS last_seq FROM _i GROUP BY session_id, _sid)
SELECT * FROM _s"""

SLOTS_D = f"""{QE.CE},
_u AS (SELECT ce.*, epoch_us(ev.ts) AS us FROM ce JOIN events ev USING (event_id)),
_g AS (SELECT *, us - lag(us) OVER (PARTITION BY session_id, request_id ORDER BY us, seq) AS _gap FROM _u),
_i AS (SELECT *, sum(CASE WHEN _gap < {SLOT_GAP_US} THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, request_id ORDER BY us, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _slot FROM _g),
_ls AS (SELECT session_id, request_id, _slot, max(seq) FILTER (WHERE method = '{E_SENT}') AS _last_send, count_if(method = '{E_SENT}') AS n_sends,
  min(us) AS slot_start_us, max(us) + {SLOT_GAP_US} AS slot_end_us FROM _i GROUP BY ALL),
_sl AS (SELECT _i.*, _ls.n_sends, slot_start_us, slot_end_us FROM _i JOIN _ls USING (session_id, request_id, _slot) WHERE seq >= _last_send),
ne AS (SELECT session_id, request_id, slot_start_us, slot_end_us, {QE.DUCK_FOLD}, first(n_sends) AS n_sends FROM _sl GROUP BY ALL)"""

W1_ORACLE = f"""WITH {SLOTS_D}
SELECT {QE.ENTRY_COLS}, CASE WHEN has_redirect THEN request_id END AS redirect_from_request_id, {QE.hints_d('_post')}, {QE.HEADERS_D},
  slot_start_us, slot_end_us FROM ne"""

W3_ORACLE = f"""WITH {SLOTS_D}
SELECT ((slot_end_us - 1) // 86400000000) * 86400000 AS window_start_ms, resource_type, count(*) AS n_pending FROM ne
WHERE state IN ('pending', 'responded') GROUP BY ALL"""

W5_ORACLE = f"""WITH {QE.CE}, _c AS (SELECT *, {QE.CONSOLE_D} AS ct FROM ce)
SELECT session_id, {QE.LEVEL_D} AS level, count(*) AS n FROM _c WHERE ({QE.LEVEL_D}) IN ('error', 'exception') GROUP BY ALL"""

_register_streaming()
