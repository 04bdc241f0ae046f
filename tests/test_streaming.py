"""Streaming equals batch across several micro-batches (state carried over)."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from pagefold.operators import cookies as K
from pagefold.operators import events as E
from pagefold.plans import q_cookies as QK
from pagefold.plans import q_events as QE
from pagefold.plans.sqlutil import select_items
from pagefold.streaming import streams as S

CLOSING = "TIMESTAMP '2200-01-01 00:00:00'"


def _rows(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def _run(df, tmp_path, name, mode="append"):
    sink, ckpt = str(tmp_path / name), str(tmp_path / f"{name}-ck")
    q = (df.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert q.exception() is None
    return q, df.sparkSession.read.schema(df.schema).parquet(sink), ckpt


@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    """Seven days of events a file, each file holding some of the next days' as well,
    so that half of every file is late; a last file closes all windows."""
    root = tmp_path_factory.mktemp("events")
    events = spark.read.parquet(f"{SF}/events.parquet")
    day = "CAST(unix_date(CAST(ts AS DATE)) + event_id % 3 AS INT) DIV 3"
    days = [r[0] for r in events.selectExpr(f"{day} AS d").distinct().orderBy("d").collect()]
    step = max(1, len(days) // 6)
    for i in range(0, len(days), step):
        events.where(f"{day} BETWEEN {days[i]} AND {days[min(i + step, len(days)) - 1]}").coalesce(1).write.parquet(f"{root}/{i:03d}")
    values = {"event_id": "-1", "user_id": "-1", "event_type": "'view'", "ts": CLOSING, "props": "'{\"k\": 0}'"}
    (spark.range(1).selectExpr(*[f"CAST({values.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS `{f.name}`" for f in events.schema.fields])
     .coalesce(1).write.parquet(f"{root}/999"))
    return str(root), events


def _typed(events):
    return events.selectExpr(*select_items(QE.cap_events_select(QE.K_SPARK, QE.TS_SPARK)), "CAST(ts AS TIMESTAMP) AS event_time")


def _islands(events, gap_us):
    """(session, request) keys extended by the island of the event: the batch definition of W1."""
    w = "OVER (PARTITION BY session_id, request_id ORDER BY event_time, seq)"
    e = events.selectExpr("*", f"unix_micros(event_time) - lag(unix_micros(event_time)) {w} AS _gap")
    return e.selectExpr("*", f"sum(CASE WHEN _gap < {gap_us} THEN 0 ELSE 1 END) {w} AS _slot")


FIELDS = ["state", "status", "mime_type", "resource_type", "end_ms", "n_sends", "post_data_size_bytes", "graphql_operation_name"]
DAY_US = 86_400_000_000


def _want(events):
    e = _islands(_typed(events), 2 * DAY_US)
    keys = [*E.KEY, "_slot"]
    end = e.groupBy(*keys).agg(F.expr(f"max(unix_micros(event_time)) + {2 * DAY_US} AS end_us"))
    return E.slot_entries(E.slot_states(E.conform_events(e), keys), keys).join(end, keys)


def test_w1_slots_of_late_batches_equal_the_batch_definition_and_state_shrinks(spark, event_files, tmp_path):
    root, events = event_files
    df = S.stream_network_entries(_typed(_stream(spark, root, events.schema)), "2 days", "9 days")
    q, got, _ = _run(df, tmp_path, "w1")
    assert len(q.recentProgress) >= 5
    late = sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators)
    most = max(op.numRowsTotal for p in q.recentProgress for op in p.stateOperators)
    assert late == 0 and q.lastProgress.stateOperators[0].numRowsTotal <= 1 < most              # only the closing event is held
    got = got.where("session_id <> 's-1'").withColumn("end_us", F.expr("unix_micros(slot.end)"))
    assert _rows(got, [*E.KEY, "end_us", *FIELDS]) == _rows(_want(events), [*E.KEY, "end_us", *FIELDS])


def test_w3_counts_what_is_pending_behind_w1(spark, event_files, tmp_path):
    root, events = event_files
    df = S.stream_pending_counts(S.stream_network_entries(_typed(_stream(spark, root, events.schema)), "2 days", "9 days"), "1 day")
    q, got, _ = _run(df.selectExpr("unix_micros(w.start) AS start_us", "resource_type", "n_pending"), tmp_path, "w3")
    assert len(q.lastProgress.stateOperators) == 2
    want = (_want(events).where("state IN ('pending', 'responded')")
            .selectExpr(f"(end_us - 1) DIV {DAY_US} * {DAY_US} AS start_us", "resource_type").groupBy("start_us", "resource_type").agg(F.count("*").alias("n_pending")))
    cols = ["start_us", "resource_type", "n_pending"]
    far = spark.sql(f"SELECT unix_micros({CLOSING})").first()[0] - 10 * DAY_US
    assert _rows(got.where(f"start_us < {far}"), cols) == _rows(want, cols)


def test_later_events_than_the_watermark_are_dropped_and_counted(spark, event_files, tmp_path):
    # Spark drops by the watermark of the batch before the last: files that each hold events of all days.
    root, events = str(tmp_path / "mixed"), event_files[1]
    for i in range(4):
        events.where(f"event_id % 4 = {i}").coalesce(1).write.parquet(f"{root}/{i}")
    df = S.stream_network_entries(_typed(_stream(spark, root, events.schema)), "1 hour", "0 seconds")
    q, got, _ = _run(df, tmp_path, "late")
    assert sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators) > 0


def test_no_credential_reaches_the_sink_or_the_state(spark, event_files, tmp_path):
    root, events = event_files
    some = _typed(_stream(spark, root, events.schema).where("event_id >= 0"))          # nothing closes the last slots
    assert "Bearer" in str(_typed(events).where("event_type = 'view'").first())
    q, got, ckpt = _run(S.stream_network_entries(some, "2 days", "9 days"), tmp_path, "secret")
    state = spark.read.format("statestore").load(ckpt)
    held = [str(r) for r in state.select("value").collect()]
    assert held and any("[redacted]" in v for v in held)
    for text in [*held, *(str(r) for r in got.collect())]:
        assert "Bearer b" not in text and "c=" not in text and "operationName" not in text
    files = [p for p in (tmp_path / "secret").rglob("*.parquet")] + [p for p in (tmp_path / "secret-ck").rglob("*") if p.is_file()]
    assert files and all(b"Bearer b" not in p.read_bytes() for p in files)


def test_w2_sessions_over_several_batches(spark, event_files, tmp_path):
    root, events = event_files
    df = S.stream_quiet_sessions(_typed(_stream(spark, root, events.schema)), "1 hour", "9 days")
    q, got, _ = _run(df, tmp_path, "w2")
    w = "OVER (PARTITION BY session_id ORDER BY event_time, seq)"
    e = (_typed(events).selectExpr("*", f"unix_micros(event_time) - lag(unix_micros(event_time)) {w} AS _gap")
         .selectExpr("*", f"sum(CASE WHEN _gap < 3600000000 THEN 0 ELSE 1 END) {w} AS island"))
    want = e.groupBy("session_id", "island").agg(F.count("*").alias("n_events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    cols = ["session_id", "n_events", "first_seq", "last_seq"]
    assert _rows(got.where("session_id <> 's-1'"), cols) == _rows(want, cols)


def test_w5_console_errors_over_several_batches(spark, event_files, tmp_path):
    root, events = event_files
    params = "concat('{\"type\":\"', CASE event_id % 3 WHEN 0 THEN 'error' ELSE 'log' END, '\",\"args\":[{\"type\":\"string\",\"value\":\"v', event_id, '\"}]}')"
    typed = lambda df: df.selectExpr("concat('s', user_id) AS session_id", "event_id AS seq", "event_id AS ts_ms", f"'{E.CONSOLE}' AS method", f"{params} AS params")
    q, got, _ = _run(S.stream_console_errors(typed(_stream(spark, root, events.schema))), tmp_path, "w5")
    assert len(q.recentProgress) >= 5
    want = E.console_events(typed(events)).where("level = 'error'")
    assert _rows(got.where("seq >= 0"), ["seq", "text"]) == _rows(want, ["seq", "text"])


def test_w4_multi_batch_equals_batch(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    src = str(tmp_path / "pages")
    for i in range(3):
        pages.where(f"page_id % 3 = {i}").coalesce(1).write.mode("append").parquet(f"{src}/p{i}")
    obs = _stream(spark, src, pages.schema).selectExpr(*select_items(QK.cookie_obs_select(QK.HOST_S, QK.LAST2_S, "STRING")))
    q = S.stream_cookie_jar(obs, str(tmp_path / "w4"), str(tmp_path / "w4ck"))
    q.awaitTermination()
    got = S.cookie_jar_from_log(spark, str(tmp_path / "w4"))
    want = K.cookie_jar(QK.obs(lambda name: spark.read.parquet(f"{SF}/{name}.parquet")))
    cols = ["name", "domain", "path", "value", "seq"]
    assert _rows(got, cols) == _rows(want, cols)


@pytest.mark.parametrize("name", ["w2_stream_quiet_sessions", "w3_stream_inflight_counts", "w4_stream_cookie_jar", "w5_stream_console_errors"])
def test_queries_stream_tables_that_are_folders_of_files(spark, tmp_path, name):
    """The files are out of order in time, and none of their rows is lost."""
    from pagefold.plans.registry import load_all
    for table, key in (("events", "event_id"), ("pages", "page_id")):
        rows = spark.read.parquet(f"{SF}/{table}.parquet")
        for i in (2, 0, 1):
            rows.where(f"{key} % 3 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{table}.parquet")
    query = load_all()[name]
    got, want = query.build(spark, str(tmp_path)), query.build(spark, SF)
    assert want.count() > 0
    assert _rows(got, want.columns) == _rows(want, want.columns)
