"""Readiness, timing and retries over time series.

Every per-key ordered computation uses the chunked scans in ``scan.py``
(running sums, as-of last values, previous/next rows), so a session or
fetch holding a large share of the events is split across tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.operators import scan, stack
from pagefold.operators.events import CACHED, FAILED, FINISHED, KEY, RESPONDED, SENT, conform_events

# --- fixed values ----------------------------------------------------------
NETWORK_IDLE_MS = 800
STABLE_MS = 500
ACQUISITION_TIMEOUT_MS = 30000
RETRIES = 0
BACKOFF_MS = 250
READINESS_RESERVE_MS = 750
READINESS_FALLBACK_MS = 100
TIMEOUT_CODES = ["navigation_timeout", "cdp_timeout", "artifact_capture_timeout", "readiness_timeout"]
# --- end fixed values -------------------------------------------------------

STATE_METHODS = f"'{SENT}', '{RESPONDED}', '{FINISHED}', '{FAILED}'"
NETWORK_METHODS = f"'{SENT}', '{RESPONDED}', '{FINISHED}', '{FAILED}', '{CACHED}'"


def _network(events: DataFrame) -> DataFrame:
    return conform_events(events).where(f"method IN ({NETWORK_METHODS})")


def _timeline(events: DataFrame, rows: int) -> DataFrame:
    """R1 with each session's next event time: one scan by request, one by session,
    cut by the same sample of the events."""
    e = _network(events)
    cuts = scan.sample(e, [*KEY, "seq"], rows)
    state = f"CASE WHEN method IN ({STATE_METHODS}) THEN method END"
    e = scan.multi(e, KEY, "seq", [
        ("sum", f"CASE WHEN method = '{SENT}' THEN 1 ELSE 0 END", "_sends"),
        ("last", state, "_last_state"), ("last_before", state, "_state_before")], sampled=cuts)
    before = f"_sends - CAST(method = '{SENT}' AS INT) > 0 AND _state_before IN ('{SENT}', '{RESPONDED}')"
    e = e.selectExpr("session_id", "seq", "ts_ms", "request_id", "method",
                     f"CAST(_sends > 0 AND _last_state IN ('{SENT}', '{RESPONDED}') AS INT) - CAST(coalesce({before}, false) AS INT) AS _delta")
    return scan.multi(e, ["session_id"], "seq", [("sum", "_delta", "inflight"), ("next", "ts_ms", "_next_ts")], sampled=cuts)


def inflight_timeline(events: DataFrame, rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """In-flight (pending or responded) requests per session after each event.

    A request is open after an event when it has had a send and its latest
    state-changing event is a send or a response; each event contributes
    open_after - open_before of its own request, summed in session order.
    """
    return _timeline(events, rows).selectExpr(
        "session_id", "seq", "ts_ms", "request_id", "method", "CAST(inflight AS BIGINT) AS inflight")


def network_quiet(events: DataFrame, idle_ms: int = NETWORK_IDLE_MS, sessions: DataFrame | None = None,
                  rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """R2: first instant per session at which nothing is in flight and no
    network event followed for ``idle_ms`` (the last event counts as followed
    by silence); sessions that are never quiet have no row.

    ``sessions`` (session_id, started_ms) lists the sessions that were watched:
    one without any network event has been idle for ever, so it is quiet as soon
    as it is started, and every listed session gets a row (null: never quiet)."""
    tl = _timeline(events, rows)
    q = f"inflight = 0 AND (_next_ts IS NULL OR _next_ts - ts_ms >= {int(idle_ms)})"
    g = tl.groupBy("session_id").agg(F.expr(f"min(CASE WHEN {q} THEN ts_ms END) + {int(idle_ms)} AS quiet_at_ms"))
    if sessions is None:
        return g.where("quiet_at_ms IS NOT NULL")
    listed = sessions.groupBy("session_id").agg(F.expr("min(started_ms) AS _started"))
    seen = g.withColumn("_seen", F.lit(True))
    return (listed.join(seen, "session_id", "full")
            .selectExpr("session_id", "CASE WHEN _seen IS NULL THEN _started ELSE quiet_at_ms END AS quiet_at_ms"))


def stability(samples: DataFrame, stable_ms: int = STABLE_MS, order: str = "ts_ms",
              rows: int = scan.CHUNK_ROWS, then: str | None = "seq") -> DataFrame:
    """Per sample, DOM/text stability. Any change of node_count,
    html_hash, text_len or text_hash resets both; stable once unchanged for
    ``stable_ms``; the first sample is never stable."""
    sig = "named_struct('n', node_count, 'h', html_hash, 'l', text_len, 't', text_hash)"
    changed = f"(_prev IS NULL OR _prev != {sig})"
    s = (scan.chunks(samples, ["session_id"], order, then, rows).scan([("prev", sig, "_prev")])
         .scan([("last", f"CASE WHEN {changed} THEN ts_ms END", "_since")]).rows())
    return s.selectExpr(*samples.columns, f"NOT {changed} AND ts_ms - _since >= {int(stable_ms)} AS stable", f"{changed} AS changed")


def readiness_budget_ms(remaining_ms: int, timeout_ms: int) -> int:
    """Remaining minus min(750, timeout/3); min(remaining, 100) when negative."""
    reserve = min(READINESS_RESERVE_MS, timeout_ms // 3)
    return remaining_ms - reserve if remaining_ms >= reserve else min(remaining_ms, READINESS_FALLBACK_MS)


def readiness(events: DataFrame, samples: DataFrame, budget_ms: int, idle_ms: int = NETWORK_IDLE_MS,
              stable_ms: int = STABLE_MS, rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """First sample where the network is quiet and DOM and text are
    stable, before ``first sample + budget``; otherwise readiness_timeout
    with the last flags. The network state at a sample comes from an as-of
    join: samples and events in one stream, last values carried forward."""
    st = stability(samples, stable_ms, "ts_ms", rows, then="seq")
    tl = _timeline(events, rows)
    ev = tl.selectExpr("session_id", "ts_ms", "0 AS _kind", "seq AS _seq", "CAST(inflight AS BIGINT) AS _inflight",
                       "ts_ms AS _ev_ts", "CAST(NULL AS BOOLEAN) AS stable")
    sm = st.selectExpr("session_id", "ts_ms", "1 AS _kind", "seq AS _seq", "CAST(NULL AS BIGINT) AS _inflight",
                       "CAST(NULL AS BIGINT) AS _ev_ts", "stable")
    u = ev.unionByName(sm)
    # the union's cuts come from its two inputs, not from their scans
    place = ["session_id", "ts_ms", "_kind", "_seq"]
    cuts = scan.sample(_network(events).selectExpr("session_id", "ts_ms", "0 AS _kind", "seq AS _seq")
                       .unionByName(samples.selectExpr("session_id", "ts_ms", "1 AS _kind", "seq AS _seq")), place, rows)
    # events before samples at equal times; seq breaks remaining ties
    u = scan.multi(u, ["session_id"], "ts_ms", [
        ("last", "_inflight", "inflight_asof"), ("last", "_ev_ts", "last_event_ts"),
        ("first", "CASE WHEN _kind = 1 THEN ts_ms END", "_t0")], then="_kind, _seq", sampled=cuts)
    s = u.where(f"_kind = 1 AND ts_ms < _t0 + {int(budget_ms)}").selectExpr(
        "session_id", "ts_ms", "stable",
        f"coalesce(inflight_asof, 0) = 0 AND (last_event_ts IS NULL OR ts_ms - last_event_ts >= {int(idle_ms)}) AS network_quiet")
    g = s.groupBy("session_id").agg(
        F.expr("min(CASE WHEN network_quiet AND stable THEN ts_ms END) AS ready_at_ms"),
        F.expr("max_by(named_struct('q', network_quiet, 'd', stable), ts_ms) AS _last"))
    return g.selectExpr("session_id", "ready_at_ms", "ready_at_ms IS NULL AS timed_out",
                        "CASE WHEN ready_at_ms IS NULL THEN 'readiness_timeout' ELSE 'wait_satisfied' END AS capture_reason",
                        "CASE WHEN ready_at_ms IS NULL THEN _last.q ELSE true END AS network_quiet",
                        "CASE WHEN ready_at_ms IS NULL THEN _last.d ELSE true END AS dom_stable",
                        "CASE WHEN ready_at_ms IS NULL THEN _last.d ELSE true END AS text_stable")


def stage_spans(stage_events: DataFrame, rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """begin/end events of a fetch's stages -> spans.

    A fetch has one stack of open stages (`stack.replayed`): a begin directly
    inside a stage of the same name opens no span, an end closes the latest open
    begin of its stage wherever it lies in the stack, an end without one is
    dropped, and a span still open at the end is ``started``. An end carrying one
    of the timeout codes gives status ``timeout``, another code ``error``, none
    ``ok``.
    """
    tcodes = ", ".join(f"'{c}'" for c in TIMEOUT_CODES)
    return stack.replayed(stage_events, rows).selectExpr(
        "fetch_id", "stage", "start_ms", "end_ms", "end_ms - start_ms AS duration_ms",
        "CASE WHEN end_ms IS NULL THEN 'started' WHEN error_code IS NULL THEN 'ok' "
        f"WHEN error_code IN ({tcodes}) THEN 'timeout' ELSE 'error' END AS status")


def stage_stats(spans: DataFrame, exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Count, total and median duration per (stage, status).

    ``exact`` keeps one count per distinct duration in each group (bounded by
    the distinct values, merged map-side); ``exact=False`` uses the bounded
    ``percentile_approx`` sketch for groups with very many distinct values."""
    p50 = "percentile(duration_ms, 0.5)" if exact else f"CAST(percentile_approx(duration_ms, 0.5, {int(accuracy)}) AS DOUBLE)"
    return spans.groupBy("stage", "status").agg(
        F.expr("count(*) AS n"), F.expr("CAST(sum(duration_ms) AS BIGINT) AS total_ms"), F.expr(f"{p50} AS p50_ms"))


def retry_outcome(attempts: DataFrame, retries: int = RETRIES, backoff_ms: int = BACKOFF_MS,
                  retryable: DataFrame | None = None) -> DataFrame:
    """Per request, the first success, first non-retryable error or the
    attempt ``retries + 1``; requests without such an attempt are ``open``.
    Only the first ``retries + 1`` attempts matter, so the per-request
    ranking is a top-k (``row_number() <= n``), which Spark limits per task
    before the shuffle."""
    from pagefold import dims
    n = retries + 1
    rk = attempts.selectExpr("*", "row_number() OVER (PARTITION BY request_id ORDER BY attempt_order) AS attempt_no") \
                 .where(f"attempt_no <= {n}")
    codes = ", ".join(f"'{c}'" for c in sorted(dims.RETRYABLE_CODES))
    rk = rk.selectExpr("*", f"code = 'success' OR code NOT IN ({codes}) OR attempt_no = {n} AS _terminal")
    g = rk.groupBy("request_id").agg(F.expr("min(CASE WHEN _terminal THEN attempt_no END) AS terminal_try"),
                                     F.expr("min_by(code, CASE WHEN _terminal THEN attempt_no END) AS final_code"),
                                     F.expr("count(*) AS attempts_seen"))
    return g.selectExpr("request_id", "CAST(terminal_try AS BIGINT) AS terminal_try",
                        "CASE WHEN terminal_try IS NULL THEN 'open' WHEN final_code = 'success' THEN 'success' "
                        "ELSE 'failed' END AS outcome", "final_code",
                        f"CAST((coalesce(terminal_try, attempts_seen) - 1) * {int(backoff_ms)} AS BIGINT) AS waited_ms")


def timeout_attribution(spans: DataFrame, deadlines: DataFrame) -> DataFrame:
    """The stage whose span was active when a fetch's budget ran out
    (latest start among spans covering the deadline)."""
    j = spans.join(deadlines, "fetch_id").where(
        "start_ms <= deadline_ms AND (end_ms IS NULL OR end_ms > deadline_ms)")
    g = j.groupBy("fetch_id").agg(F.expr("max_by(stage, named_struct('s', start_ms, 'st', stage)) AS timed_out_stage"))
    return deadlines.select("fetch_id", "deadline_ms").join(g, "fetch_id", "left")
