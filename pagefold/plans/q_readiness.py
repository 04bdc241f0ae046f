"""Queries for readiness, stage timing and retries."""

from __future__ import annotations

from pagefold import dims
from pagefold.operators import readiness as R
from pagefold.operators.events import CACHED, FAILED, FINISHED, RESPONDED, SENT
from pagefold.plans.q_events import CE, K_DUCK, K_SPARK, TS_DUCK, TS_SPARK, cap_events
from pagefold.plans.sqlutil import select_items
from pagefold.plans.registry import register

# --- fixed values: adapters (FIXTURES 2.1, 2.5) -----------------------------
IDLE_MS = 3_600_000
SAMPLE_STABLE_MS = 43_200_000
READINESS_BUDGET_MS = 864_000_000
RETRY_CODES = ["success", "navigation_timeout", "host_unreachable", "tls_error", "dns_resolution_failed"]
RETRIES = 2
BACKOFF_MS = 250
DEADLINE_AFTER_MS = 3_600_000
STAGE_CODES = ["navigation_timeout", "host_unreachable", "readiness_timeout"]
# --- end fixed values -------------------------------------------------------

STATE = f"'{SENT}', '{RESPONDED}', '{FINISHED}', '{FAILED}'"
NET = f"{STATE}, '{CACHED}'"
RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

TIMELINE_D = f"""{CE},
_a AS (SELECT *, sum(CASE WHEN method = '{SENT}' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, request_id ORDER BY seq {RUN}) AS _sends,
  last_value(CASE WHEN method IN ({STATE}) THEN method END IGNORE NULLS) OVER (PARTITION BY session_id, request_id ORDER BY seq {RUN}) AS _ls
  FROM ce WHERE method IN ({NET})),
_b AS (SELECT *, CAST(_sends > 0 AND _ls IN ('{SENT}', '{RESPONDED}') AS INTEGER) AS _open FROM _a),
_c AS (SELECT *, _open - coalesce(lag(_open) OVER (PARTITION BY session_id, request_id ORDER BY seq), 0) AS _d FROM _b),
tl AS (SELECT session_id, seq, ts_ms, request_id, method, CAST(sum(_d) OVER (PARTITION BY session_id ORDER BY seq {RUN}) AS BIGINT) AS inflight FROM _c)"""


@register("r1_inflight_timeline", f"WITH {TIMELINE_D}\nSELECT * FROM tl")
def r1(t):
    """In-flight requests per session after every network event."""
    return R.inflight_timeline(cap_events(t))


#: Watched sessions: one for each customer, most of them without events.
SESSIONS = "concat('s', CAST(c_custkey AS STRING)) AS session_id, CAST(c_custkey AS BIGINT) * 1000 AS started_ms"


@register("r2_network_quiet", f"""WITH {TIMELINE_D},
_n AS (SELECT *, lead(ts_ms) OVER (PARTITION BY session_id ORDER BY seq) AS _next FROM tl),
_q AS (SELECT session_id, min(ts_ms) FILTER (WHERE inflight = 0 AND (_next IS NULL OR _next - ts_ms >= {IDLE_MS})) + {IDLE_MS} AS quiet_at_ms FROM _n GROUP BY session_id),
_l AS (SELECT {SESSIONS.replace('AS STRING)', 'AS VARCHAR)')} FROM customer)
SELECT session_id, quiet_at_ms FROM _q
UNION ALL SELECT session_id, started_ms FROM _l WHERE session_id NOT IN (SELECT session_id FROM ce WHERE method IN ({NET}))""")
def r2(t):
    """First network-quiet instant per watched session (idle one hour on this data); without events, its start."""
    return R.network_quiet(cap_events(t), IDLE_MS, t("customer").selectExpr(*select_items(SESSIONS)))


def samples_select(ts: str) -> str:
    day = f"CAST(floor(({ts}) / 86400000) AS BIGINT)"
    return (f"concat('s', CAST(user_id AS STRING)) AS session_id, event_id AS seq, {ts} AS ts_ms, "
            f"CAST({day} DIV 2 AS BIGINT) AS text_hash, CAST({day} DIV 3 AS BIGINT) AS html_hash, 100 AS node_count, "
            f"CAST(1000 + {day} DIV 2 AS BIGINT) AS text_len")


def samples(t):
    return t("events").selectExpr(*select_items(samples_select(TS_SPARK)))


SAMPLES_D = f"ps AS (SELECT {samples_select(TS_DUCK).replace('AS STRING)', 'AS VARCHAR)').replace(' DIV ', ' // ')} FROM events)"
STABILITY_D = f"""{SAMPLES_D},
_p AS (SELECT *, lag({{'n': node_count, 'h': html_hash, 'l': text_len, 't': text_hash}}) OVER (PARTITION BY session_id ORDER BY ts_ms, seq) AS _prev,
  {{'n': node_count, 'h': html_hash, 'l': text_len, 't': text_hash}} AS _sig FROM ps),
_q AS (SELECT *, _prev IS NULL OR _prev != _sig AS _changed FROM _p),
_r AS (SELECT *, last_value(CASE WHEN _changed THEN ts_ms END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts_ms, seq {RUN}) AS _since FROM _q),
st AS (SELECT session_id, seq, ts_ms, text_hash, html_hash, node_count, text_len, NOT _changed AND ts_ms - _since >= {SAMPLE_STABLE_MS} AS stable,
  _changed AS changed FROM _r)"""


@register("r3_stability", f"WITH {STABILITY_D}\nSELECT * FROM st")
def r3(t):
    """DOM/text stability per page-metrics sample (gaps and islands)."""
    return R.stability(samples(t), SAMPLE_STABLE_MS)


@register("r4_readiness", f"""WITH {TIMELINE_D}, {STABILITY_D},
_u AS (SELECT session_id, ts_ms, 0 AS _kind, seq AS _seq, inflight AS _inflight, ts_ms AS _ev_ts, NULL::BOOLEAN AS stable FROM tl
  UNION ALL SELECT session_id, ts_ms, 1, seq, NULL, NULL, stable FROM st),
_v AS (SELECT *, last_value(_inflight IGNORE NULLS) OVER w AS ia, last_value(_ev_ts IGNORE NULLS) OVER w AS le FROM _u
  WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, _kind, _seq {RUN})),
_s AS (SELECT session_id, ts_ms, stable, coalesce(ia, 0) = 0 AND (le IS NULL OR ts_ms - le >= {IDLE_MS}) AS nq,
  min(ts_ms) OVER (PARTITION BY session_id) AS _t0 FROM _v WHERE _kind = 1),
_g AS (SELECT session_id, min(CASE WHEN nq AND stable THEN ts_ms END) AS ready_at_ms, arg_max({{'q': nq, 'd': stable}}, ts_ms) AS _last
  FROM _s WHERE ts_ms < _t0 + {READINESS_BUDGET_MS} GROUP BY session_id)
SELECT session_id, ready_at_ms, ready_at_ms IS NULL AS timed_out,
  CASE WHEN ready_at_ms IS NULL THEN 'readiness_timeout' ELSE 'wait_satisfied' END AS capture_reason,
  CASE WHEN ready_at_ms IS NULL THEN _last.q ELSE true END AS network_quiet,
  CASE WHEN ready_at_ms IS NULL THEN _last.d ELSE true END AS dom_stable,
  CASE WHEN ready_at_ms IS NULL THEN _last.d ELSE true END AS text_stable FROM _g""")
def r4(t):
    """Readiness per session: first quiet-and-stable sample within the budget (as-of join)."""
    return R.readiness(cap_events(t), samples(t), READINESS_BUDGET_MS, IDLE_MS, SAMPLE_STABLE_MS)


def stage_events_select(k: str, ts: str) -> str:
    code = ("CASE WHEN event_type = 'purchase' THEN CASE event_id % 5 "
            + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(STAGE_CODES)) + " END END")
    return (f"user_id AS fetch_id, concat('st', CAST(({k}) % 4 AS STRING)) AS stage, event_id AS seq, {ts} AS ts_ms, "
            f"CASE event_type WHEN 'view' THEN 'begin' ELSE 'end' END AS event, {code} AS error_code")


def stage_events(t):
    return t("events").where("event_type IN ('view', 'purchase')").selectExpr(
        *select_items(stage_events_select(K_SPARK, TS_SPARK)))


SE_D = (f"se AS (SELECT {stage_events_select(K_DUCK, TS_DUCK).replace('AS STRING)', 'AS VARCHAR)')} FROM events "
        f"WHERE event_type IN ('view', 'purchase'))")
# Begins are paired with ends level by level; a begin is nested if the latest other begin open then has its stage.
SPANS_D = f"""{SE_D},
_a AS (SELECT *, sum(CASE WHEN event = 'begin' THEN 1 ELSE -1 END) OVER (PARTITION BY fetch_id, stage ORDER BY seq {RUN}) AS _s FROM se),
_b AS (SELECT *, _s - least(0, min(_s) OVER (PARTITION BY fetch_id, stage ORDER BY seq {RUN})) AS depth FROM _a),
_c AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY fetch_id, stage ORDER BY seq), 0) AS _db FROM _b),
_d AS (SELECT *, CASE event WHEN 'begin' THEN depth ELSE _db END AS _level FROM _c WHERE event = 'begin' OR _db > 0),
_e AS (SELECT *, lead(seq) OVER w AS _end, lead(ts_ms) OVER w AS _end_ms, lead(error_code) OVER w AS _code FROM _d
  WINDOW w AS (PARTITION BY fetch_id, stage, _level ORDER BY seq)),
_t AS (SELECT * FROM _e WHERE event = 'begin'),
_o AS (SELECT x.fetch_id, x.seq, arg_max(y.stage, y.seq) AS _top FROM _t x JOIN _t y
  ON y.fetch_id = x.fetch_id AND y.seq < x.seq AND (y._end IS NULL OR y._end > x.seq) GROUP BY ALL),
spans AS (SELECT x.fetch_id, x.stage, x.ts_ms AS start_ms, x._end_ms AS end_ms, x._end_ms - x.ts_ms AS duration_ms,
  CASE WHEN x._end IS NULL THEN 'started' WHEN x._code IS NULL THEN 'ok' WHEN x._code IN ({', '.join(f"'{c}'" for c in R.TIMEOUT_CODES)}) THEN 'timeout' ELSE 'error' END AS status
  FROM _t x LEFT JOIN _o o ON o.fetch_id = x.fetch_id AND o.seq = x.seq WHERE o._top IS NULL OR o._top <> x.stage)"""


@register("r5_stage_spans", f"WITH {SPANS_D}\nSELECT * FROM spans")
def r5(t):
    """Spans of each fetch's stage stack; a begin directly inside its own stage opens none; open spans are 'started'."""
    return R.stage_spans(stage_events(t))


@register("r6_stage_stats", """WITH sp AS (SELECT concat('st', CAST(l_linenumber AS VARCHAR)) AS stage,
  CASE l_returnflag WHEN 'A' THEN 'ok' WHEN 'N' THEN 'timeout' ELSE 'error' END AS status, CAST(l_quantity AS BIGINT) AS duration_ms FROM lineitem)
SELECT stage, status, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS total_ms, quantile_cont(duration_ms, 0.5) AS p50_ms FROM sp GROUP BY ALL""")
def r6(t):
    """Count, total and median duration per (stage, status)."""
    sp = t("lineitem").selectExpr("l_orderkey AS fetch_id", "concat('st', CAST(l_linenumber AS STRING)) AS stage",
                                  "CASE l_returnflag WHEN 'A' THEN 'ok' WHEN 'N' THEN 'timeout' ELSE 'error' END AS status",
                                  "CAST(l_quantity AS BIGINT) AS duration_ms")
    return R.stage_stats(sp)


CODE_CASE = "CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(RETRY_CODES)) + " END"
RETRYABLE = ", ".join(f"'{c}'" for c in sorted(dims.RETRYABLE_CODES))


RETRY_D = f"""WITH a AS (SELECT o_custkey AS request_id, o_orderkey AS attempt_order, {CODE_CASE} AS code FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY attempt_order) AS attempt_no FROM a),
x AS (SELECT *, code = 'success' OR code NOT IN ({RETRYABLE}) OR attempt_no = {RETRIES + 1} AS _t FROM r WHERE attempt_no <= {RETRIES + 1}),
g AS (SELECT request_id, min(CASE WHEN _t THEN attempt_no END) AS tt, arg_min(code, CASE WHEN _t THEN attempt_no END) AS fc, count(*) AS seen FROM x GROUP BY ALL)
SELECT request_id, CAST(tt AS BIGINT) AS terminal_try, CASE WHEN tt IS NULL THEN 'open' WHEN fc = 'success' THEN 'success' ELSE 'failed' END AS outcome,
  fc AS final_code, CAST((coalesce(tt, seen) - 1) * {BACKOFF_MS} AS BIGINT) AS waited_ms FROM g"""


@register("r7_retry_outcome", RETRY_D)
def r7(t):
    """Retry outcome per request: first success / non-retryable error / last allowed try."""
    a = t("orders").selectExpr("o_custkey AS request_id", "o_orderkey AS attempt_order", f"{CODE_CASE} AS code")
    return R.retry_outcome(a, RETRIES, BACKOFF_MS)


@register("r8_timeout_attribution", f"""WITH {SPANS_D},
d AS (SELECT fetch_id, min(start_ms) + {DEADLINE_AFTER_MS} AS deadline_ms FROM spans GROUP BY fetch_id),
j AS (SELECT d.fetch_id, arg_max(stage, {{'s': start_ms, 'st': stage}}) AS timed_out_stage FROM spans JOIN d USING (fetch_id)
  WHERE start_ms <= deadline_ms AND (end_ms IS NULL OR end_ms > deadline_ms) GROUP BY d.fetch_id)
SELECT d.fetch_id, d.deadline_ms, j.timed_out_stage FROM d LEFT JOIN j USING (fetch_id)""")
def r8(t):
    """Stage active when each fetch's budget (first start + 1 h) ran out."""
    from pyspark.sql import functions as F
    sp = R.stage_spans(stage_events(t))
    d = sp.groupBy("fetch_id").agg(F.expr(f"min(start_ms) + {DEADLINE_AFTER_MS} AS deadline_ms"))
    return R.timeout_attribution(sp, d)
