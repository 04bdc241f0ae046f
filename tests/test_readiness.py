"""Readiness, stage spans and retries."""

import random

import pytest

from pagefold.operators import readiness as R


def test_retry_outcomes(spark):
    a = spark.createDataFrame([("u", 1, "host_unreachable"), ("u", 2, "host_unreachable"), ("u", 3, "host_unreachable"),
                               ("i", 1, "invalid_argument"), ("i", 2, "success"), ("o", 1, "host_unreachable")],
                              "request_id string, attempt_order int, code string")
    got = {r.request_id: (r.terminal_try, r.outcome, r.waited_ms) for r in R.retry_outcome(a, 2, 150).collect()}
    assert got["u"] == (3, "failed", 300)
    assert got["i"] == (1, "failed", 0)
    assert got["o"] == (None, "open", 0)
    assert R.readiness_budget_ms(30000, 30000) == 29250 and R.readiness_budget_ms(50, 30000) == 50


def test_stability(spark):
    s = spark.createDataFrame([("s", i, t, h, h, 10, 5) for i, (t, h) in enumerate([(0, 1), (100, 1), (700, 1), (800, 2), (1400, 2)])],
                              "session_id string, seq long, ts_ms long, text_hash long, html_hash long, node_count int, text_len int")
    got = [r.stable for r in R.stability(s, 500).orderBy("seq").collect()]
    assert got == [False, False, True, False, True]


def test_stage_spans(spark):
    ev = spark.createDataFrame([(1, "nav", 1, 10, "begin", None), (1, "nav", 2, 20, "begin", None),
                                (1, "nav", 3, 30, "end", None), (1, "nav", 4, 40, "end", "navigation_timeout"),
                                (1, "cap", 5, 50, "end", None), (1, "cap", 6, 60, "begin", None)],
                               "fetch_id long, stage string, seq long, ts_ms long, event string, error_code string")
    got = sorted((r.stage, r.start_ms, r.end_ms, r.status) for r in R.stage_spans(ev).collect())
    assert got == [("cap", 60, None, "started"), ("nav", 10, 40, "timeout")]


def _events(spark):
    from conftest import SF
    from pagefold.plans import q_events, q_readiness
    t = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    return q_events.cap_events(t), q_readiness.samples(t), q_readiness.stage_events(t)


@pytest.mark.parametrize("op", ["r1", "r2", "r3", "r4", "r5"])
def test_cut_scans_equal_whole_ones(spark, op):
    events, samples, stages = _events(spark)
    run = {"r1": lambda **k: R.inflight_timeline(events, **k), "r2": lambda **k: R.network_quiet(events, 3_600_000, **k),
           "r3": lambda **k: R.stability(samples, 43_200_000, **k), "r4": lambda **k: R.readiness(events, samples, 864_000_000, 3_600_000, 43_200_000, **k),
           "r5": lambda **k: R.stage_spans(stages, **k)}[op]
    whole, cut = run(), run(rows=5)
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))


@pytest.mark.parametrize("op, most", [("r1", 2), ("r3", 2), ("r5", 2), ("r4", 4), ("r8", 6)])
def test_tables_are_read_once_more_than_needed_at_most(spark, op, most):
    """The cuts' pass is run when a query is built; the plan holds the other reads."""
    from conftest import SF
    from pagefold.plans.registry import load_all
    name = next(n for n in load_all() if n.startswith(op + "_"))
    plan = load_all()[name].build(spark, SF)._jdf.queryExecution().executedPlan().toString()
    passes = {"r1": 1, "r3": 1, "r5": 1, "r4": 3, "r8": 1}[op]           # r4: a sample of events, of samples, and of both
    assert plan.count("FileScan") <= most - (0 if op == "r4" else passes) and plan.count("FileScan") > 0


def _spans(rows):
    """A plain stack: (stage, seq, ts, nested), ends close the latest begin of their stage."""
    open_, out = [], []
    for fetch, stage, seq, ts, event, code in sorted(rows, key=lambda r: r[2]):
        if event == "begin":
            open_.append((stage, ts, bool(open_) and open_[-1][0] == stage))
            continue
        at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == stage), None)
        if at is not None:
            _, start, nested = open_.pop(at)
            if not nested:
                out.append((stage, start, ts, "ok" if code is None else "timeout" if code in R.TIMEOUT_CODES else "error"))
    return out + [(stage, ts, None, "started") for stage, ts, nested in open_ if not nested]


@pytest.mark.parametrize("rows", [2, 7, 1 << 18])
def test_interleaved_stages_against_a_plain_stack(spark, rows):
    rnd = random.Random(rows)
    ev = [(f, rnd.choice("abc"), f * 1000 + i, 10 * i, "begin" if rnd.random() < [0.5, 0.7, 0.3][f % 3] else "end",
           rnd.choice([None, None, "cdp_timeout", "tls_error"])) for f in range(30) for i in range(rnd.choice([1, 5, 60, 300]))]
    df = spark.createDataFrame(ev, "fetch_id long, stage string, seq long, ts_ms long, event string, error_code string")
    got = {}
    for r in R.stage_spans(df, rows).collect():
        got.setdefault(r.fetch_id, []).append((r.stage, r.start_ms, r.end_ms, r.status))
    for f in range(30):
        assert sorted(got.get(f, []), key=str) == sorted(_spans([e for e in ev if e[0] == f]), key=str)


def test_sessions_without_events_are_quiet(spark):
    from pagefold.operators.events import SENT
    ev = spark.createDataFrame([("a", "r", 1, 5, SENT)], "session_id string, request_id string, seq long, ts_ms long, method string")
    listed = spark.createDataFrame([("a", 0), ("b", 7)], "session_id string, started_ms long")
    assert sorted((r.session_id, r.quiet_at_ms) for r in R.network_quiet(ev, 10, listed).collect()) == [("a", None), ("b", 7)]
