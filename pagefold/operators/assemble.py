"""One wide result row per acquisition, joined from its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold import dims
from pagefold.functions.core import lit
from pagefold.operators import events as E
from pagefold.operators import rules as R

NO_WARNINGS = "CAST(array() AS array<struct<artifact:string,code:string,detail:string>>)"
NO_STAGES = "CAST(array() AS array<struct<name:string,status:string,duration_ms:bigint>>)"
UNSEEN = "main document network request was not observed"
NO_BODY = "cannot write body_file: main document request was not observed"


def main_outcomes(events: DataFrame) -> DataFrame:
    """What became of every session's main request (E2): ``session_id``, its request id, the
    URL, status and state of its last hop, and how many hops redirected (E3). The last
    hop is the request's slot (E1), so aggregates do, without the scan that numbers hops."""
    e = E.conform_events(events)
    sent = f"method = {lit(E.SENT)}"
    sends = e.where(sent).groupBy(*E.KEY).agg(
        F.expr("min(seq) FILTER (WHERE resource_type = 'Document') AS _first"),
        F.expr("count_if(has_redirect) - min_by(CAST(coalesce(has_redirect, false) AS INT), seq) AS redirects")).where("_first IS NOT NULL")
    slots = E.slot_entries(E.slot_states(e)).select(*E.KEY, "url", "status", "state")
    ends = slots.join(sends, E.KEY).groupBy("session_id").agg(F.expr("min_by(struct(request_id, url, status, state, redirects), _first) AS _m"))
    return ends.selectExpr("session_id", "_m.request_id AS main_request_id", "_m.url AS main_url", "_m.status AS main_status",
                           "_m.state AS main_state", "_m.redirects AS redirects")


def _stages(spans: DataFrame) -> DataFrame:
    """Trace of every fetch: its spans by start, an open one lasting to the fetch's last instant."""
    g = spans.groupBy(F.col("fetch_id").alias("request_id")).agg(
        F.expr("array_sort(collect_list(struct(start_ms, stage, status, end_ms))) AS _spans"),
        F.min("start_ms").alias("_from"), F.max(F.greatest("start_ms", "end_ms")).alias("_until"))
    return g.selectExpr("request_id", "_until - _from AS duration_ms", "transform(_spans, _s -> named_struct('name', _s.stage, 'status', _s.status, "
                        "'duration_ms', coalesce(_s.end_ms, _until) - _s.start_ms)) AS stages")


def assemble_results(acq: DataFrame, mode: str = "auto", want_content: bool = True, warnings: DataFrame | None = None,
                     artifacts: DataFrame | None = None, stages: DataFrame | None = None, retries: DataFrame | None = None,
                     main: DataFrame | None = None) -> DataFrame:
    """Acquisitions ``(request_id, request_url, status, content_type, html,
    error_code)`` -> result rows, one for each.

    The rules give the render plan, page kind, next action, error info and size
    warnings of a row. The rest is joined on ``request_id``, every part once and
    aggregated to one row a request before it: ``warnings`` (artifact, code,
    detail), ``artifacts`` (S6: a ``<artifact>_file`` column each), ``stages`` (R5
    spans, ``fetch_id`` being the request: the trace's stages and duration),
    ``retries`` (R7: attempts, waiting and the final error code) and ``main``
    (`main_outcomes`, through the acquisition's ``session_id``: final URL, status
    and redirects). With ``main``, a main request that was not observed, or has
    no status, is a warning, as is a wanted body without one. A part that
    is left out, or holds nothing for a request, leaves NULL or an empty list. The
    page text is read by the rules only and meets no join.
    """
    own = ["CASE WHEN _size IS NOT NULL THEN named_struct('artifact', 'rendered_html', 'code', _size, 'detail', 'rendered_html artifact size check') END",
           "CASE WHEN page_kind IS NOT NULL THEN named_struct('artifact', 'content', 'code', page_kind, 'detail', 'challenge page') END"]
    session = ["session_id"] if main is not None else []
    r = acq.selectExpr("request_id", "request_url", "status", "error_code", *session, f"{R.render_plan_sql(lit(mode), str(want_content).lower())} AS _plan",
                       f"{R.classify_body_sql()} AS page_kind", f"{R.size_warning_sql('html', 1)} AS _size", "request_url = 'about:blank' AS _blank")
    if retries is None:
        r = r.selectExpr("*", "CAST(NULL AS BIGINT) AS attempts", "CAST(NULL AS STRING) AS outcome", "CAST(NULL AS BIGINT) AS waited_ms")
    else:
        r = r.join(retries.selectExpr("request_id", "terminal_try AS attempts", "outcome", "CASE WHEN outcome = 'failed' THEN final_code END AS _failed", "waited_ms"), "request_id", "left")
        r = r.withColumn("error_code", F.coalesce("error_code", "_failed"))
    if stages is None:
        r = r.selectExpr("*", "CAST(NULL AS BIGINT) AS duration_ms", f"{NO_STAGES} AS stages")
    else:
        r = r.join(_stages(stages), "request_id", "left")
    missing = "false"
    if artifacts is not None:
        files = artifacts.groupBy("request_id").agg(
            *[F.expr(f"max(file) FILTER (WHERE artifact = {lit(a)}) AS {a}_file") for a, _ in dims.ARTIFACTS],
            F.expr("count_if(artifact = 'body' AND NOT present) > 0 AS _no_body"))
        r, missing = r.join(files, "request_id", "left"), "coalesce(_no_body, false)"
    if main is None:
        r = r.selectExpr("*", "request_url AS final_url", "status AS _status", "CAST(NULL AS BIGINT) AS redirects", "CAST(NULL AS BOOLEAN) AS _seen")
    else:
        r = r.join(main, "session_id", "left").selectExpr(
            "*", "coalesce(nullif(main_url, ''), request_url) AS final_url", "coalesce(main_status, status) AS _status", "main_request_id IS NOT NULL AS _seen")
        own += [f"CASE WHEN NOT _seen AND NOT _blank THEN named_struct('artifact', 'network', 'code', 'artifact_capture_failed', 'detail', {lit(UNSEEN)}) END",
                "CASE WHEN _seen AND main_status IS NULL THEN named_struct('artifact', 'network', 'code', 'artifact_capture_failed', "
                "'detail', concat('main request ', main_request_id, ' had no response status')) END",
                f"CASE WHEN NOT _seen AND {missing} THEN named_struct('artifact', 'body', 'code', 'artifact_capture_failed', 'detail', {lit(NO_BODY)}) END"]
    listed = f"array_compact(array({', '.join(own)}))"
    if warnings is not None:
        more = warnings.groupBy("request_id").agg(F.expr("collect_list(struct(artifact, code, detail)) AS _more"))
        r = r.join(more, "request_id", "left")
        listed = f"concat({listed}, coalesce(_more, {NO_WARNINGS}))"
    r = R.with_error_info(r)
    files = [f"{a}_file" for a, _ in dims.ARTIFACTS] if artifacts is not None else []
    return r.selectExpr(
        "request_id", "request_url", "final_url", "_status AS status",
        f"named_struct('render_mode', {lit(mode)}, 'render_decision', _plan.render_decision, 'render_used', _plan.render_decision = 'browser', "
        "'escalation_reason', _plan.escalation_reason, 'main_request_observed', _seen, 'redirects', redirects, 'attempts', attempts, "
        f"'waited_ms', waited_ms, 'duration_ms', duration_ms, 'stages', coalesce(stages, {NO_STAGES})) AS trace",
        "page_kind", "CASE WHEN page_kind IS NOT NULL THEN 'human_takeover' END AS next_action",
        "error_code", "retryable", "outcome", f"array_sort({listed}) AS warnings", *files)
