"""Plan shape guards: the scale properties checked with explain()."""

import __spark_entry__ as E
from conftest import SF


def _plan(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_pipeline_single_exchange(spark):
    plan = _plan(spark, "t6_paragraphs")
    assert plan.count("Exchange") == 1 and "hashpartitioning(page_id" in plan


def test_topk_limits_before_shuffle(spark):
    for name in ("e16_recent_requests", "r7_retry_outcome"):
        assert _plan(spark, name).count("WindowGroupLimit") >= 2, name


def test_scan_prunes_columns(spark):
    plan = _plan(spark, "c9_body_cap")
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan or "page_id,html" in plan.replace(" ", "")


def test_ordered_scans_do_not_double(spark):
    # e1 reads the events once more for the files of captured bodies, r2 the list of sessions
    for name, most in (("e8_pending_by_resource_type", 1), ("e1_network_entries", 2), ("r1_inflight_timeline", 1), ("r2_network_quiet", 2), ("r5_stage_spans", 1)):
        assert _plan(spark, name).count("FileScan") <= most, name
