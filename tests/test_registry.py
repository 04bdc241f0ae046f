"""Every registered query builds and runs on sf0.001 with a stable schema."""

import pytest

import __spark_entry__ as E
from conftest import SF

FAST = ["t5_page_title", "t10_resolve_url", "c2_classify_body", "c4_render_plan", "e2_main_request",
        "k2_cookie_jar", "r7_retry_outcome", "s6_artifact_manifest", "e1_network_entries", "e12_console_events", "e14_ws_frames",
        "k1_parse_set_cookie", "c12_stale_navigation", "n10_observation_empty", "t22_content_warnings", "s3_read_capture_events"]


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["kind", "same_site", "n_links"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    names = {q for q in E.queries() if q != "pipeline" and not q.startswith("op")}
    assert names <= set(E.oracle_sql())
    assert len(names) >= 104


@pytest.mark.parametrize("name", FAST)
def test_fast_queries_have_rows(spark, name):
    df = E.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0
