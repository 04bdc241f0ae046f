"""Small fixed dimension tables (error codes, artifact tokens, mime map).

These are bounded by definition (tens of rows), so joining them with
``broadcast`` is always safe whatever the size of the fact table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's contract) --------------------
# Error codes in contract order, with default retryability and category.
# Retryable by default: navigation_timeout, host_unreachable,
# dns_resolution_failed, target_unreachable, tab_crashed, cdp_timeout, io_error.
ERROR_CODES = [
    "navigation_timeout", "render_unavailable", "host_unreachable",
    "dns_resolution_failed", "target_unreachable", "tls_error", "tab_crashed",
    "profile_locked", "browser_launch_failed", "cdp_unavailable", "cdp_error",
    "cdp_timeout", "wait_selector_unmatched", "backend_unsupported",
    "artifact_capture_failed", "artifact_capture_timeout", "artifact_empty",
    "artifact_tiny", "bot_wall_detected", "security_challenge_detected",
    "network_not_idle", "navigation_stale", "observation_empty",
    "pending_xhr_at_capture", "readiness_timeout", "network_body_truncated",
    "profile_not_found", "profile_delete_locked", "profile_invalid_name",
    "profile_root_unavailable", "invalid_argument", "invalid_endpoint",
    "io_error", "internal_error",
]
RETRYABLE_CODES = {
    "navigation_timeout", "host_unreachable", "dns_resolution_failed",
    "target_unreachable", "tab_crashed", "cdp_timeout", "io_error",
}
TRANSPORT_CODES = {
    "navigation_timeout", "host_unreachable", "dns_resolution_failed",
    "target_unreachable", "tls_error", "tab_crashed", "browser_launch_failed",
}
WARNING_CODES = {
    "backend_unsupported", "artifact_capture_failed", "artifact_capture_timeout",
    "network_body_truncated", "network_not_idle", "pending_xhr_at_capture",
    "artifact_empty", "artifact_tiny", "bot_wall_detected",
    "security_challenge_detected", "observation_empty", "readiness_timeout",
}
CONFIGURATION_CODES = {
    "invalid_argument", "invalid_endpoint", "render_unavailable", "io_error",
    "profile_locked", "profile_not_found", "profile_delete_locked",
    "profile_invalid_name", "profile_root_unavailable",
}

# Artifact tokens and their fixed file names; the first nine are the default want.
ARTIFACTS = [
    ("body", "body"), ("rendered_html", "rendered.html"), ("text", "text.txt"),
    ("content", "content.md"), ("content_json", "content.json"),
    ("screenshot", "page.png"), ("network", "network.json"),
    ("console", "console.json"), ("observation", "observation.json"),
    ("storage", "storage.json"),
]
DEFAULT_WANT = [a for a, _ in ARTIFACTS[:9]]

# Primary mime type -> body file extension.
MIME_EXTENSIONS = {
    "text/html": "html", "application/xhtml+xml": "html",
    "application/json": "json", "application/ld+json": "json",
    "application/javascript": "js", "text/javascript": "js",
    "text/css": "css", "text/plain": "txt", "image/png": "png",
    "image/jpeg": "jpg", "image/jpg": "jpg", "image/gif": "gif",
    "image/webp": "webp", "image/svg+xml": "svg", "application/xml": "xml",
    "text/xml": "xml", "application/pdf": "pdf",
    "application/octet-stream": "bin",
}
# A small public-suffix sample for tests; production passes the full list.
SAMPLE_PUBLIC_SUFFIXES = ["com", "net", "org", "io", "app", "cn", "uk", "gov.cn", "com.cn",
                          "co.uk", "org.uk", "github.io", "vercel.app"]
# --- end fixed values -------------------------------------------------------


def error_category(code: str) -> str:
    if code in TRANSPORT_CODES:
        return "transport"
    if code in WARNING_CODES:
        return "warning"
    if code in CONFIGURATION_CODES:
        return "configuration"
    return "internal"


def error_codes_df(spark: SparkSession) -> DataFrame:
    rows = [(c, c in RETRYABLE_CODES, error_category(c)) for c in ERROR_CODES]
    return spark.createDataFrame(rows, "error_code string, retryable boolean, category string")


def artifacts_df(spark: SparkSession) -> DataFrame:
    rows = [(a, f, a in DEFAULT_WANT) for a, f in ARTIFACTS]
    return spark.createDataFrame(rows, "artifact string, filename string, default_want boolean")


def mime_extension_expr(col):
    """Extension for a content type column: primary type, lower, literal map."""
    primary = F.lower(F.trim(F.split(col, ";").getItem(0)))
    m = F.create_map(*[F.lit(x) for kv in MIME_EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(m, primary), F.lit("bin"))


def public_suffixes_df(spark: SparkSession, suffixes: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([(x,) for x in (suffixes or SAMPLE_PUBLIC_SUFFIXES)], "suffix string")
