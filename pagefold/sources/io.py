"""Readers and writers for pages, capture directories, event logs and
result envelopes (S1-S6). All are Spark data sources; nothing is read or
written through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagefold import dims
from pagefold.functions.core import lit
from pagefold.functions.redact import SECRET_MASK, masked_sql

# Typed view of the CDP ``params`` object the operators use.
PARAMS_SCHEMA = (
    "requestId string, frameId string, loaderId string, initiator string, type string, timestamp double, encodedDataLength bigint, errorText string, "
    "request struct<url:string, method:string, headers:string, postData:string>, "
    "redirectResponse struct<status:int, headers:string>, "
    "response struct<status:int, mimeType:string, headers:string, protocol:string, remoteIPAddress:string, url:string, "
    "opcode:int, mask:boolean, payloadData:string>, "
    "errorMessage string, eventName string, eventId string, data string, isDownload boolean"
)


def read_pages(spark: SparkSession, path: str, columns=("page_id", "url", "html")) -> DataFrame:
    """Page table (parquet); only the needed columns reach the scan."""
    return spark.read.parquet(path).select(*columns)


def read_capture_dirs(spark: SparkSession, root: str, artifact: str, schema: str | None = None) -> DataFrame:
    """``<root>/<request_id>/<fixed file name>`` JSON artifacts, one row
    per acquisition with its ``request_id`` taken from the file path. Without
    ``schema`` the files are read once more to infer it."""
    name = dict(dims.ARTIFACTS)[artifact]
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name)
    df = (reader.schema(schema) if schema else reader).json(root)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1).alias("request_id"))


def typed_events(raw: DataFrame) -> DataFrame:
    """Raw event envelope ``{session_id, method, params, seq, ts}`` (params
    as JSON text) -> typed event columns."""
    p = raw.selectExpr("*", f"from_json(params, '{PARAMS_SCHEMA}') AS _p")
    return p.selectExpr(
        "session_id", "_p.requestId AS request_id", "CAST(seq AS BIGINT) AS seq", "CAST(ts AS BIGINT) AS ts_ms", "method",
        "_p.type AS resource_type", "_p.request.url AS url", "_p.request.method AS http_method",
        "_p.request.headers AS request_headers", "_p.request.postData AS post_data",
        "_p.redirectResponse IS NOT NULL AS has_redirect", "_p.redirectResponse.status AS redirect_status",
        "_p.response.status AS status", "_p.response.mimeType AS mime_type", "_p.response.headers AS response_headers",
        "_p.response.protocol AS protocol", "_p.response.remoteIPAddress AS remote_address",
        "CAST(_p.timestamp * 1000 AS BIGINT) AS timestamp_ms", "_p.encodedDataLength AS encoded_data_length",
        "_p.errorText AS error_text", "_p.frameId AS frame_id", "_p.loaderId AS loader_id", "_p.initiator AS initiator",
        "_p.response.opcode AS opcode", "_p.response.mask AS mask", "_p.response.payloadData AS payload_data",
        "_p.errorMessage AS error_message", "_p.eventName AS event_name", "_p.data AS data", "_p.eventId AS event_id",
        "_p.isDownload AS is_download", "params")


RAW_EVENT_SCHEMA = "session_id string, method string, params string, seq bigint, ts bigint"


def read_capture_events(spark: SparkSession, path: str) -> DataFrame:
    """S3: JSON-lines event log (explicit schema, no inference)."""
    raw = spark.read.schema(RAW_EVENT_SCHEMA).json(path)
    return typed_events(raw)


def stream_capture_events(spark: SparkSession, path: str) -> DataFrame:
    """S3 (streaming): the same typed events from files arriving in ``path``."""
    raw = spark.readStream.schema(RAW_EVENT_SCHEMA).json(path)
    return typed_events(raw).withColumn("event_time", F.timestamp_millis("ts_ms"))


def sorted_sql(path: str, dtype) -> str:
    """``path`` with the fields of its structs in name order."""
    if isinstance(dtype, StructType):
        inner = ", ".join(f"{lit(f.name)}, {sorted_sql(f'{path}.`{f.name}`', f.dataType)}" for f in sorted(dtype.fields, key=lambda f: f.name))
        return f"CASE WHEN {path} IS NULL THEN NULL ELSE named_struct({inner}) END"
    return path


def envelope_json(df: DataFrame, code: str, redact: bool = True) -> DataFrame:
    """S4 core: one JSON text per row with keys in sorted order (nested too)
    and the envelope ``code``. If the payload already carries a *different*
    ``code`` it is nested under ``result``; NULL fields are omitted. Fields
    whose names end in ``_secret`` are masked unless ``redact`` is off."""
    mask = SECRET_MASK if redact else None

    def value(f):
        if mask is not None and f.name.endswith("_secret"):
            return f"CAST({lit(mask)} AS STRING)"
        return masked_sql(f"`{f.name}`", f.dataType, mask, sort=True) if mask is not None else sorted_sql(f"`{f.name}`", f.dataType)

    fields = sorted(df.schema.fields, key=lambda f: f.name)
    payload = "named_struct(" + ", ".join(f"{lit(f.name)}, {value(f)}" for f in fields) + ")"
    if "code" in df.columns:
        with_code = "named_struct(" + ", ".join(
            f"{lit(f.name)}, " + (f"coalesce(`code`, {lit(code)})" if f.name == "code" else value(f)) for f in fields) + ")"
        nested = f"named_struct('code', {lit(code)}, 'result', {payload})"
        expr = f"CASE WHEN code IS NULL OR code = {lit(code)} THEN to_json({with_code}) ELSE to_json({nested}) END"
    else:
        allf = sorted([(f.name, value(f)) for f in fields] + [("code", lit(code))])
        expr = "to_json(named_struct(" + ", ".join(f"{lit(n)}, {e}" for n, e in allf) + "))"
    return df.selectExpr(f"{expr} AS value")


def write_results_jsonl(df: DataFrame, path: str, code: str = "fetch", redact: bool = True) -> None:
    """Results as JSON lines (Spark's committer makes the write atomic)."""
    envelope_json(df, code, redact).write.mode("overwrite").text(path)


def write_frames_jsonl(frames: DataFrame, path: str, files: int = 64, order: str = "seq") -> None:
    """WebSocket / SSE frames as JSON lines, ordered by connection
    (session_id, request_id) and ``order`` over at most ``files`` files; connections
    without frames write nothing. Files take ranges of that order, so a connection
    lies in one file or in files that follow each other, and neither many
    connections nor a hot one make many files or one long task."""
    keys = ["session_id", "request_id", order]
    frames.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").json(path)


def write_capture_dirs(artifacts: DataFrame, root: str) -> None:
    """S2's layout: every row (request_id, artifact, content) of ``artifacts``
    becomes the file ``<root>/<request_id>/<the artifact's file name>``. Tasks write
    beside the final name and rename, so a task that is run again leaves the
    same files."""
    names = dict(dims.ARTIFACTS)

    def write(batches):
        import uuid

        from pyarrow import fs
        files, base = fs.FileSystem.from_uri(root.rstrip("/") if "://" in root else root.removeprefix("file:").rstrip("/"))
        for batch in batches:
            for request_id, artifact, content in zip(*(c.to_pylist() for c in batch.columns)):
                folder = f"{base}/{request_id}"
                files.create_dir(folder)
                draft = f"{folder}/.{uuid.uuid4().hex}"
                with files.open_output_stream(draft) as out:
                    out.write(content.encode())
                files.move(draft, f"{folder}/{names[artifact]}")
            yield batch.slice(0, 0)

    (artifacts.where("request_id IS NOT NULL AND content IS NOT NULL").select("request_id", "artifact", "content")
     .mapInArrow(write, "request_id string, artifact string, content string").write.format("noop").mode("overwrite").save())


def artifact_manifest(results: DataFrame, want: list[str] | None = None) -> DataFrame:
    """Per acquisition x wanted artifact: expected file name and whether
    the result names a file for it (``<artifact>_file`` columns unpivoted
    and joined to the 10-row artifact dimension)."""
    spark = results.sparkSession
    want = want or dims.DEFAULT_WANT
    file_cols = [f"{a}_file" for a, _ in dims.ARTIFACTS]
    have = set(results.columns)
    stack = ", ".join(f"{lit(c[:-5])}, " + (f"CAST(`{c}` AS STRING)" if c in have else "CAST(NULL AS STRING)")
                      for c in file_cols)
    long = results.selectExpr("request_id", f"stack({len(file_cols)}, {stack}) AS (artifact, file)")
    d = dims.artifacts_df(spark).where(F.col("artifact").isin(*want))
    # one row per (acquisition, wanted artifact): the long form (every
    # artifact column, NULL when absent) joined to the broadcast 10-row
    # artifact dimension on the artifact name.
    m = long.join(F.broadcast(d), "artifact")
    return m.selectExpr("request_id", "artifact", "filename AS expected_filename", "file", "file IS NOT NULL AS present")
