"""The two stored tables: traces (read) and security scans (appended)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of a scan row in their order, with types, and what stands for a missing value.
SCAN_COLUMNS = (
    ("organization_id", "string", None),
    ("api_key_prefix", "string", ""),
    ("trace_id", "string", None),
    ("root_trace_id", "string", None),
    ("mode", "string", "warn"),
    ("prompt_redacted", "string", ""),
    ("response_redacted", "string", ""),
    ("pii_entities_prompt", "array<string>", ()),
    ("pii_entities_response", "array<string>", ()),
    ("injection_detected", "tinyint", 0),
    ("injection_patterns", "array<string>", ()),
    ("jailbreak_detected", "tinyint", 0),
    ("jailbreak_patterns", "array<string>", ()),
    ("skeleton_key_detected", "tinyint", 0),
    ("skeleton_key_patterns", "array<string>", ()),
    ("secrets_detected", "tinyint", 0),
    ("secret_types", "array<string>", ()),
    ("indirect_injection_detected", "tinyint", 0),
    ("indirect_injection_sources", "array<string>", ()),
    ("rag_poisoning_detected", "tinyint", 0),
    ("rag_poisoning_sources", "array<string>", ()),
    ("rag_poisoning_score", "double", 0.0),
    ("tool_exfiltration_detected", "tinyint", 0),
    ("tool_exfiltration_types", "array<string>", ()),
    ("tool_exfiltration_sources", "array<string>", ()),
    ("tool_policy_violation_detected", "tinyint", 0),
    ("tool_policy_violations", "array<string>", ()),
    ("cross_agent_injection_detected", "tinyint", 0),
    ("image_injection_detected", "tinyint", 0),
    ("image_injection_sources", "array<string>", ()),
    ("semantic_attack_score", "double", 0.0),
    ("security_risk_level", "string", "clean"),
    ("security_risk_score", "double", 0.0),
    ("should_block", "tinyint", 0),
    ("scan_latency", "double", 0.0),
    ("extra", "struct<crescendo_detected:boolean,crescendo_score:double,session_turns:int,trust_boundary_escalation:boolean,escalation_score:double,agent_chain_depth:int,scan_failed:boolean>", None),
    ("retention_days", "int", 36500),
)
TRACE_SCHEMA = "organization_id string, root_trace_id string, trace_id string, type string, parent_id string, event string"


def read_traces(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Traces with type and parent_id; where the table has only the event, both come from its JSON ('' if missing)."""
    df = spark.read.format(file_format).load(path)
    for c in ("type", "parent_id"):
        if c not in df.columns:
            df = df.withColumn(c, F.coalesce(F.get_json_object("event", f"$.{c}"), F.lit("")))
    return df.withColumn("parent_id", F.when(F.col("parent_id") != "", F.col("parent_id")))


def read_scans(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    return spark.read.format(file_format).load(path)


def _filled(df: DataFrame, name: str, kind: str, default) -> Column:
    value = F.col(name) if name in df.columns else F.lit(None)
    if kind == "tinyint":
        return F.coalesce(value.cast("boolean"), F.lit(False)).cast("tinyint").alias(name)
    value = value.cast(kind)
    if name == "root_trace_id":
        value = F.coalesce(F.when(value != "", value), F.col("trace_id").cast("string"))
    elif kind == "string" and default:
        value = F.coalesce(F.when(value != "", value), F.lit(default))
    elif name == "retention_days":
        value = F.coalesce(F.when(value != 0, value), F.lit(default))
    elif isinstance(default, tuple):
        value = F.coalesce(value, F.expr(f"cast(array() as {kind})"))
    elif default is not None:
        value = F.coalesce(value, F.lit(default))
    return value.alias(name)


def scan_rows(df: DataFrame) -> DataFrame:
    """The 37 columns of a stored row; missing columns and values get their defaults, booleans become 0 or 1."""
    return df.select(*(_filled(df, *c) for c in SCAN_COLUMNS))


def failure_rows(df: DataFrame) -> DataFrame:
    """Marker rows of scans that failed: clean, score 0, extra.scan_failed."""
    extra = F.from_json(F.lit('{"scan_failed": true}'), dict((n, t) for n, t, _ in SCAN_COLUMNS)["extra"])
    keep = [c for c in ("organization_id", "api_key_prefix", "trace_id", "root_trace_id", "mode", "retention_days", "scan_latency") if c in df.columns]
    return scan_rows(df.select(*keep, extra.alias("extra")))


def append_scans(rows: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append stored rows with the time of ingestion.

    With ``batch_id`` the rows go to a folder of their own, which a repeated batch overwrites: the append of a
    micro-batch is idempotent.
    """
    rows = rows.withColumn("ingested_at", F.current_timestamp())
    if batch_id is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def expired(scans: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows whose retention has passed."""
    return scans.where(F.col("ingested_at") + F.make_dt_interval(F.col("retention_days")) < (F.current_timestamp() if now is None else now))


def retained(scans: DataFrame, now: Column | None = None) -> DataFrame:
    return scans.where(F.col("ingested_at") + F.make_dt_interval(F.col("retention_days")) >= (F.current_timestamp() if now is None else now))
