"""Job messages from and results to Kafka, and the shape of the messages.

The connector is a package of its own (org.apache.spark:spark-sql-kafka-0-10), which a deployment adds. Every
transform here works on any DataFrame with a ``value`` column, so files can stand in for a topic.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fetch ceiling, operations, and the one that messages without any mean.
MOST_FETCH_BYTES = 10 * 1024 * 1024
OPERATIONS = ("sdk_security", "security_check_sync", "response_gate_check")
DEFAULT_OPERATION = "sdk_security"
MESSAGE = """operation string, organization_id string, api_key_prefix string, trace_id string, response_gated boolean,
 pii_ignore array<string>, allowed_tools array<string>, security_config struct<mode:string>, retention_days int,
 correlation_id string, org_id string, prompt string, response string,
 policy struct<block_threshold:string,block_categories:array<string>,pii_ignore:array<string>>"""


def security_options(protocol: str | None = None, mechanism: str = "SCRAM-SHA-512", username: str | None = None, password: str | None = None) -> dict[str, str]:
    """Connection options: PLAINTEXT, or SASL_SSL with a user and password."""
    if (protocol or "PLAINTEXT").upper() != "SASL_SSL":
        return {"kafka.security.protocol": "PLAINTEXT"}
    quote = lambda x: (x or "").replace("\\", "\\\\").replace('"', '\\"')
    login = f'org.apache.kafka.common.security.scram.ScramLoginModule required username="{quote(username)}" password="{quote(password)}";'
    return {"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": mechanism, "kafka.sasl.jaas.config": login}


def read_jobs(spark: SparkSession, servers: str, topic: str, security: Mapping[str, str] | None = None) -> DataFrame:
    """The stream of a topic from its earliest offset; offsets are kept in the query's checkpoint."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    reader = reader.option("startingOffsets", "earliest").option("kafka.max.partition.fetch.bytes", str(MOST_FETCH_BYTES))
    return reader.options(**(security or security_options())).load()


def write_topic(df: DataFrame, servers: str, topic: str, security: Mapping[str, str] | None = None) -> None:
    """Send (key, value) rows with all acknowledgements; delivery is at least once, so consumers go by trace_id."""
    writer = df.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    writer.option("kafka.acks", "all").option("kafka.enable.idempotence", "true").options(**(security or security_options())).save()


def decode(df: DataFrame) -> DataFrame:
    """``df`` (value) with message, event (VARIANT) and valid: whether the value is a JSON object."""
    value = F.col("value").cast("string")
    parsed = df.select(*df.columns, F.from_json(value, MESSAGE).alias("message"), F.try_parse_json(value).alias("raw"))
    valid = F.coalesce(F.substring(F.to_json("raw"), 1, 1) == "{", F.lit(False))
    return parsed.select(*df.columns, "message", F.try_variant_get("raw", "$.event", "variant").alias("event"), valid.alias("valid"))


def route(decoded: DataFrame) -> DataFrame:
    """``decoded`` with route: the operation, ``unknown``, or ``malformed``."""
    operation = F.coalesce("message.operation", F.lit(DEFAULT_OPERATION))
    return decoded.withColumn("route", F.when(~F.col("valid"), "malformed").when(operation.isin(*OPERATIONS), operation).otherwise("unknown"))


def notifications(results: DataFrame, details: list[str]) -> DataFrame:
    """(key, value): the message that a scan has enriched a trace; keyed by organisation."""
    body = F.struct(
        F.lit("enriched").alias("kind"),
        F.lit("security").alias("enrichment"),
        F.col("organization_id").cast("string").alias("organization_id"),
        "api_key_prefix",
        "trace_id",
        F.coalesce("root_trace_id", "trace_id").alias("root_trace_id"),
        F.struct(*details).alias("security"),
    )
    return results.select(F.col("organization_id").cast("string").alias("key"), F.to_json(body).alias("value"))


def replies(results: DataFrame, columns: list[str], with_org: bool) -> DataFrame:
    """(key, value) of the answers to requests that can be told apart: those with a correlation id."""
    named = results.where(F.coalesce(F.col("correlation_id") != "", F.lit(False)))
    body = F.struct("correlation_id", *(["org_id"] if with_org else []), F.struct(*columns).alias("result"))
    return named.select(F.col("correlation_id").alias("key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))
