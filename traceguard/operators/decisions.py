"""Decisions of the two synchronous gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceguard.functions.text import blank

from .scan import DEFAULT, ScanConfig, reason, scan

NONE = "cast(array() as array<string>)"


def sync_check(df: DataFrame, config: ScanConfig = DEFAULT) -> DataFrame:
    """``df`` (prompt, block_threshold, block_categories, pii_ignore, ...) with allow, block_reason, risk_level, attack_types.

    A prompt is blocked if a type that counts was found and its risk is high, or medium where the threshold says so.
    """
    own = df.columns
    given = {c: (F.col(c) if c in own else F.lit(None)).cast(t) for c, t in (("block_threshold", "string"), ("block_categories", "array<string>"))}
    kept = F.struct(*own).alias("own")
    x = scan(df.withColumns(given).select(kept, "block_threshold", "block_categories", F.col("prompt").alias("asked"), "prompt", *(["pii_ignore"] if "pii_ignore" in own else [])), config)
    types = F.array_compact(F.array(
        F.when(F.col("injection_detected"), F.lit("prompt_injection")),
        F.when(F.col("jailbreak_detected"), F.lit("jailbreak")),
        F.when(F.col("skeleton_key_detected"), F.lit("skeleton_key")),
        F.when(F.col("semantic_attack_score") >= config.report_threshold, F.lit("semantic_attack")),
        F.when(F.size("pii_entities_prompt") > 0, F.lit("pii_detected")),
        F.when(F.col("secrets_detected"), F.lit("secrets_detected")),
    ))
    x = x.withColumn("types", types)
    counted = F.when(F.coalesce(F.size("block_categories") > 0, F.lit(False)), F.filter("types", lambda t: F.array_contains(F.col("block_categories"), t))).otherwise(F.col("types"))
    level = F.col("security_risk_level")
    x = x.withColumn("counted", counted)
    block = (F.size("counted") > 0) & ((level == "high") | ((level == "medium") & (F.coalesce("block_threshold", F.lit("high")) == "medium"))) & ~blank(F.col("asked"))
    x = x.withColumn("block", block)
    none = blank(F.col("asked"))
    return x.select("own.*", (~F.col("block")).alias("allow"), F.when(F.col("block"), reason(config.block_prefix, F.col("counted"))).alias("block_reason"), F.when(none, "clean").otherwise(level).alias("risk_level"), F.when(none, F.expr(NONE)).otherwise(F.col("types")).alias("attack_types"))


def response_gate(df: DataFrame, config: ScanConfig = DEFAULT) -> DataFrame:
    """``df`` (response, pii_ignore, ...) with response_blocked, block_reason, risk_level, attack_types.

    A response is blocked by personal data or a named secret at a score of at least 0.5; a random token alone is not enough.
    """
    own = df.columns
    x = scan(df.select(F.struct(*own).alias("own"), F.col("response").alias("asked"), "response", *(["pii_ignore"] if "pii_ignore" in own else [])), config)
    types = F.array_compact(F.array(F.when(F.size("pii_entities_response") > 0, F.lit("pii_in_response")), F.when(F.col("secrets_detected"), F.lit("secrets_in_response"))))
    none = blank(F.col("asked"))
    concrete = (F.size("pii_entities_response") > 0) | (F.size("secret_types") > 0)
    x = x.withColumn("types", types).withColumn("block", concrete & (F.col("security_risk_score") >= 0.5) & ~none)
    return x.select("own.*", F.col("block").alias("response_blocked"), F.when(F.col("block"), reason(config.response_prefix, F.col("types"))).alias("block_reason"), F.when(none, "clean").otherwise(F.col("security_risk_level")).alias("risk_level"), F.when(none, F.expr(NONE)).otherwise(F.col("types")).alias("attack_types"))
