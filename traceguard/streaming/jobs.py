"""Streams: post-call scans, the two gates, and messages that nothing can be done with.

Each stream is a stateless projection up to ``foreachBatch``; what a scan needs of other traces is joined from the
stored tables, as of the batch. Delivery is at least once: offsets are in the checkpoint, stored rows are written
to one folder for each batch, and notifications are told apart by trace_id.

A message that cannot be worked on does not hold up its batch. Where a job over a batch fails on a value, the batch
is halved by a hash until what fails is one message or cannot be told apart: a failed scan leaves a marker row, a
failed request is let through. Faults of stores and of the cluster are no such failures; they end the batch, which the
stream repeats from its checkpoint.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.errors import ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, NumberFormatException, PythonException, SparkRuntimeException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from traceguard.operators.decisions import response_gate, sync_check
from traceguard.operators.scan import DEFAULT, ScanConfig
from traceguard.plans.post_call import EXTRA, NO_MODELS, Models, scan_texts, texts
from traceguard.sources import kafka, tables

log = logging.getLogger(__name__)
Sink = Callable[[DataFrame, str, int], None]
#: Failures that a value causes; a batch with fewer different messages than FEW is halved at their middle, a larger one by a bit of their hash.
VALUE_FAILURES = (ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, NumberFormatException, PythonException, SparkRuntimeException)
FEW = 1024
CHECK_RESULT = ["allow", "block_reason", "risk_level", "attack_types"]
GATE_RESULT = ["response_blocked", "risk_level", "attack_types", "block_reason"]
STORED = {name for name, _, _ in tables.SCAN_COLUMNS}
DETAILS = [n for n, _, _ in tables.SCAN_COLUMNS[5:35]] + ["trust_boundary_escalation", "escalation_score", "agent_chain_depth", "crescendo_detected", "crescendo_score", "session_turns", "risk_trajectory"]


def parquet_sink(folder: str) -> Sink:
    """Rows of each kind and batch in a folder of their own; a repeated batch replaces its rows."""

    def write(df: DataFrame, kind: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{kind}/batch={batch}")

    return write


def check_replies(routed: DataFrame, config: ScanConfig = DEFAULT) -> DataFrame:
    """Answers of the pre-call gate."""
    asked = routed.where("route = 'security_check_sync'").select("message.correlation_id", "message.org_id", F.coalesce("message.prompt", F.lit("")).alias("prompt"), "message.policy.block_threshold", "message.policy.block_categories", "message.policy.pii_ignore")
    return kafka.replies(sync_check(asked, config), CHECK_RESULT, True)


def gate_replies(routed: DataFrame, config: ScanConfig = DEFAULT) -> DataFrame:
    """Answers of the response gate."""
    asked = routed.where("route = 'response_gate_check'").select("message.correlation_id", F.coalesce("message.response", F.lit("")).alias("response"), "message.pii_ignore")
    return kafka.replies(response_gate(asked, config), GATE_RESULT, False)


def scan_jobs(routed: DataFrame) -> DataFrame:
    """Jobs of the post-call scan."""
    m = "message"
    fields = [f"{m}.{c}" for c in ("organization_id", "api_key_prefix", "trace_id", "response_gated", "pii_ignore", "allowed_tools", "retention_days")]
    return routed.where("route = 'sdk_security'").select(*fields, F.coalesce(f"{m}.security_config.mode", F.lit("warn")).alias("mode"), "event")


def caused_by_value(error: Exception) -> bool:
    """Whether a job failed on what it read. Several failed stages come as one error that names their failures."""
    several = "STAGE_MATERIALIZATION_MULTIPLE_FAILURES" in str(error)
    return isinstance(error, VALUE_FAILURES) or several and any(kind.__name__ in str(error) for kind in VALUE_FAILURES)


def isolated(rows: DataFrame, work: Callable[[DataFrame], DataFrame]) -> tuple[list[DataFrame], list[DataFrame]]:
    """(results, failed): ``work`` over ``rows`` (value), in parts that could be worked on, persisted, and the rows that could not."""
    results, failed = [], []

    def take(part: DataFrame, depth: int) -> None:
        done = work(part).persist()
        try:
            done.write.format("noop").mode("overwrite").save()
        except Exception as error:
            done.unpersist()
            if not caused_by_value(error):
                raise
            name = F.xxhash64("value")
            names = sorted(r.name for r in part.select(name.alias("name")).distinct().limit(FEW).collect())
            if len(names) < 2:
                log.warning("a message could not be worked on", exc_info=error)
                failed.append(part)
                return
            upper = name >= names[len(names) // 2] if len(names) < FEW else F.pmod(F.shiftright(name, depth % 64), F.lit(2)) == 1
            for half in (~upper, upper):
                take(part.where(half), depth + 1)
        else:
            results.append(done)

    take(rows, 0)
    return results, failed


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def failed_checks(routed: DataFrame) -> DataFrame:
    """Answers to pre-call requests that could not be checked: they are let through."""
    asked = routed.where("route = 'security_check_sync'").select("message.correlation_id", "message.org_id")
    none = F.expr("cast(array() as array<string>)")
    open_ = asked.select("*", F.lit(True).alias("allow"), F.lit(None).cast("string").alias("block_reason"), F.lit("clean").alias("risk_level"), none.alias("attack_types"))
    return kafka.replies(open_, CHECK_RESULT, True)


def failed_gates(routed: DataFrame) -> DataFrame:
    """Answers to response gates that could not be checked: they are let through."""
    asked = routed.where("route = 'response_gate_check'").select("message.correlation_id")
    none = F.expr("cast(array() as array<string>)")
    open_ = asked.select("*", F.lit(False).alias("response_blocked"), F.lit("clean").alias("risk_level"), none.alias("attack_types"), F.lit(None).cast("string").alias("block_reason"))
    return kafka.replies(open_, GATE_RESULT, False)


def failed_scans(routed: DataFrame) -> DataFrame:
    """Marker rows of jobs that could not be scanned. Their events are read for the root alone."""
    jobs = scan_jobs(routed)
    root = F.coalesce(F.try_variant_get("event", "$.root_trace_id", "string"), F.col("trace_id"))
    return tables.failure_rows(jobs.select(*(c for c in jobs.columns if c != "event"), root.alias("root_trace_id")))


def process_batch(batch: DataFrame, batch_id: int, traces: Callable[[], DataFrame], scans: Callable[[], DataFrame], sink: Sink, models: Models = NO_MODELS, config: ScanConfig = DEFAULT) -> None:
    """One micro-batch (value): stored rows, notifications, replies, and dead letters."""
    routed = kafka.route(kafka.decode(batch)).persist()
    held = [routed]
    try:

        def scanned(part: DataFrame) -> DataFrame:
            found = texts(scan_jobs(part)).persist()  # read by the scan and by the walk along the ancestors
            held.append(found)
            return scan_texts(found, traces(), scans(), models, config)

        began = time.monotonic()
        results, failed = isolated(routed.where("route = 'sdk_security'"), scanned)
        latency = F.lit(time.monotonic() - began)  # of the batch, as its rows are scanned together
        held += results
        rows = [tables.scan_rows(x.withColumn("scan_latency", latency)) for x in results] + [failed_scans(x) for x in failed]
        sink(_union(rows).withColumn("ingested_at", F.current_timestamp()), "scans", batch_id)
        if results:
            sink(_union([kafka.notifications(x.withColumn("scan_latency", latency), DETAILS) for x in results]), "notifications", batch_id)
        for kind, route, answer, let_through in (("check_replies", "security_check_sync", check_replies, failed_checks), ("gate_replies", "response_gate_check", gate_replies, failed_gates)):
            answers, failed = isolated(routed.where(F.col("route") == route), lambda part, answer=answer: answer(part, config))
            held += answers
            sink(_union(answers + [let_through(x) for x in failed]), kind, batch_id)
        sink(routed.where("route in ('malformed', 'unknown')").select(F.col("value").cast("string").alias("value"), "route"), "dead_letters", batch_id)
    finally:
        for x in held:
            x.unpersist()


def start(messages: DataFrame, traces: Callable[[], DataFrame], scans: Callable[[], DataFrame], sink: Sink, checkpoint: str, models: Models = NO_MODELS, config: ScanConfig = DEFAULT, available_now: bool = False, every: str = "1 second") -> StreamingQuery:
    """Run the jobs of a stream (value). ``traces`` and ``scans`` give the stored tables as they are at each batch."""
    writer = messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: process_batch(df, n, traces, scans, sink, models, config))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def rolling_scores(scored: DataFrame, keep: int = 20) -> DataFrame:
    """(organization_id, root_trace_id, turns): a stream of scores (ingested_at too) with the last ``keep`` of each session, held as state."""
    import pandas as pd

    def update(key, frames, state):
        past = list(state.get[0]) if state.exists else []
        new = pd.concat(list(frames))
        past += new.sort_values(["ingested_at", "trace_id"])["security_risk_score"].tolist()
        state.update((past[-keep:],))
        yield pd.DataFrame({"organization_id": [key[0]], "root_trace_id": [key[1]], "turns": [past[-keep:]]})

    return scored.groupBy("organization_id", "root_trace_id").applyInPandasWithState(update, "organization_id string, root_trace_id string, turns array<double>", "turns array<double>", "update", "NoTimeout")


__all__ = ["DETAILS", "EXTRA", "STORED", "check_replies", "gate_replies", "isolated", "parquet_sink", "process_batch", "rolling_scores", "scan_jobs", "start"]
