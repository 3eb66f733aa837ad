"""The post-call scan of traces: texts, tree, models, scan, trajectories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceguard import providers
from traceguard.functions import phrases, trajectory, vectors
from traceguard.functions import variants as V
from traceguard.functions.text import fold, normalize_text
from traceguard.operators import events, traces
from traceguard.operators.scan import DEFAULT, ScanConfig, normalized_arrays, scan

from .derived import kept

KEY = traces.KEY


@dataclass(frozen=True)
class Models:
    """Factories of models; None means that there is none.

    ``injection``, ``jailbreak`` and ``blended`` score how close a text is to attacks of that kind, the last one for
    tool outputs and documents; ``classifier`` scores windows of the prompt; ``ocr`` reads images.
    """

    injection: providers.ScoreProvider | None = None
    jailbreak: providers.ScoreProvider | None = None
    blended: providers.ScoreProvider | None = None
    classifier: providers.ScoreProvider | None = None
    ocr: providers.OcrProvider | None = None
    fetcher: providers.Fetcher | None = None  # gets images that stand at public URLs; without it none are fetched
    entities: providers.EntityProvider | None = None  # names and places, for prompt, response and tool inputs


NO_MODELS = Models()


def encoder_models(encoder: providers.VectorProvider, scoped: providers.VectorProvider | None = None) -> Models:
    """Models of meaning from encoders: ``encoder`` for jailbreaks and tree texts, ``scoped`` (or the same) for injections."""
    return Models(
        injection=providers.similarity(scoped or encoder, phrases.INJECTION_SEEDS),
        jailbreak=providers.similarity(encoder, phrases.JAILBREAK_SEEDS),
        blended=providers.similarity(encoder, phrases.BLENDED_SEEDS),
    )


def texts(jobs: DataFrame) -> DataFrame:
    """``jobs`` (event, organization_id, trace_id, ...) with ids, prompt and response; jobs without either are dropped."""
    prompt, response = events.prompt_and_response(F.col("event"))
    trace = F.coalesce(F.col("trace_id"), V.text(V.at(F.col("event"), "trace_id")))
    root = V.text(V.first_true(V.at(F.col("event"), "root_trace_id")))
    gated = F.coalesce("response_gated", F.lit(False)) if "response_gated" in jobs.columns else F.lit(False)
    x = jobs.withColumns({"trace_id": trace, "root_trace_id": F.coalesce(root, trace), "parent_id": V.text(V.first_true(V.at(F.col("event"), "parent_id"))), "prompt": prompt, "response": response, "images": events.images(F.col("event"))})
    return kept(x, "(prompt <> '' OR response <> '')").withColumn("response", F.when(gated, F.lit("")).otherwise(F.col("response")))


def with_tree(x: DataFrame, trace_table: DataFrame, scans: DataFrame) -> DataFrame:
    """``x`` with sibling texts, cross_agent, chain and history.

    A tree's siblings and scans are one row, which its traces are joined with once; only the walk along the ancestors
    has joins of its own, of ids alone.
    """
    none = F.expr("cast(array() as array<double>)")
    tree = traces.gathered_siblings(trace_table).join(traces.gathered_history(scans), KEY, "full")
    chain = traces.chain_scores(x.select(*KEY, "trace_id", "parent_id").distinct(), trace_table, scans)
    chain = chain.groupBy(*KEY, "trace_id").agg(F.max("chain").alias("chain"))  # a repeated job may name another parent
    x = traces.parent_kinds(x, trace_table).drop("parent_kind").join(tree, KEY, "left")
    x = x.withColumns({**traces.sibling_columns(F.col("siblings"), F.col("trace_id")), "history": traces.history_column(F.col("recent"), F.col("trace_id"))}).drop("siblings", "recent")
    return x.join(chain, [*KEY, "trace_id"], "left").withColumn("chain", F.coalesce("chain", none))


def trajectories(x: DataFrame) -> DataFrame:
    """``x`` (history, chain, cross_agent, security_risk_score) with slopes and what they mean."""
    none = F.expr("cast(array() as array<double>)")
    turns = F.concat(F.coalesce("history", none), F.array("security_risk_score"))
    line = F.concat(F.coalesce("chain", none), F.array("security_risk_score"))
    x = x.withColumns({"turns": turns, "line": line})
    return x.withColumns({
        "crescendo_detected": trajectory.rising(F.col("turns")),
        "crescendo_score": F.round(trajectory.slope(F.col("turns")), 4),
        "session_turns": F.size("turns"),
        "trust_boundary_escalation": F.coalesce("cross_agent", F.lit(False)) & trajectory.rising(F.col("line")),
        "escalation_score": F.round(trajectory.slope(F.col("line")), 4),
        "agent_chain_depth": F.size("line"),
        "risk_trajectory": F.transform("turns", lambda s: F.round(s, 4)),
    }).drop("turns", "line")


EXTRA = ("crescendo_detected", "crescendo_score", "session_turns", "trust_boundary_escalation", "escalation_score", "agent_chain_depth")


def post_call(jobs: DataFrame, trace_table: DataFrame, scans: DataFrame, models: Models = NO_MODELS, config: ScanConfig = DEFAULT) -> DataFrame:
    """One row for each job with text: ids, all scan results, trajectories, and extra.

    ``jobs``: event (VARIANT), organization_id, trace_id and, where present, api_key_prefix, response_gated,
    pii_ignore, allowed_tools, mode, retention_days.
    """
    return scan_texts(texts(jobs), trace_table, scans, models, config)


def scan_texts(x: DataFrame, trace_table: DataFrame, scans: DataFrame, models: Models = NO_MODELS, config: ScanConfig = DEFAULT) -> DataFrame:
    """``post_call`` from what ``texts`` gives, for callers that hold on to that."""
    x = with_tree(x, trace_table, scans)
    if models.entities:
        x = x.withColumns({f"{c}_entities": providers.entity_spans(F.col(c), models.entities) for c in ("prompt", "response")})
        x = x.withColumn("tool_entities", providers.array_entity_spans(F.col("tool_inputs"), models.entities))
    if models.injection or models.jailbreak:
        x = x.withColumn("plain", normalize_text(F.col("prompt")))
        x = x.withColumns({"injection_score": providers.scores(F.col("plain"), models.injection), "jailbreak_score": providers.scores(F.col("plain"), models.jailbreak)}).drop("plain")
    if models.classifier:
        x = x.withColumn("windows", vectors.windows(F.col("prompt")))
        x = x.withColumn("classifier_score", F.coalesce(F.array_max(providers.array_scores(F.col("windows"), models.classifier)), F.lit(0.0))).drop("windows")
    if models.blended:
        x = normalized_arrays(x, ("tool_outputs", "context_docs"))
        folded = {c: F.transform(f"{c}_plain", lambda t: fold(t)) for c in ("tool_outputs", "context_docs")}
        x = x.withColumns({"tool_folded": folded["tool_outputs"], "doc_folded": folded["context_docs"]}).drop("tool_outputs_plain", "context_docs_plain")
        x = x.withColumns({"tool_scores": providers.array_scores(F.col("tool_folded"), models.blended), "doc_scores": providers.array_scores(F.col("doc_folded"), models.blended)}).drop("tool_folded", "doc_folded")
    x = x.withColumns({
        "image_texts": events.labelled_texts(providers.ocr_texts(events.inline_bytes(F.col("images")), models.ocr, events.public_urls(F.col("images")), models.fetcher)),
    })
    carried = x.withColumn("was_cross", F.col("cross_agent"))
    done = scan(carried.drop("event", "images"), config).withColumnRenamed("was_cross", "cross_agent")
    done = trajectories(done).drop("cross_agent", "history", "chain")
    return done.withColumn("extra", F.struct(*EXTRA, F.lit(None).cast("boolean").alias("scan_failed")))
