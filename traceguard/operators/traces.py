"""Joins of the trace tree: siblings, parents, ancestor chains, session history.

Traces: organization_id, root_trace_id, trace_id, type, parent_id, event (JSON). Scans: organization_id,
root_trace_id, trace_id, security_risk_score, ingested_at. All joins are equi-joins on organisation and root, so
tables bucketed or partitioned on those need no shuffle; every per-group limit is a ranked window, which Spark
applies before the shuffle as well, and what is left of a tree or session is gathered into one row before it is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceguard.functions import variants as V

from .events import output_text

# Siblings read of one tree, earlier turns of a session, ancestors.
MOST_SIBLINGS, MOST_TURNS, MOST_ANCESTORS = 50, 19, 12
SIBLING_TYPES = ("tool", "function", "vectorstore")
KEY = ["organization_id", "root_trace_id"]
TEXTS = ("tool_outputs", "context_docs", "tool_inputs", "tool_names")


def sibling_texts(traces: DataFrame, *more: str) -> DataFrame:
    """Traces of tools and stores with what a scan reads of them: tool_output, tool_input, tool_name, docs; ``more``: columns to keep."""
    rows = traces.where(F.col("type").isin(*SIBLING_TYPES)).withColumn("e", V.parse(F.col("event")))
    tool = F.col("type").isin("tool", "function")
    given = lambda text: F.when(tool & text.rlike("(?U)\\S"), text)
    items = V.items(V.at(F.col("e"), "result", "matches", "items"))
    texts = F.filter(F.transform(items, lambda m: V.string(V.at(m, "text"))), lambda t: t.rlike("(?U)\\S"))
    name = V.string(V.first_true(V.at(F.col("e"), "name"), V.at(F.col("e"), "function")))
    return rows.select(
        *KEY,
        "trace_id",
        given(output_text(V.at(F.col("e"), "output"))).alias("tool_output"),
        F.when(F.col("type") == "vectorstore", texts).alias("docs"),
        given(output_text(V.first_true(V.at(F.col("e"), "input"), V.at(F.col("e"), "arguments")))).alias("tool_input"),
        F.trim(given(name)).alias("tool_name"),
        *more,
    )


def gathered_siblings(traces: DataFrame, limit: int = MOST_SIBLINGS) -> DataFrame:
    """(KEY, siblings): the first limit + 1 traces of tools and stores of each tree.

    No more can be among the first ``limit`` siblings of any of its traces, so a tree costs each of its traces a
    bounded number of texts, and no other event is parsed.
    """
    first = Window.partitionBy(*KEY).orderBy("trace_id")
    few = traces.where(F.col("type").isin(*SIBLING_TYPES)).withColumn("n", F.row_number().over(first)).where(F.col("n") <= limit + 1)
    few = sibling_texts(few, "n")
    return few.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("n", "trace_id", "tool_output", "docs", "tool_input", "tool_name"))).alias("siblings"))


def sibling_columns(siblings: Column, trace_id: Column, limit: int = MOST_SIBLINGS) -> dict[str, Column]:
    """TEXTS: arrays from the first ``limit`` siblings by trace_id, the trace itself left out."""
    others = F.slice(F.filter(siblings, lambda s: s["trace_id"] != trace_id), 1, limit)
    none = F.expr("cast(array() as array<string>)")
    strings = lambda name: F.coalesce(F.filter(F.transform(others, lambda s: s[name]), lambda t: t.isNotNull()), none)
    docs = F.flatten(F.filter(F.transform(others, lambda s: s["docs"]), lambda d: d.isNotNull()))
    return {"tool_outputs": strings("tool_output"), "context_docs": F.coalesce(docs, none), "tool_inputs": strings("tool_input"), "tool_names": strings("tool_name")}


def sibling_sources(current: DataFrame, traces: DataFrame, limit: int = MOST_SIBLINGS) -> DataFrame:
    """(KEY, trace_id) of ``current`` with TEXTS."""
    joined = current.select(*KEY, "trace_id").join(gathered_siblings(traces, limit), KEY, "left")
    return joined.withColumns(sibling_columns(F.col("siblings"), F.col("trace_id"), limit)).drop("siblings")


def parent_kinds(current: DataFrame, traces: DataFrame) -> DataFrame:
    """``current`` (KEY, trace_id, parent_id, ...) with parent_kind ('' without a parent) and cross_agent."""
    parents = traces.select(*KEY, F.col("trace_id").alias("parent_id"), F.col("type").alias("parent_type")).groupBy(*KEY, "parent_id").agg(F.min("parent_type").alias("parent_type"))
    joined = current.join(parents, [*KEY, "parent_id"], "left")
    kind = F.coalesce("parent_type", F.lit(""))
    return joined.select(*current.columns, kind.alias("parent_kind"), (kind == "llm").alias("cross_agent"))


def chain_scores(current: DataFrame, traces: DataFrame, scans: DataFrame, depth: int = MOST_ANCESTORS) -> DataFrame:
    """(KEY, trace_id, chain): scores of the scanned ancestors of each row of ``current``, oldest first.

    The walk starts at parent_id and goes on through llm events only; it ends after ``depth`` nodes, or at one
    that it has seen. Each step is one equi-join; a walk that has ended has a null node, which matches nothing and is
    dealt out by its tree.
    """
    edges = traces.where(F.col("type") == "llm").groupBy(*KEY, F.col("trace_id").alias("node")).agg(F.min("parent_id").alias("next"))
    score = latest_scores(scans).select(*KEY, F.col("trace_id").alias("node"), F.col("security_risk_score").alias("score"))
    nodes = edges.join(score, [*KEY, "node"], "full").select(*KEY, "node", "next", "score")
    none = F.expr("cast(array() as array<double>)")
    walk = current.select(*KEY, "trace_id", F.col("parent_id").alias("node"), none.alias("chain"), F.array("parent_id").alias("seen"))
    for _ in range(depth):
        walk = walk.join(nodes, [*KEY, "node"], "left")
        onward = F.when(~F.array_contains("seen", F.col("next")), F.col("next"))
        walk = walk.select(*KEY, "trace_id", onward.alias("node"), F.when(F.col("score").isNull(), F.col("chain")).otherwise(F.concat(F.array("score"), "chain")).alias("chain"), F.when(onward.isNotNull(), F.concat("seen", F.array("next"))).otherwise(F.col("seen")).alias("seen"))
    return walk.select(*KEY, "trace_id", "chain")


def latest_scores(scans: DataFrame) -> DataFrame:
    """One row for each scanned trace: the one ingested last."""
    best = F.max_by(F.struct("security_risk_score", "ingested_at"), F.struct("ingested_at", "security_risk_score"))
    return scans.groupBy(*KEY, "trace_id").agg(best.alias("b")).select(*KEY, "trace_id", "b.security_risk_score", "b.ingested_at")


def gathered_history(scans: DataFrame, limit: int = MOST_TURNS) -> DataFrame:
    """(KEY, recent): the newest scans of each session, oldest first.

    Of a trace no more than its newest ``limit`` scans can be in a history, and leaving out one trace leaves out no
    more than that: the newest 2 * limit of what remains hold the history of every trace.
    """
    order = (F.desc("ingested_at"), F.desc("trace_id"), F.desc("security_risk_score"))
    rows = scans.select(*KEY, "trace_id", "ingested_at", "security_risk_score")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*KEY, "trace_id").orderBy(*order))).where(F.col("n") <= limit)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).where(F.col("n") <= 2 * limit)
    return rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("ingested_at", "trace_id", "security_risk_score"))).alias("recent"))


def history_column(recent: Column, trace_id: Column, limit: int = MOST_TURNS) -> Column:
    """Scores of the newest ``limit`` scans of other traces, oldest first."""
    scores = F.transform(F.filter(recent, lambda r: r["trace_id"] != trace_id), lambda r: r["security_risk_score"])
    newest = F.slice(scores, F.greatest(F.size(scores) - limit, F.lit(0)) + 1, limit)
    return F.coalesce(newest, F.expr("cast(array() as array<double>)"))


def session_history(current: DataFrame, scans: DataFrame, limit: int = MOST_TURNS) -> DataFrame:
    """(KEY, trace_id, history): scores of the newest ``limit`` scans of the session, oldest first.

    All scans of the current trace are left out. This is the online form: it reads what has been ingested. A session
    keeps its newest scans before the join, so a trace meets one row.
    """
    joined = current.select(*KEY, "trace_id").join(gathered_history(scans, limit), KEY, "left")
    return joined.withColumn("history", history_column(F.col("recent"), F.col("trace_id"), limit)).drop("recent")


def backfilled_history(limit: int = MOST_TURNS) -> Column:
    """Scores of the preceding ``limit`` turns and the current one, in the order of ingestion: one window, no join."""
    order = Window.partitionBy(*KEY).orderBy("ingested_at", "trace_id").rowsBetween(-limit, 0)
    return F.collect_list("security_risk_score").over(order)
