"""The scans: one select over prompt, response and what the trace tree adds.

Input columns (``SCAN_INPUT``) missing from a DataFrame count as null. All result columns are expressions of
built-in functions, apart from NFKC on texts that need it and from the models of providers.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceguard.functions import patterns, pii, risk, secrets, vectors
from traceguard.functions import variants as V
from traceguard.functions.text import NOT_PLAIN, fold, normalize_text

NONE = "cast(array() as array<string>)"
HITS = "array<struct<found:boolean,types:array<string>,label:string>>"
SCAN_INPUT = {
    "prompt": "string",
    "response": "string",
    "tool_outputs": "array<string>",
    "context_docs": "array<string>",
    "tool_inputs": "array<string>",
    "tool_names": "array<string>",
    "allowed_tools": "array<string>",
    "cross_agent": "boolean",
    "pii_ignore": "array<string>",
    "image_texts": "array<struct<label:string,text:string>>",
    "injection_score": "double",
    "jailbreak_score": "double",
    "classifier_score": "double",
    "tool_scores": "array<double>",
    "doc_scores": "array<double>",
    "prompt_entities": pii.SPAN,
    "response_entities": pii.SPAN,
    "tool_entities": f"array<{pii.SPAN}>",
}


@dataclass(frozen=True)
class ScanConfig:
    semantic_blocks: bool = True  # semantic hits are HIGH, else MEDIUM
    classifier_blocks: bool = False
    block_prefix: str = "Blocked by traceguard"
    response_prefix: str = "Response blocked by traceguard"
    report_threshold: float = vectors.REPORT_THRESHOLD


DEFAULT = ScanConfig()


def with_inputs(df: DataFrame) -> DataFrame:
    return df.withColumns({c: (F.col(c) if c in df.columns else F.lit(None)).cast(t) for c, t in SCAN_INPUT.items()})


def indirect_sources(texts: Column, label: str, scores: Column | None = None) -> Column:
    """``label[i]`` of each text with a strong injection or jailbreak phrase, or with a score at the threshold."""
    def hit(t, i):
        plain = fold(t)
        found = patterns.strong_hit(plain, patterns.INJECTION) | patterns.strong_hit(plain, patterns.JAILBREAK)
        if scores is not None:
            found = found | (F.coalesce(F.get(scores, i), F.lit(0.0)) >= vectors.POISON_THRESHOLD)
        return F.when(found, F.concat(F.lit(f"{label}["), i.cast("string"), F.lit("]")))

    return F.coalesce(F.array_compact(F.transform(texts, hit)), F.expr(NONE))


def normalized_arrays(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``df`` with ``<name>_plain`` for arrays of texts: their NFKC forms, where Python is called only if needed.

    Python functions cannot run inside lambdas, so this comes before ``fold`` is applied to each text.
    """

    @F.arrow_udf("array<string>")
    def nfkc(x: pa.Array) -> pa.Array:
        return pa.array([None if r is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in r] for r in x.to_pylist()], pa.list_(pa.string()))

    new = {}
    for c in columns:
        needs = F.exists(c, lambda t: F.coalesce(t.rlike(NOT_PLAIN), F.lit(False)))
        new[f"{c}_plain"] = F.coalesce(nfkc(F.when(needs, F.col(c))), F.col(c))
    return df.withColumns(new)


def poisoned_docs(scores: Column) -> tuple[Column, Column]:
    """(sources, largest score) of documents whose meaning is close to attacks."""
    labels = F.transform(scores, lambda s, i: F.when(s >= vectors.POISON_THRESHOLD, F.concat(F.lit("context_doc["), i.cast("string"), F.lit("]"))))
    return F.coalesce(F.array_compact(labels), F.expr(NONE)), F.coalesce(F.greatest(F.array_max(scores), F.lit(0.0)), F.lit(0.0))


def exfiltration(inputs: Column, plain: Column, ignore: Column, more: Column | None = None) -> Column:
    """array<struct<found, types, label>>: personal data and secrets in what the agent sends to tools, where there are any.

    ``more``: spans of names and places of each input.
    """
    # Lambdas are interpreted, without common subexpressions: what is used twice is put into a struct first.
    nothing = F.struct(F.expr(NONE).alias("types"), F.lit(False).alias("random"))  # a text that is its own normal form hides nothing

    def read(t, i):
        named = None if more is None else F.coalesce(F.get(more, i), F.expr(f"cast(array() as {pii.SPAN})"))
        return F.struct(pii.entities(pii.pii_spans(t, ignore, more=named)).alias("types"), secrets.parts(t).alias("raw"), V.let(fold(F.get(plain, i)), lambda p: F.when(p == t, nothing).otherwise(secrets.parts(p))).alias("hidden"))

    def one(x, i):
        types = F.array_union(F.array_union(x["types"], x["raw"]["types"]), x["hidden"]["types"])
        found = (F.size(types) > 0) | x["raw"]["random"] | x["hidden"]["random"]
        return F.struct(found.alias("found"), types.alias("types"), F.concat(F.lit("tool_input["), i.cast("string"), F.lit("]")).alias("label"))

    return F.coalesce(F.filter(F.transform(F.transform(inputs, read), one), lambda h: h["found"]), F.expr(f"cast(array() as {HITS})"))


def exfiltrated_types(hits: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["types"]))))


def labels(hits: Column) -> Column:
    return F.transform(hits, lambda h: h["label"])


def policy_violations(names: Column, allowed: Column) -> Column:
    """Names outside the list, compared without case and outer space, each once as first written; off if the list is empty."""
    key = lambda n: F.lower(F.trim(n))
    allow = F.filter(F.transform(allowed, key), lambda k: k != "")
    keys = F.transform(names, key)
    bad = F.filter(F.transform(names, lambda n, i: F.struct(n.alias("name"), F.get(keys, i).alias("key"), i.alias("at"))), lambda x: (x["key"] != "") & ~F.array_contains(allow, x["key"]) & (F.array_position(keys, x["key"]) == x["at"] + 1))
    return F.coalesce(F.when(F.size(allow) > 0, F.transform(bad, lambda x: x["name"])), F.expr(NONE))


def image_sources(texts: Column) -> Column:
    """Labels of image texts with strong injection, any jailbreak, or strong skeleton-key phrases."""
    def hit(p):
        plain = fold(p["text"])
        return patterns.strong_hit(plain, patterns.INJECTION) | patterns.any_hit(plain, patterns.JAILBREAK) | patterns.strong_hit(plain, patterns.SKELETON)

    return F.coalesce(F.transform(F.filter(texts, hit), lambda p: p["label"]), F.expr(NONE))


def attack_tiers(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with injection, jailbreak and skeleton_key structs of a text."""
    df = df.withColumn("plain_prompt", normalize_text(text))
    return df.withColumns({f.name: patterns.tiered(F.col("plain_prompt"), f) for f in patterns.FAMILIES}).drop("plain_prompt")


def semantic(df: DataFrame, config: ScanConfig) -> DataFrame:
    """``df`` with sem (detected, scope, score) from the scores of the two scopes and of the classifier."""
    v = vectors.verdict(F.coalesce("injection_score", F.lit(0.0)), F.coalesce("jailbreak_score", F.lit(0.0)))
    c = vectors.classifier_verdict(F.coalesce("classifier_score", F.lit(0.0)), config.classifier_blocks)
    df = df.withColumns({"v": v, "c": c})
    scope = F.when((F.col("v.scope") == "") & F.col("c.detected"), "classifier").otherwise(F.col("v.scope"))
    return df.withColumn("sem", F.struct((F.col("v.detected") | F.col("c.detected")).alias("detected"), scope.alias("scope"), F.col("v.score").alias("score"))).drop("v", "c")


def check(df: DataFrame, config: ScanConfig = DEFAULT) -> DataFrame:
    """``df`` (prompt, ...) with allow, block_reason, risk_level, attack_types: patterns and meaning only."""
    own = df.columns
    x = semantic(attack_tiers(with_inputs(df), F.col("prompt")), ScanConfig(config.semantic_blocks, False))
    types = F.array_compact(F.array(F.when(F.col("injection.detected"), F.lit("prompt_injection")), F.when(F.col("jailbreak.detected"), F.lit("jailbreak")), F.when(F.col("skeleton_key.detected"), F.lit("skeleton_key")), F.when(F.col("sem.detected"), F.concat(F.lit("semantic_"), F.col("sem.scope")))))
    level = risk.highest(F.col("injection.level"), F.col("jailbreak.level"), F.col("skeleton_key.level"), risk.when_any(F.col("sem.detected"), risk.HIGH if config.semantic_blocks else risk.MEDIUM))
    x = x.withColumns({"attack_types": types, "rank": level})
    return x.select(*own, (F.col("rank") != risk.HIGH).alias("allow"), F.when(F.col("rank") == risk.HIGH, reason(config.block_prefix, F.col("attack_types"))).alias("block_reason"), risk.level_name(F.col("rank")).alias("risk_level"), "attack_types")


def reason(prefix: str, types: Column) -> Column:
    return F.concat(F.lit(f"{prefix}: "), F.array_join(types, ", "))


def scan(df: DataFrame, config: ScanConfig = DEFAULT) -> DataFrame:
    """``df`` with the 30 result columns of a full scan, which reads texts to their end.

    Inputs that ``df`` lacks cost nothing: their results are constants in the plan.
    """
    own, given = [c for c in df.columns if c not in SCAN_INPUT], set(df.columns)
    none = F.expr(NONE)
    lists = [c for c in ("tool_outputs", "context_docs", "tool_inputs") if c in given]
    x = with_inputs(df)
    x = x.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("prompt", "response")})
    x = normalized_arrays(x, tuple(lists)) if lists else x
    texts = (("prompt", "p"), ("response", "r"))
    named = lambda c: F.coalesce(f"{c}_entities", F.expr(f"cast(array() as {pii.SPAN})")) if f"{c}_entities" in given else None
    x = x.withColumns({f"spans_{k}": pii.pii_spans(F.col(c), F.col("pii_ignore"), more=named(c)) if c in given else F.expr(f"cast(array() as {pii.SPAN})") for c, k in texts})
    clean = F.struct(none.alias("entities"), F.lit(0.0).alias("score"), F.lit(0).alias("level"), F.lit("").alias("redacted"))
    safe = F.struct(F.lit(False).alias("detected"), none.alias("types"), F.lit(0).alias("level"))
    x = x.withColumns({f"pii_{k}": pii.pii_result(F.col(c), F.col(f"spans_{k}")) if c in given else clean for c, k in texts})
    x = semantic(attack_tiers(x, F.col("prompt")) if "prompt" in given else x.withColumns({f.name: patterns.grade(none, none) for f in patterns.FAMILIES}), config)
    rag, rag_max = poisoned_docs(F.col("doc_scores")) if "doc_scores" in given else (none, F.lit(0.0))
    x = x.withColumn("exfil_hits", exfiltration(F.col("tool_inputs"), F.col("tool_inputs_plain"), F.col("pii_ignore"), F.col("tool_entities") if "tool_entities" in given else None) if "tool_inputs" in given else F.expr(f"cast(array() as {HITS})"))
    indirect = [indirect_sources(F.col("tool_outputs_plain"), "tool_output", F.col("tool_scores"))] if "tool_outputs" in given else []
    indirect += [indirect_sources(F.col("context_docs_plain"), "context_doc")] if "context_docs" in given else []
    x = x.withColumns({
        "indirect": F.concat(*indirect) if indirect else none,
        "rag": rag,
        "rag_max": rag_max,
        "exfil_types": exfiltrated_types(F.col("exfil_hits")),
        "exfil": labels(F.col("exfil_hits")),
        "policy": policy_violations(F.col("tool_names"), F.col("allowed_tools")) if {"tool_names", "allowed_tools"} <= given else none,
        "image": image_sources(F.col("image_texts")) if "image_texts" in given else none,
        "sec_p": secrets.secrets(F.col("prompt")) if "prompt" in given else safe,
        "sec_r": secrets.secrets(F.col("response")) if "response" in given else safe,
    })
    x = x.withColumns({
        "cross": F.coalesce("cross_agent", F.lit(False)) & (F.col("injection.detected") | F.col("jailbreak.detected") | F.col("sem.detected")),
        "sec_types": F.array_sort(F.array_union("sec_p.types", "sec_r.types")),
        "sec_found": F.col("sec_p.detected") | F.col("sec_r.detected"),
    })
    rank, score = roll_up(config)
    x = x.withColumns({"rank": rank, "total": score})
    detected = lambda c: risk.filled(F.col(c))
    return x.select(
        *own,
        F.col("pii_p.redacted").alias("prompt_redacted"),
        F.col("pii_r.redacted").alias("response_redacted"),
        F.col("pii_p.entities").alias("pii_entities_prompt"),
        F.col("pii_r.entities").alias("pii_entities_response"),
        *(e for f in patterns.FAMILIES for e in (F.col(f"{f.name}.detected").alias(f"{f.name}_detected"), F.col(f"{f.name}.patterns").alias(f"{f.name}_patterns"))),
        F.col("sec_found").alias("secrets_detected"),
        F.col("sec_types").alias("secret_types"),
        detected("indirect").alias("indirect_injection_detected"),
        F.col("indirect").alias("indirect_injection_sources"),
        detected("rag").alias("rag_poisoning_detected"),
        F.col("rag").alias("rag_poisoning_sources"),
        F.round("rag_max", 4).alias("rag_poisoning_score"),
        detected("exfil").alias("tool_exfiltration_detected"),
        F.col("exfil_types").alias("tool_exfiltration_types"),
        F.col("exfil").alias("tool_exfiltration_sources"),
        detected("policy").alias("tool_policy_violation_detected"),
        F.col("policy").alias("tool_policy_violations"),
        F.col("cross").alias("cross_agent_injection_detected"),
        detected("image").alias("image_injection_detected"),
        F.col("image").alias("image_injection_sources"),
        F.round("sem.score", 4).alias("semantic_attack_score"),
        F.round(F.coalesce("classifier_score", F.lit(0.0)), 4).alias("classifier_score"),
        risk.level_name(F.col("rank")).alias("security_risk_level"),
        F.round("total", 4).alias("security_risk_score"),
        (F.col("rank") == risk.HIGH).alias("should_block"),
    )


def roll_up(config: ScanConfig) -> tuple[Column, Column]:
    """(rank, score) over the intermediate columns of ``scan``."""
    filled = lambda c: risk.filled(F.col(c))
    rank = risk.highest(
        F.col("injection.level"),
        F.col("jailbreak.level"),
        F.col("skeleton_key.level"),
        risk.when_any(filled("indirect"), risk.HIGH),
        risk.when_any(filled("rag"), risk.HIGH),
        risk.when_any(filled("exfil"), risk.MEDIUM),
        risk.when_any(filled("policy"), risk.HIGH),
        risk.when_any(F.col("cross"), risk.HIGH),
        risk.when_any(filled("image"), risk.HIGH),
        risk.when_any(F.col("sem.detected"), risk.HIGH if config.semantic_blocks else risk.MEDIUM),
        F.col("pii_p.level"),
        F.col("pii_r.level"),
        F.col("sec_p.level"),
        F.col("sec_r.level"),
    )
    worth = lambda found, score: F.when(found, score).otherwise(0.0)
    score = F.greatest(
        F.col("pii_p.score"),
        F.col("pii_r.score"),
        F.col("injection.score"),
        F.col("jailbreak.score"),
        F.col("skeleton_key.score"),
        worth(filled("indirect"), 1.0),
        worth(filled("rag"), F.col("rag_max")),
        worth(filled("exfil"), 0.5),
        worth(filled("policy"), 1.0),
        worth(F.col("cross"), 1.0),
        worth(filled("image"), 1.0),
        F.col("sem.score"),
        secrets.secret_score(F.col("sec_types"), F.col("sec_found")),
    )
    return rank, score
