"""Choice of provider and model per request, and the outcome when the first choice fails."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields of a routing rule, default provider and default model of each provider.
RULE_FIELDS = ("provider", "model", "fallback_provider", "fallback_model")
DEFAULT_PROVIDER = "openai"
DEFAULT_MODELS = {"openai": "gpt-4.1-mini", "openrouter": "openai/gpt-4.1-mini"}

RULE_TYPE = "map<string,string>"


def parse_rules(text: str) -> dict[str, dict[str, str]]:
    """Routing rules from a JSON object of objects; fields other than the known four are dropped."""
    if not text.strip():
        return {}
    try:
        loaded = json.loads(text)
    except json.JSONDecodeError as problem:
        raise ValueError("routing rules must be valid JSON") from problem
    if not isinstance(loaded, dict) or not all(isinstance(rule, dict) for rule in loaded.values()):
        raise ValueError("routing rules must be an object of objects")
    return {
        name: {field: str(rule[field]) for field in RULE_FIELDS if field in rule}
        for name, rule in loaded.items()
    }


def rule_table(rules: Mapping[str, Mapping[str, str]]) -> Column:
    """The rules as one constant map column; a rule set is configuration and small."""
    entries: list[Column] = []
    for name, rule in rules.items():
        fields = [F.lit(part) for pair in rule.items() for part in pair]
        entries += [F.lit(name), F.create_map(*fields).cast(RULE_TYPE)]
    return F.create_map(*entries).cast(f"map<string,{RULE_TYPE}>")


def applicable_rule(rules: Column, task: Column, quality_mode: Column) -> Column:
    """Rule of "task.quality_mode", else of the task, else null."""
    exact = F.try_element_at(rules, F.concat(task, F.lit("."), quality_mode))
    return F.coalesce(exact, F.try_element_at(rules, task))


def _default_model(provider: Column) -> Column:
    chosen = F.raise_error(
        F.concat(F.lit("unsupported routed provider: "), provider)
    ).cast("string")
    for name, model in DEFAULT_MODELS.items():
        chosen = F.when(provider == name, model).otherwise(chosen)
    return chosen


def routing_decision(
    rules: Column, task: Column, quality_mode: Column, prompt_version: Column,
    default_provider: str = DEFAULT_PROVIDER,
) -> Column:
    """struct<provider, model, fallback_provider, fallback_model, reason>.

    A provider without a default model is an error even where the rule names a model.
    """
    rule = applicable_rule(rules, task, quality_mode)

    def field(name: str) -> Column:
        return F.try_element_at(rule, F.lit(name))

    provider = F.lower(F.btrim(F.coalesce(field("provider"), F.lit(default_provider))))
    default_model = _default_model(provider)
    model = F.when(default_model.isNotNull(), F.btrim(F.coalesce(field("model"), default_model)))
    fallback_provider = F.lower(F.btrim(field("fallback_provider")))
    named_fallback = F.btrim(field("fallback_model"))
    fallback_model = F.when(
        (fallback_provider != "") & (F.coalesce(named_fallback, F.lit("")) == ""),
        _default_model(fallback_provider),
    ).otherwise(named_fallback)
    in_mode = F.concat(F.lit("' in quality mode '"), quality_mode, F.lit("'"))
    reason = F.when(
        F.coalesce(F.size(rule), F.lit(0)) > 0, F.concat(F.lit("task override for '"), task, in_mode)
    ).otherwise(F.concat(F.lit("default provider for prompt version '"), prompt_version, in_mode))
    return F.struct(
        provider.alias("provider"),
        model.alias("model"),
        fallback_provider.alias("fallback_provider"),
        fallback_model.alias("fallback_model"),
        reason.alias("reason"),
    )


def fallback_outcome(decision: Column, primary_ok: Column) -> Column:
    """struct<provider, model, fallback_used, failed, note> once it is known whether the first call worked."""
    has_fallback = F.coalesce(decision["fallback_provider"], F.lit("")) != ""
    used = ~primary_ok & has_fallback
    provider = F.when(used, decision["fallback_provider"]).otherwise(decision["provider"])
    backup = F.coalesce(F.nullif(decision["fallback_model"], F.lit("")), decision["model"])
    model = F.when(used, backup).otherwise(decision["model"])
    note = F.when(
        used,
        F.concat(
            F.lit("Fallback used: "), decision["provider"], F.lit("/"), decision["model"],
            F.lit(" -> "), provider, F.lit("/"), model,
        ),
    )
    return F.struct(
        provider.alias("provider"),
        model.alias("model"),
        used.alias("fallback_used"),
        (~primary_ok & ~has_fallback).alias("failed"),
        note.alias("note"),
    )
