"""Agent runs: trace events, checkpoints and outcome from the steps of a report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.guardrails import evidence_label
from corpusmill.functions.text import round_exact, strip

RETRIEVE, ANSWER, DRAFT = "retrieve_context", "answer_question", "draft_email"

METADATA = "map<string,string>"


def first_step(steps: Column, step_type: str) -> Column:
    """The first step of a type, or null."""
    return F.get(F.filter(steps, lambda step: step["step_type"] == step_type), F.lit(0))


def run_latency_ms(created_at: Column, completed_at: Column) -> Column:
    """Time from creation to completion, two decimals; 0 while the run is open."""
    seconds = (F.unix_micros(completed_at) - F.unix_micros(created_at)) / F.lit(1e6)
    return F.coalesce(round_exact(seconds * 1000, 2), F.lit(0.0))


def _metadata(**entries: Column) -> Column:
    parts = [part for name, value in entries.items() for part in (F.lit(name), value.cast("string"))]
    return F.create_map(*parts).cast(METADATA)


def _step_event(step: Column, counted: bool) -> Column:
    output = step["output"]
    common = {"step_id": step["step_id"], "status": step["status"]}
    searched = {"retrieval_mode": output["retrieval_mode"]}
    if counted:
        searched |= {
            "retrieval_count": output["retrieval_count"],
            "reranker_type": output["reranker_type"],
        }
    kind = step["step_type"]
    stage = (
        F.when(kind == RETRIEVE, F.lit("retrieval.search"))
        .when(kind == ANSWER, F.lit("generation.answer"))
        .when(kind == DRAFT, F.lit("generation.draft_email"))
        .otherwise(F.concat(F.lit("agent."), kind))
    )
    metadata = (
        F.when(kind == RETRIEVE, _metadata(**common, **searched))
        .when(kind == ANSWER, _metadata(**common, provider=output["provider"], model=output["model"]))
        .otherwise(_metadata(**common))
    )
    return F.struct(
        stage.alias("stage"),
        F.coalesce(step["latency_ms"], F.lit(0.0)).alias("duration_ms"),
        metadata.alias("metadata"),
    )


def _checkpoint_event(step: Column) -> Column:
    checkpoint = step["checkpoint"]
    metrics = F.coalesce(F.to_json(checkpoint["metrics"]), F.lit("{}"))
    event = F.struct(
        F.concat(F.lit("checkpoint."), step["step_type"]).alias("stage"),
        F.lit(0.0).alias("duration_ms"),
        _metadata(decision=checkpoint["decision"], reason=checkpoint["reason"], metrics=metrics).alias("metadata"),
    )
    return F.when(checkpoint.isNotNull(), event)


def stored_trace(steps: Column) -> Column:
    """Trace as written with a run: an event per step, and one per checkpoint behind its step."""
    events = F.flatten(F.transform(steps, lambda s: F.array(_step_event(s, True), _checkpoint_event(s))))
    return F.array_compact(events)


def log_trace(steps: Column) -> Column:
    """Trace rebuilt from a log line: steps only."""
    return F.transform(steps, lambda s: _step_event(s, False))


def checkpoint_decision(
    step_type: Column, question: Column, n_chunks: Column, article_in_top: Column, answer: Column,
    groundedness: Column, subject: Column, body: Column,
) -> Column:
    """struct<decision, reason> of the check after a step."""
    evidence = evidence_label(question, n_chunks, article_in_top)

    def decide(ok: Column, good: Column | str, bad: Column | str) -> Column:
        def text(value: Column | str) -> Column:
            return F.lit(value) if isinstance(value, str) else value

        sure = F.coalesce(ok, F.lit(False))
        return F.struct(
            F.when(sure, "allow").otherwise("abort").alias("decision"),
            F.when(sure, text(good)).otherwise(text(bad)).alias("reason"),
        )

    no_chunks = F.coalesce(n_chunks, F.lit(0)) == 0
    retrieved = decide(
        ~no_chunks & (evidence["status"] == "sufficient"),
        evidence["reason"],
        F.when(no_chunks, F.lit("No supporting context was retrieved.")).otherwise(evidence["reason"]),
    )
    answered = decide(
        (strip(answer) != "") & (groundedness >= 1.0),
        "Answer step produced grounded output.",
        "Answer step failed groundedness or returned an empty answer.",
    )
    drafted = decide(
        (strip(body) != "") & (strip(subject) != ""),
        "Email draft generated successfully.",
        "Email draft was empty.",
    )
    unknown = F.concat(F.lit("Unsupported step type '"), step_type, F.lit("'."))
    return (
        F.when(step_type == RETRIEVE, retrieved)
        .when(step_type == ANSWER, answered)
        .when(step_type == DRAFT, drafted)
        .otherwise(decide(F.lit(False), "", unknown))
    )


def run_outcome(scope: Column, steps: Column) -> Column:
    """struct<status, stop_reason, step_count> of a run.

    ``steps`` is array<struct<step_type, error, decision, reason>> in planned order. The first step that
    failed or was not allowed ends the run and is the last one counted; out of scope no step runs.
    """
    numbered = F.transform(
        steps,
        lambda step, at: F.struct(
            at.alias("at"), step["error"].alias("error"), step["decision"].alias("decision"),
            step["reason"].alias("reason"),
        ),
    )
    stopped = F.get(
        F.filter(
            numbered,
            lambda s: s["error"].isNotNull() | (F.coalesce(s["decision"], F.lit("allow")) != "allow"),
        ),
        F.lit(0),
    )
    blocked = scope["status"] != "in_scope"
    return F.struct(
        F.when(blocked, "aborted")
        .when(stopped.isNull(), "completed")
        .when(stopped["error"].isNotNull(), "failed")
        .otherwise("aborted")
        .alias("status"),
        F.when(blocked, scope["reason"])
        .otherwise(F.coalesce(stopped["error"], stopped["reason"]))
        .alias("stop_reason"),
        F.when(blocked, 0).otherwise(F.coalesce(stopped["at"] + 1, F.size(steps))).alias("step_count"),
    )
