"""Conversations formatted by a compiled template, with loss spans, and read back from the output."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import read, running_sums, ship_package
from corpusmill.llm.templates import Template

#: Turn numbers of a conversation that are numbered together.
TURN_RANGE = 256

CHAT_TEMPLATE = (
    "{%- for message in messages -%}"
    "{{ '<turn ' }}{{ message.role | tojson }}{{ '>\\n' }}"
    "{%- if message.role == 'assistant' -%}"
    "{%- generation -%}{{ message.text | guard }}{%- endgeneration -%}"
    "{%- else -%}{{ message.text | guard }}{%- endif -%}"
    "{{ '\\n</turn>\\n' }}"
    "{%- endfor -%}"
)

_CONTROL = re.compile(r"\\*</?turn")
_GUARDED = re.compile(r"\\+</?turn")
_DECODE = json.JSONDecoder()


def guard(text: object) -> str:
    """One more backslash before each control string, so that none stands without."""
    return _CONTROL.sub(lambda found: "\\" + found[0], str(text))


def unguard(text: str) -> str:
    """The text that ``guard`` was given."""
    return _GUARDED.sub(lambda found: found[0][1:], text)


FILTERS = {"tojson": lambda value: json.dumps(value, ensure_ascii=False), "guard": guard}


def format_conversations(conversations: DataFrame, template: str = CHAT_TEMPLATE) -> DataFrame:
    """conv_id, position (0, 1, ...), formatted and loss_spans: one row per turn, to be read in order of position.

    Turns are ordered by turn, role and text, a null turn first; null roles and texts are empty. Repeated rows are turns of
    their own. A null conv_id is a conversation like any other. Turns are numbered in ranges of their turn number, so a
    conversation of any length is spread over tasks. Other columns are not read. An empty table gives no rows.
    """
    ship_package(conversations.sparkSession)
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("_key"), "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / TURN_RANGE), F.lit(-(1 << 62))).alias("_range"),
    )
    lengths = rows.groupBy("_key").agg(F.count("*").alias("_length"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    numbered = running_sums(rows, ["_key"], "_range", order, {"position": F.lit(1).cast("long")}, lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template, FILTERS)
        for batch in batches:
            texts, spans = [], []
            for role, text, at, length in zip(*[batch.column(c).to_pylist() for c in ("role", "text", "position", "_length")]):
                formatted, found = compiled.turn({"role": role, "text": text}, at, length)
                texts.append(formatted)
                spans.append([{"start": a, "end": b} for a, b in found])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("position"), pa.array(texts, pa.string()), pa.array(spans, kind)],
                ["conv_id", "position", "formatted", "loss_spans"],
            )

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return numbered.select("conv_id", "position", "role", "text", "_length").mapInArrow(
        run, f"conv_id {kind}, position long, formatted string, loss_spans array<struct<start:long,end:long>>"
    )


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of the turns in a piece of formatted text."""
    at = 0
    while (start := formatted.find("<turn ", at)) >= 0:
        role, after = _DECODE.raw_decode(formatted, start + 6)
        end = formatted.index("\n</turn>\n", after)
        yield role, unguard(formatted[after + 2 : end])
        at = end + 9


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """What a reader gets back per conversation: counts and SHA-256 of its turns and of the text under the loss spans.

    Pieces of a conversation are read in order by one task as a stream; it holds hash states, never a conversation.
    """
    ship_package(formatted.sparkSession)
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list | None = None
        done: list[list] = []

        def close() -> None:
            if current:
                conv, turns, turns_hash, chars, loss_hash, total = current
                done.append([conv, turns, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), total])

        for batch in batches:
            for conv, text, spans in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")]):
                if current is None or conv != current[0]:
                    close()
                    current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    current[1] += 1
                    current[2].update(f"{role}\n{said}\n".encode())
                for span in spans:
                    learned = unguard(text[span["start"] : span["end"]])
                    current[3] += len(learned)
                    current[4].update(learned.encode())
                current[5] += len(text)
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done)))))
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done)))))

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


#: A conversation made of control strings.
CONTROL_CONVERSATION = r"""
SELECT -7L AS conv_id, turn, role, '\\### Assistant: </turn> ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"""


def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    given = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql(CONTROL_CONVERSATION)
    return digest_conversations(format_conversations(given.unionByName(added)))


OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn ' || to_json(role)::VARCHAR || '>' || chr(10) || regexp_replace(text, '(\\*</?turn)', '\\\1', 'g')
    || chr(10) || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""
