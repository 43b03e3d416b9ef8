r"""Chat formatting: conversations rendered by a compiled template with generation marks.

The template marks every turn, so roles and texts can be read back from the output.  Control
strings inside a role or text are escaped reversibly: a backslash is doubled, and in each control
string a backslash follows its first character; in reading, a doubled backslash gives one and a
single one vanishes.  Output between generation marks, the assistants' texts, is the loss mask.

Turns come sorted by conversation and turn, and a conversation is rendered, read back and digested
as a stream, in the memory of one turn, even if it holds a third of all rows.

Defined results: a null text or role counts as empty; turns are ordered by turn (nulls first), then
role, then text, repeated ones stay; rows with a null conv_id are one conversation; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, releasing
from tessera.llm.template import compile_template

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ASST]", "[ROLE]", "[/ROLE]")
TEMPLATE = """{%- for m in messages -%}
{%- if m.role == 'user' -%}
{{ '<s>[INST] ' ~ (m.text | escape) ~ ' [/INST]' }}
{%- elif m.role == 'assistant' -%}
{{ '[ASST]' }}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '</s>' }}
{%- elif m.role == 'system' -%}
{{ '<<SYS>>' ~ (m.text | escape) ~ '<</SYS>>' }}
{%- else -%}
{{ '[ROLE]' ~ (m.role | escape) ~ '[/ROLE]' ~ (m.text | escape) ~ '</s>' }}
{%- endif -%}
{%- endfor -%}"""
_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_TURN = re.compile(
    r"<s>\[INST\] (?P<user>.*?) \[/INST\]|\[ASST\](?P<assistant>.*?)</s>|<<SYS>>(?P<system>.*?)<</SYS>>|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)</s>",
    re.DOTALL,
)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text or "")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def read_turn(formatted: str, at: int = 0) -> tuple[str, str, int] | None:
    """(role, text, end) of the turn that starts at ``at``, or None if it isn't whole."""
    found = _TURN.match(formatted, at)
    if not found:
        return None
    kind = found.lastgroup
    if kind == "text":
        return unescape(found["role"]), unescape(found["text"]), found.end()
    return kind, unescape(found[kind]), found.end()


def read_back(formatted: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    while at < len(formatted):
        found = read_turn(formatted, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        turns.append(found[:2])
        at = found[2]
    return turns


def renderer(template: str = TEMPLATE):
    return compile_template(template, {"escape": escape})


def format_chat(messages: Iterable[dict], template: str = TEMPLATE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask as spans [start, end) of code points."""
    out, spans, at = [], [], 0
    for text, generated in renderer(template)({"messages": messages}):
        if generated:
            spans.append((at, at + len(text)))
        out.append(text)
        at += len(text)
    return "".join(out), spans


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    rows = (row for b in batches for row in zip(*(b[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True))
    for conv_id, turns in itertools.groupby(rows, key=lambda r: r[0]):
        yield conv_id, ({"role": role or "", "text": text or ""} for _, role, text in turns)


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, loss_start and loss_end (spans of code points)."""
    spec = "conv_id long, formatted string, loss_start array<int>, loss_end array<int>"
    schema = arrow_schema(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, turns in _conversations(batches):
            text, spans = format_chat(turns, template)
            columns = [[conv_id], [text], [[a for a, _ in spans]], [[b for _, b in spans]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return _sorted(conversations).mapInArrow(releasing(run), spec)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """What is read back from each formatted conversation: its turns and the text under the mask."""
    schema = arrow_schema(DIGESTS)

    def digest(turns: Iterator[dict], render) -> tuple:
        waiting, n, chars, loss = "", 0, 0, 0
        read, masked = hashlib.sha256(), hashlib.sha256()
        for part, generated in render({"messages": turns}):
            chars += len(part)
            waiting += part
            if generated:
                text = unescape(part)
                loss += len(text)
                masked.update(text.encode("utf-8", "surrogatepass"))
            while found := read_turn(waiting):
                role, text, end = found
                read.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n, waiting = n + 1, waiting[end:]
        if waiting:
            raise ValueError("the output can't be read back")
        return n, read.hexdigest(), loss, masked.hexdigest(), chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, rows = renderer(template), []
        for conv_id, turns in _conversations(batches):
            rows.append((conv_id, *digest(turns, render)))
            if len(rows) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _sorted(conversations).mapInArrow(releasing(run), DIGESTS)
