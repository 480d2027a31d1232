"""Chat formatting: conversations rendered by a compiled template, and read back.

Rows of a conversation are dealt to one task and sorted by turn there; the template renders
them lazily, and the text leaves in chunks that end at a turn's end, so that a conversation of
any length passes in bounded memory. Control strings inside roles and texts are escaped
reversibly: a backslash is put into every ``<``, backslashes, ``|`` (and taken out again).

Edge cases: a null role or text is empty; rows with equal or null turn are ordered by role and
text, nulls first; repeated rows are turns of their own; a null ``conv_id`` is a conversation;
an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphloom.llm.template import Template

START, END = "<|im_start|>", "<|im_end|>"
CHUNK_CHARS = 1_000_000


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def one_line(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def many_lines(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


#: Filters apply from the left: a role becomes one line, then control strings are escaped.
FILTERS = {"escape": escape, "one_line": one_line}
CHATML = Template(
    START
    + "{{ turn.role | one_line | escape }}\n{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}"
    + END
    + "\n",
    FILTERS,
)
CONVERSATION = Template("{% for turn in turns %}" + CHATML.source + "{% endfor %}", FILTERS)
FORMATTED = "conv_id bigint, chunk int, text string, loss_start array<bigint>, loss_end array<bigint>"
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def format_conversations(rows: DataFrame, template: Template = CONVERSATION, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(conv_id, chunk, text, loss_start, loss_end); spans are code points of the chunk's text.

    Chunks of a conversation are consecutive rows of one partition, in order.
    """

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = template.compiled()
        cols: tuple[list, ...] = ([], [], [], [], [])
        held = 0
        for key, group in groupby(turns(batches), key=lambda r: r[0]):
            text, starts, ends, size, chunk = [], [], [], 0, 0
            given = ({"role": role or "", "text": body or ""} for _, role, body in group)
            for part, loss in compiled(turns=given):
                if loss and part:
                    if ends and ends[-1] == size:
                        ends[-1] = size + len(part)
                    else:
                        starts.append(size)
                        ends.append(size + len(part))
                text.append(part)
                size += len(part)
                if size >= chunk_chars and part.endswith(END + "\n"):
                    for col, v in zip(cols, (key, chunk, "".join(text), starts, ends)):
                        col.append(v)
                    held, chunk = held + size, chunk + 1
                    text, starts, ends, size = [], [], [], 0
                    if held >= 4 * chunk_chars:
                        yield _batch(cols)
                        cols, held = ([], [], [], [], []), 0
            if size or not chunk:
                for col, v in zip(cols, (key, chunk, "".join(text), starts, ends)):
                    col.append(v)
                held += size
            if held >= 4 * chunk_chars:
                yield _batch(cols)
                cols, held = ([], [], [], [], []), 0
        if cols[0]:
            yield _batch(cols)

    given = rows.select(F.col("conv_id").cast("bigint"), "role", "text", "turn").repartition("conv_id")
    ordered = given.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, FORMATTED)


def _batch(cols: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "chunk", "text", "loss_start", "loss_end"])


def parse_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; the whole text has to be turns."""
    at = 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("text between turns")
        at = m.end()
        yield many_lines(unescape(m[1])), unescape(m[2])
    if at != len(text):
        raise ValueError("text after the last turn")


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of loss text, from the output of ``format_conversations`` as it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, state = None, None
        for b in batches:
            for conv, chunk, text, starts, ends in zip(*(c.to_pylist() for c in b.columns)):
                if chunk == 0:
                    if state:
                        done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for s, e in zip(starts, ends):
                    plain = unescape(text[s:e])
                    state[2] += len(plain)
                    state[3].update(plain.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if len(done) >= 10_000:
                yield _digests(done)
                done = []
        if state:
            done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        if done:
            yield _digests(done)

    return formatted.mapInArrow(run, DIGESTS)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
