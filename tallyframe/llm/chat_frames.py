"""Conversations as Spark frames: formatting with a compiled template, and reading the output back.

Turns are hash-partitioned by conversation and sorted inside the partition, then rendered as a stream: a
task holds one output part (about PART_CHARS characters, one turn at least), never a conversation, so one
conversation that holds a large share of all rows needs no more memory than any other.
"""

from __future__ import annotations

import hashlib
import re
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .chat import compile_template, unescape

PART_CHARS = 1 << 20
BATCH_CHARS = 8 << 20
PARTS = "conv_id long, part int, text string, loss_spans array<struct<start:int,end:int>>"
_PARTS_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _rows(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            yield from zip(*(c.to_pylist() for c in part.columns))


def _parts(conversation: int | None, pieces):
    """(conv_id, part number, text, loss spans) of one conversation, cut at ends of turns."""
    number, texts, spans, size, some = 0, [], [], 0, False
    for text, loss in pieces:
        if text:
            some = True
            if loss and spans and spans[-1][1] == size:
                spans[-1] = (spans[-1][0], size + len(text))
            elif loss:
                spans.append((size, size + len(text)))
            texts.append(text)
            size += len(text)
        elif size >= PART_CHARS:
            yield conversation, number, "".join(texts), spans
            number, texts, spans, size = number + 1, [], [], 0
    if texts or not some:
        yield conversation, number, "".join(texts), spans


def _format(source: str):
    def run(batches):
        render = compile_template(source)

        def frame(rows):
            ids, numbers, texts, spans = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _PARTS_TYPE)],
                names=["conv_id", "part", "text", "loss_spans"],
            )

        held, size = [], 0
        for conversation, turns in groupby(_rows(batches), key=itemgetter(0)):
            for part in _parts(conversation, render({"role": r or "", "text": t or ""} for _, r, t in turns)):
                held.append(part)
                size += len(part[2])
                if size >= BATCH_CHARS or len(held) >= 4096:
                    yield frame(held)
                    held, size = [], 0
        if held:
            yield frame(held)

    return run


def format_conversations(turns: DataFrame, template: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, text, loss_spans): the rendered conversations, in parts that end with a turn.

    loss_spans are code-point ranges of `text` that lie in {% generation %} blocks.  Turns go by turn (null first), then
    role, then text; repeated turns are turns like any others.  A null role or text is empty; rows with a null conv_id form
    one conversation.  An empty table gives an empty one.  Parts of a conversation lie together and in order in one partition.
    """
    ship(turns.sparkSession)
    compile_template(template)  # errors show here, not in a task
    own = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    placed = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return placed.mapInArrow(_format(template), PARTS)


_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\] (.*?)</s>", re.S)


def _digest(batches):
    def row(conversation, parts):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n, loss_chars, chars = 0, 0, 0
        for _, _, text, spans in parts:
            chars += len(text)
            for m in _TURN.finditer(text):
                n += 1
                turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            for span in spans:
                own = unescape(text[span["start"] : span["end"]])
                loss_chars += len(own)
                loss.update(own.encode())
        return conversation, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def frame(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    held = []
    for conversation, parts in groupby(_rows(batches), key=itemgetter(0)):
        held.append(row(conversation, parts))
        if len(held) >= 4096:
            yield frame(held)
            held = []
    if held:
        yield frame(held)


def digests(parts: DataFrame) -> DataFrame:
    """What the formatted output says of each conversation, read back by its turn marks.

    `parts` must lie as `format_conversations` gives them, or be partitioned by conv_id and sorted by (conv_id, part).
    """
    ship(parts.sparkSession)
    return parts.mapInArrow(_digest, DIGESTS)
