"""Chat formatting on token level."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ship import ship
from . import tokens

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (START, SEP, END)
#: A bar after an angle bracket and any number of backslashes gets one more.
_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """Text without any control string; ``unescape`` gives it back."""
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def reserved(model) -> dict[str, int]:
    """Ids of the control strings: those that follow the vocabulary."""
    return {s: model.n_vocab + k for k, s in enumerate(CONTROLS)}


def assemble(model, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of one conversation. Every segment is encoded by itself
    and the reserved ids are spliced between them, so no token spans a border.
    The mask is 1 on the ids of assistant texts: +1 where such a segment starts
    and -1 where it ends, summed up from the left."""
    ids = reserved(model)
    parts, marks, at = [], [], 0
    for role, text in turns:
        role_ids, text_ids = (tokens.encode(model, escape(x), special=False) for x in (role, text))
        parts += [[ids[START]], role_ids, [ids[SEP]], text_ids, [ids[END]]]
        first = at + 2 + len(role_ids)
        if role == "assistant":
            marks += [(first, 1), (first + len(text_ids), -1)]
        at = first + len(text_ids) + 1
    flat = np.concatenate([np.asarray(p, np.uint32) for p in parts]) if parts else np.zeros(0, np.uint32)
    steps = np.zeros(len(flat) + 1, np.int8)
    np.add.at(steps, [k for k, _ in marks], [s for _, s in marks])
    return flat, np.cumsum(steps[:-1], dtype=np.int8)


def read_back(model, ids: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[str, str]], str, str]:
    """(turns, text under the loss mask, formatted text) from ids and mask alone."""
    names = {k: s for s, k in reserved(model).items()}
    turns, shown, fields = [], [], []
    cuts = np.flatnonzero(ids >= model.n_vocab)
    begin = 0
    for at in cuts:
        kind = names[int(ids[at])]
        part = model.decode(ids[begin:at].tolist())
        shown += [part, kind]
        if kind != START:
            fields.append(unescape(part))
        if kind == END:
            turns.append((fields[0], fields[1]))
            fields = []
        begin = at + 1
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
    loss = "".join(unescape(model.decode(ids[a:b].tolist())) for a, b in edges.reshape(-1, 2))
    return turns, loss, "".join(shown)


def chat_format(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, n_turns, ids, mask) per conversation: token ids as little-endian
    unsigned 32-bit binary and one mask byte for each id.

    Turns are ordered by turn, then role and text, nulls first. Null roles and
    texts count as empty; a turn with empty text has an empty segment. Repeated
    rows are turns of their own. Rows with a null conv_id form a conversation.
    A role that holds a control string or line end is escaped like a text and
    read back whole. Other columns are ignored; no rows give no rows. A
    conversation is one row of the result, and its turns meet in the task that
    makes that row; conversations are spread by conv_id.
    """
    ship(conversations.sparkSession)
    path = path or tokens.default_path()
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    grouped = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "role", "text"))).alias("turns")
    )

    def run(batches):
        model = tokens.load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                turns = [[(t["role"], t["text"]) for t in c] for c in part.column(1).to_pylist()]
                made = [assemble(model, t) for t in turns]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in turns], pa.int64()),
                     pa.array([i.astype("<u4").tobytes() for i, _ in made], pa.binary()),
                     pa.array([m.tobytes() for _, m in made], pa.binary())],
                    names=["conv_id", "n_turns", "ids", "mask"],
                )

    return grouped.mapInArrow(run, "conv_id long, n_turns long, ids binary, mask binary")


def chat_read(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, turns, loss_text, formatted) read back from ``chat_format``'s ids
    and masks; turns are structs of role and text."""
    path = path or tokens.default_path()
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches):
        model = tokens.load(path)
        for batch in batches:
            found = [
                read_back(model, np.frombuffer(i, "<u4"), np.frombuffer(m, np.int8))
                for i, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[{"role": r, "text": t} for r, t in f[0]] for f in found], turn),
                 pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())],
                names=["conv_id", "turns", "loss_text", "formatted"],
            )

    return formatted.select("conv_id", "ids", "mask").mapInArrow(
        run, "conv_id long, turns array<struct<role:string,text:string>>, loss_text string, formatted string"
    )
