"""Chat formatting by columnar byte assembly.

The turns of an Arrow batch become segments (header, content, footer); their lengths and
cumulative offsets give scatter indices, and every byte is copied once into one buffer that
is the output's text column. Control strings inside texts and roles are escaped by a
backslash, so the template can be read back exactly.

Defined cases: null text and null role are empty; a null conversation id is a conversation
of its own; turns are ordered by turn (null first), then role, then text; repeated rows are
repeated turns; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from utterscale.llm.common import flat_bytes, ranges, slices

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
SPECIAL = r"(\\|</?s>|\[/?INST\]|\[/?ROLE\])"
PIECE = 4 << 20

#: role -> opening and closing of a turn; other roles are written out
TURNS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "</s>")


def _escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(column, ""), SPECIAL, r"\\\1")


def _assemble(columns: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The rows' segments one after the other: bytes, and the offsets (rows x segments, flat, n+1)."""
    lengths = np.stack([np.diff(at) for _, at in columns], axis=1)
    starts = np.r_[0, np.cumsum(lengths.ravel())]
    out = np.empty(int(starts[-1]), np.uint8)
    to = starts[:-1].reshape(lengths.shape)
    for k, (data, _) in enumerate(columns):
        out[ranges(to[:, k], lengths[:, k])] = data
    return out, starts


def _code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points before each offset."""
    return np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]


def formatted(turns: DataFrame) -> DataFrame:
    """``conv_id, part, text, loss_start, loss_end`` of ``conv_id, turn, role, text``.

    A conversation is the concatenation of its parts in order; a part ends with an Arrow
    batch, so no task holds a whole conversation. The loss mask is a list of spans in code
    points of the part's text: the escaped contents of the assistant. Rows come out
    partitioned by conversation, a conversation's parts in order.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "turn", "role", "text")
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = [], 0  # last: [id] of the conversation before
        for batch in slices(batches, "text", PIECE):
            role = np.array(batch.column("role").fill_null("").to_pylist(), dtype=object)
            written = np.array([r not in TURNS for r in role])
            opening = [OTHER[0] if w else TURNS[r][0] for r, w in zip(role, written)]
            names = _escape(pa.array([r if w else "" for r, w in zip(role, written)], pa.string()))
            middle = [OTHER[1] if w else "" for w in written]
            closing = [OTHER[2] if w else TURNS[r][1] for r, w in zip(role, written)]
            texts = [pa.array(opening), names, pa.array(middle), _escape(batch.column("text")), pa.array(closing)]
            data, starts = _assemble([flat_bytes(x) for x in texts])
            ids = batch.column("conv_id").to_pylist()
            heads = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            ends = [*heads[1:], len(ids)]
            parts = []
            for h in heads:
                part = part + 1 if h == 0 and last == [ids[0]] else 0
                parts.append(part)
            last = [ids[-1]]
            row_start = np.r_[starts[:-1:5], starts[-1]]
            points = _code_points(data, starts)
            begin, end = points[3:-1:5], points[4::5]
            asks = role == "assistant"
            picked = [np.flatnonzero(asks[a:b]) + a for a, b in zip(heads, ends)]
            base = points[:-1:5]
            text_offsets = row_start[[*heads, len(ids)]]
            if text_offsets[-1] >= 2**31:  # only a single turn can be that long
                raise ValueError("a formatted turn of 2 GB or more")
            column = pa.StringArray.from_buffers(len(heads), pa.py_buffer(text_offsets.astype(np.int32)), pa.py_buffer(data))
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[h] for h in heads], batch.column("conv_id").type), pa.array(parts, pa.int64()), column,
                pa.array([(begin[p] - base[h]).tolist() for p, h in zip(picked, heads)], pa.list_(pa.int64())),
                pa.array([(end[p] - base[h]).tolist() for p, h in zip(picked, heads)], pa.list_(pa.int64())),
            ], names=["conv_id", "part", "text", "loss_start", "loss_end"])

    return placed.mapInArrow(run, f"conv_id {kind}, part long, text string, "
                                  "loss_start array<bigint>, loss_end array<bigint>")


_TOKEN = re.compile(r"\\(?:\\|</?s>|\[/?INST\]|\[/?ROLE\])|</?s>|\[/?INST\]|\[/?ROLE\]")


def unescape(text: str) -> str:
    return re.sub(r"\\" + SPECIAL, r"\1", text)


def parse(text: str) -> Iterator[tuple[str, str]]:
    """``role, text`` of every turn of a formatted part."""
    pending, role, since = None, "", 0
    for m in _TOKEN.finditer(text):
        mark = m.group()
        if mark[0] == "\\":
            continue
        if mark in ("[INST]", "<s>", "[ROLE]"):
            pending, since = mark, m.end()
        elif mark == "[/ROLE]":
            role, since = unescape(text[since:m.start()]), m.end()
        elif mark == "[/INST]":
            yield "user", unescape(text[since + 1:m.start() - 1])
        else:
            yield ("assistant" if pending == "<s>" else role), unescape(text[since:m.start()])


def read_back(parts: DataFrame) -> DataFrame:
    """One row per conversation with what the formatted text says about its turns and loss mask.

    Expects the partitioning and order of ``formatted``; digests are fed part by part, so a
    conversation of any length needs constant memory.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        done: list[tuple] = []

        def closed(x):
            return (x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5])

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["part"] == 0:
                    if now is not None:
                        done.append(closed(now))
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[5] += len(row["text"])
                for role, text in parse(row["text"]):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for a, b in zip(row["loss_start"], row["loss_end"]):
                    said = unescape(row["text"][a:b])
                    now[3] += len(said)
                    now[4].update(said.encode())
                if len(done) >= 4096:
                    yield _rows(done, batch.schema.field("conv_id").type)
                    done = []
            last_type = batch.schema.field("conv_id").type
        if now is not None:
            yield _rows([*done, closed(now)], last_type)

    return parts.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                 "loss_sha256 string, formatted_chars long")


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
