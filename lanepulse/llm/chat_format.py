"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one string, encoded once with character offsets, and the
sorted spans of its turns are intersected with the token spans by binary search.

Template, per turn::

    <|turn|>ROLE<|body|>TEXT<|end|>

The three control strings are special tokens, so no token crosses a turn's edge. Inside
roles and texts a backslash becomes two and ``<|`` becomes ``<\\|``; no control string can
then occur in them, and reading a backslash with its next character undoes it.

Defined results: rows are ordered by (turn, role, text), nulls first; a null role or text
counts as empty; rows repeated in the input are turns repeated in the output; rows with a
null conversation id form one conversation with a null id; an empty table gives no rows;
further columns are ignored. Texts may be of any length: memory is bound by the longest
conversation, which is one model input and thus never split.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
_TURNS = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)

FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("input_ids", T.ArrayType(T.IntegerType())),
        T.StructField("token_start", T.ArrayType(T.IntegerType())),
        T.StructField("token_end", T.ArrayType(T.IntegerType())),
        T.StructField("loss_mask", T.ArrayType(T.BooleanType())),
    ]
)
READ_BACK = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("loss_tokens", T.LongType()),
    ]
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], learn: str) -> tuple[str, np.ndarray]:
    """The conversation's string, and the [start, end) code points of the texts to learn."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + BODY, escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def span_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Tokens that overlap any span; tokens and spans are sorted."""
    lo = np.searchsorted(ends, spans[:, 0], side="right")
    hi = np.searchsorted(starts, spans[:, 1], side="left")
    steps = np.zeros(len(starts) + 1, np.int64)
    np.add.at(steps, lo, 1)
    np.add.at(steps, np.maximum(hi, lo), -1)
    return np.cumsum(steps[:-1]) > 0


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.add_special_tokens([TURN, BODY, END])
    return tok


def format_conversations(
    rows: DataFrame,
    tokenizer: str,
    conv_id: str | Column = "conv_id",
    turn: str | Column = "turn",
    role: str | Column = "role",
    text: str | Column = "text",
    learn: str = "assistant",
) -> DataFrame:
    """One row per conversation: the formatted string, its token ids and their character
    spans, and the loss mask over tokens (true on the texts of the role ``learn``).

    ``tokenizer`` is the path of a byte-level ``tokenizers`` file.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    turns = rows.select(
        col(conv_id).cast("long").alias("conv_id"),
        F.struct(
            col(turn).alias("turn"),
            F.coalesce(col(role), F.lit("")).alias("role"),
            F.coalesce(col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches):
        tok = _tokenizer(tokenizer)
        for batch in batches:
            ids, turns = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 64):
                out = []
                for cid, ts in zip(ids[lo : lo + 64].to_pylist(), turns[lo : lo + 64].to_pylist(), strict=True):
                    whole, spans = render([(t["role"], t["text"]) for t in ts], learn)
                    enc = tok.encode(whole, add_special_tokens=False)
                    at = np.array(enc.offsets, np.int64).reshape(-1, 2)
                    mask = span_mask(at[:, 0], at[:, 1], spans)
                    out.append((cid, whole, enc.ids, at[:, 0], at[:, 1], mask))
                yield pa.record_batch(
                    [
                        pa.array([o[0] for o in out], pa.int64()),
                        pa.array([o[1] for o in out], pa.string()),
                        *(pa.array([o[k] for o in out], pa.list_(pa.int32())) for k in (2, 3, 4)),
                        pa.array([o[5] for o in out], pa.list_(pa.bool_())),
                    ],
                    names=FORMATTED.names,
                )

    return grouped.mapInArrow(run, FORMATTED)


def masked_texts(whole: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The unescaped text under each run of masked tokens."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [unescape(whole[starts[a] : ends[b - 1]]) for a, b in edge.reshape(-1, 2).tolist()]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what :func:`format_conversations` wrote, read from its strings and masks."""

    def run(batches):
        for batch in batches:
            cols = [batch.column(n) for n in FORMATTED.names]
            out = []
            for i in range(batch.num_rows):
                cid, whole = cols[0][i].as_py(), cols[1][i].as_py()
                starts, ends, mask = (np.asarray(c[i].values.to_numpy(zero_copy_only=False)) for c in cols[3:])
                turns = [(unescape(r), unescape(t)) for r, t in _TURNS.findall(whole)]
                loss = "".join(masked_texts(whole, starts, ends, mask))
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((cid, len(turns), sha(said), len(loss), sha(loss), len(whole), len(starts), int(mask.sum())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[k] for o in out], pa.string() if k in (2, 4) else pa.int64()) for k in range(len(READ_BACK))],
                names=READ_BACK.names,
            )

    return formatted.mapInArrow(run, READ_BACK)
