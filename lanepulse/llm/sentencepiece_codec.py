"""SentencePiece encoding and decoding over a model file's pieces and scores.

The pieces form an Aho-Corasick automaton. One pass over a text visits, at each position, all
pieces that end there (the automaton's output links, longest first) and relaxes the best score
up to that position; the path back from the end is the segmentation with the highest sum of
scores. Characters without a piece of their own cost the lowest score less ten and fall back
to their bytes. These are the rules of SentencePiece's unigram encoder. Of equal scores the longer
last piece wins.

A file of type BPE is read the same way, by its scores: the ids are the best-scored
segmentation into its pieces, not the outcome of its merges in order.

Where no piece continues from a non-blank into a blank (or from a letter into a stop), the best
path splits there, so distinct fragments are segmented once and looked up afterwards.

Defined results: a null or empty text has no ids; repeated rows give repeated results; null
ids are kept; an empty table gives no rows; further columns are ignored. Decoding undoes
encoding but for a literal U+2581, which reads as a blank, as in the library.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fragments import _ALNUM, _STOP, FragmentEncoder
from .token_store import list_array, text_bytes

BLANK = "▁"
#: Fixed values of the model file: piece types, and the penalty of unknown characters.
NORMAL, UNKNOWN, USER_DEFINED, BYTE, UNUSED = 1, 2, 4, 6, 5
UNKNOWN_PENALTY = 10.0


def _fields(raw: bytes):
    """(number, value) of each field of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if raw[i - 1] < 128:
                return value, i

    i = 0
    while i < len(raw):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n, i = (8, i) if key & 7 == 1 else (4, i) if key & 7 == 5 else varint(i)
            value, i = raw[i : i + n], i + n
        yield key >> 3, value


class Pieces:
    """A model file's pieces, scores, types and the settings that encoding needs."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.dummy_prefix = self.trim = True
        self.byte_fallback = False
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                score = struct.unpack("<f", f[2])[0] if 2 in f else 0.0
                self.pieces.append((f[1].decode("utf-8"), score, f.get(3, NORMAL)))
            elif number == 2:
                self.byte_fallback = bool(dict(_fields(value)).get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                self.dummy_prefix, self.trim = bool(f.get(3, 1)), bool(f.get(4, 1))
                if f.get(2):
                    raise ValueError("a model with a character map needs its normaliser")
        if self.trim:
            raise ValueError("a model that trims white space needs its normaliser")
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.bytes = {int(p[0][3:5], 16): i for i, p in enumerate(self.pieces) if p[2] == BYTE}
        scores = [p[1] for p in self.pieces if p[2] == NORMAL]
        self.lowest, self.highest = min(scores), max(scores)
        texts = [p[0] for p in self.pieces if p[2] in (NORMAL, USER_DEFINED)]
        #: whether runs of blanks (and newlines) always start a piece
        self.splits = not any(BLANK in t.lstrip(BLANK) for t in texts)
        self.splits_lines = self.splits and not any("\n" in t for t in texts)
        #: whether a stop or comma after an ASCII letter or digit always starts a piece
        self.splits_stops = self.splits and not any(re.search("[A-Za-z0-9][.,]", t) for t in texts)

    def automaton(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for i, (text, score, kind) in enumerate(self.pieces):
            if kind == NORMAL:
                auto.add_word(text, (len(text), score, i))
            elif kind == USER_DEFINED:
                auto.add_word(text, (len(text), len(text) * self.highest - 0.1, i))
        auto.make_automaton()
        return auto


class Viterbi:
    """Best-scored segmentation of blank-escaped strings."""

    def __init__(self, model: Pieces):
        self.model, self.auto = model, model.automaton()
        self.unknown_score = model.lowest - UNKNOWN_PENALTY
        self.sizes = [len(p[0]) for p in model.pieces]
        self.singles = {p[0] for p in model.pieces if len(p[0]) == 1 and p[2] in (NORMAL, USER_DEFINED)}

    def __call__(self, text: str) -> list[int]:
        return self._known(text) if self.singles.issuperset(text) else self._any(text)

    def _known(self, text: str) -> list[int]:
        """Where each character is a piece, every position is reached and none is unknown. All
        pieces that end before a position come before those that start there."""
        n = len(text)
        best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for last, (size, score, piece) in self.auto.iter(text):  # the longest of one end first
            score += best[last + 1 - size]
            if score > best[last + 1]:
                best[last + 1], back[last + 1] = score, piece
        out, sizes = [], self.sizes
        while n:
            out.append(back[n])
            n -= sizes[back[n]]
        return out[::-1]

    def _any(self, text: str) -> list[int]:
        n = len(text)
        best, back = [0.0] * (n + 1), [(0, -1)] * (n + 1)
        done = 0  # positions up to here have their best score

        def close(upto: int) -> None:
            """Characters after ``done`` without any piece ending on them are unknown."""
            nonlocal done
            while done < upto:
                done += 1
                best[done], back[done] = best[done - 1] + self.unknown_score, (done - 1, -1)

        ends: list[tuple[int, float, int]] = []
        at = 0
        for end, (size, score, piece) in self.auto.iter(text):
            if end + 1 != at:
                self._relax(best, back, at, ends)
                done = max(done, at)
                close(end)
                at, ends = end + 1, []
            ends.append((size, score, piece))
        self._relax(best, back, at, ends)
        done = max(done, at)
        close(n)
        path, i = [], n
        while i:
            start, piece = back[i]
            path.append((start, i, piece))
            i = start
        return self._ids(text, path[::-1])

    def _relax(self, best: list, back: list, at: int, ends: list) -> None:
        if not ends:
            return
        top, link = -np.inf, (0, -1)
        for size, score, piece in ends:  # longest first
            if best[at - size] + score > top:
                top, link = best[at - size] + score, (at - size, piece)
        if ends[-1][0] != 1 and best[at - 1] + self.unknown_score > top:
            top, link = best[at - 1] + self.unknown_score, (at - 1, -1)
        best[at], back[at] = top, link

    def _ids(self, text: str, path: list) -> list[int]:
        m, out, was_unknown = self.model, [], False
        for start, end, piece in path:
            if piece >= 0:
                out.append(piece)
            elif m.byte_fallback:
                out += [m.bytes[b] for b in text[start:end].encode("utf-8", "surrogatepass")]
            elif not was_unknown:
                out.append(m.unknown)
            was_unknown = piece < 0
        return out


def _cuts(model: Pieces):
    """Fragment starts over raw bytes: before each run of blanks, and around newlines."""

    def cut(data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data), bool)
        if model.splits and len(data) > 1:
            # 0x81 may end a literal U+2581, which pieces take for a blank
            out[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20) & (data[:-1] != 0x81)
            if model.splits_lines and model.byte_fallback:
                line = data == 0x0A
                out |= line
                out[1:] |= line[:-1]
            if model.splits_stops:
                out[1:] |= _STOP[data[1:]] & _ALNUM[data[:-1]]
        return out

    return cut


_CODECS: dict[str, Codec] = {}


class Codec:
    """Encoder and decoder of one model file, kept by each worker."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.model = Pieces(f.read())
        viterbi = Viterbi(self.model)
        self._fragments = FragmentEncoder(lambda ts: [viterbi(t.replace(" ", BLANK)) for t in ts], _cuts(self.model))
        blank = BLANK.encode()
        self._bytes = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else p.encode().replace(blank, b" ") if kind in (NORMAL, USER_DEFINED, UNUSED) else b""
            for p, _, kind in self.model.pieces
        ]

    @staticmethod
    def of(path: str) -> Codec:
        if path not in _CODECS:
            _CODECS[path] = Codec(path)
        return _CODECS[path]

    def encode(self, texts: list[bytes]):
        lead = b" " if self.model.dummy_prefix else b""
        return self._fragments.encode([lead + t if t else t for t in texts])

    def decode(self, ids: list[int]) -> bytes:
        out = b"".join(map(self._bytes.__getitem__, ids))
        return out[1:] if self.model.dummy_prefix and out[:1] == b" " else out


def encode(docs: DataFrame, model: str, doc_id: str | Column = "doc_id", text: str | Column = "text") -> DataFrame:
    """(doc_id, text, ids) with the ids of each whole text."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        codec = Codec.of(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                keys, texts = (batch.column(k)[lo : lo + 500] for k in (0, 1))
                yield pa.record_batch([keys, texts, list_array(list(codec.encode(text_bytes(texts))))], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``rows`` with the column ``decoded``: the text of each row's ids (null for null)."""
    names = [c for c in rows.columns if c != "decoded"]
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("decoded", T.StringType())])

    def run(batches):
        codec = Codec.of(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                out = [None if x.as_py() is None else codec.decode(x.values.to_pylist()).decode("utf-8", "replace") for x in b.column(ids)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=schema.names)

    return rows.select(*names).mapInArrow(run, schema)
