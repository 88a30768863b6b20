"""Byte-level BPE by a transducer.

Encoding. A byte sequence has one token sequence whose neighbours all fit, that is, whose
pairs are what the merges make of their bytes; it is the result of the merges. So the merges
compile into a transducer: a path through the vocabulary's trie may end a token where it fits
the one before. It is determinised while it runs: a state holds the places in the trie of all paths that
the bytes so far allow (one for each place where an open token may have begun), a move says which of
them a byte carries on and which may end a token. Beside the state each path has its tokens that
wait; of the paths that may end a token at a byte one fits. Tokens that all paths share are emitted. An
open token is no longer than the longest one, which bounds the lookahead. Moves, and whether two tokens
fit, are kept for the worker's next texts.

A text is first cut into matches of the pattern (one that covers all characters, and takes a blank and
Latin letters for one match); each is encoded by itself. Distinct fragments of texts, cut where no match can
cross, are encoded once a worker.

Decoding. Ids become their bytes, in portions of a text. An incremental UTF-8 state machine
holds back what a portion leaves of a character until the next one brings the rest.

Defined results: a null or empty text has no ids and decodes to nothing; repeated rows give
repeated results; null ids of documents are kept; an empty table gives no rows; further columns are
ignored. Texts may be of any length. Bytes that are no UTF-8 are handed on as they are.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_by_bytes
from .fragments import _PLAIN, FragmentEncoder, cut_before_last_space
from .token_store import list_array, text_bytes

SLICE = 4_000_000
#: Tokens that are decoded at a time.
PORTION = 1 << 20
#: Moves and pairs that a worker keeps.
KEPT_MOVES, KEPT_PAIRS = 200_000, 1_000_000
#: Tokens that may wait before the paths are compared.
AHEAD = 8


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """What the merges make of ``data``: the pair of least rank first, of equal ones the leftmost."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], len(ranks) + 256))
        if parts[at] + parts[at + 1] not in ranks:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Bytes in, token ids out; determinised lazily."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes = ranks, {r: t for t, r in ranks.items()}
        self._next: dict[int, int] = {}  # trie: (node, byte) to node
        self._token = [-1]
        for text, rank in ranks.items():
            node = 0
            for b in text:
                at = self._next.setdefault(node << 8 | b, len(self._token))
                if at == len(self._token):
                    self._token.append(-1)
                node = at
            self._token[node] = rank
        self._inner = bytearray(len(self._token))
        for key in self._next:
            self._inner[key >> 8] = 1
        self._derived: dict[int, tuple | None] = {}
        self._fits: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self._states, self._number, self._moves = [(0,)], {(0,): 0}, {}

    def _derivation(self, token: int) -> tuple | None:
        """The ranks of the merges that make a token, in their order, with its first and last part before each of
        them and at the end; None where the merges make something else of its bytes."""
        if token not in self._derived:
            text, ranks = self.bytes[token], self.ranks
            parts = [text[i : i + 1] for i in range(len(text))]
            order, firsts, lasts = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                rank, at = min((ranks.get(x + y, len(ranks) + 256), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
                if parts[at] + parts[at + 1] not in ranks:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                order.append(rank), firsts.append(parts[0]), lasts.append(parts[-1])
            never = 1 << 40
            self._derived[token] = ([*order, never], firsts, lasts) if len(parts) == 1 else None
        return self._derived[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave token ``b`` as it is after ``a`` (-1: at the start).

        Both derive as they do alone, the lesser rank first, until a merge across comes before the next of either
        (of equal ranks the leftmost is first: one in ``a``, then the one across)."""
        key = a << 32 | b
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) >= KEPT_PAIRS:
                self._fits.clear()
            right = self._derivation(b)
            left = self._derivation(a) if a >= 0 else ([1 << 40], [b""], [b""])
            found = left is not None and right is not None
            if found and a >= 0:
                i = j = 0
                (left_ranks, _, lasts), (right_ranks, firsts, _), ranks = left, right, self.ranks
                while True:
                    x, y, across = left_ranks[i], right_ranks[j], ranks.get(lasts[i] + firsts[j])
                    if across is not None and across < x and across <= y:
                        found = False
                        break
                    if x <= y:
                        i += 1
                        if i == len(left_ranks):
                            break
                    else:
                        j += 1
            self._fits[key] = found
        return found

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...], tuple[tuple[int, int], ...]]:
        """The state after a byte, the paths that go on within a token, and those that may end one."""
        keep, ends, nodes = [], [], []
        for k, node in enumerate(self._states[state]):
            child = self._next.get(node << 8 | byte)
            if child is None:
                continue
            if self._inner[child]:
                keep.append(k), nodes.append(child)
            if self._token[child] >= 0:
                ends.append((k, self._token[child]))
        after = self._number.setdefault((*nodes, 0), len(self._states))
        if after == len(self._states):
            self._states.append((*nodes, 0))
        self._moves[state << 8 | byte] = found = after, tuple(keep), tuple(ends)
        return found

    def __call__(self, data: bytes) -> list[int]:
        if len(self._moves) >= KEPT_MOVES:
            self._clear()
        moves, fits = self._moves.get, self._fits.get
        out: list[int] = []
        state, last, waiting = 0, -1, [()]  # a path's tokens that are not out yet
        for byte in data:
            state, keep, ends = moves(state << 8 | byte) or self._move(state, byte)
            for k, token in ends:
                before = waiting[k][-1] if waiting[k] else last
                fit = fits(before << 32 | token)
                if self.fits(before, token) if fit is None else fit:
                    break
            else:
                raise ValueError(f"the vocabulary cannot spell byte {byte}")
            ended = (*waiting[k], token)
            if not keep:  # one path is left
                out += ended
                last, waiting = token, [()]
                continue
            waiting = [waiting[k] for k in keep]
            waiting.append(ended)
            if len(ended) > AHEAD:  # what all paths share goes out
                n = 0
                while n < AHEAD and all(len(w) > n and w[n] == ended[n] for w in waiting):
                    n += 1
                if n:
                    out += ended[:n]
                    last, waiting = ended[n - 1], [w[n:] for w in waiting]
        out += waiting[-1]
        if len(out) > 1 and data in self.ranks:  # a whole match that the merges would not reach
            return [self.ranks[data]]
        return out


class Utf8Stream:
    """An incremental UTF-8 state machine: whole characters out, the rest waits.

    States are the continuation bytes that are still to come, with the bounds that the first
    of them has."""

    def __init__(self) -> None:
        self.rest = b""

    @staticmethod
    def after_lead(b: int) -> tuple[int, int, int] | None:
        """(continuation bytes to come, least and greatest next byte), or None where no character starts."""
        if b < 0x80:
            return 0, 0, 0
        if 0xC2 <= b <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= b <= 0xEF:
            return 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
        if 0xF0 <= b <= 0xF4:
            return 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
        return None

    @classmethod
    def waits(cls, tail: bytes) -> bool:
        """Whether ``tail`` begins a character that it does not end."""
        state = cls.after_lead(tail[0])
        for b in tail[1:]:
            if state is None or not state[0] or not state[1] <= b <= state[2]:
                return False
            state = state[0] - 1, 0x80, 0xBF
        return state is not None and state[0] > 0

    def feed(self, portion: bytes) -> bytes:
        """The bytes up to the end of the last whole character."""
        data = self.rest + portion
        # only the last three bytes can begin a character without ending it
        cut = next((len(data) - k for k in range(min(3, len(data)), 0, -1) if self.waits(data[-k:])), len(data))
        self.rest = data[cut:]
        return data[:cut]

    def finish(self) -> bytes:
        out, self.rest = self.rest, b""
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}
_DECODERS: dict[str, Decoder] = {}


class Encoder:
    """Texts to ids by one vocabulary, kept by each worker."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, pre_tokenizers

        self.transducer = Transducer(read_ranks(path))
        # the same pattern engine, and so the same classes of characters, as tiktoken's
        self.split = pre_tokenizers.Split(Regex(pattern), "isolated").pre_tokenize_str
        self._fragments = FragmentEncoder(lambda texts: [self.text_ids(t) for t in texts], cut_before_last_space)

    @staticmethod
    def of(path: str, pattern: str) -> Encoder:
        if (path, pattern) not in _ENCODERS:
            _ENCODERS[path, pattern] = Encoder(path, pattern)
        return _ENCODERS[path, pattern]

    def text_ids(self, text: str) -> list[int]:
        matches = [text] if _PLAIN.fullmatch(text) else [m for m, _ in self.split(text)]
        return [i for m in matches for i in self.transducer(m.encode("utf-8", "surrogatepass"))]

    def encode(self, texts: list[bytes]):
        return self._fragments.encode(texts)


class Decoder:
    """Ids to bytes by one vocabulary, kept by each worker."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self._pool = np.frombuffer(b"".join(tokens), np.uint8)
        self._lens = np.array([len(t) for t in tokens])
        self._ends = np.cumsum(self._lens)

    @staticmethod
    def of(path: str) -> Decoder:
        if path not in _DECODERS:
            _DECODERS[path] = Decoder(path)
        return _DECODERS[path]

    def token_bytes(self, ids: np.ndarray) -> bytes:
        lens = self._lens[ids]
        upto = np.cumsum(lens)
        return self._pool[np.repeat(self._ends[ids] - upto, lens) + np.arange(int(upto[-1]) if len(ids) else 0)].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        stream = Utf8Stream()
        out = [stream.feed(self.token_bytes(ids[lo : lo + PORTION])) for lo in range(0, len(ids), PORTION)]
        return b"".join([*out, stream.finish()])


def encode(docs: DataFrame, ranks: str, pattern: str, doc_id: str | Column = "doc_id", text: str | Column = "text") -> DataFrame:
    """(doc_id, ids) of each whole text, by a file of ranks and the pattern whose matches are encoded by themselves."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))

    def run(batches):
        codec = Encoder.of(ranks, pattern)
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for lo, hi in batches_by_bytes(texts, SLICE):
                yield pa.record_batch([batch.column(0)[lo:hi], list_array(list(codec.encode(texts[lo:hi])))], names=["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """``rows`` with the column ``decoded``: the bytes of each row's ids (null for null)."""
    names = [c for c in rows.columns if c != "decoded"]
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        codec = Decoder.of(ranks)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                column = b.column(ids)
                flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                out = [codec.decode(flat[x:y]) if good else None for x, y, good in zip(at[:-1], at[1:], column.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=schema.names)

    return rows.select(*names).mapInArrow(run, schema)
