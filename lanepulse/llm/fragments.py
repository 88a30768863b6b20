"""Exact tokenisation by memoised fragments.

A subword tokenizer first cuts a text into pre-tokens that no merge crosses. Where a cut
can be told from two neighbouring bytes, a text's ids are the ids of its fragments in a
row, so each distinct fragment is encoded once by the tokenizer and looked up afterwards.
The lookup is vectorised: all fragments of a batch are hashed with one cumulative sum.

Fragments are told apart by a 64-bit hash of bytes and length; a worker holds at most
``LIMIT`` of them, so a false match has a chance near 1e-13 for each new fragment.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from .common import batches_by_bytes

LIMIT = 1_000_000
CHUNK = 2_000_000
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(int(_RNG.integers(1, 2**62)) * 2 + 1)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHasher:
    """64-bit hashes of spans of a byte buffer from one cumulative sum."""

    def __init__(self):
        self._up = self._down = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self._up) <= len(data):
            n = max(len(data) + 1, CHUNK + 1)
            self._up, self._down = _powers(_STEP, n), _powers(_BACK, n)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self._up[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self._down[starts]
        return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x0A]] = True
#: First bytes of characters that may be white space (ASCII and the leads of the others), and
#: of the strings of special tokens, which end a text's run of white space as its end does.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[*range(9, 14), *range(28, 33), 0x3C, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def cut_before_last_space(data: np.ndarray) -> np.ndarray:
    """Cuts for pre-tokens of the form `` ?letters`` / white space: before a blank or newline
    that a non-space follows (the last of its run always starts a pre-token), after such a
    newline (it is a pre-token of its own), and between a letter or digit and a following
    stop or comma."""
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        cut[:-1] = _SPACE[data[:-1]] & ~_MAYBE_SPACE[data[1:]]
        cut[1:] |= (cut[:-1] & (data[:-1] == 0x0A)) | (_STOP[data[1:]] & _ALNUM[data[:-1]])
    return cut


def cut_before_space(data: np.ndarray) -> np.ndarray:
    """Cuts for tokenizers that drop white space: before any blank or newline, and between a
    letter or digit and a following stop or comma."""
    cut = _SPACE[data]
    if len(data) > 1:
        cut[1:] |= _STOP[data[1:]] & _ALNUM[data[:-1]]
    return cut


class FragmentEncoder:
    """Encodes UTF-8 texts by looking up the ids of their fragments."""

    def __init__(self, encode: Callable[[list[str]], list], cut: Callable[[np.ndarray], np.ndarray], lower: bool = False):
        self._encode, self._cut, self._lower = encode, cut, lower
        self._hash = SpanHasher()
        self._reset()

    def _reset(self) -> None:
        self._keys = np.zeros(0, np.uint64)
        self._off = np.zeros(0, np.int64)
        self._len = np.zeros(0, np.int64)
        self._pool = np.zeros(1 << 16, np.uint32)
        self._used = 0

    def _learn(self, keys: np.ndarray, fragments: list[str]) -> None:
        ids = self._encode(fragments)
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lens.sum())
        if self._used + total > len(self._pool):
            grown = np.zeros(max(2 * len(self._pool), self._used + total), np.uint32)
            grown[: self._used] = self._pool[: self._used]
            self._pool = grown
        self._pool[self._used : self._used + total] = np.fromiter((x for one in ids for x in one), np.uint32, total)
        at = np.searchsorted(self._keys, keys)
        self._keys = np.insert(self._keys, at, keys)
        self._off = np.insert(self._off, at, self._used + np.cumsum(lens) - lens)
        self._len = np.insert(self._len, at, lens)
        self._used += total

    def _chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b"".join(texts)
        bounds = np.cumsum([0, *map(len, texts)])
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(raw, np.uint8)
        if self._lower:
            data = _LOWER[data]
        cut = self._cut(data)
        cut[bounds[1:][bounds[1:] > 0] - 1] = False  # a text's last byte has no next byte
        cut[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        uniq, first, inverse = np.unique(self._hash(data, starts, ends), return_index=True, return_inverse=True)
        if len(self._keys) + len(uniq) > LIMIT:
            self._reset()
        at = np.minimum(np.searchsorted(self._keys, uniq), max(len(self._keys) - 1, 0))
        new = np.ones(len(uniq), bool) if not len(self._keys) else self._keys[at] != uniq
        if new.any():
            raw = data.tobytes()
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            self._learn(uniq[new], [raw[s:e].decode("utf-8", "surrogatepass") for s, e in spans])
            at = np.searchsorted(self._keys, uniq)
        at = at[inverse]
        lens = self._len[at]
        upto = np.cumsum(lens)
        ids = self._pool[np.repeat(self._off[at] - (upto - lens), lens) + np.arange(int(upto[-1]))]
        edges = np.append(0, upto)[np.searchsorted(starts, bounds)]
        return ids, np.diff(edges)

    def encode(self, texts: list[bytes]):
        """Yields the ids (uint32 array) of each text in turn."""
        for lo, hi in batches_by_bytes(texts, CHUNK):
            ids, counts = self._chunk(texts[lo:hi])
            at = 0
            for n in counts.tolist():
                yield ids[at : at + n]
                at += n


_HELD: dict[tuple, FragmentEncoder] = {}


def held(key: tuple, make: Callable[[], FragmentEncoder]) -> FragmentEncoder:
    """This worker's lookup table; one at a time is kept, so that a worker that serves several stages holds the fragments of one."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


#: One pre-token for certain: an optional blank and Latin letters.
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints,
    else the next letter from 256 on."""
    out, spare = {}, 256
    for b in range(256):
        prints = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        out[b], spare = (chr(b), spare) if prints else (chr(spare), spare + 1)
    return out


def library_encode(path: str, drop_space: bool) -> Callable[[list[str]], list]:
    """Encodes short strings with the ``tokenizers`` library. Strings that are one pre-token
    go straight to its BPE model, the others through its whole pipeline."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    model, letters = tok.model, _byte_letters()

    def encode(texts: list[str]) -> list:
        out: list = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if _PLAIN.fullmatch(t):
                word = t.lstrip(" ").lower() if drop_space else t
                out[i] = [x.id for x in model.tokenize(word.encode().decode("latin-1").translate(letters))]
            else:
                rest.append(i)
        for i, x in zip(rest, tok.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = x.ids
        return out

    return encode


def encoder(path: str, kind: str) -> FragmentEncoder:
    """This worker's encoder of a ``tokenizers`` file: kind ``byte`` keeps white space in
    pre-tokens, kind ``word`` drops it and lower-cases."""
    cut = {"byte": cut_before_last_space, "word": cut_before_space}[kind]
    return held((path, kind), lambda: FragmentEncoder(library_encode(path, kind == "word"), cut, lower=kind == "word"))
