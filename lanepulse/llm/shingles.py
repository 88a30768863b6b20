"""Word shingle sets of whole texts, hashed and made distinct per text with array operations."""

from __future__ import annotations

import numpy as np

from .fragments import _LOWER, SpanHasher, mix64

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_HASH = SpanHasher()
_MULTIPLIERS = np.random.default_rng(77).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges): ascending distinct hashes of each text's ``k``-word shingles, and where
    each text's begin and end. Words are runs of bytes other than ASCII white space, A-Z
    lower-cased; a text of fewer than ``k`` words has its whole sequence as one shingle, a
    text without words none."""
    raw = b" ".join(texts) + b" "
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    word = _WORD[data]
    step = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h = _HASH(data, starts, ends)
    first = np.searchsorted(starts, begins)  # the first word of each text
    counts = np.diff(first)
    # whole-sequence hash of short texts, and shingles of the others
    size = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), size)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    width = np.minimum(counts[doc], k)
    value = np.zeros(len(doc), np.uint64)
    for j in range(k):
        here = np.minimum(at + j, len(h) - 1)
        value += np.where(j < width, h[here] * _MULTIPLIERS[j], np.uint64(0))
    value = mix64(value + width.astype(np.uint64))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))
