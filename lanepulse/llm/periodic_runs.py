"""Periodic runs of words, and texts without their repetitions.

A run is a longest stretch of words with smallest period ``q`` (words ``q`` apart are equal) whose
length is ``least_words`` and ``least_periods`` times ``q`` at least. Per document:

1. Every run of that kind consists of ``GRAM``-word windows that occur again in it. The text
   is cut into stretches of such windows (hashes tell them; equal hashes of unequal windows
   only lengthen a stretch), and stretches that are too short for a run hold none.
2. Ukkonen's algorithm builds the suffix trees of a stretch and of its reversal. The common
   extension of two positions, forwards and backwards, is the depth of the lowest common
   ancestor of two leaves: the least depth between them on the tree's Euler tour, found in
   constant time from minima of blocks and of their powers of two.
3. The longest Lyndon word at each position, in an order of words and in its reverse, ends
   at the next smaller suffix. Each such word is a candidate root of a run; it is
   extended in both directions, and what is long enough is a run. By the theorem of runs all runs
   have such a root.

All steps are linear in the stretch, or n log n. A document is the unit of work: no rows meet,
and nothing is shuffled.

Defined results: a null or empty text has no words and no runs; repeated rows give repeated
results; null ids are kept; an empty table gives no rows; further columns are ignored. Words are
separated by ASCII white space and compared byte by byte. Texts may be of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes
from .fragments import mix64
from .token_store import text_bytes

GRAM = 8
BLOCK = 16
SLICE = 4_000_000


class SuffixTree:
    """Ukkonen's suffix tree of ``word`` (integers from 1) and an end mark 0."""

    def __init__(self, word: list[int]):
        s = [*word, 0]
        n, base = len(s), max(s) + 1
        go: dict[int, int] = {}  # (node, first letter) to child
        first, last, depth, link, leaf = [0], [0], [0], [0], [-1]
        node = length = edge = pending = 0
        for i, c in enumerate(s):
            pending += 1
            linking = 0
            while pending:
                if not length:
                    edge = i
                key = node * base + s[edge]
                child = go.get(key)
                if child is None:
                    go[key] = len(first)
                    first.append(i), last.append(n), depth.append(0), link.append(0), leaf.append(i - pending + 1)
                    if linking:
                        link[linking], linking = node, 0
                else:
                    at = first[child]
                    span = (last[child] if last[child] <= i else i + 1) - at
                    if length >= span:
                        node, length, edge = child, length - span, edge + span
                        continue
                    if s[at + length] == c:
                        length += 1
                        if linking:
                            link[linking] = node
                        break
                    split = len(first)
                    first.append(at), last.append(at + length), depth.append(depth[node] + length), link.append(0), leaf.append(-1)
                    first.append(i), last.append(n), depth.append(0), link.append(0), leaf.append(i - pending + 1)
                    go[key], go[split * base + c] = split, split + 1
                    first[child] = at + length
                    go[split * base + s[at + length]] = child
                    if linking:
                        link[linking] = split
                    linking = split
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length, edge = length - 1, i - pending + 1
        self.n = n
        self.leaf = np.array(leaf)
        self.depth = np.where(self.leaf >= 0, n - self.leaf, np.array(depth))
        edges = np.fromiter(go.keys(), np.int64, len(go))
        self._child = np.fromiter(go.values(), np.int64, len(go))
        self._parent, self._letter = edges // base, edges % base

    def _ordered(self, key: np.ndarray) -> tuple[list[int], list[int]]:
        """Children of all nodes in one list, by node and ``key``, and where each node's begin."""
        children = self._child[np.lexsort((key, self._parent))]
        begin = np.zeros(len(self.leaf) + 1, np.int64)
        np.cumsum(np.bincount(self._parent, minlength=len(self.leaf)), out=begin[1:])
        return children.tolist(), begin.tolist()

    def tour(self) -> tuple[np.ndarray, np.ndarray]:
        """The Euler tour's depths, and each suffix's place on it."""
        children, begin = self._ordered(self._letter)
        at, path, tour = list(begin), [0], [0]
        while path:
            node = path[-1]
            k = at[node]
            if k < begin[node + 1]:
                at[node] = k + 1
                path.append(children[k])
                tour.append(children[k])
            else:
                path.pop()
                if path:
                    tour.append(path[-1])
        tour = np.array(tour)
        suffix = self.leaf[tour]
        places = np.zeros(self.n, np.int64)
        places[suffix[suffix >= 0]] = np.flatnonzero(suffix >= 0)
        return self.depth[tour], places

    def reverse_ranks(self) -> np.ndarray:
        """Ranks of the suffixes where words are ordered the other way (the end stays least)."""
        children, begin = self._ordered(np.where(self._letter == 0, 0, self._letter.max() + 1 - self._letter))
        stack, out, leaf = [0], [], self.leaf.tolist()
        while stack:
            node = stack.pop()
            if leaf[node] >= 0:
                out.append(leaf[node])
            else:
                stack += children[begin[node] : begin[node + 1]][::-1]
        ranks = np.zeros(self.n, np.int64)
        ranks[out] = np.arange(self.n)
        return ranks


class CommonExtension:
    """Lengths of the common beginnings of two suffixes, in constant time each."""

    def __init__(self, tree: SuffixTree):
        depths, self.places = tree.tour()
        blocks = np.full(-(-len(depths) // BLOCK) * BLOCK, np.iinfo(np.int64).max)
        blocks[: len(depths)] = depths
        blocks = blocks.reshape(-1, BLOCK)
        self._flat = blocks.reshape(-1)
        self._upto = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        self._from = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self._powers = [blocks.min(axis=1)]
        while 2 ** len(self._powers) <= len(blocks):
            half, low = 2 ** (len(self._powers) - 1), self._powers[-1]
            self._powers.append(np.minimum(low[:-half], low[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        p, q = self.places[i], self.places[j]
        p, q = np.minimum(p, q), np.maximum(p, q)
        a, b = p // BLOCK, q // BLOCK
        out = np.minimum(self._from[p], self._upto[q])
        wide = b - a > 1
        k = np.zeros(len(p), np.int64)
        k[wide] = np.log2((b - a - 1)[wide]).astype(np.int64)
        for level in np.unique(k[wide]).tolist():
            at = np.flatnonzero(wide & (k == level))
            least = self._powers[level]
            out[at] = np.minimum(out[at], np.minimum(least[a[at] + 1], least[b[at] - 2**level]))
        same = np.flatnonzero(a == b)
        if len(same):
            x, y, low = p[same], q[same], self._flat[p[same]].copy()
            for step in range(1, BLOCK):
                low = np.where(x + step <= y, np.minimum(low, self._flat[np.minimum(x + step, y)]), low)
            out[same] = low
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix but the empty one the next that is smaller: where its longest Lyndon word ends."""
    ranks, out, open_ = rank.tolist(), [0] * len(rank), []
    for i, r in enumerate(ranks):
        while open_ and ranks[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out[:-1])


def stretch_runs(word: np.ndarray, least_words: int, least_periods: int) -> np.ndarray:
    """(start, length, period) of the runs of an integer sequence, repeated where both orders find them."""
    letters = (np.unique(word, return_inverse=True)[1] + 1).tolist()
    n = len(letters)
    tree = SuffixTree(letters)
    ahead, behind = CommonExtension(tree), CommonExtension(SuffixTree(letters[::-1]))
    rank = np.zeros(n + 1, np.int64)
    rank[np.argsort(ahead.places)] = np.arange(n + 1)  # the tour meets the leaves in their order
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([next_smaller(rank), next_smaller(tree.reverse_ranks())])
    left, right = behind(n - i, n - j), ahead(i, j)
    start, length, period = i - left, j + right - i + left, j - i
    found = np.flatnonzero(length >= np.maximum(least_words, least_periods * period))
    return np.stack([start[found], length[found], period[found]], axis=1)


def _again(ids: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Whether the window at each place (all but the last ``GRAM - 1``) occurs again in its stretch."""
    h = np.zeros(len(ids) - GRAM + 1, np.uint64)
    mixed = mix64(ids.astype(np.uint64) + np.uint64(1))
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mixed[k : k + len(h)]
    _, back, count = np.unique(mix64(h) ^ mix64(stretch[: len(h)].astype(np.uint64)), return_inverse=True, return_counts=True)
    return count[back] > 1


def stretches(ids: np.ndarray, least_words: int) -> list[tuple[int, int]]:
    """Parts of a text that hold all its runs."""
    if len(ids) < max(least_words, GRAM):
        return []
    stretch, starts, ends = np.zeros(len(ids), np.int64), [], []
    for _ in range(2):  # again in the text, then again in the stretch
        again = _again(ids, stretch) & (stretch[: len(ids) - GRAM + 1] >= 0)
        edge = np.diff(np.concatenate([[0], again, [0]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + GRAM - 1
        long = ends - starts >= least_words
        starts, ends = starts[long], ends[long]
        stretch[:] = -1
        for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            stretch[a : b - GRAM + 1] = k
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def text_runs(words: list, least_words: int = 24, least_periods: int = 3) -> np.ndarray:
    """(start, length, period) of the runs of a list of words."""
    if least_words < 3 * GRAM - 5 or least_periods < 3:  # else a run may hold a window once
        raise ValueError(f"runs have {3 * GRAM - 5} words and three periods at least")
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(words) < least_words or len(number) == len(words):
        return np.zeros((0, 3), np.int64)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    parts = [stretch_runs(ids[a:b], least_words, least_periods) + [a, 0, 0] for a, b in stretches(ids, least_words)]
    runs = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *parts]), axis=0)  # roots of either order
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period, joined by blanks."""
    if not len(runs):
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, doc_id: str | Column = "doc_id", text: str | Column = "text", least_words: int = 24, least_periods: int = 3) -> DataFrame:
    """(doc_id, runs, collapsed): the runs of each whole text by start and period, numbered in words
    from 0, and the text without their repetitions."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    fields = ("start", "length", "period")

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for lo, hi in batches_by_bytes(texts, SLICE):
                found, collapsed = [], []
                for t in texts[lo:hi]:
                    words = t.split()
                    found.append(text_runs(words, least_words, least_periods))
                    collapsed.append(collapse(words, found[-1]))
                flat = np.concatenate(found)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, k], pa.int64()) for k in range(3)], names=fields)
                runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), structs)
                text = pa.array(collapsed, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], runs, text], names=["doc_id", "runs", "collapsed"])

    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def greatest_run(runs: Column) -> Column:
    """Of runs in order, the first with the greatest length over period (compared exactly), or null."""
    more = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    return F.aggregate(runs, F.get(runs, 0), more)
