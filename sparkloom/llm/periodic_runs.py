"""Periodic runs of words, found with suffix trees and Lyndon roots.

A run is a stretch of words of smallest period q that no neighbour extends keeping
q, of at least LEAST words and TIMES periods. Every run has a Lyndon root: the
longest Lyndon word that starts at one of its places, in the order of words or in
its reverse. So one candidate per place and order is enough, extended both ways by
common-extension queries. Per text:

1. A run of period q and length L holds L - q - 2 neighbouring places whose next
   three words come again within q words. Stretches of such places are narrowed
   until nothing changes; what they leave out can hold no run. Only hashes of
   words are compared here, which lets too much through at worst.
2. In what is left, words become numbers (by their bytes). Ukkonen's construction
   makes the suffix trees of the stretch and of its reversal; an Euler tour of each
   with least depths by block answers the lowest common ancestor, and so the
   longest common extension of two places, in constant time, for all candidates of
   a stretch at once.
3. The order of the tree's leaves gives the next smaller suffix of every place and
   so its longest Lyndon word, in both orders. Each such word of length p is
   extended to the right and to the left; it is a run where that gives enough
   words. Runs that are found from several roots count once.

A text is worked on by one task: memory grows with the longest periodic stretch of
one text, about 200 bytes a word of it.

Defined results: a null text has no words. Repeated rows are texts of their own,
and ids may be null (those are not made periodic by :func:`planted`). Extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, slices, table

#: Fewest words of a run, and fewest periods.
LEAST, TIMES = 6, 4
#: Tour entries of a block, for least depths.
BLOCK = 64
#: Children of a node that are searched one by one; more get a table.
FEW = 12
#: Times that stretches are narrowed; more would only leave out more.
NARROWINGS = 40


class SuffixTree:
    """Ukkonen's suffix tree of words 1, 2, ... closed by 0, kept in flat arrays.

    Node 0 is the root. Children are chained; a node that gets more than FEW of
    them has a table instead.
    """

    def __init__(self, words: list[int]) -> None:
        s = self.words = array("i", words)
        s.append(0)
        n = len(s)
        none = array("i", [-1]) * (2 * n)
        start, link = array("i", bytes(8 * n)), array("i", bytes(8 * n))
        stop, head, after = array("i", [n]) * (2 * n), none[:], none
        stop[0] = 0
        wide: dict[int, dict[int, int]] = {0: {}}
        made, node, edge, length, left = 1, 0, 0, 0, 0
        for i in range(n):
            c, unlinked = s[i], 0
            left += 1
            while left:
                if not length:
                    edge = i
                key, last, seen = s[edge], -1, 0
                table = wide.get(node)
                if table is not None:
                    child = table.get(key, -1)
                else:
                    child = head[node]
                    while child >= 0 and s[start[child]] != key:
                        last, child, seen = child, after[child], seen + 1
                if child < 0:
                    start[made] = i
                    if table is not None:
                        table[key] = made
                    else:
                        after[made] = head[node]
                        head[node] = made
                        if seen >= FEW:
                            wide[node] = {s[start[x]]: x for x in self._chain(head, after, node)}
                    made += 1
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    begin = start[child]
                    reach = min(stop[child], i + 1) - begin
                    if length >= reach:
                        node, edge, length = child, edge + reach, length - reach
                        continue
                    if s[begin + length] == c:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    # a node within the edge: the old child and a new leaf hang from it
                    new, leaf = made, made + 1
                    made += 2
                    start[new], stop[new] = begin, begin + length
                    head[new], after[new] = leaf, after[child]
                    start[leaf], after[leaf] = i, child
                    start[child], after[child] = begin + length, -1
                    if table is not None:
                        table[key] = new
                    elif last < 0:
                        head[node] = new
                    else:
                        after[last] = new
                    if unlinked:
                        link[unlinked] = new
                    unlinked = new
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length, edge = length - 1, i - left + 1
        self.start, self.stop, self.head, self.after, self.wide = start, stop, head, after, wide

    @staticmethod
    def _chain(head: array, after: array, node: int) -> list[int]:
        out, child = [], head[node]
        while child >= 0:
            out.append(child)
            child = after[child]
        return out

    def walk(self, falling: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The tour of the tree: rank of every suffix among the leaves, and between
        each two leaves the depth (in words) of the node that the tour returns to,
        which is their lowest common ancestor. Children go by their first words, or
        in reverse if ``falling``; the closing word comes first in both orders."""
        s, start, stop, head, after, wide = self.words, self.start, self.stop, self.head, self.after, self.wide
        n = len(s)
        rank, tour = array("i", bytes(4 * n)), array("i")
        waiting, depths = [], []  # nodes still to be visited, and the depths of their parents
        turn = tour.append
        node, own, leaves = 0, 0, 0
        while True:
            first = head[node]
            if first < 0 and node:
                rank[start[node] - own] = leaves  # own: depth of the leaf's parent
                leaves += 1
            else:
                own += stop[node] - start[node]
                second = after[first] if first >= 0 else -1
                if node in wide or after[second] >= 0:
                    table = wide.get(node)
                    children = list(table.values()) if table is not None else self._chain(head, after, node)
                    children.sort(key=(lambda x: s[start[x]] or 1 << 31) if falling else (lambda x: -s[start[x]]))
                    node = children.pop()
                    waiting += children
                    depths += [own] * len(children)
                    continue
                a, b = s[start[first]], s[start[second]]
                if (b < a) != (falling and a > 0 and b > 0):
                    first, second = second, first
                if head[first] >= 0:
                    waiting.append(second)
                    depths.append(own)
                    node = first
                    continue
                rank[start[first] - own] = leaves
                leaves += 1
                turn(own)
                node = second
                continue
            if not waiting:
                return np.frombuffer(rank, dtype=np.int32), np.frombuffer(tour, dtype=np.int32)
            node, own = waiting.pop(), depths.pop()
            turn(own)


class Extensions:
    """Longest common extensions of two places of a text: the least depth on the
    tour between their leaves, from least depths within and over blocks."""

    def __init__(self, rank: np.ndarray, tour: np.ndarray) -> None:
        self.rank = rank
        blocks = -(-len(tour) // BLOCK)
        depths = np.full(blocks * BLOCK, np.iinfo(np.int32).max, dtype=np.int32)
        depths[: len(tour)] = tour
        self.depths, by_block = depths, depths.reshape(blocks, BLOCK)
        self.before = np.minimum.accumulate(by_block, axis=1).ravel()
        self.behind = np.minimum.accumulate(by_block[:, ::-1], axis=1)[:, ::-1].ravel()
        levels = [by_block.min(axis=1)]
        while 2 << (len(levels) - 1) <= blocks:
            half, held = 1 << (len(levels) - 1), levels[-1]
            levels.append(np.minimum(held[: len(held) - half], held[half:]))
        self.levels = levels

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = self.rank[a], self.rank[b]
        low, high = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64) - 1
        out = np.minimum(self.behind[low], self.before[high])
        first, last = low // BLOCK + 1, high // BLOCK  # whole blocks between: first .. last - 1
        for level, held in enumerate(self.levels):
            of = np.flatnonzero((last - first >= 1 << level) & (last - first < 2 << level))
            if len(of):
                ends = np.minimum(held[first[of]], held[last[of] - (1 << level)])
                out[of] = np.minimum(out[of], ends)
        inside = np.flatnonzero(first > last)
        for k in range(0, len(inside), 1 << 14):
            of = inside[k : k + (1 << 14)]
            at = low[of, None] + np.arange(BLOCK)
            at = np.minimum(at, high[of, None])
            out[of] = self.depths[at].min(axis=1)
        return out.astype(np.int64)


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For every suffix the next one behind it of smaller rank; the last has none."""
    out = [0] * len(rank)
    for i in range(len(rank) - 2, -1, -1):
        j, own = i + 1, rank[i]
        while rank[j] > own:
            j = out[j]
        out[i] = j
    return np.array(out[:-1], dtype=np.int64)


def runs_in(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in a sequence of numbers from 1 on."""
    n = len(words)
    tree = SuffixTree(words)
    rank, tour = tree.walk()
    other, _ = tree.walk(falling=True)
    del tree
    forward, backward = Extensions(rank, tour), Extensions(*SuffixTree(words[::-1]).walk())
    found = set()
    for order in (rank, other):
        i, j = np.arange(n), _next_smaller(order.tolist())
        period = j - i
        begin, end = i - backward(n - i, n - j), j + forward(i, j)
        good = end - begin >= np.maximum(least, times * period)
        found.update(zip(begin[good].tolist(), (end - begin)[good].tolist(), period[good].tolist()))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Ranges of words outside of which no run lies."""
    n = len(words)
    # places that the shortest possible run has; without any, nothing can be left out
    fewest = min(max(least, times * q) - q - 2 for q in range(1, least + 1))
    if n < max(least, times):
        return []
    if fewest < 1 or times < 2:
        return [(0, n)]
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    three = h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ h[2:] * np.uint64(0x165667B19E3779F9)
    order = np.argsort(three, kind="stable")
    ordered = three[order]
    again = np.flatnonzero(ordered[1:] == ordered[:-1])
    if len(again) < fewest:
        return []
    away = np.full(n, n, dtype=np.int64)
    away[order[again]] = order[again + 1] - order[again]
    near = np.flatnonzero(away < n)
    out: list[tuple[int, int]] = []
    for narrowing in range(NARROWINGS):
        if not len(near):
            return []
        breaks = np.flatnonzero(np.diff(near) > 1)
        first, last = near[np.append(0, breaks + 1)], near[np.append(breaks, len(near) - 1)]
        size = last - first + 1
        reach = (size + 2) // (times - 1)  # no longer period fits
        keep = np.repeat(size >= fewest, size) & (away[near] <= np.repeat(reach, size))
        if keep.all() or narrowing == NARROWINGS - 1:
            break
        near = near[keep]
    # a run ends at most reach + 2 words behind its last place; one more on each side shows where it ends
    for b, e in zip(np.maximum(first - 1, 0).tolist(), np.minimum(last + reach + 4, n).tolist()):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def text_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start, then period."""
    out = []
    for b, e in stretches(words, least, times):
        number: dict[bytes, int] = {}
        numbered = [number.setdefault(w, len(number) + 1) for w in words[b:e]]
        out += [(b + start, length, period) for start, length, period in runs_in(numbered, least, times)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, start (word number), length and period of every run of every text."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [(k, *r) for k, text in enumerate(as_bytes(batch.column("text"))) for r in text_runs(text.split(), least, times)]
            of, *values = list(zip(*rows)) or [()] * 4
            ids = batch.column("doc_id").take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, pa.int64()) for v in values)], ["doc_id", "start", "length", "period"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(found, f"doc_id {kind}, start long, length long, period long")


def planted(words: list[bytes], h: int | None) -> list[bytes]:
    """Words of every tenth text (by the hash h of its id) repeated from a place on."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that a run has behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


_DIGEST = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _digest(words: list[bytes]) -> tuple:
    runs = text_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join(f"{start},{length},{period}\n" for start, length, period in runs).encode()
    own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *own, hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()


def run_digests(docs: DataFrame, periodic: bool = False) -> DataFrame:
    """Per document: the number of runs, the one of greatest length / period, and
    digests of all runs and of the text without what they repeat. If ``periodic``,
    texts go through :func:`planted` first."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes = batch.column("h").to_pylist()
            rows = [_digest(planted(text.split(), h)) for text, h in zip(as_bytes(batch.column("text")), hashes)]
            columns = [pa.array(v, pa.string() if k > 4 else pa.int64()) for k, v in enumerate(zip(*rows))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], _DIGEST)

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in _DIGEST[1:6])
    h = F.crc32(F.col("doc_id").cast("string").cast("binary")) if periodic else F.lit(None).cast("long")
    return docs.select("doc_id", "text", h.alias("h")).mapInArrow(digests, f"doc_id {kind}, {numbers}, runs_sha256 string, collapsed_sha256 string")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"), periodic=True)
