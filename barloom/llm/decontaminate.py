"""Benchmark decontamination over item-sized SimHash windows.

Words are the runs of letters, digits, underscores and non-ASCII characters of the lower-cased text.
Benchmark items and text windows of the same number of words are compared by a SimHash over weighted five-word shingles
(a shingle weighs the bytes of its words). The fingerprint is cut into blocks; within ``radius`` bits at least one
block differs by ``radius // blocks`` bits at most, so looking up every such variant of every block finds all items
within the radius. Candidates are verified by the exact weighted Jaccard similarity of the shingles.

Windows are placed at every word. Before fingerprints are taken, windows are left out in which the shingles that occur in
any item of this size weigh less than ``similarity`` of the window: their similarity to such an item cannot reach it.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import read_table

SHINGLE = 5
SIMILARITY = 0.8
#: Shingle sets of similarity 0.8 differ in about 10 of 64 bits, with a deviation near 3.
RADIUS = 19
BLOCKS = 5
#: Items looked up in one pass over the texts; more items make more passes.
ITEMS_PER_PASS = 50_000
_PRIME = np.uint64(0x100000001B3)
_FIELDS = "item_id bigint, start_word int, n_words int, similarity double"


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as the longest text so far has bytes."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 1 << 16)
            base = 0x9E3779B97F4A7C15
            self.up, self.down = (
                np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, v, np.uint64))]) for v in (base, pow(base, -1, 1 << 64))
            )
        return self.up, self.down


_POWERS = _Powers()
_IN_WORD = np.array([c >= 0x80 or chr(c).isalnum() or c == 0x5F for c in range(256)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and byte length of every word of the lower-cased text, in order."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    flags = np.zeros(len(raw) + 2, np.int8)
    flags[1:-1] = _IN_WORD[raw]
    step = np.diff(flags)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _POWERS.to(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return _mix((sums[end] - sums[start]) * down[start]), end - start


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash and weight of every shingle, and the number of words; a shorter text is one shingle."""
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64), 0
    hashes, length = words(text)
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), 0
    size = min(SHINGLE, n)
    last = n - size + 1
    mixed, weight = hashes[:last].copy(), length[:last].astype(np.int64)
    for k in range(1, size):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _PRIME + hashes[k : k + last]
        weight += length[k : k + last]
    return _mix(mixed), weight, n


def _signed(hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
    return (2 * bits - 1) * weight[:, None]


def _packed(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _bag(hashes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(hashes, return_inverse=True)
    return keys, np.bincount(at, weights=weight).astype(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    every = int(a[1].sum() + b[1].sum()) - both
    return both / every if every else 0.0


class ItemIndex:
    """The items of one pass: shingle set, fingerprints and the block tables."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, blocks: int = BLOCKS, similarity: float = SIMILARITY):
        self.radius, self.similarity = radius, similarity
        kept = [(i, *shingles(t)) for i, t in items]
        kept = [k for k in kept if k[3]]
        self.ids = [k[0] for k in kept]
        self.words = np.array([k[3] for k in kept], np.int64)
        self.bags = [_bag(k[1], k[2]) for k in kept]
        self.known = np.unique(np.concatenate([k[1] for k in kept])) if kept else np.empty(0, np.uint64)
        self.holders = [[] for _ in self.known]  # of each known shingle, the word counts of the items that have it
        for k in kept:
            for at in np.searchsorted(self.known, np.unique(k[1])):
                self.holders[at].append(k[3])
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.known >> np.uint64(44)] = True
        self.prints = np.concatenate([_packed(_signed(h, w).sum(0)[None, :]) for _, h, w, _ in kept]) if kept else np.empty(0, np.uint64)
        edges = np.linspace(0, 64, blocks + 1).astype(int)
        self.blocks = []
        for low, high in itertools.pairwise(edges):
            width = int(high - low)
            values = ((self.prints >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
            order = np.argsort(values, kind="stable")
            first = np.searchsorted(values[order], np.arange((1 << width) + 1))
            flips = [sum(1 << b for b in c) for k in range(radius // blocks + 1) for c in itertools.combinations(range(width), k)]
            self.blocks.append((np.uint64(low), np.uint64((1 << width) - 1), order, first, np.array(flips, np.int64)))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, item) within the radius."""
        wins, items = [], []
        for low, mask, order, first, flips in self.blocks:
            value = ((prints >> low) & mask).astype(np.int64)[:, None] ^ flips[None, :]
            start, count = first[value], first[value + 1] - first[value]
            at = np.repeat(np.arange(value.size), count.ravel())
            within = np.arange(len(at)) - np.repeat(np.cumsum(count.ravel()) - count.ravel(), count.ravel())
            wins.append(at // len(flips))
            items.append(order[start.ravel()[at] + within])
        w, i = np.concatenate(wins), np.concatenate(items)
        close = np.bitwise_count(prints[w] ^ self.prints[i]) <= self.radius
        if not close.any():
            return w[:0], i[:0]
        pairs = np.unique(w[close] * len(self.prints) + i[close])
        return pairs // len(self.prints), pairs % len(self.prints)

    def matches(self, text: str | None) -> list[tuple]:
        """``item_id, start_word, n_words, similarity`` of the best window of every item that the text holds."""
        if not len(self.ids):
            return []
        hashes, weight, n = shingles(text)
        if not n:
            return []
        maybe = np.flatnonzero(self.sieve[hashes >> np.uint64(44)])
        if not len(maybe):
            return []
        at = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
        by_size: dict[int, list[int]] = defaultdict(list)
        for position, k in zip(maybe.tolist(), at.tolist()):
            if self.known[k] == hashes[position]:
                for size in set(self.holders[k]):
                    by_size[size].append(position)
        if not by_size:
            return []
        total = np.concatenate([[0], np.cumsum(weight)])
        best: dict[int, tuple] = {}
        for size, hits in by_size.items():
            known = np.zeros(len(weight) + 1, np.int64)
            known[np.array(hits) + 1] = weight[hits]
            shared = np.cumsum(known)
            span = min(max(size - SHINGLE + 1, 1), len(hashes))  # shingles in a window; a shorter text is one window
            inside = shared[span:] - shared[:-span]
            starts = np.flatnonzero((inside > 0) & (inside >= self.similarity * (total[span:] - total[:-span])))
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):
                if len(part):
                    self._verify(part, span, size, hashes, weight, n, best)
        return [(self.ids[i], start, length, value) for i, (value, start, length) in sorted(best.items())]

    def _verify(self, starts, span, size, hashes, weight, n, best) -> None:
        for at in range(0, len(starts), 512):
            some = starts[at : at + 512]
            low, high = some[0], some[-1] + span
            votes = np.vstack([np.zeros((1, 64), np.int64), np.cumsum(_signed(hashes[low:high], weight[low:high]), axis=0)])
            wins, items = self.within(_packed(votes[some - low + span] - votes[some - low]))
            right = self.words[items] == size
            by_window: dict[int, list[int]] = defaultdict(list)
            for w, i in zip(wins[right], items[right]):
                by_window[int(w)].append(int(i))
            for w, close in by_window.items():
                start = int(some[w])
                bag = _bag(hashes[start : start + span], weight[start : start + span])
                for i in close:
                    value = weighted_jaccard(bag, self.bags[i])
                    if value >= self.similarity and (i not in best or value > best[i][0]):
                        best[i] = (value, start, min(size, n))


def passes(benchmark: DataFrame, per_pass: int = ITEMS_PER_PASS, **settings):
    """Item indexes of bounded size that together hold the whole benchmark; a repeated item is held once."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct().orderBy("item_id", "text")
    held: list[tuple[int, str]] = []
    for r in items.toLocalIterator():
        held.append((r["item_id"], r["text"]))
        if len(held) == per_pass:
            yield ItemIndex(held, **settings)
            held = []
    if held:
        yield ItemIndex(held, **settings)


def matches(docs: DataFrame, benchmark: DataFrame, per_pass: int = ITEMS_PER_PASS, **settings) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, similarity`` for every document and item it holds (the best window).

    An item of one to four words is one shingle of that size and matches only a text of as many words, never inside a longer one.

    Items or texts that are null or have no word match nothing. Items with a null id are matched with a null id. Texts
    shorter than an item are compared as a whole. Repeated rows of ``docs`` repeat their matches. Empty tables give an
    empty result; other columns are not read. Ties between windows go to the first.
    """
    spark, kept = docs.sparkSession, docs.select("doc_id", "text").where("text is not null")
    kind = kept.schema["doc_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"doc_id {kind}, {_FIELDS}")
    for index in passes(benchmark, per_pass, **settings):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                out = [(d, *m) for d, t in zip(b["doc_id"], b["text"]) for m in shared.value.matches(t)]
                if out:
                    frame = pd.DataFrame(out, columns=["doc_id", "item_id", "start_word", "n_words", "similarity"])
                    yield frame.astype({"item_id": "Int64"})

        found = found.union(kept.mapInPandas(run, f"doc_id {kind}, {_FIELDS}"))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, per_pass: int = ITEMS_PER_PASS, **settings) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item. Null and empty texts stay."""
    for index in passes(benchmark, per_pass, **settings):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @F.pandas_udf("boolean")
        def holds_item(text: pd.Series) -> pd.Series:
            return pd.Series([bool(shared.value.matches(t)) for t in text], dtype=bool)

        docs = docs.where(~holds_item(docs["text"]))
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontamination": op6_decontamination}
ORACLES: dict[str, str] = {}
