"""Token counts of a BPE vocabulary by rank-synchronous array merging.

A text is cut into pre-tokens that no merge can cross. All unseen pre-tokens of a batch are laid out as one ragged array of
symbols; in every round each sequence applies its lowest-ranked pair, all sequences at once, until none has a pair left.
The surviving symbols are counted, with one token per UTF-8 byte of a character that the vocabulary does not hold.

A pre-token of more than ``LONG`` characters (a page without spaces, base64) would need as many rounds as it has pairs of
different ranks. There a round applies every pair that has the lowest rank within ``reach`` symbols on both sides. No earlier
merge can touch such a pair: what an earlier merge makes is a piece, no piece is longer than ``reach`` characters, and it
would have to start from a pair of lower rank.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import id_text, read_table

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
LIMIT = 4096
NO_RANK = np.iinfo(np.int64).max
LONG = 256


@dataclass
class Vocabulary:
    """Symbols are numbered: pieces by their id, characters without a piece from ``len(scores)`` on."""

    pieces: list[str]
    scores: list[float]

    def __post_init__(self):
        at = {p: k for k, p in enumerate(self.pieces) if p}
        self.chars = {p: k for p, k in at.items() if len(p) == 1}
        order = sorted(at.values(), key=lambda k: -self.scores[k])
        rank, tied = {}, set()
        for k in order:
            last = rank.get("last")
            if last is not None and self.scores[last] == self.scores[k]:
                tied.add(rank[last])
                rank[k] = rank[last]
            else:
                rank[k] = 0 if last is None else rank[last] + 1
            rank["last"] = k
        del rank["last"]
        pairs = {}
        careful = set()
        for piece, k in at.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                for part in (left, right):  # merging ``part`` late could make a pair that ranks before it
                    if len(part) > 1 and part in at and rank[at[part]] > rank[k]:
                        careful.add(at[part])
                if self._symbol(left, at) is not None and self._symbol(right, at) is not None:
                    pairs[self._symbol(left, at), self._symbol(right, at)] = k
        self.width = len(self.pieces) + 1
        self.reach = max(map(len, at), default=1)
        keys = np.array([a * self.width + b for a, b in pairs], np.int64)
        sort = np.argsort(keys)
        self.keys, self.made = keys[sort], np.array(list(pairs.values()), np.int64)[sort]
        self.ranks = np.array([rank[k] for k in self.made], np.int64)
        self.single = np.zeros(self.width, bool)  # of these merges a round applies the first only
        self.single[[k for k in at.values() if k in careful or rank[k] in tied]] = True
        inner = {a + b for p in at for a, b in zip(p, p[1:])}
        free = [c for c in "\n\r\t" if not any(c in x for x in inner)]
        if any(x[1] == SPACE and x[0] != SPACE for x in inner):
            raise ValueError("pieces with an inner space: pre-tokens cannot be cut at spaces")
        loose = "".join(map(re.escape, free))
        self.pattern = re.compile(f"[{loose}]|{SPACE}*[^{SPACE}{loose}]+|{SPACE}+")

    @staticmethod
    def _symbol(part: str, at: dict[str, int]) -> int | None:
        return at.get(part)

    def count(self, tokens: list[str]) -> np.ndarray:
        """Number of surviving symbols of every pre-token."""
        long = np.fromiter((len(t) > LONG for t in tokens), bool, len(tokens))
        if not long.any():
            return self._merge(tokens, self._lowest_of_sequences)
        out = np.empty(len(tokens), np.int64)
        for at, chosen in ((~long, self._lowest_of_sequences), (long, self._lowest_nearby)):
            if at.any():
                out[at] = self._merge([tokens[k] for k in np.flatnonzero(at)], chosen)
        return out

    def _merge(self, tokens: list[str], chosen) -> np.ndarray:
        text = "".join(tokens)
        unknown = len(self.pieces)
        symbols = np.fromiter((self.chars.get(c, unknown) for c in text), np.int64, len(text))
        owner = np.repeat(np.arange(len(tokens)), np.fromiter(map(len, tokens), np.int64, len(tokens)))
        rest = np.zeros(len(tokens), np.int64)
        lost = np.flatnonzero(symbols == unknown)
        if len(lost):  # bytes beyond the one symbol that is counted
            np.add.at(rest, owner[lost], [len(text[k].encode()) - 1 for k in lost])
        done = np.zeros(len(tokens), np.int64)
        while len(symbols):
            here = owner[1:] == owner[:-1]
            pair = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.append(np.where(here & (self.keys[at] == pair), self.ranks[at], NO_RANK), NO_RANK)  # a last slot has no pair
            starts = np.flatnonzero(np.concatenate([[True], ~here]))
            size = np.diff(np.append(starts, len(symbols)))
            best = np.minimum.reduceat(rank, starts)
            live = best < NO_RANK
            done[owner[starts[~live]]] = size[~live]
            where = chosen(rank, best, size, symbols, owner, at)
            symbols[where] = self.made[at[where]]
            keep = np.repeat(live, size)
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return done + rest

    def _lowest_of_sequences(self, rank, best, size, symbols, owner, at) -> np.ndarray:
        hit = rank == np.repeat(np.where(best < NO_RANK, best, -1), size)
        return self._first_of_runs(np.flatnonzero(hit), symbols, owner, at)

    def _lowest_nearby(self, rank, best, size, symbols, owner, at) -> np.ndarray:
        """Pairs that no pair within ``reach`` goes before: none of lower rank and, for a careful one, none of the same rank to
        its left that could set off further merges of lower rank."""
        n = len(rank)
        free = (rank < NO_RANK) & (rank <= self._least_before(rank)) & (rank <= self._least_before(rank[::-1])[::-1])
        some = np.flatnonzero(free & np.append(self.single[self.made[at]], False))
        if len(some):
            calm = free.copy()
            calm[some] = self._is_calm(some, rank, symbols, owner, at)
            stirring = self._least_before(np.where(calm, NO_RANK, rank))
            free[some] &= rank[some] < stirring[some]
        # pairs of equal symbols overlap: a run of them is taken from its start on, every second one
        same = np.concatenate([[False], (rank[1:] == rank[:-1]) & (rank[1:] < NO_RANK)])
        begin = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        blocked = np.concatenate([[0], np.cumsum(~free)])
        whole = blocked[1:] == blocked[begin]  # no blocked pair of the run up to here
        return np.flatnonzero(free & whole & ((np.arange(n) - begin) % 2 == 0))

    def _least_before(self, rank: np.ndarray) -> np.ndarray:
        """Least of the ``reach`` ranks before each place."""
        low, span = np.concatenate([np.full(self.reach, NO_RANK), rank]), 1  # low[i]: least of ``span`` from i on
        while span * 2 <= self.reach:
            low, span = np.minimum(low[:-span], low[span:]), span * 2
        return np.minimum(low[: len(rank)], low[self.reach - span : self.reach - span + len(rank)])

    def _is_calm(self, where: np.ndarray, rank, symbols, owner, at) -> np.ndarray:
        """Whether the merges at ``where`` make no pair of as low a rank with a neighbour, be it merged at the same time or not."""
        made = np.append(self.made[at], 0)
        n, own, limit = len(symbols), made[where], rank[where]

        def ranks(left, right, known):
            pair = np.where(known, left * self.width + right, -1)
            k = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            return np.where(self.keys[k] == pair, self.ranks[k], NO_RANK)

        def beside(k):
            inside = (k >= 0) & (k < n)
            k = np.where(inside, k, where)
            return k, inside & (owner[k] == owner[where])

        calm = np.ones(len(where), bool)
        before, known = beside(where - 1)
        calm &= ranks(symbols[before], own, known) > limit
        after, known = beside(where + 2)
        calm &= ranks(own, symbols[after], known) > limit
        for k, left in ((where - 2, True), (where + 2, False)):
            k, known = beside(k)
            known &= rank[k] == limit
            calm &= ranks(made[k] if left else own, own if left else made[k], known) > limit
        return calm

    def _first_of_runs(self, where: np.ndarray, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of overlapping hits every second is left out; of a careful merge only the first of a sequence is taken."""
        if not len(where):
            return where
        run = np.concatenate([[True], np.diff(where) > 1])
        since = np.arange(len(where)) - np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
        taken = since % 2 == 0
        careful = self.single[self.made[at[where]]]
        first = np.concatenate([[True], owner[where[1:]] != owner[where[:-1]]])
        return where[(taken & ~careful) | (first & careful)]


class Counter:
    """Counts texts; counts of pre-tokens seen before are remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = 1_000_000):
        self.vocabulary, self.remembered, self.seen = vocabulary, remembered, {}

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.vocabulary.pattern.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.seen) > self.remembered:
            self.seen.clear()
        fresh = list({p for part in parts for p in part if p not in self.seen})
        for at in range(0, len(fresh), 100_000):
            some = fresh[at : at + 100_000]
            self.seen.update(zip(some, self.vocabulary.count(some).tolist()))
        return [sum(map(self.seen.__getitem__, part)) for part in parts]


def load(path: str) -> Vocabulary:
    """Pieces that merges can make, and their scores; other ids (bytes, control, unknown) have an empty piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.normalize("a  béﬁ ") != f"{SPACE}a{SPACE}{SPACE}béﬁ{SPACE}" or not model.is_byte(model.piece_to_id("<0x00>")):
        raise ValueError("only models with plain text normalisation and byte fallback are supported")
    ids = range(model.vocab_size())
    plain = [not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k)) for k in ids]
    return Vocabulary([model.id_to_piece(k) if plain[k] else "" for k in ids], [model.get_score(k) for k in ids])


def token_counts(docs: DataFrame, vocabulary: Vocabulary, limit: int = LIMIT, texts_at_once: int = 500) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; null and empty texts have 0 tokens. Other columns are not read."""
    kept = id_text(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        counter = Counter(shared.value)
        for b in batches:
            for at in range(0, len(b), texts_at_once):
                part = b.iloc[at : at + texts_at_once]
                n = counter.count(part["text"].tolist())
                sizes = [len(t.encode()) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": sizes, "n_tokens": n, "over_limit": [k > limit for k in n]})

    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInPandas(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), load(public_tokenizers.path(MODEL)))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict[str, str] = {}
