"""Language identification by words first, character n-grams for the rest.

A word seen in training scores its log frequency in every language. An unseen word falls back to its character n-grams:
the longest order of which any is known gives the score (the mean over its known n-grams), then the next shorter one.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import read_table, staged

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
#: Training documents per language, about (a hash threshold): the model's only sample. All of its words and n-grams are kept.
TRAIN_DOCS = 1_000
UNDEFINED = "und"


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode category L), lower-cased; numbers that are no digits, such as fractions, part them."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return "".join(c if c.isalpha() else " " for w in found for c in (*w, " ")).split()


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, per_language: int = TRAIN_DOCS) -> DataFrame:
    """``text, lang`` of about ``per_language`` rows per language that are not held out, chosen by a hash of the row."""
    usable = docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    usable = usable.where(~held_out("doc_id"))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return usable.select("text", "lang")
    limits = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n) * 1_000_000)])
    return usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(limits, F.col("lang"))).select("text", "lang")


def term_counts(rows: DataFrame) -> DataFrame:
    """``lang, kind, term, n`` over training rows; kind 0 are words, kind k the n-grams of k characters."""

    def run(batches):
        for b in batches:
            for lang, texts in b.groupby("lang", sort=False)["text"]:
                words = Counter()
                for t in texts:
                    words.update(words_of(t))
                counts = {(0, w): n for w, n in words.items()}
                for w, n in words.items():
                    for order in ORDERS:
                        for g in grams(w, order):
                            counts[order, g] = counts.get((order, g), 0) + n
                yield pd.DataFrame([(lang, k, t, n) for (k, t), n in counts.items()], columns=["lang", "kind", "term", "n"])

    return rows.mapInPandas(run, "lang string, kind int, term string, n bigint").groupBy("lang", "kind", "term").agg(F.sum("n").alias("n"))


class _Seen(dict):
    """Word -> row of ``table`` with its scores; bounded, emptied between texts when full."""

    def __init__(self, model: Model, cells: int = 4_000_000):
        super().__init__()
        self.model, self.limit = model, max(cells // max(len(model.langs), 1), 1)
        self.table = np.empty((1024, len(model.langs)), np.float32)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[at] = self.model.word(word)
        return at

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Model:
    """Log frequencies per language: one row of ``weights`` per known term of each kind."""

    def __init__(self, langs: list[str], counted: dict[int, dict[str, list[int]] | tuple[list[str], np.ndarray]], smooth: float = 0.5):
        """``counted``: per kind and term the counts in the order of ``langs``, as a dict or as terms and a table."""
        self.langs = langs
        self.rows: dict[int, dict[str, int]] = {}
        self.weights: dict[int, np.ndarray] = {}
        for kind, terms in counted.items():
            terms, table = terms if isinstance(terms, tuple) else (terms, list(terms.values()))
            table = np.asarray(table, float)
            self.rows[kind] = {t: k for k, t in enumerate(terms)}
            self.weights[kind] = np.log((table + smooth) / (table.sum(0) + smooth * len(table))).astype(np.float32)
        self.seen = _Seen(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "seen"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.seen = _Seen(self)

    def word(self, word: str) -> np.ndarray:
        at = self.rows.get(0, {}).get(word)
        if at is not None:
            return self.weights[0][at]
        for order in ORDERS:
            known = [k for g in grams(word, order) if (k := self.rows.get(order, {}).get(g)) is not None]
            if known:
                return self.weights[order].take(known, axis=0).sum(0) / len(known)
        return np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its score: the share of the best language in the softmax of the scores over the root of the word count."""
        words = words_of(text or "")
        if not words or not self.langs:
            return UNDEFINED, 0.0
        rows = self.seen.rows(words)
        total = self.seen.table[rows].sum(0, dtype=float) / np.sqrt(len(words))
        share = np.exp(total - total.max())
        best = int(share.argmax())
        return self.langs[best], float(share[best] / share.sum())


def fit(docs: DataFrame, per_language: int = TRAIN_DOCS) -> Model:
    """Learn from ``text`` and ``lang``: every word and n-gram of the sample, with its counts in all languages.

    What reaches the driver is bounded by the sample: ``per_language`` documents of each language.
    """
    counts = staged(term_counts(training_rows(docs, per_language)), "terms")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return Model([], {})
    by_lang = F.array(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)) for x in langs])
    got = counts.groupBy("kind", "term").agg(by_lang.alias("n")).toArrow()
    kinds, names, table = got["kind"].to_numpy(), got["term"], got["n"].combine_chunks().flatten().to_numpy().reshape(-1, max(len(langs), 1))
    return Model(langs, {k: (names.filter(kinds == k).to_pylist(), table[kinds == k]) for k in sorted(set(kinds.tolist()))})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus ``lang_pred, score`` (same names are replaced), one row per row; other columns are untouched.

    A null text or one without a letter gives ``und`` and 0, as does everything if nothing could be learned. Ties go to the
    language first in order. Whole texts are scored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"]).astype({"score": float})

    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    judged = docs.select(*names, judge("text").alias("_judged"))
    return judged.select(*names, F.col("_judged.lang_pred").alias("lang_pred"), F.col("_judged.score").alias("score"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    judged = identify(docs.select("doc_id", "text"), fit(docs))
    return judged.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
