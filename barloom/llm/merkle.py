"""Document fingerprints: a Merkle tree over sections, paragraphs and short word runs.

A text is cut into sections (after blank lines), sections into paragraphs (lines), paragraphs into leaves (at most eight
words, never past a sentence end); the leaves of a text together are the text. Every node hashes its children. The
fingerprint is the root (64 hex digits), a colon, and the leaf hashes (8 hex digits each) with ``.`` between paragraphs and
``/`` between sections: equal roots mean equal texts, and differing branches say where an edit lies.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b, sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import id_text, read_table

LEAF = re.compile(r"(?:\s*+\S++(?<![.!?])){0,7}\s*+\S++\s*+")
LEAF_HEX = 8
FIELDS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def leaves(paragraph: str) -> list[bytes]:
    """Hashes of the leaves of one line."""
    return [blake2b(x.encode(), digest_size=16).digest() for x in LEAF.findall(paragraph) or [paragraph]]


class Tree:
    """Sections of paragraphs of leaf hashes, and the root. ``known`` holds paragraphs hashed before."""

    def __init__(self, text: str | None, known: dict[str, list[bytes]] | None = None):
        self.paragraphs: dict[str, list[bytes]] = {}
        self.sections: list[list[list[bytes]]] = []
        section: list[list[bytes]] = []
        for line in re.findall(r"[^\n]*\n|[^\n]+", text or ""):
            got = self.paragraphs.get(line) or (known or {}).get(line) or leaves(line)
            self.paragraphs[line] = got
            section.append(got)
            if not line.strip():
                self.sections.append(section)
                section = []
        if section:
            self.sections.append(section)
        self.root = _node(b"document", [_node(b"section", [_node(b"paragraph", p) for p in s]) for s in self.sections])

    def fingerprint(self) -> str:
        body = "/".join(".".join("".join(x[: LEAF_HEX // 2].hex() for x in p) for p in s) for s in self.sections)
        return f"{self.root.hex()}:{body}"


def _node(kind: bytes, children: list[bytes]) -> bytes:
    return blake2b(b"".join(children), digest_size=32, person=kind[:16]).digest()


def _branches(fingerprint: str) -> list[list[list[str]]]:
    body = fingerprint.partition(":")[2]
    cut = lambda p: [p[k : k + LEAF_HEX] for k in range(0, len(p), LEAF_HEX)]
    return [[cut(p) for p in s.split(".")] for s in body.split("/")] if body else []


def likeness(a: str, b: str) -> float:
    """Shared leaves of two fingerprints as a Dice coefficient; 1 if, and only if, the roots are equal."""
    if a[:64] == b[:64]:
        return 1.0
    left, right = (re.findall("." * LEAF_HEX, re.sub("[./]", "", x[65:])) for x in (a, b))
    both = len(left) + len(right)
    common = sum((Counter(left) & Counter(right)).values())
    return min(2 * common / both, 1 - 1 / (both + 1))


def changed_branches(a: str, b: str) -> list[tuple[int, int]]:
    """Section and paragraph numbers of ``b`` whose branch is not at the same place in ``a``."""
    if a[:64] == b[:64]:
        return []
    left, right = _branches(a), _branches(b)
    out = []
    for i, section in enumerate(right):
        old = left[i] if i < len(left) else []
        if section != old:
            out += [(i, k) for k, p in enumerate(section) if k >= len(old) or old[k] != p]
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first characters of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(text: str, tree: Tree, following: str, after: Tree) -> tuple:
    changed = edited(text, following)
    fingerprint, new = tree.fingerprint(), Tree(changed, after.paragraphs | tree.paragraphs).fingerprint()
    digest = sha256(changed.encode()).hexdigest()
    return len(text), digest, fingerprint, new, likeness(fingerprint, new), likeness(fingerprint, after.fingerprint())


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", *(f.split()[0] for f in FIELDS.split(", "))])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint``, one row per row; null and empty texts share the fingerprint of the empty text."""
    kept = id_text(docs)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fingerprint": [Tree(t).fingerprint() for t in b["text"]]})

    return kept.mapInPandas(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def compare_to_following(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row.

    The following document is the next one in descending doc_id, after the last the first; equal doc_ids are ordered by a
    hash of the text, rows without a doc_id come last. A single document follows itself. Null texts count as empty. An
    empty table gives an empty result; other columns are not read.

    Texts are dealt into ranges of doc_id once and read in order. The first and last row of every range meet their
    neighbours over a join of as many rows as there are ranges.
    """
    spark = docs.sparkSession
    kept = id_text(docs).withColumn("tie", F.xxhash64("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    order = [F.desc_nulls_last("doc_id"), F.desc("tie")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept.repartitionByRange(ranges, *order)

    def run(batches):
        text, doc, tree = None, None, None
        for b in batches:
            for at in range(0, len(b), 500):
                rows = []
                for next_doc, following in zip(b["doc_id"].iloc[at : at + 500], b["text"].iloc[at : at + 500]):
                    after = Tree(following)
                    if tree is not None:
                        rows.append((doc, *_compared(text, tree, following, after)))
                    text, doc, tree = following, next_doc, after
                yield _frame(rows)

    inner = dealt.sortWithinPartitions(*order).select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {FIELDS}")

    row = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "tie", "text")
    ends = dealt.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.max(row).alias("head"), F.min(row).alias("tail"))
    heads = ends.select(F.col("part").alias("next_part"), F.col("head.text").alias("following"))
    steps = ends.select("part").withColumn("next_part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.orderBy("part"))))
    tails = ends.select("part", F.col("tail.doc_id").alias("doc_id"), F.col("tail.text").alias("text"))
    edges = tails.join(steps, "part").join(heads, "next_part").select("doc_id", "text", "following")

    def close(batches):
        for b in batches:
            yield _frame([(d, *_compared(t, Tree(t), f, Tree(f))) for d, t, f in zip(b["doc_id"], b["text"], b["following"])])

    return inner.union(edges.mapInPandas(close, f"doc_id {kind}, {FIELDS}"))


def op1_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_to_following(read_table(spark, sf_dir, "documents"))


QUERIES = {"op1_merkle": op1_merkle}
ORACLES: dict[str, str] = {}
