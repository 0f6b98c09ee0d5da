"""SimHash near-duplicates by exact tiled comparison.

Every document gets a 64-bit fingerprint (majority vote over the XXH64 of its word shingles). Equal fingerprints are
folded first, so a group of copies is one row. Distinct fingerprints are laid into tiles by the population counts of
their four 16-bit quarters. A differing bit changes one count by one, so two fingerprints within ``radius`` bits lie in
tiles whose counts differ by ``radius`` in sum at most; all other tile pairs are skipped. What is left is compared in
full with numpy exclusive-or and bit counts. Nothing is sampled or banded: every pair within the radius is found.

A tile of more than ``tile_rows`` fingerprints is cut into chunks by hash, and each chunk meets the rows of the
neighbouring tiles as a stream, so a task holds one chunk. Links leave a task as a forest (as many rows as nodes at most).
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import components, id_text, read_table, staged

SEED = 42
QUARTERS = 4
SIDE = 17  # a 16-bit quarter has 0 to 16 bits set
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8, dtype=np.int32) * 256


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in runs), np.uint64)
    votes = np.zeros((8, 256), np.int64)
    for at in range(0, len(hashes), 1 << 16):
        lanes = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8) + _LANES
        votes += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    ones = (votes @ _BITS).ravel() * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, row, fp`` (hash of the text, fingerprint as a signed long), one row per input row."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "row": b["row"], "fp": fps.view(np.int64)})

    kept = id_text(docs).withColumn("row", F.xxhash64("text"))
    return kept.mapInPandas(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, row bigint, fp bigint")


def near_offsets(radius: int) -> list[tuple[int, ...]]:
    """Quarter-count differences of tiles that may hold a pair, one of each pair of opposite ones; zero left out."""
    span = range(-radius, radius + 1)
    return [o for o in itertools.product(span, repeat=QUARTERS) if o > (0,) * QUARTERS and sum(map(abs, o)) <= radius]


def _quarter_counts():
    return [F.expr(f"bit_count(shiftrightunsigned(fp, {16 * k}) & 65535)").cast("int") for k in range(QUARTERS)]


def _bytes_set(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None].view(np.uint8).reshape(-1, 8)).astype(np.int16)


def _close(a: np.ndarray, b: np.ndarray, radius: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs within ``radius`` bits; sub-tiles whose byte counts lie too far apart are skipped."""
    if len(a) * len(b) <= block * block:
        i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
        return i, j
    sides = []
    for x in (a, b):
        counts = _bytes_set(x)
        order = np.lexsort(counts.T)
        cuts = range(0, len(x), block)
        sides.append([(order[c : c + block], counts[order[c : c + block]]) for c in cuts])
    found = []
    boxes = [(o, c.min(0), c.max(0)) for o, c in sides[1]]
    for at, counts in sides[0]:
        low, high = counts.min(0), counts.max(0)
        for to, low2, high2 in boxes:
            if np.maximum(0, np.maximum(low2 - high, low - high2)).sum() > radius:
                continue
            i, j = np.nonzero(np.bitwise_count(a[at][:, None] ^ b[to][None, :]) <= radius)
            found.append((at[i], to[j]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _forest(x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    """Links ``x - y`` as links of each node to the least node it is joined with."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    i, j = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            break
        label = least
    move = label != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[label[move]].view(np.int64), "b": nodes[move].view(np.int64)})


def _compare_tiles(radius: int):
    def run(batches):
        key, own, held = None, None, []
        for b in batches:
            if b.empty:
                continue
            fp = b["fp"].to_numpy(np.int64).view(np.uint64)
            head = b[["tile", "chunk", "guest"]].to_numpy(np.int64)
            cuts = np.flatnonzero((head[1:] != head[:-1]).any(1)) + 1
            for start, end in itertools.pairwise([0, *cuts, len(fp)]):
                now, guest = tuple(head[start, :2]), head[start, 2]
                if now != key:
                    if held:  # a chunk without guests
                        yield from _inside(np.concatenate(held), radius)
                    key, own, held = now, None, []
                if not guest:
                    held.append(fp[start:end])
                    continue
                if held:
                    own, held = np.concatenate(held), []
                    yield from _inside(own, radius)
                if own is not None:
                    i, j = _close(own, fp[start:end], radius)
                    if len(i):
                        yield _forest(own[i], fp[start:end][j])
        if held:
            yield from _inside(np.concatenate(held), radius)

    return run


def _inside(own: np.ndarray, radius: int):
    i, j = _close(own, own, radius)
    keep = i < j
    if keep.any():
        yield _forest(own[i[keep]], own[j[keep]])


def close_links(distinct: DataFrame, radius: int = 3, tile_rows: int = 32_768) -> DataFrame:
    """Links ``a, b`` that join all distinct fingerprints ``fp`` within ``radius`` bits of each other.

    Within one comparison the links are a forest of the pairs found, so they join the same fingerprints.
    """
    counts = _quarter_counts()
    tile = sum((c * SIDE**k for k, c in enumerate(counts)), F.lit(0))
    tiled = distinct.select("fp", *[c.alias(f"q{k}") for k, c in enumerate(counts)], tile.alias("home"))
    # at most 17^4 rows: one per combination of quarter counts
    sizes = tiled.groupBy("home").agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("chunks"))
    sizes = F.broadcast(sizes.select(F.col("home").alias("tile"), "chunks"))
    offsets = F.array(*[F.struct(*[F.lit(v).alias(f"o{k}") for k, v in enumerate(o)]) for o in near_offsets(radius)])
    chunk_of = F.expr("cast(pmod(xxhash64(fp), chunks) as int)")
    mine = tiled.withColumnRenamed("home", "tile").join(sizes, "tile").select("tile", "fp", "chunks", chunk_of.alias("chunk"))
    own = mine.select("tile", "chunk", F.lit(0).alias("guest"), "fp")
    later = mine.where("chunk > 0").select("tile", F.explode(F.expr("sequence(0, chunk - 1)")).alias("chunk"), F.lit(1).alias("guest"), "fp")
    moved = tiled.select("fp", *[f"q{k}" for k in range(QUARTERS)], F.explode(offsets).alias("o"))
    to = [F.col(f"q{k}") - F.col(f"o.o{k}") for k in range(QUARTERS)]
    inside = F.lit(True)
    for t in to:
        inside = inside & t.between(0, SIDE - 1)
    guests = moved.where(inside).select("fp", sum((t * SIDE**k for k, t in enumerate(to)), F.lit(0)).alias("tile"))
    guests = guests.join(sizes, "tile").select("tile", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.lit(1).alias("guest"), "fp")
    laid = own.unionByName(later).unionByName(guests).repartition("tile", "chunk").sortWithinPartitions("tile", "chunk", "guest")
    return laid.mapInPandas(_compare_tiles(radius), "a bigint, b bigint")


def grouped(docs: DataFrame, radius: int = 3, shingle: int = 3, tile_rows: int = 32_768) -> DataFrame:
    """``doc_id, row, fp, root, component_id`` for every input row; ``root`` names the component, also where no row has an id."""
    fps = staged(fingerprints(docs, shingle), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(close_links(distinct.select("fp"), radius, tile_rows))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(groups, "root").select("fp", "root", "component_id")
    return fps.join(named, "fp")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, tile_rows: int = 32_768) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every input row.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows each get a row. ``component_id`` is
    the least non-null doc_id reachable over links (null if there is none). An empty table gives an empty result; other
    columns of ``docs`` are not read.
    """
    found = grouped(docs, radius, shingle, tile_rows)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, radius: int = 3, shingle: int = 3, tile_rows: int = 32_768) -> DataFrame:
    """One row of ``docs``, all columns, of each group: the least doc_id (rows without one come last), of equal ids the least hash.

    Repeated rows are one document, so one of them stays.
    """
    found = grouped(docs, radius, shingle, tile_rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    keepers = found.groupBy("root").agg(first).select(F.xxhash64("first.doc_id", "first.row").alias("_key"), F.col("first.row").alias("_row"))
    row = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    keyed = docs.select(F.struct("*").alias("_all"), row.alias("_row"), F.xxhash64(docs["doc_id"], row).alias("_key"))
    once = F.row_number().over(Window.partitionBy("_key", "_row").orderBy("_row"))
    return keyed.join(keepers, ["_key", "_row"]).withColumn("_once", once).where("_once = 1").select("_all.*")


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {"op9_simhash_neardup": op9_simhash_neardup}
ORACLES: dict[str, str] = {}
