"""Best-fit packing of token pieces into sequences of a fixed capacity.

How full the sequences get depends on the lengths alone, so the plan is made from the count of each length (``capacity`` rows at
most) and is exact: pieces above one third of the capacity fit twice into a sequence at most and are matched greedily, the
longest with the longest that fits; shorter ones then go, longest first, into the sequence with the least room that is
enough. Sequences that are alike are one row of the plan, so its size is bounded by the capacity, not by the documents.

Every piece then needs a number among the pieces of its length. A piece is counted within the file it was written to, and
files are numbered by sums of these counts, so a length that a third of all documents have is spread over all files.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import id_text, read_table, staged

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 1024
END_ID = 2
TOKENS_AT_ONCE = 1_000_000
RUN = ["size", "first_rank", "first_bin", "copies", "offset"]


class Encoder:
    """Ids of ``tokenizers`` for a byte-level BPE file, without added tokens.

    ``tiktoken`` gives the same ids three times as fast from the vocabulary of the same file, if that lists the merges in the
    order of their ids; it takes the texts that hold no special string. ``tokenizers`` itself takes the others.
    """

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(text)
        spec = json.loads(text)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._tiktoken(spec)

    def _tiktoken(self, spec: dict):
        import public_tokenizers
        import tiktoken

        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        made = [model["vocab"].get(a + b, -1) for a, b in pairs]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not spec.get("normalizer")
        plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or any(a >= b for a, b in zip(made, made[1:])) or len(made) + 256 != len(set(model["vocab"]) - set(self.special)):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a byte-level vocabulary writes as themselves
        shown += [b for b in range(256) if b not in shown]
        byte = {chr(b if k < 188 else 256 + k - 188): b for k, b in enumerate(shown)}
        ranks = {bytes(byte[c] for c in p): k for p, k in model["vocab"].items() if p not in self.special}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: all are full but the first."""
    first = (n - 1) % capacity + 1
    return [first] + [capacity] * ((n - first) // capacity)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids, ids_crc32`` of every row of ``docs``; ``tokenizer`` is the text of a tokenizer file.

    A document is its ids and then ``end_id``; a null text is the empty one and has ``end_id`` alone.
    """
    kept = id_text(docs)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)  # a vocabulary file
    names = ["doc_id", "piece", "start", "length", "ids", "ids_crc32"]

    def frame(kind: pa.DataType, rows: list, values: list) -> pa.RecordBatch:
        docs_, pieces, starts, lengths, crcs = zip(*rows)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).view(np.int32)))
        columns = [pa.array(docs_, kind), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), ids, pa.array(crcs, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        encode = Encoder(shared.value)
        end = np.array([end_id], np.uint32)
        for b in batches:
            rows, values, held = [], [], 0
            kind = b.schema.field("doc_id").type
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = np.concatenate([encode(text.as_py()), end]).astype("<u4")
                start = 0
                for piece, n in enumerate(cut(len(ids), capacity)):
                    some = ids[start : start + n]
                    rows.append((doc, piece, start, n, zlib.crc32(some)))
                    values.append(some)
                    start, held = start + n, held + n
                    if held >= TOKENS_AT_ONCE:
                        yield frame(kind, rows, values)
                        rows, values, held = [], [], 0
            if rows:
                yield frame(kind, rows, values)

    doc_type = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {doc_type}, piece int, start bigint, length bigint, ids array<int>, ids_crc32 bigint")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Where the pieces of every length go: rows ``size, first_rank, first_bin, copies, offset`` by size and rank.

    The pieces of a size from ``first_rank`` on lie ``copies`` to a bin from ``offset`` on, from ``first_bin`` on. Bins are 0, 1, ...
    """
    counts = {s: n for s, n in counts.items() if n}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("a piece is empty or longer than the capacity")
    taken: dict[int, int] = defaultdict(int)
    rows, bins = [], 0
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> first bin and number of bins that are alike

    def put(size: int, first_bin: int, offset: int, copies: int, items: int) -> None:
        rows.append((size, taken[size], first_bin, copies, offset))
        taken[size] += items

    large = sorted(s for s in counts if 3 * s > capacity)
    left = {s: counts[s] for s in large}
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else None
        if b == a and left[a] == 1:  # one is left over: the next shorter one is its partner
            b = large[-2] if len(large) > 1 else None
        if b is None:
            n, gap = left[a], capacity - a
            put(a, bins, 0, 1, n)
        elif b == a:
            n, gap = left[a] // 2, capacity - 2 * a
            put(a, bins, 0, 2, 2 * n)
        else:
            n, gap = min(left[a], left[b]), capacity - a - b
            put(a, bins, 0, 1, n)
            put(b, bins, a, 1, n)
            left[b] -= n
        left[a] -= 2 * n if b == a else n
        if gap:
            room[gap].append((bins, n))
        bins += n
        large = [s for s in large if left[s]]

    gaps = sorted(room)
    for size in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        items = counts[size]
        made = []
        while items:
            at = bisect.bisect_left(gaps, size)
            gap = gaps[at] if at < len(gaps) else capacity
            copies = gap // size
            if at < len(gaps):
                first, n = room[gap].pop()
            else:
                first, n = bins, -(-items // copies)
                bins += n
            full = min(n, items // copies)
            if full:
                put(size, first, capacity - gap, copies, full * copies)
                made.append((gap - copies * size, first, full))
                items -= full * copies
            if full < n and items and items < copies:  # the last ones
                put(size, first + full, capacity - gap, items, items)
                made.append((gap - items * size, first + full, 1))
                full, items = full + 1, 0
            if full < n:
                room[gap].append((first + full, n - full))
            elif at < len(gaps) and not room[gap]:
                del room[gap], gaps[at]
        for gap, first, n in made:  # no room for a piece of this size, or no piece of it is left
            if gap:
                if gap not in room or not room[gap]:
                    bisect.insort(gaps, gap)
                room[gap].append((first, n))
    return pd.DataFrame(rows, columns=RUN, dtype=np.int64).sort_values(["size", "first_rank"], ignore_index=True)


def numbered(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pieces``, read from files, with ``rank``: a number from 0 among the pieces of its length; and the counts ``length, n``."""
    rows = pieces.withColumn("_file", F.xxhash64("_metadata.file_path")).withColumn("_at", F.col("_metadata.row_index"))
    counts = staged(rows.groupBy("length", "_file").agg(F.count("*").alias("n")), "length-counts")
    earlier = Window.partitionBy("length").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("length").alias("_length"), F.col("_file").alias("_in"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    before = staged(before, "length-ranks")
    own = F.row_number().over(Window.partitionBy("length", "_file").orderBy("_at")) - 1
    placed = rows.withColumn("_own", own).join(before, (F.col("length") == F.col("_length")) & (F.col("_file") == F.col("_in")))
    return placed.withColumn("rank", F.col("_before") + F.col("_own")).drop("_file", "_at", "_length", "_in", "_before", "_own"), counts


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces(length, ...)``, read from files, with ``sequence_id, offset``; other columns stay."""
    ranked, counts = numbered(pieces)
    by_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs = plan(by_length, capacity)
    shared = pieces.sparkSession.sparkContext.broadcast({c: runs[c].to_numpy() for c in RUN})

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = shared.value
        step = np.int64(1) << 48
        size, number = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(table["size"] * step + table["first_rank"], size * step + number, side="right") - 1
        since, copies = number - table["first_rank"][at], table["copies"][at]
        return pd.DataFrame({"sequence_id": table["first_bin"][at] + since // copies, "offset": table["offset"][at] + since % copies * size})

    found = ranked.withColumn("_place", place("length", "rank"))
    return found.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset`` of every piece of every row of ``docs``.

    Only documents of more than ``capacity`` tokens are cut. A null text is the empty one. Repeated rows and rows with a null or
    repeated doc_id are documents of their own. Other columns are not read. An empty table gives an empty result.
    """
    return placed(staged(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_pieces, ids``: the packed sequences themselves; a group is one sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        packed = pack(read_table(spark, sf_dir, "documents"), f.read())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op11_best_fit_packing": op11_best_fit_packing}
ORACLES: dict[str, str] = {}
