"""Line dedup over content-defined chunks of lines.

A text is cut into lines (at newlines, and at sentence ends inside a paragraph; white space alone belongs to the line before). A
rolling hash over the hashes of the last two lines sets chunk boundaries, so an insertion moves only the boundaries next to
it. Paragraphs of at least ``LONG_WORDS`` words start and end a chunk, so a passage pasted in as a paragraph is always cut at its
own edges. Chunks that occur more than once are compared byte by byte; all but the first occurrence (least doc_id, then
position) of equal multi-line chunks are cut out of the texts.

Chunks need two edges inside a passage, so passages are also found by windows: the shortest run of lines of at least
``PASSAGE_WORDS`` words from every line on, and up to every line. A run of equal lines of that many words is covered by such windows
wherever it starts. Windows have the same lines, which are compared byte by byte too, in the same order by a 128-bit rolling sum.

The texts are read twice and not shuffled for that: the first reading counts the hashes of lines, the second makes chunks and windows
where every line occurs more than once, which is rare. Only small rows of these are grouped and joined.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import read_table, staged

#: Newlines, or a sentence end and the blanks after it. It begins with a set of characters, which the engine can search for.
LINE_END = re.compile(r"[\n.!?](?:(?<=\n)\n*|(?<=\w[.!?])[ \t]+)")
LONG_WORDS = 40
MAX_LINES = 64
#: A repeated run of lines of so many words goes wherever it starts.
PASSAGE_WORDS = 50
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Odd bases of the two rolling sums over a window's lines, and their inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
#: The filter of repeated hashes has a fixed size; where it fills up, more units are made and the result is the same.
FILTER_WORDS = 1 << 20
CHUNK, WINDOW, LINE = 0, 1, 2
#: Characters of texts that are handled as one array, and lines that a task remembers to have given out.
TEXT_AT_ONCE = 2_000_000
KNOWN = 200_000

UNIT = ["kind", "start", "len", "lines", "words", "hi", "lo", "text"]


def lines_of(text: str) -> tuple[list[int], list[str], list[bool]]:
    """End, stripped text, and whether a paragraph ends there, of every line with text; the first begins at 0."""
    ends = [m.end() for m in LINE_END.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    lines = [text[a:b].strip() for a, b in zip([0, *ends], ends)]
    breaks = [text[e - 1] == "\n" for e in ends]
    if "" in lines:
        kept: list[list] = []
        for e, line, stop in zip(ends, lines, breaks):
            if line:
                kept.append([e, line, stop])
            elif kept:
                kept[-1][0] = e
                kept[-1][2] |= stop
        ends, lines, breaks = map(list, zip(*kept)) if kept else ([], [], [])
    return ends, lines, breaks


def line_hashes(lines: list[str], seed: int = 0) -> np.ndarray:
    """``(lines, 2)``: the two halves of a 128-bit hash of every line."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x, seed) for x in lines]), ">u8").astype(np.uint64).reshape(-1, 2)


def _word_counts(lines: list[str]) -> np.ndarray:
    return np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))


def windows(lines: list[str], least: int = PASSAGE_WORDS) -> list[tuple[int, int]]:
    """First line and line after the last of the shortest runs of ``least`` words, from every line on and up to every line."""
    counts = _word_counts(lines)
    return list(map(tuple, _windows(counts, least).tolist())) if len(counts) else []


def _windows(words: np.ndarray, least: int, begins: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
    """Of lines of several texts: ``begins`` and ``ends`` are the first line of each line's text and the line after its last."""
    n = len(words)
    begins, ends = (np.zeros(n, np.int64), np.full(n, n)) if begins is None else (begins, ends)
    upto = np.concatenate([[0], np.cumsum(words)])
    rows = np.arange(n)
    after = np.searchsorted(upto, upto[:-1] + least)
    first = np.searchsorted(upto, upto[1:] - least, side="right") - 1
    forward, back = after <= ends, first >= begins
    both = np.unique(np.concatenate([rows[forward] * (n + 1) + after[forward], first[back] * (n + 1) + rows[back] + 1]))
    return np.stack([both // (n + 1), both % (n + 1)], 1)


def _chunk_ends(hashes: np.ndarray, words: np.ndarray, breaks: np.ndarray, divisor: int, begins: np.ndarray, ends: np.ndarray) -> list[int]:
    """Line after the last of every chunk; the last line of a text ends one."""
    n = len(words)
    if not n:
        return []
    rows = np.arange(n)
    rolled = hashes * MIX
    rolled[1:] += np.where(rows[1:] > begins[1:], hashes[:-1], np.uint64(0))
    stop = ((rolled * MIX) >> np.uint64(40)) % np.uint64(divisor) == 0
    last = rows == ends - 1
    paragraph = np.flatnonzero(breaks | last)
    upto = np.concatenate([[0], np.cumsum(words)])
    first = np.concatenate([[0], paragraph[:-1] + 1])
    long = upto[paragraph + 1] - upto[first] >= LONG_WORDS
    forced = last.copy()
    forced[paragraph[long]] = True
    before = first[long]
    forced[before[before > begins[before]] - 1] = True
    out, begin = [], 0
    at = np.flatnonzero(stop | forced)
    for k, always in zip(at.tolist(), forced[at].tolist()):
        while k - begin >= MAX_LINES:
            begin += MAX_LINES
            out.append(begin)
        if always or k > begin or k + 1 - begin >= MAX_LINES:
            out.append(k + 1)
            begin = k + 1
    return out


def cut(text: str, divisor: int = 3) -> list[tuple[int, int, int]]:
    """Chunks of a text as ``start, end, lines`` (code points); together they cover it (white space alone has no chunk)."""
    ends, lines, breaks = lines_of(text)
    if not lines:
        return []
    n = len(lines)
    stops = _chunk_ends(line_hashes(lines)[:, 1], _word_counts(lines), np.array(breaks), divisor, np.zeros(n, np.int64), np.full(n, n))
    edges = [0, *ends]
    return [(edges[a], edges[b], b - a) for a, b in zip([0, *stops], stops)]


def _rolling_keys(hashes: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """``(runs, 2)``: a key of the lines from ``first`` to ``after``, the same wherever they stand."""
    out = np.empty((len(runs), 2), np.uint64)
    n = len(hashes)
    for lane, (base, inverse) in enumerate(zip(BASES, INVERSES)):
        steps = np.repeat(np.array([[base], [inverse]], np.uint64), n + 1, axis=1)
        steps[:, 0] = 1
        powers, back = np.cumprod(steps, axis=1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[:, lane] * powers[:-1])])
        sums = (sums[runs[:, 1]] - sums[runs[:, 0]]) * back[runs[:, 0]]
        out[:, lane] = (sums ^ (sums >> np.uint64(31))) * MIX + (runs[:, 1] - runs[:, 0]).astype(np.uint64)
    return out


def line_keys(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``lo``: the lower half of the hash of every line of every text."""

    def run(batches):
        for b in batches:
            lines: list[str] = []
            for k, text in enumerate(b.column("text")):
                lines += lines_of(text.as_py() or "")[1]
                if lines and (len(lines) >= 50_000 or k == len(b) - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(line_hashes(lines, seed)[:, 1].view(np.int64))], names=["lo"])
                    lines = []

    return docs.select("text").mapInArrow(run, "lo bigint")


def _repeated_filter(keys: DataFrame) -> np.ndarray:
    """Bit filter of fixed size over the hashes that occur more than once."""
    again = keys.groupBy("lo").count().where("count > 1")
    word, bit = F.expr(f"shiftrightunsigned(lo, 6) & {FILTER_WORDS - 1}"), F.expr("shiftleft(1L, cast(lo & 63 as int))")
    got = again.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    filled = np.zeros(FILTER_WORDS, np.int64)
    filled[got["word"].to_numpy()] = got["bits"].to_numpy()
    return filled.view(np.uint64)


def _units(texts: list[str], bits: np.ndarray, divisor: int, seed: int, known: set) -> list[tuple[np.ndarray, ...]]:
    """Columns ``text number`` and ``UNIT`` of the chunks and windows of lines that occur again, and of the windows' lines that
    are not ``known``. The lines of all texts are handled as one array."""
    parsed = [lines_of(t) for t in texts]
    counts = np.fromiter((len(p[1]) for p in parsed), np.int64, len(parsed))
    if not counts.sum():
        return []
    hashes = line_hashes([x for p in parsed for x in p[1]], seed)
    lo = hashes[:, 1]
    again = ((bits[(lo >> np.uint64(6)) & np.uint64(FILTER_WORDS - 1)] >> (lo & np.uint64(63))) & np.uint64(1)).astype(bool)
    owner = np.repeat(np.arange(len(texts)), counts)
    used = np.bincount(owner[again], minlength=len(texts)) > 0  # texts with a line that occurs again
    keep = used[owner]
    if not keep.any():
        return []
    hashes, again, owner = hashes[keep], again[keep], owner[keep]
    parsed = [p for p, u in zip(parsed, used) if u]
    lines = [x for p in parsed for x in p[1]]
    counts = counts[used]
    ends = np.repeat(np.cumsum(counts), counts)
    begins = ends - np.repeat(counts, counts)
    stop_at = np.fromiter((e for p in parsed for e in p[0]), np.int64, len(lines))
    start_at = np.concatenate([[0], stop_at[:-1]])
    start_at[np.arange(len(lines)) == begins] = 0
    breaks = np.fromiter((x for p in parsed for x in p[2]), bool, len(lines))
    words = _word_counts(lines)
    upto = np.concatenate([[0], np.cumsum(words)])
    repeated = np.concatenate([[0], np.cumsum(again)])
    out = []

    chunk_hashes = hashes[:, 1] if seed == 0 else line_hashes(lines)[:, 1]
    after = np.array(_chunk_ends(chunk_hashes, words, breaks, divisor, begins, ends))
    first = np.concatenate([[0], after[:-1]])
    hit = repeated[after] - repeated[first] == after - first
    if hit.any():
        first, after = first[hit], after[hit]
        starts, size = start_at[first], stop_at[after - 1] - start_at[first]
        chunks = [texts[i][s : s + n].strip() for i, s, n in zip(owner[first].tolist(), starts.tolist(), size.tolist())]
        keys = line_hashes(chunks, seed).view(np.int64)
        out.append((owner[first], np.full(len(first), CHUNK), starts, size, after - first, upto[after] - upto[first], keys[:, 0], keys[:, 1], chunks))

    runs = _windows(words, PASSAGE_WORDS, begins, ends)
    first, after = runs.T
    whole = repeated[after] - repeated[first] == after - first
    if whole.any():
        runs = runs[whole]
        first, after = runs.T
        keys = _rolling_keys(hashes, runs).view(np.int64)
        starts = start_at[first]
        zeros = np.zeros(len(first), np.int64)
        out.append((owner[first], zeros + WINDOW, starts, stop_at[after - 1] - starts, after - first, zeros, keys[:, 0], keys[:, 1], [None] * len(first)))
        held = np.zeros(len(lines) + 1, np.int64)
        np.add.at(held, first, 1)
        np.add.at(held, after, -1)
        inside = np.flatnonzero(np.cumsum(held)[:-1]).tolist()
        fresh = [k for k in inside if lines[k] not in known and not known.add(lines[k])]
        if fresh:
            keys, zeros = hashes[fresh].view(np.int64), np.zeros(len(fresh), np.int64)
            out.append((owner[fresh], zeros + LINE, zeros, zeros, zeros + 1, zeros, keys[:, 0], keys[:, 1], [lines[k] for k in fresh]))
    return out


def units(docs: DataFrame, bits: np.ndarray, divisor: int, seed: int) -> DataFrame:
    """``doc_id, row`` and ``UNIT`` of ``docs(doc_id, row, text)``; lines (kind 2) come once per task and ``KNOWN`` lines at least."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    kinds = [pa.int32()] * 5 + [pa.int64()] * 2 + [pa.string()]

    def run(batches):
        known: set = set()
        for b in batches:
            held, first = 0, 0
            texts: list[str] = []
            for k, text in enumerate(b.column("text")):
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= TEXT_AT_ONCE or k == len(b) - 1:
                    for number, *columns in _units(texts, shared.value, divisor, seed, known):
                        at = pa.array(number + first)
                        ids = [b.column(c).take(at) for c in ("doc_id", "row")]
                        yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["doc_id", "row", *UNIT])
                    texts, held, first = [], 0, k + 1
                    if len(known) > KNOWN:
                        known.clear()

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, row bigint, kind int, start int, len int, lines int, words int, hi bigint, lo bigint, text string"
    return docs.select("doc_id", "row", "text").mapInArrow(run, schema)


def repeated_chunks(docs: DataFrame, divisor: int = 3, seeds: int = 8) -> DataFrame:
    """Repeated chunks (``kind`` 0) and windows (1) of ``docs(doc_id, row, text)``: ``doc_id, row, kind, start, len,
    lines, words, first_doc, is_first, apart``. A window that overlaps the first one is not ``apart``. Identical rows are one."""
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "start", "len")
    for seed in range(seeds):
        found = staged(units(docs, _repeated_filter(line_keys(docs, seed)), divisor, seed), "units")
        unequal = found.where(f"kind <> {WINDOW}").groupBy("kind", "hi", "lo").agg(F.min("text").alias("a"), F.max("text").alias("b"))
        # written at once with the test of the bytes: chunks and lines of one key that are not the same bytes
        if unequal.where("a <> b").isEmpty():
            break
    else:
        raise RuntimeError(f"{seeds} hash seeds gave equal keys to unequal lines")
    spots = found.where(f"kind <> {LINE}").drop("text")
    same = spots.groupBy("kind", "hi", "lo").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    # written apart, so that both sides of the join are plain exchanges and a frequent key can be split
    same = staged(same.select("kind", "hi", "lo", "first"), "repeats")
    rows = spots.join(same, ["kind", "hi", "lo"])
    is_first = F.expr("doc_id <=> first.doc_id and row = first.row and start = first.start")
    apart = F.expr("not (doc_id <=> first.doc_id and row = first.row) or start >= first.start + first.len")
    names = ["doc_id", "row", "kind", "start", "len", "lines", "words"]
    rows = rows.select(*names, F.col("first.doc_id").alias("first_doc"), is_first.alias("is_first"), apart.alias("apart"))
    return rows.dropDuplicates(["doc_id", "row", "kind", "start", "len"])


def removed_spans(chunks: DataFrame, min_words: int = 50) -> DataFrame:
    """``doc_id, row, spans, repeated``: the spans to cut and the number of repeated chunks of a document.

    A repeated chunk goes unless it is the first, if it has several lines or ``min_words`` words. A repeated single line
    goes only next to such a chunk that repeats the same first document: then both belong to one longer passage. A repeated
    window goes unless it is the first or overlaps the first. Overlapping spans are one.
    """
    chunks = chunks.withColumn("big", F.expr(f"kind = 0 and not is_first and (lines > 1 or words >= {min_words})"))
    order = Window.partitionBy("doc_id", "row").orderBy("kind", "start", "len")
    with_before = F.expr("big_b and start_b + len_b = start and first_b <=> first_doc")
    with_after = F.expr("big_a and start + len = start_a and first_a <=> first_doc")
    for tag, shift in (("b", F.lag), ("a", F.lead)):
        for column, short in (("big", "big"), ("start", "start"), ("len", "len"), ("first_doc", "first")):
            chunks = chunks.withColumn(f"{short}_{tag}", shift(column).over(order))
    near = F.col("big") | (~F.col("is_first") & (F.coalesce(with_before, F.lit(False)) | F.coalesce(with_after, F.lit(False))))
    gone = F.when(F.col("kind") == 0, near).otherwise(F.col("apart") & ~F.col("is_first"))
    by_start = Window.partitionBy("doc_id", "row").orderBy("start", "len", "kind")
    marked = chunks.select("doc_id", "row", "kind", "start", "len", gone.alias("gone"))
    reach = F.max(F.expr("if(gone, start + len, null)")).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("opens", F.col("gone") & (F.col("start") >= F.coalesce(reach, F.lit(0))))
    marked = marked.withColumn("island", F.sum(F.col("opens").cast("int")).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [F.min(F.expr("if(gone, start, null)")).alias("start"), F.max(F.expr("if(gone, start + len, null)")).alias("end")]
    islands = marked.groupBy("doc_id", "row", "island").agg(*ends, F.expr("count_if(kind = 0)").alias("repeated"))
    span = F.expr("if(start is null, null, struct(start, end - start as len))")
    grouped = islands.withColumn("span", span).groupBy("doc_id", "row")
    return grouped.agg(F.sort_array(F.collect_list("span")).alias("spans"), F.sum("repeated").alias("repeated"))


def dedup(docs: DataFrame, divisor: int = 3) -> DataFrame:
    """``docs`` with repeated multi-line chunks and passages of 50 words cut out of ``text``, plus ``repeated_chunks, removed_chunks, removed_chars``.

    All columns of ``docs`` stay (names that clash with the three new ones are replaced). Every row stays: a text that
    is repeated in full becomes empty. Null and empty texts are returned as they are. Identical rows (equal doc_id and
    text) count as one document and get the same result, so they repeat nothing of each other. ``removed_chunks`` counts the spans
    that were cut out. Among copies the least doc_id keeps the chunk; rows with a null doc_id come last. An empty table gives
    an empty result.
    """
    names = [c for c in docs.columns if c not in ("repeated_chunks", "removed_chunks", "removed_chars")]
    keyed = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    marks = staged(removed_spans(repeated_chunks(keyed, divisor)), "spans")
    marks = marks.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "spans", "repeated")
    others = F.struct(*[c for c in names if c != "text"])  # the text itself is shuffled once
    joined = docs.select(others.alias("_all"), docs["doc_id"], docs["text"], F.xxhash64("text").alias("_text_row"))
    joined = joined.join(marks, joined["doc_id"].eqNullSafe(marks["_doc"]) & (joined["_text_row"] == marks["_row"]), "left")
    pieces = F.expr(
        "concat(transform(spans, (s, i) -> substring(text, if(i = 0, 1, spans[i - 1].start + spans[i - 1].len + 1),"
        " if(i = 0, s.start, s.start - spans[i - 1].start - spans[i - 1].len))),"
        " array(substring(text, element_at(spans, -1).start + element_at(spans, -1).len + 1)))"
    )
    text = F.when(F.size("spans") > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
    sizes = [
        F.coalesce("repeated", F.lit(0)).alias("repeated_chunks"),
        F.when(F.size("spans") > 0, F.size("spans")).otherwise(0).alias("removed_chunks"),
        F.coalesce(F.expr("aggregate(spans, 0L, (a, s) -> a + s.len)"), F.lit(0)).alias("removed_chars"),
    ]
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"_all.{c}").alias(c) for c in names], *sizes)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "repeated_chunks", "removed_chunks", "removed_chars", F.length("text").alias("kept_chars"), "text")


QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES: dict[str, str] = {}
