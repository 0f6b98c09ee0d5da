"""Best-fit packing: ids against the library, the plan against packing one piece at a time, and whole sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barloom.llm import packing

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(packing.TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def spec():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def one_by_one(sizes, capacity):
    """Room left in every bin: pieces above a third of the capacity matched, the others best-fit, longest first."""
    bins = []
    large = sorted(s for s in sizes if 3 * s > capacity)
    while large:
        a = large.pop()
        fits = [k for k, b in enumerate(large) if a + b <= capacity]
        bins.append(capacity - a - (large.pop(fits[-1]) if fits else 0))
    for s in sorted((s for s in sizes if 3 * s <= capacity), reverse=True):
        fits = [k for k, gap in enumerate(bins) if gap >= s]
        if fits:
            bins[min(fits, key=bins.__getitem__)] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


def room_of(counts, capacity):
    """Room left by the plan, after a check that the ranks of each size are covered once and nothing overlaps."""
    runs = packing.plan(counts, capacity)
    held, seen = defaultdict(list), Counter()
    by_size = {s: list(g.itertuples()) for s, g in runs.groupby("size")}
    for size, n in counts.items():
        own = by_size.get(size, [])
        for k, r in enumerate(own):
            assert r.first_rank == seen[size]
            end = own[k + 1].first_rank if k + 1 < len(own) else n
            for rank in range(r.first_rank, end):
                since = rank - r.first_rank
                held[r.first_bin + since // r.copies].append((r.offset + since % r.copies * size, size))
            seen[size] = end
        assert seen[size] == n
    assert sorted(held) == list(range(len(held)))
    for pieces in held.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= capacity
    return sorted(capacity - sum(s for _, s in p) for p in held.values())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=80))
def test_plan_equals_packing_one_by_one(sizes):
    assert room_of(Counter(sizes), 24) == one_by_one(sizes, 24)


def test_plan_of_many_lengths():
    rng = random.Random(1)
    sizes = [min(1024, int(rng.expovariate(1 / 300)) + 1) for _ in range(3000)] + [1] * 1500 + [700] * 400
    left = room_of(Counter(sizes), 1024)
    assert left == one_by_one(sizes, 1024)
    assert len(left) <= 1.02 * -(-sum(sizes) // 1024) + 400
    with pytest.raises(ValueError):
        packing.plan({1025: 1}, 1024)


def test_ids_are_those_of_the_library(spec, library):
    encode = packing.Encoder(spec)
    assert encode.fast is not None
    rng = random.Random(2)
    texts = ["", "<|endoftext|>", "a <|endoftext|> b", "x" * 30_000, " " * 3000 + "y", "\r\n\x0b\x85    a  b\t\tc ", "don't we'LL 12½③ ٣٤", "\x00\x1c\x1f ", "東京 ไทย 👩‍👩‍👧 é"]
    texts += ["".join(chr(k) for k in range(at, at + 256) if not 0xD800 <= k < 0xE000) for at in range(0, 0x30000, 256)]
    texts += ["".join(f" {chr(k)}a{chr(k)}{chr(k)}1{chr(k)}." for k in range(at, at + 256) if not 0xD800 <= k < 0xE000) for at in range(0, 0x20000, 256)]
    texts += ["".join(rng.choice("ab zZ1\n\t'’é.") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    for text in texts:
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text[:40]


def test_cut():
    assert [packing.cut(n, 10) for n in (1, 10, 11, 20, 35)] == [[1], [10], [1, 10], [10, 10], [5, 10, 10, 10]]


def check(rows, texts, library, capacity):
    """``rows`` of a packed table against ``texts``, doc_id -> the texts that have it."""
    held, found = defaultdict(list), defaultdict(Counter)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
        found[r.doc_id][r.piece, r.start, r.length, r.ids_crc32] += 1
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, own in texts.items():
        want = Counter()
        for text in own:
            ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
            start = 0
            for piece, n in enumerate(packing.cut(len(ids), capacity)):
                want[piece, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
                start += n
        assert found[doc] == want
    assert set(found) == set(texts)
    return held


def test_packing_of_odd_rows(spark, spec, library):
    docs = [(1, None), (1, ""), (2, "a b c"), (2, "a b c"), (None, "x"), (None, None), (3, "word " * 40_000), (4, "<|endoftext|> é")]
    docs += [(10 + k, "tie " * (k % 7)) for k in range(60)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    for c in ("piece", "length", "offset", "_file", "rank"):
        table = table.withColumn(c, table["doc_id"])
    texts = defaultdict(list)
    for doc, text in docs:
        texts[doc].append(text)
    packed = packing.pack(table, spec, 16)
    held = check(packed.collect(), texts, library, 16)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert {k: (len(v), sum(n for _, n in v)) for k, v in held.items()} == {k: (r.n_pieces, len(r.ids)) for k, r in whole.items()}
    assert packing.pack(table.limit(0), spec).count() == 0


def test_query(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    rows = packing.op11_best_fit_packing(spark, FOLDER).collect()
    held = check(rows, {r.doc_id: [r.text] for r in docs}, library, packing.CAPACITY)
    sizes = [r.length for r in rows]
    assert len(held) == len(one_by_one(sizes, packing.CAPACITY)) and len(held) <= 1.05 * -(-sum(sizes) // packing.CAPACITY)
