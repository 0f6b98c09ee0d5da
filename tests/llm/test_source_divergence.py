"""Source divergence against dense rates in plain integers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from parity import compare, duck, rows_of

from barloom.llm import source_divergence as sd

FOLDER = "/root/testdata/sf0.001"


def plain(docs, min_docs=30, top=50):
    """``docs``: (text, lang, source) rows."""
    used, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[a-z\u0080-\U0010ffff]+", low)
        used[lang, source].update(words)
        seen[lang].update(set(words))
    out = set()
    for lang in seen:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        sources = {s: used[k, s] for k, s in used if k == lang}
        whole = sum((sources[s] for s in sources), Counter())

        def rates(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = rates(whole)
        p = {s: rates(sources[s]) for s in sources}
        for s in sources:
            pairs = [(h, sum(abs(p[s][t] - p[h][t]) for t in kept)) for h in sources if h != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)}
    return out


def as_set(df):
    rows = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("block, slice_", [(1 << 14, 1 << 22), (5, 1 << 22), (7, 12)])
def test_divergence_of_odd_rows(spark, monkeypatch, block, slice_):
    monkeypatch.setattr(sd, "SLICE", slice_)  # few sums a slice: many slices
    rng = random.Random(7)
    words = ["Alpha", "alpha", "beta", "gämma", "Ünder", "ünder", "東京", "x1y", "don't", "ZED", " ", "tie", "tie2"]
    docs = []
    for _ in range(400):
        text = rng.choice([None, "", "123 !!", "İI", " ".join(rng.choices(words, [9, 4, 3, 2, 2, 2, 1, 1, 1, 1, 1, 3, 3], k=rng.randint(1, 12)))])
        docs.append((text, rng.choice([None, "", "en", "en", "de"]), rng.choice([None, "", "s1", "s2", "S", "é"])))
    docs += [(None, "en", "empty"), ("123", "xx", "a"), ("456", "xx", "b"), ("alpha " * 100_000, "en", "long")] + docs[:30]
    names = "text string, lang string, source string"
    table = spark.createDataFrame(docs, names)
    for c in ("term", "peer", "n", "doc_id"):
        table = table.withColumn(c, table["source"])  # extra columns with clashing names
    assert as_set(sd.divergence(table, min_docs=12, top=4, block_postings=block)) == plain(docs, 12, 4)
    assert as_set(sd.divergence(table, min_docs=10_000, block_postings=block)) == plain(docs, 10_000)  # no kept term
    assert sd.divergence(table.limit(0)).count() == 0


def test_counts_survive_small_tables_of_sums(spark):
    docs = [("a b a", "en", "s"), ("b c", "en", "s"), ("a", "en", "t")]
    got = sd.term_counts(spark.createDataFrame(docs, "text string, lang string, source string").coalesce(1), held=1).collect()
    assert len(got) > 4
    sums = Counter()
    for r in got:
        sums[r.source, r.term] += r.n
    assert sums == {("s", "a"): 2, ("s", "b"): 2, ("s", "c"): 1, ("t", "a"): 1}


def test_query_equals_plain_version_and_sql(spark):
    got = sd.op13_source_divergence(spark, FOLDER)
    docs = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = as_set(got)
    assert found == plain(docs) and {x[2] for x in found} == {"pair", "term"}
    cur = duck(FOLDER).execute(sd.ORACLES["op13_source_divergence"])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert compare(rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(names, cur.fetchall()), names) is None
