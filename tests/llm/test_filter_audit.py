"""Filter interaction audit against plain sets, and its merges against numpy's."""

import itertools
import random
from collections import Counter

import numpy as np
from parity import compare, duck, rows_of

from barloom.llm import filter_audit as fa

FOLDER = "/root/testdata/sf0.001"


def plain(docs, labels):
    """``docs``: (doc_id, text, source) rows; the 600 steps of each part by replaying every order."""
    rows = [(d, t or "", s or "") for d, t, s in docs]
    good = {d for d, q, x in labels if q == 1 and d is not None}
    toxic = {d for d, q, x in labels if x == 1 and d is not None}
    fails = []
    for d, t, s in rows:
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails.append({
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": d is not None and any(d2 is not None and d2 < d and t2 == t for d2, t2, _ in rows),
        })
    out, shapley = [], Counter()
    for part in {s for _, _, s in rows}:
        own = [k for k, r in enumerate(rows) if r[2] == part]
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if fails[k][f]]
                failing = [k for k in own if fails[k][f]]
                left = [k for k in left if not fails[k][f]]
                alone = sum(sum(fails[k].values()) == 1 for k in failing)
                lost = [sum(rows[k][0] in who for k in gone) for who in (good, toxic)]
                out.append(((part, "".join(order), step), (len(left), len(gone), len(failing) - len(gone), alone, *lost)))
                shapley[part, f] += len(gone)
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out}


def as_dict(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in names) for r in rows}
    assert len(found) == len(rows)
    return found


def test_merges_equal_numpy():
    rng = np.random.default_rng(3)
    for _ in range(300):
        lists = [np.unique(rng.integers(0, rng.integers(1, 60), rng.integers(0, 40))) for _ in range(rng.integers(0, 6))]
        want = np.unique(np.concatenate([*lists, np.empty(0, np.int64)]))
        block = int(rng.integers(1, 9))
        assert fa.union(lists, block).tolist() == fa.union(lists).tolist() == want.tolist()
        a = np.unique(rng.integers(0, 50, rng.integers(0, 40)))
        assert fa.difference(a, want, block).tolist() == fa.difference(a, want).tolist() == np.setdiff1d(a, want).tolist()
    long = np.arange(0, 10_000, 3)
    assert fa.gallop(long, 3000, 0) == 1000 and fa.gallop(long, 3001, 5) == 1001 and fa.gallop(long, 10**6, 7) == len(long)


def test_audit_of_odd_rows(spark):
    rng = random.Random(5)
    long = " ".join(f"w{k}" for k in range(250))
    texts = [None, "", " \t\x0b", "AB cd", long, long + " #", "same " * 300, "Ünïcödé " * 10, "x|y", long.upper(), "a b " * 120, "w" * 200_000]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "s1", "s2", "it's"]), "x") for _ in range(150)]
    docs += docs[:20]  # repeated rows
    labels = [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, source string, part string")  # a clashing name
    for c in ("n", "good", "least", "sha", "_part"):
        table = table.withColumn(c, table["doc_id"])
    said = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    want = plain([d[:3] for d in docs], labels)
    assert as_dict(fa.audit(table, said)) == want
    assert as_dict(fa.audit(table, said, range_rows=7)) == want  # many ranges
    assert fa.audit(table.limit(0), said).count() == 0
    assert as_dict(fa.audit(table, said.limit(0))) == plain([d[:3] for d in docs], [])


def test_query_equals_plain_version_and_sql(spark):
    got = fa.op12_filter_audit(spark, FOLDER)
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert as_dict(got) == plain(docs, labels)
    cur = duck(FOLDER).execute(fa.ORACLES["op12_filter_audit"])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert compare(rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(names, cur.fetchall()), names) is None
