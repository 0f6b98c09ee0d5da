"""Each text operator against a plain version of what it promises."""

import gzip
import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from parity import duck, rows_of, compare

from barloom import llm
from barloom.llm import decontaminate, langid, line_chunks, link_graph, merkle, mixing, simhash_tiles, token_counts, warc_archive
from barloom.llm.common import components

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{FOLDER}/documents.parquet").sort_values("doc_id", ignore_index=True)


@pytest.mark.parametrize("name", list(llm.ORACLES))
def test_query_equals_sql(spark, name):
    df = llm.QUERIES[name](spark, FOLDER)
    cur = duck(FOLDER).execute(llm.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert compare(rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(cols, cur.fetchall()), cols) is None


def plain_fingerprint(text):
    words = text.encode().lower().split()
    runs = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    votes = [sum(xxhash.xxh64_intdigest(r, 42) >> k & 1 for r in runs) for k in range(64)]
    return sum(1 << k for k in range(64) if votes[k] * 2 > len(runs))


def plain_components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_fingerprints_and_groups(spark, docs):
    got = llm.QUERIES["op9_simhash_neardup"](spark, FOLDER).toPandas().sort_values("doc_id", ignore_index=True)
    fps = [plain_fingerprint(t) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{v:016x}" for v in fps]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert got.component_id.tolist() == [int(docs.doc_id[k]) for k in plain_components(len(fps), pairs)]


def test_fingerprint_hash_is_the_engine_hash(spark):
    assert spark.sql("select xxhash64('a b c') h").first().h == np.uint64(xxhash.xxh64_intdigest(b"a b c", 42)).astype(np.int64)


@pytest.mark.parametrize("tile_rows", [4, 32_768])
def test_tiles_find_every_close_pair(spark, tile_rows):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(150)]
    fps = set(base)
    for v in base[:40]:
        for _ in range(12):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                v ^= 1 << b
            fps.add(v)
    fps = sorted(fps)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    signed = [int(np.uint64(v).astype(np.int64)) for v in fps]
    got = simhash_tiles.close_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), 3, tile_rows).collect()
    place = {v: k for k, v in enumerate(signed)}
    assert plain_components(len(fps), pairs) == plain_components(len(fps), [(place[r.a], place[r.b]) for r in got])


def test_blocks_of_far_sub_tiles_are_skipped_without_loss():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    b = np.concatenate([a[:50] ^ np.uint64(5), rng.integers(0, 1 << 63, 650).astype(np.uint64)])
    i, j = simhash_tiles._close(a, b, 3, block=64)
    x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= 3)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(x.tolist(), y.tolist()))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_line_chunks_cover_the_text_and_resist_shifts(docs):
    for t in docs.text:
        spans = line_chunks.cut(t)
        assert "".join(t[a:b] for a, b, _ in spans) == t
    text = "".join(f"Line {k} says {k * k}.\n" for k in range(400))
    old = [text[a:b] for a, b, _ in line_chunks.cut(text)]
    new = [("Inserted.\n" + text)[a:b] for a, b, _ in line_chunks.cut("Inserted.\n" + text)]
    assert len(set(old) & set(new)) >= 0.9 * len(old)


def plain_lines(t):
    """(start, end, stripped line) of the lines with text; white space alone belongs to the line before."""
    out, at = [], 0
    for piece in re.findall(r"(?s).*?(?:\n+|(?<=\w)[.!?][ \t]+|\Z)", t):
        if piece.strip():
            out.append([at if out else 0, at + len(piece), piece.strip()])
        elif out:
            out[-1][1] = at + len(piece)
        at += len(piece)
    return out


def plain_dedup(texts):
    """Texts by id -> texts without later copies of repeated chunks, and of runs of lines of 50 words, by plain search."""
    units = {}  # (id, kind, start, end) -> (what is equal, lines, words)
    for i, t in texts.items():
        lines = plain_lines(t or "")
        words = [len(x.split()) for _, _, x in lines]
        for a, b, n in line_chunks.cut(t or ""):
            units[i, 0, a, b] = (t[a:b].strip(), n, len(t[a:b].split()))
        runs = set()
        for k in range(len(lines)):
            ends = [e for e in range(k + 1, len(lines) + 1) if sum(words[k:e]) >= 50]
            firsts = [f for f in range(k + 1) if sum(words[f : k + 1]) >= 50]
            runs |= {(k, e) for e in ends[:1]} | {(f, k + 1) for f in firsts[-1:]}
        for f, e in runs:
            units[i, 1, lines[f][0], lines[e - 1][1]] = (tuple(x for _, _, x in lines[f:e]), e - f, 0)
    first, count = {}, {}
    for place in sorted(units, key=lambda p: (p[0], p[2], p[3])):
        key = (place[1], units[place][0])
        first.setdefault(key, place)
        count[key] = count.get(key, 0) + 1
    out = dict(texts)
    for i, t in texts.items():
        own = {p: first[p[1], units[p][0]] for p in units if p[0] == i and count[p[1], units[p][0]] > 1}
        big = {p for p, f in own.items() if p[1] == 0 and f != p and (units[p][1] > 1 or units[p][2] >= 50)}
        chunks = sorted(p for p in own if p[1] == 0)
        gone = set(big)
        for x, y in zip(chunks, chunks[1:]):  # a single line next to a chunk that repeats the same first document
            if x[3] == y[2] and own[x][0] == own[y][0]:
                gone |= {p for p, q in ((x, y), (y, x)) if q in big and own[p] != p}
        for p, f in own.items():
            if p[1] == 1 and f != p and not (f[0] == i and p[2] < f[3]):
                gone.add(p)
        if gone:
            cut = set().union(*(range(p[2], p[3]) for p in gone))
            out[i] = "".join(c for k, c in enumerate(t) if k not in cut)
    return out


def test_line_dedup_of_many_small_texts(spark):
    """Passages, shared lines and periods out of a few words, so that most lines repeat somewhere."""
    rng = random.Random(11)
    for trial in range(6):
        pool = [" ".join(rng.choice("ab cd ef gh".split()) + str(rng.randint(0, 5)) for _ in range(rng.randint(1, 14))) for _ in range(25)]
        seps = [". ", "\n", "\n\n", "! ", " \n ", "?\t"]
        texts = {}
        for i in range(60):
            at = rng.randrange(20)
            own = pool[at : at + rng.randint(0, 15)] if rng.random() < 0.6 else rng.choices(pool, k=rng.randint(0, 12))
            own = own * rng.choice([1, 1, 1, 3])
            texts[i] = "".join(x + (rng.choice(seps) if trial % 2 else seps[(i + k) % 2]) for k, x in enumerate(own))
        texts |= {60: "", 61: " \n \n", 62: texts[3], 63: "\n" + texts[4] + "\n\n "}
        got = line_chunks.dedup(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
        assert {r.doc_id: r.text for r in got} == plain_dedup(texts)


def test_line_dedup_equals_plain_version(spark, docs):
    got = llm.QUERIES["op4_line_dedup"](spark, FOLDER).toPandas().set_index("doc_id").text.to_dict()
    assert got == plain_dedup(dict(zip(docs.doc_id, docs.text)))


def test_repeated_passage_is_kept_once(spark):
    passage = " ".join(f"Sentence number {k} of the passage goes on for some words." for k in range(8))
    rows = [(k, f"Own start {k} {k * 7}.\n{passage}\nOwn end {k * 13} here.") for k in range(1, 6)]
    got = line_chunks.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).toPandas().sort_values("doc_id")
    assert [passage in t for t in got.text] == [True] + [False] * 4
    assert all(f"Own start {k}" in t and f"Own end {k * 13}" in t for k, t in zip(got.doc_id, got.text))


def test_decontamination_equals_every_window(docs):
    items = pd.read_parquet(f"{FOLDER}/benchmark.parquet")
    index = decontaminate.ItemIndex(list(zip(items.item_id, items.text)))
    found = 0
    for text in docs.text:
        hashes, weight, _ = decontaminate.shingles(text)
        want = []
        for k in range(len(index.ids)):
            if np.isin(index.bags[k][0], hashes).any():
                span = min(max(int(index.words[k]) - 4, 1), len(hashes))
                best = max(decontaminate.weighted_jaccard(decontaminate._bag(hashes[s : s + span], weight[s : s + span]), index.bags[k]) for s in range(len(hashes) - span + 1))
                want += [index.ids[k]] if best >= 0.8 else []
        got = [m[0] for m in index.matches(text)]
        assert got == want
        found += len(got)
    assert found


def test_hamming_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    index = decontaminate.ItemIndex([(k, " ".join(f"w{rng.integers(9999)}" for _ in range(20))) for k in range(60)])
    probes = index.prints[rng.integers(0, 60, 300)].copy()
    for k in range(len(probes)):
        for b in rng.choice(64, rng.integers(0, 24), replace=False):
            probes[k] ^= np.uint64(1) << np.uint64(b)
    w, i = index.within(probes)
    x, y = np.nonzero(np.bitwise_count(probes[:, None] ^ index.prints[None, :]) <= index.radius)
    assert set(zip(w.tolist(), i.tolist())) == set(zip(x.tolist(), y.tolist()))


def test_language_accuracy_and_backoff(spark):
    got = llm.QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    true = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")[["doc_id", "lang"]]
    joined = got.merge(true, on="doc_id")
    part = joined[joined.held_out]
    assert len(joined) == len(true) and len(part) > 100 and (part.lang_pred == part.lang).mean() > 0.98
    model = langid.Model(["a", "b"], {0: {"hat": [9, 1], "mit": [1, 9]}, 3: {"<zu": [0, 5], "the": [5, 0]}, 1: {"z": [3, 3]}})
    assert model.predict("hat")[0] == "a" and model.predict("zum zug")[0] == "b" and model.predict("q")[1] == 0.5


def test_token_counts_equal_the_library(docs):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(token_counts.MODEL)
    library, counter = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.Counter(token_counts.load(path))
    rng = random.Random(3)
    texts = docs.text.tolist() + ["".join(rng.choice("ab  \n\t▁éßfi語😀.1</s><0x0A>the ing tion") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += ["", " ", "abab" * 400, "</s><unk>", "a\x00b"]
    assert counter.count(texts) == [len(x) for x in library.encode(texts, num_threads=1)]


def test_merkle_fingerprints(spark, docs):
    got = llm.QUERIES["op1_merkle"](spark, FOLDER).toPandas().sort_values("doc_id", ascending=False, ignore_index=True)
    texts = docs.text.tolist()[::-1]
    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        new = merkle.edited(t, after)
        a, b, c = (merkle.Tree(x).fingerprint() for x in (t, new, after))
        assert (got.fingerprint[k], got.edited_fingerprint[k]) == (a, b)
        assert (got.near_edited[k], got.near_next[k]) == (merkle.likeness(a, b), merkle.likeness(a, c))
    assert len(new) == len(t) and got.near_edited.mean() > 0.3 > got.near_next.mean()


def test_merkle_branches_locate_an_edit():
    a, b = "One two.\nThree four.\n\nFive six.\nSeven.", "One two.\nThree four.\n\nFive SIX.\nSeven."
    x, y = merkle.Tree(a).fingerprint(), merkle.Tree(b).fingerprint()
    assert merkle.changed_branches(x, y) == [(1, 0)] and merkle.changed_branches(x, x) == []
    assert 0 < merkle.likeness(x, y) < 1 == merkle.likeness(x, x)
    assert merkle.Tree("a\nb").root != merkle.Tree("b\na").root and merkle.likeness(merkle.Tree("a\nb").fingerprint(), merkle.Tree("b\na").fingerprint()) < 1


def test_page_rank_equals_power_iteration(spark):
    rng = np.random.default_rng(6)
    n, edges = 12, [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(0, 12, 40), rng.integers(0, 10, 40), rng.integers(1, 4, 40)) if a != b]
    w = np.zeros((n, n))
    for a, b, c in edges:
        w[a, b] += c
    base = np.zeros(n)
    base[[0, 3]] = 0.25, 0.75
    out, rank = w.sum(1, keepdims=True), base
    share = np.divide(w, out, out=np.zeros_like(w), where=out > 0)
    for _ in range(200):
        flow = 0.85 * rank @ share
        rank = flow + (1 - flow.sum()) * base
    frame = pd.DataFrame(edges, columns=["src", "dst", "n"]).astype({"src": str, "dst": str})
    seeds = spark.createDataFrame([("0", 1.0), ("3", 3.0)], "host string, weight double")
    got = {r.host: r.score for r in link_graph.page_rank(spark.createDataFrame(frame), seeds, steps=200, tolerance=1e-9).collect()}
    assert all(abs(got.get(str(k), 0.0) - rank[k]) < 1e-6 for k in range(n))


def test_archives_are_gzip_members_with_a_searchable_index(spark, tmp_path):
    rows = [(k, f"http://h{k % 7}.org/p/{k}", f"<p>{k}</p>" * (k % 200)) for k in range(3000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = f"file://{tmp_path}/w"
    got = warc_archive.archive_and_read(pages, folder).toPandas().set_index("page_id")
    assert len(got) == 3000 and got.payload_bytes.tolist() == [len(rows[k][2]) for k in got.index]
    archives = sorted((tmp_path / "w").glob("*.warc.gz"))
    records = sum(gzip.decompress(p.read_bytes()).count(b"WARC/1.1\r\n") for p in archives)
    assert archives and records == 3000 and not list((tmp_path / "w").glob(".*"))
    missing = spark.createDataFrame([("org,h1)/p/1", 2), ("", 1), ("zz", 1)], "key string, page_id bigint")
    blocks = sorted((tmp_path / "w").glob("index-*.gz"))
    files = []
    for p in blocks:
        first = __import__("json").loads((tmp_path / "w" / f"{p.name}.directory").read_text())[0][0]
        files.append((first[0], __import__("json").dumps(first[1:]), p.name))
    index = spark.createDataFrame(files, "key string, id string, file string")
    assert warc_archive.look_up(missing, index, folder).collect() == []


def test_mixing_meets_targets_and_drops_toxic(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(900):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 60))]
        toxic, poor = k % 10 == 0, k % 3 == 1
        words += ["vileword"] * 2 * toxic + ["###"] * 3 * poor
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, 0 if poor else 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = mixing.mix(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).toPandas().set_index("doc_id").sort_index()
    toxic = np.array([x[2] for x in labels], bool)
    assert (got.rate[toxic] == 0).mean() > 0.97 and (got.rate[~toxic] > 0).mean() > 0.99
    total = got.tokens.sum()
    for d, share in mixing.TARGETS.items():
        assert abs((got.tokens * got[f"p_{d}"] * got.rate).sum() / total - share) < 0.03


def test_rates_equal_a_plain_descent(spark):
    rng = np.random.default_rng(8)
    p = rng.dirichlet([1, 1, 1], 200)
    t = rng.integers(1, 50, 200).astype(float)
    frame = pd.DataFrame(p, columns=["p_good", "p_poor", "p_toxic"]).assign(tokens=t)
    df = spark.createDataFrame(frame)
    targets = {"good": 0.6, "poor": 0.3, "toxic": 0.1}
    got = mixing.fit_rates(df, targets).toPandas()
    p, t = got[["p_good", "p_poor", "p_toxic"]].to_numpy(), got.tokens.to_numpy()
    goal, rate = t.sum() * np.array([0.6, 0.3, 0.1]), np.ones(len(t))
    second = (p * t[:, None]).T @ p
    for _ in range(20_000):
        rate = np.maximum(0, rate - p @ np.linalg.solve(second, (t * rate) @ p - goal))
    loss = lambda r: ((t * r) @ p - goal) @ np.linalg.solve(second, (t * r) @ p - goal)
    assert (got.rate >= 0).all() and abs(loss(got.rate.to_numpy()) - loss(rate)) < 1e-6 * t.sum()
    assert np.abs((t * got.rate.to_numpy()) @ p - (t * rate) @ p).max() < 1e-4 * t.sum()

    # targets that cannot be met: the least gap, as long plain descent finds it; equal posteriors have one rate
    q = p * 0.2 + 0.8 * np.array([0.2, 0.3, 0.5])
    frame = pd.concat([pd.DataFrame(q, columns=["p_good", "p_poor", "p_toxic"]).assign(tokens=t)] * 2, ignore_index=True)
    got = mixing.fit_rates(spark.createDataFrame(frame), {"good": 0.9, "poor": 0.1, "toxic": 0.0}).toPandas()
    p, t = got[["p_good", "p_poor", "p_toxic"]].to_numpy(), got.tokens.to_numpy()
    goal, rate = t.sum() * np.array([0.9, 0.1, 0.0]), np.ones(len(t))
    second = (p * t[:, None]).T @ p
    for _ in range(20_000):
        rate = np.maximum(0, rate - p @ np.linalg.solve(second, (t * rate) @ p - goal))
    assert abs(loss(got.rate.to_numpy()) - loss(rate)) < 1e-4 * loss(rate)
    assert (got.groupby(["p_good", "p_poor", "p_toxic"]).rate.nunique() == 1).all()
    assert mixing.fit_rates(spark.createDataFrame(frame.head(0), "p_good double, p_poor double, p_toxic double, tokens bigint"), targets).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    last = cp.run(spark, FOLDER).toPandas()
    assert last.columns[:5].tolist() == docs.columns and last.doc_id.is_unique and (last.rate > 0).all()
    kept = cp.language_id(spark, docs, FOLDER)
    assert kept.count() == docs.count()  # all have letters of a learned language
    deduped = cp.line_dedup(spark, kept, FOLDER)
    texts = {r.doc_id: r.text for r in kept.collect()}
    got = {r.doc_id: (r.text, r.n_chars) for r in deduped.collect()}
    want = plain_dedup(texts)
    assert {k: v[0] for k, v in got.items()} == want and all(n == len(t) for t, n in got.values())
    near = {r.doc_id for r in cp.near_dedup(spark, kept, FOLDER).collect()}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(ids)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert near == {ids[k] for k in set(plain_components(len(ids), pairs))}
    leaks = {r.doc_id for r in decontaminate.matches(kept, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert leaks and {r.doc_id for r in cp.decontamination(spark, kept, FOLDER).collect()} == set(ids) - leaks
