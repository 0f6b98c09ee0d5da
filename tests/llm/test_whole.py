"""Cases that a shortened version of a text operator misses."""

import random
import zlib

from barloom.llm import langid, line_chunks, mixing


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n))


def test_line_dedup_cuts_passages_wherever_they_start(spark):
    rng = random.Random(1)
    inside = ". ".join(words(rng, 14) for _ in range(5))  # sentences inside a paragraph
    short = "\n".join(words(rng, 12) for _ in range(5))  # short lines
    alone = words(rng, 54)  # one sentence
    tail = f"{words(rng, 52)}. {words(rng, 3)}. {words(rng, 4)}"  # short lines after a long one
    few = ". ".join(words(rng, 12) for _ in range(3))  # 36 words stay
    rows = []
    for passage in (inside, short, alone, tail, few):
        sep = "\n" if passage is short else ". "
        for _ in range(40):
            rows += [(2 * len(rows) + k, f"{words(rng, 9)}. {words(rng, 6)}{sep}{passage}{sep}{words(rng, 8)}. {words(rng, 5)}\n") for k in (0, 1)]
        got = {r.doc_id: r for r in line_chunks.dedup(spark.createDataFrame(rows[-80:], "doc_id bigint, text string")).collect()}
        kept = [passage in got[i].text for i, _ in rows[-80:]]
        if passage is few:
            continue
        assert kept == [True] + [False] * 79
        for i, text in rows[-79:]:
            own = text.replace(passage, "")
            assert sorted(own.replace(".", "").split()) == sorted(got[i].text.replace(".", "").split())


def test_line_dedup_keeps_one_copy_of_a_period(spark):
    line = "one two three four five six seven eight nine ten\n"
    got = line_chunks.windows((line * 12).splitlines())
    assert len(got) == 8
    text = "".join(f"{k} {line}" for k in range(5)) * 3
    kept = line_chunks.dedup(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().text
    assert kept == text[: len(text) // 3]


def test_mixing_hears_weak_words(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(2000):
        good = i % 2
        hint = "weak " if rng.random() < (0.3 if good else 0.7) else ""  # a likelihood ratio of 2.3
        docs.append((i, hint + words(rng, 3)))
        labels.append((i, good, 0))
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    model, chances = mixing.word_model(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = mixing.posteriors(docs, model, chances).join(docs, "doc_id").selectExpr("text like 'weak%' weak", "p_poor").groupBy("weak").avg("p_poor")
    poor = {r.weak: r["avg(p_poor)"] for r in got.collect()}
    assert abs(poor[True] - 0.7) < 0.06 and abs(poor[False] - 0.3) < 0.06


def test_language_model_has_all_counts_of_all_terms(spark):
    rows = [(i, "ja ja ja nein" if i % 2 else "oui oui oui non non ja", "de" if i % 2 else "fr") for i in range(60)]
    rows += [(100 + i, "x" * 90, "de") for i in range(5)]  # a long word is a word
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    seen = [r[1:] for r in rows if not zlib.crc32(str(r[0]).encode()) % 5 == 0]
    model = langid.fit(docs)
    words = ("ja", "nein", "oui", "non", "x" * 90)
    want = [[sum(t.split().count(w) for t, x in seen if x == lang) for lang in ("de", "fr")] for w in words]
    both = langid.Model(["de", "fr"], {0: dict(zip(words, want))})
    assert set(model.rows[0]) == set(words) and all(abs(model.word(w) - both.word(w)).max() < 1e-6 for w in words)
    assert want[0][1] > 0


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "½ ² ① Ⅷ 12"), (2, "½ja²nein① _ja_"), (3, "Ⅷ"), (4, "ª")], "doc_id bigint, text string")
    assert langid.words_of("½Ja²nein① _ja_ Ⅷ x2y") == ["ja", "nein", "ja", "x", "y"]
    model = langid.Model(["de", "fr"], {0: {"ja": [5, 0], "nein": [3, 0], "oui": [0, 6]}})
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert got[1] == got[3] == ("und", 0.0) and got[2][0] == "de" and got[2][1] > 0.5 and got[4][0] != "und"


def test_long_pre_tokens_count_like_the_library():
    import base64
    import time

    import public_tokenizers
    import sentencepiece

    from barloom.llm import token_counts

    path = public_tokenizers.path(token_counts.MODEL)
    model, vocabulary = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.load(path)
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (257, 8_000, 1_000_000)]
    texts += [base64.b64encode(rng.randbytes(300_000)).decode(), "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(200_000))]
    texts += [x * 30_000 for x in ("ab", "a", "-", "the", "= ", "ing+er")]
    texts += ["".join(rng.choice("a-= .,*#_/") * rng.randint(1, 40) for _ in range(rng.randint(10, 40))) for _ in range(400)]
    texts += ["".join(rng.choice(["the", "ing", "ation", "str", "://", "==", "--"]) * rng.randint(1, 9) for _ in range(100)) for _ in range(100)]
    start = time.time()
    assert token_counts.Counter(vocabulary).count(texts) == [len(x) for x in model.encode(texts, num_threads=1)]
    assert time.time() - start < 120


def test_pages_of_one_id_keep_their_own_payloads(spark, tmp_path):
    from hashlib import sha1

    from barloom.llm import warc_archive

    long = "<p>long</p>" * 200
    rows = [(1, "http://a.org/", "<p>one</p>"), (1, "http://a.org/", "<p>two</p>"), (1, "http://a.org/", long), (2, "http://a.org/", long), (1, "http://b.org/", None)]
    rows += [(7, "http://c.org/", f"<p>{k}</p>") for k in range(700)] + [(None, "http://a.org/", "x"), (None, "http://a.org/", "y"), rows[0]]
    got = warc_archive.archive_and_read(spark.createDataFrame(rows, "page_id bigint, url string, html string"), f"file://{tmp_path}/w").collect()
    want = [(p, len(h or ""), sha1((h or "").encode()).hexdigest(), "revisit" if h == long and p == 1 else "response", 2 if h == long and p == 1 else None) for p, _, h in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
