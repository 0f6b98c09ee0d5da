"""Odd rows through every text operator: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

from barloom.llm import decontaminate, langid, licenses, line_chunks, link_graph, merkle, mixing, simhash_tiles, token_counts, warc_archive

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = "The quick brown fox jumps over the lazy dog. It was a fine day in the middle of June. Nobody had seen it coming at all.\n"
LONG = "word " * 30_000 + "\n" + "ab" * 40_000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, PROSE * 3, "en", "a", 1),
        (2, PROSE * 3, "en", "a", 1),
        (2, PROSE * 3, "en", "a", 1),
        (2, "another text under the same id", "en", None, None),
        (3, None, "en", "b", None),
        (4, "", "fr", "b", 0),
        (5, " \n\t ", None, "b", 4),
        (6, LONG, "fr", "b", len(LONG)),
        (None, "le chat est sur la table", "fr", "c", 3),
        (None, None, None, None, None),
        (8, "12 34 !! ##", "en", "c", 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = ("row", "fp", "hi", "lo", "start", "spans", "tokens", "rate", "tie", "score", "lang_pred", "_doc", "_row", "removed_chunks", "part", "words")
    for c in clashing:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def by_id(df, column):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r[column])
    return out


def test_simhash(odd, none):
    got = by_id(simhash_tiles.near_duplicates(odd), "component_id")
    assert got[1] == [1] and sorted(got[2]) == [1, 1, 2]
    assert got[3] == got[4] == got[5] == [3] and got[None].count(3) == 1 and sum(map(len, got.values())) == odd.count()
    assert by_id(simhash_tiles.near_duplicates(odd), "fingerprint")[4] == ["0" * 16]
    assert simhash_tiles.near_duplicates(none).collect() == []
    first = simhash_tiles.first_of_groups(odd)
    assert first.columns == odd.columns
    assert sorted(((r.doc_id, r.text) for r in first.collect()), key=str)[0] == (1, PROSE * 3) and first.where("text = '" + (PROSE * 3).replace("\n", "\\n") + "'").count() == 1
    assert simhash_tiles.first_of_groups(none).collect() == []


def test_line_dedup(odd, none):
    got = line_chunks.dedup(odd)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and got.count() == odd.count()
    texts = by_id(got, "text")
    assert texts[1][0].startswith("The quick") and texts[3] == [None] and texts[4] == [""] and texts[6] == [LONG]
    assert sorted(texts[2]) == sorted(["", "", "another text under the same id"])
    assert line_chunks.dedup(none).collect() == []


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "quick BROWN fox jumps over the lazy dog it was"), (1, None), (None, "le chat est sur la table"), (3, ""), (4, "!!")], "item_id bigint, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.matches(odd, items).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 1), (None, None)], key=str)
    assert sorted(by_id(decontaminate.clean(odd, items), "doc_id"), key=str) == sorted([2, 3, 4, 5, 6, 8, None], key=str)
    assert decontaminate.clean(odd, items).columns == odd.columns
    assert decontaminate.matches(odd, items.limit(0)).collect() == [] and decontaminate.matches(none, items).collect() == []
    assert decontaminate.clean(odd, items.limit(0)).count() == odd.count()
    small = decontaminate.matches(odd, items, per_pass=1)
    assert small.count() == 4


def test_language(odd, none):
    model = langid.fit(odd)
    got = langid.identify(odd, model)
    assert got.count() == odd.count() and got.columns[-2:] == ["lang_pred", "score"]
    preds = by_id(got, "lang_pred")
    assert preds[3] == preds[4] == preds[5] == preds[8] == ["und"] and set(preds[1]) <= {"en", "fr"}
    assert all(0 <= r.score <= 1 for r in got.collect())
    nothing = langid.identify(odd, langid.fit(none))
    assert set(r.lang_pred for r in nothing.collect()) == {"und"}
    assert langid.identify(none, model).collect() == []


def test_mixing(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (6, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = mixing.mix(odd, labels).collect()
    assert len(got) == 10  # one row per different row
    assert all(r.rate >= 0 and abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-9 for r in got)
    assert mixing.mix(none, labels).collect() == []
    assert mixing.mix(odd, labels.limit(0)).count() == 10


def test_merkle(odd, none):
    got = merkle.compare_to_following(odd)
    assert got.count() == odd.count()
    prints = by_id(got, "fingerprint")
    assert prints[3] == prints[4] and prints[1][0] in prints[2] and prints[1] != prints[5]
    assert merkle.compare_to_following(none).collect() == []
    alone = merkle.compare_to_following(odd.where("doc_id = 1")).first()
    assert alone.near_next == 1.0 and alone.n_chars == 3 * len(PROSE)


def test_tokens(odd, none):
    import public_tokenizers

    vocabulary = token_counts.load(public_tokenizers.path(token_counts.MODEL))
    got = token_counts.token_counts(odd, vocabulary)
    n = by_id(got, "n_tokens")
    assert got.count() == odd.count() and n[3] == n[4] == [0] and by_id(got, "over_limit")[6] == [True]
    assert token_counts.token_counts(none, vocabulary).collect() == []


def test_licences(odd, none, spark):
    got = licenses.scan(odd)
    assert got.count() == odd.count() and set(by_id(got, "n_matches")[3]) == {0}
    assert licenses.scan(none).collect() == []
    texts = [(1, "intro\nreleased under THE mit license\nmore"), (2, "All rights\nreserved"), (3, "Released under the licence")]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert (rows[1].license, rows[1].dice, rows[1].unit, rows[1].unit_no) == ("MIT", 1.0, "line", 2)
    assert (rows[2].license, rows[2].unit) == ("proprietary", "block") and rows[3].license is None


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("x")).withColumn("key", F.lit("x"))


def test_urls(spark):
    rows = [
        (1, "HTTP://WWW.Example.ORG/es/1?x", None),
        (2, "http://example.org", ""),
        (3, None, "x"),
        (4, "no scheme", "x"),
        (5, "http://a.com/fr/1", '<a href="http://friend.net/">'),
        (6, "http://b.com/de/1", "x"),
        (7, "http://friend.net/x", "x"),
        (8, "http://fan.net/x", "<a href='//b.com/de/1'>"),
        (8, "http://fan.net/x", "<a href='//b.com/de/1'>"),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in link_graph.judge_urls(pages(spark, rows)).collect()}
    assert got[1] == ("www.example.org", "/es/1", "example.org/es/", "block") and got[2] == ("example.org", "", None, "allow")
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5][2:] == ("com/fr/", "allow") and got[6][2:] == ("com/de/", "block")
    assert got[7][3] == "allow" and got[8][3] == "block"  # it links to a blocked host
    assert link_graph.judge_urls(pages(spark, rows)).count() == len(rows)
    assert link_graph.judge_urls(pages(spark, rows[:0])).collect() == []


def test_warc(spark):
    big = "<p>é</p>\r\n\r\n" * 200
    rows = [(1, "http://x.org/a", big), (5, "http://x.org/b", big), (7, None, big), (7, None, big), (8, "http://y.org/\r\nq", "s"), (9, "http://y.org/", "s"), (10, "u", None), (None, None, "z"), (11, "", "")]
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc_archive.archive_and_read(pages(spark, rows)).collect()), key=str)
    size = len(big.encode())
    want = [(1, size, "revisit", 7), (5, size, "revisit", 7), (7, size, "response", None), (7, size, "response", None), (8, 1, "response", None), (9, 1, "response", None), (10, 0, "response", None), (None, 1, "response", None), (11, 0, "response", None)]
    assert got == sorted(want, key=str)
    assert warc_archive.archive_and_read(pages(spark, rows[:0])).collect() == []
