"""Steps that must not grow faster than the input: what they leave out is the large intermediate table, never a row of the result."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import codecs as C
from tessera.functions import text
from tessera.operators import boolean, counting, index, langid, ranking

TEXTS = [(1, "bb aa bb cc"), (2, ""), (3, None), (4, "cc dd dd aa dd"), (5, "ee")]
def words():
    return text.letter_words(F.col("text"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_slices(monkeypatch):
    monkeypatch.setattr(counting, "AT_ONCE", 3)


def test_bottom_terms_build_no_postings_in_ranges(spark, tmp_path):
    from tessera.plans import catalogue

    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.queries()["bottom10_terms"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [("ee", 1), ("cc", 2), ("bb", 2), ("aa", 2), ("dd", 3)]
    assert set(catalogue.stored(spark, str(tmp_path))) == {"by_doc", "vocab"}


@pytest.mark.parametrize("twice", [False, True])
def test_words_are_counted_inside_documents(spark, small_slices, twice):
    rows = TEXTS + [(1, "aa zz"), (None, "zz"), (None, "zz yy")] if twice else TEXTS
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = counting.words_by_document(docs, words())
    assert ("Exchange" in plan(got)) == twice
    want, length = Counter(), Counter()
    for d, t in rows:
        for w in (t or "").split():
            want[w, d] += 1
            length[d] += 1
    assert {(r.term, r.doc_id): (r.tf, r.dl) for r in got.collect()} == {(w, d): (n, length[d]) for (w, d), n in want.items()}
    if not twice:
        assert {(r.term, r.pos) for r in got.where("doc_id = 4").collect()} == {("cc", 0), ("dd", 1), ("aa", 3)}


def test_words_are_found_in_bytes_as_the_analysis_finds_them(spark, monkeypatch):
    rng = random.Random(3)
    alphabet = "abzÁáéñüÑ" + "ßàÿçİıſKœ\u0301\u00ad\U0001F600 \t\n.,-'09" + "\u0101\u20ac\u4e2d"
    rows = [(i, "".join(rng.choice(alphabet if i % 2 else "aá b") for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "ab"), (1003, "cd"), (1004, "ñ"), (1005, "ñá"), (1006, "x" * 23), (1007, "é" * 23), (1008, "é" * 24), (1009, "x" * 24 + " ok"), (1010, "end"), (1011, "É"), (1012, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    analysis = text.analyzed(text.letter_words(F.col("text")))
    want = sorted(tuple(r) for r in counting.words_by_row(docs, analysis).collect())
    assert len(want) > 500
    for at_once in (1, 50, 1_000_000):
        monkeypatch.setattr(counting, "AT_ONCE", at_once)
        got = counting.letter_words_by_row(docs)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert "regexp" not in plan(counting.words_by_document(docs))


def test_term_ids_by_hashing(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    stored = counting.words_by_document(docs, words())
    got = index.term_ids_of(stored)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in index.term_ids(index.tokens(docs, words())).collect()}
    assert [r.term for r in got.orderBy("term_id").collect()] == ["bb", "aa", "cc", "dd", "ee"]


def test_common_terms_are_broadcast_and_rare_ones_joined(spark, monkeypatch):
    postings = index.postings_of(spark.createDataFrame(TEXTS, "doc_id long, text string"), words())
    vocab = index.vocabulary(postings).select("term", "df")
    monkeypatch.setattr(index, "COMMON_TERMS", 5)  # 7 pointers: terms of one document are rare
    got = index.with_terms(postings, vocab)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in postings.join(vocab, "term").collect())
    assert "Broadcast" in plan(got) and "Union" in plan(got)


def test_hits_are_grouped_where_their_documents_are(spark):
    postings = index.postings_of(spark.createDataFrame(TEXTS, "doc_id long, text string"), words())
    queries = spark.createDataFrame([("q", "aa", 1, 0), ("q", "cc", 2, 1), ("r", "dd", 1, 0), ("r", "none", 1, 1)], "qid string, term string, qtf long, first_at int")
    hits = ranking.matches(postings, queries, index.vocabulary(postings), F.lit(5))
    scored = ranking.count_scores(hits, "daat", 20)
    assert sorted((r.qid, r.doc_id, r.score) for r in scored.collect()) == [("q", 1, 3.0), ("q", 4, 3.0), ("r", 4, 1.0)]
    log = spark.createDataFrame([(1, ["aa", "cc"]), (2, ["aa", "none"]), (3, ["ee", "aa"])], "qid long, terms array<string>")
    batch = boolean.batch(postings, log, "or", index.vocabulary(postings))
    assert sorted(tuple(r) for r in batch.collect()) == [(1, 1), (1, 4), (3, 1), (3, 4), (3, 5)]
    for df in (scored, batch):
        dealt = [x for x in plan(df).split("Exchange hashpartitioning(")[1:]]
        assert not [x for x in dealt if x.startswith("qid") and "doc_id" in x.split(")")[0]]


def dealt_by_document(df):
    return [int(n) for n in re.findall(r"Exchange hashpartitioning\(doc_id#\d+L?, (\d+)\), REPARTITION", plan(df))]


@pytest.fixture
def asked_often(spark, tmp_path):
    """20 documents that each of 30 queries meets."""
    spark.createDataFrame([(i, f"aa bb {'aa ' * (i % 3)}cc", "en", "s", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, "aa bb cc none") for i in range(30)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["bm25_whole", "daat_count"])
def test_pairs_in_a_task_do_not_grow_with_the_queries(spark, asked_often, monkeypatch, name):
    from tessera.plans import catalogue

    few = catalogue.queries()[name](spark, asked_often)
    monkeypatch.setattr(ranking, "PAIRS_AT_ONCE", 50)
    many = catalogue.queries()[name](spark, asked_often)
    assert dealt_by_document(few) == [4] and dealt_by_document(many) == [12]  # 30 queries meet 20 documents each
    assert sorted(tuple(r) for r in many.collect()) == sorted(tuple(r) for r in few.collect()) and few.count() == 30 * (10 if name == "bm25_whole" else 20)


def test_character_pairs_are_counted_inside_texts(spark, small_slices):
    rows = [(1, "abab"), (2, "a\U0001F600a"), (3, None), (4, "x"), (5, "ab")]
    df = spark.createDataFrame(rows, "id long, text string")
    want = Counter((i, a, b) for i, t in rows for a, b in zip(t or "", (t or "")[1:]))
    assert {(r.id, r.a, r.b): r.n for r in counting.character_pairs(df, "id", F.col("text")).collect()} == dict(want)
    train = spark.createDataFrame([("en", "abab"), ("es", "baaabbb")], "lang string, text string")
    scores = langid.chain_scores(train, df)
    assert {(r.id, r.lang): r.unseen for r in scores.collect()}[(1, "en")] == 0 and scores.count() == 10
    assert not [x for x in plan(scores).split("Exchange hashpartitioning(")[1:] if x.startswith("id") and "a#" in x.split(")")[0]]


def test_gaps_are_summed_by_one_pass(spark):
    ids = list(range(0, 9000, 3))
    packed = C.compress_index(spark.createDataFrame([("t", ids, [1] * len(ids), len(ids))], "term string, docid array<long>, freq array<long>, df long"))
    back = C.decompress_index(packed)
    assert back.first().docid == ids
    assert "lambda" not in plan(back)
