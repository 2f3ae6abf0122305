"""Operators of the text engine on small literal inputs, worked out by hand, and by properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import codecs as C
from tessera.functions import stemmers, text
from tessera.operators import boolean, evaluation, graph, index, langid, laws, prefix, ranking, skips, web
from tessera.sources import readers, writers


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "casa perro casa", "doc1"), (2, "auto casa", "doc2"), (3, "gato perro", "doc3")], "doc_id long, text string, name string")


@pytest.fixture(scope="module")
def postings(docs):
    return index.postings_of(docs, text.letter_words(F.col("text"))).cache()


def ids(df, column="doc_id"):
    return [r[column] for r in df.collect()]


def test_postings_and_statistics(docs, postings):
    assert {(r.term, r.doc_id, r.tf) for r in postings.collect()} == {("casa", 1, 2), ("casa", 2, 1), ("perro", 1, 1), ("perro", 3, 1), ("auto", 2, 1), ("gato", 3, 1)}
    tokens = index.tokens(docs, text.letter_words(F.col("text")))
    vocab = index.term_ids(tokens).join(index.vocabulary(postings), "term")
    assert [(r.term, r.seek) for r in index.seeks(vocab).orderBy("term_id").collect()] == [("casa", 0), ("perro", 16), ("auto", 32), ("gato", 40)]
    c = index.collection(docs, postings).first()
    assert (c.n_docs, c.n_tokens, c.n_terms) == (3, 7, 4)


def test_stored_index_round_trip(docs, postings, spark, tmp_path):
    index.write_index(postings, docs, str(tmp_path / "ix"))
    t = index.read_index(spark, str(tmp_path / "ix"))
    assert sorted(t["postings"].collect()) == sorted(postings.collect())
    assert [r.line for r in writers.posting_lines(index.posting_lookup(t["postings"], docs, "casa")).collect()] == ["doc1:1:2", "doc2:2:1"]


@pytest.mark.parametrize("query, want", [
    ("((casa AND perro) OR casa)", [1, 2]), ("(casa AND auto)", [2]), ("((casa AND auto) OR gato)", [2, 3]), ("NOT casa", [3]),
    ("casa AND NOT perro", [2]), ("nada", []), ("NOT (casa OR gato)", []), ("", []), ("casa OR gato AND perro", [1, 3]),
])
def test_boolean_queries(docs, postings, query, want):
    assert ids(boolean.evaluate(postings, docs, query)) == want


@pytest.mark.parametrize("query", ["casa perro", "NOT NOT casa", "casa AND", "AND casa"])
def test_boolean_errors(docs, postings, query):
    with pytest.raises(ValueError):
        boolean.evaluate(postings, docs, query)


def test_skip_lists(spark):
    perro = [7, 18, 31, 52, 60, 83, 104, 135]
    casa = [3, 5, 7, 12, 18, 20, 25, 31, 37, 45, 50, 52, 55, 60, 68, 75, 83, 90, 104, 110, 120, 135, 150, 180]
    p = spark.createDataFrame([("perro", d, 1) for d in perro] + [("casa", d, 1) for d in casa], "term string, doc_id long, tf long")
    blocks = skips.skip_blocks(p.where("term = 'casa'")).orderBy("block").collect()
    assert [(r.max_doc_id, r.start) for r in blocks] == [(12, 0), (31, 4), (52, 8), (75, 12), (110, 16), (180, 20)]
    got = skips.skip_and(p, "perro", "casa").orderBy("doc_id").collect()
    assert [r.doc_id for r in got if r.found] == perro


def test_evaluation_worked_example(spark):
    rel = [1, 0, 0, 1, 1, 0, 0, 0, 0, 1, 0, 0, 0, 1, 0]
    run = spark.createDataFrame([("q", i, i + 1) for i in range(15)], "qid string, doc_id long, rank int")
    qrels = spark.createDataFrame([("q", i, r) for i, r in enumerate(rel) if r] + [("q", 100 + i, 1) for i in range(6)], "qid string, doc_id long, label int")
    m = evaluation.measures(run, qrels).first()
    assert (m.p_cut, m.rr) == (0.4, 1.0)
    assert m.ap == pytest.approx((1 + 2 / 4 + 3 / 5 + 4 / 10 + 5 / 14) / 11) and m.r_cut == m.r_precision == pytest.approx(4 / 11)
    assert 0 < m.ndcg_cut <= 1
    levels = [r.precision for r in evaluation.interpolated(evaluation.at_rank(run, qrels), ["qid"]).orderBy("level").collect()]
    assert levels == pytest.approx([1.0, 0.6, 0.6, 0.4, 5 / 14, 0, 0, 0, 0, 0, 0])


def test_codec_values():
    assert [C.vbyte_encode([n]).hex() for n in (0, 5, 127, 128, 824)] == ["80", "85", "ff", "0180", "06b8"]
    assert [C.gamma_encode([n]) for n in (1, 2, 5, 9)] == [b"\x80", b"\x40", b"\x28", b"\x12"]
    assert C.gaps([7, 18, 31]) == [7, 11, 13] and C.ungaps([7, 11, 13]) == [7, 18, 31]
    with pytest.raises(ValueError):
        C.gamma_encode([0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2**40), max_size=40))
def test_codecs_round_trip(values):
    assert C.vbyte_decode(C.vbyte_encode(values)) == values
    assert C.gamma_decode(C.gamma_encode(values), len(values)) == values
    assert C.ungaps(C.gaps(sorted(values))) == sorted(values)


def test_compressed_index_round_trip(postings):
    lists = index.inverted_lists(postings)
    for d_gaps in (True, False):
        packed = C.compress_index(lists, d_gaps)
        back = {(r.term, tuple(r.docid), tuple(r.freq)) for r in C.decompress_index(packed, d_gaps).collect()}
        assert back == {(r.term, tuple(r.docid), tuple(r.freq)) for r in lists.collect()}
        assert {tuple(r) for r in C.fetch_posting(packed, "casa", d_gaps).collect()} == {(1, 2), (2, 1)}
        assert C.fetch_posting(packed, "nada", d_gaps).count() == 0


def test_typed_tokens(spark):
    df = spark.createDataFrame([("From Wikipedia, the free encyclopedia",)], "text string")
    assert df.select(text.analyzed(text.typed_tokens(F.col("text"))).alias("w")).first().w == ["From Wikipedia", "the", "free", "encyclopedia"]


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("generalizations", "gener"), ("adjustment", "adjust"), ("sky", "sky")])
def test_porter(word, stem):
    assert stemmers.porter(word) == stem


@pytest.mark.parametrize("word, stem", [("maximum", "maxim"), ("presumably", "presum"), ("multiply", "multiply"), ("saying", "say"), ("owed", "ow")])
def test_lancaster(word, stem):
    assert stemmers.lancaster(word) == stem


@pytest.mark.parametrize("word, stem", [("torneado", "torn"), ("chicas", "chic"), ("canciones", "cancion"), ("rápidamente", "rapid"), ("bibliotecas", "bibliotec")])
def test_spanish(word, stem):
    assert stemmers.spanish(word) == stem


def test_taat_and_daat_have_the_same_scores(spark, docs, postings):
    topics = ranking.query_terms(spark.createDataFrame([("q", "casa perro casa")], "qid string, text string"), text.letter_words(F.col("text")))
    hits = ranking.matches(postings, topics, index.vocabulary(postings), F.lit(3))
    a, b = ranking.count_scores(hits, "taat").collect(), ranking.count_scores(hits, "daat").collect()
    assert {(r.doc_id, r.score) for r in a} == {(r.doc_id, r.score) for r in b} == {(1, 3.0), (2, 2.0), (3, 1.0)}


def test_url_functions(spark):
    rows = [("https://www.google.com/search", "www.google.com", 1), ("https://example.com/a/b/c", "example.com", 3), ("https://example.com/", "example.com", 0)]
    df = spark.createDataFrame([(r[0],) for r in rows], "url string")
    assert [(r.h, r.d) for r in df.select(web.host(F.col("url")).alias("h"), web.physical_depth(F.col("url")).alias("d")).collect()] == [(r[1], r[2]) for r in rows]
    one = spark.createDataFrame([("http://posgrado.example.edu/x",), ("http://xexample.edu/",)], "url string")
    assert [r[0] for r in one.select(web.same_domain(F.col("url"), "example.edu")).collect()] == [True, False]
    assert web.normalize("http://a.b/c/d", "../e#f") == "http://a.b/e" and web.normalize("http://a.b/", "#x") is None and web.normalize("http://a.b/", "mailto:x") is None


def test_crawl_equals_a_sequential_one(spark):
    links = {f"http://s{i % 4}.org/p{i}": [f"http://s{j % 4}.org/p{j}" for j in (i * 3 % 17, i * 5 % 17, (i + 1) % 17)] for i in range(17)}
    edges = spark.createDataFrame([(u, k, v) for u, out in links.items() for k, v in enumerate(out)], "src string, pos int, dst string")
    seen, sites, queue, order = set(), {}, [("http://s0.org/p0", 0)], []
    while queue and len(order) < 9:
        u, depth = queue.pop(0)
        site = u.split("/")[2]
        if u in seen or depth > 2 or sites.get(site, 0) >= 3:
            continue
        seen.add(u)
        sites[site] = sites.get(site, 0) + 1
        order.append(u)
        queue += [(v, depth + (v.split("/")[2] != site)) for v in links[u]]
    got = web.crawl(edges, ["http://s0.org/p0"], max_logical=2, per_site=3, most=9)
    assert ids(got, "url") == order


def test_pagerank_and_hits_sum_to_one(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d")], "src string, dst string")
    ranks = {r.node: r.pagerank for r in graph.pagerank(edges).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and max(ranks, key=ranks.get) == "c"
    both = graph.hits(edges, 30).collect()
    assert sum(r.hub for r in both) == pytest.approx(1) and sum(r.authority for r in both) == pytest.approx(1)


def test_pagerank_and_hits_settle_where_power_iteration_does(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("e", "a"), ("e", "d"), ("a", "b")]
    names = sorted({x for e in edges for x in e})
    at = np.zeros((len(names), len(names)))
    for x, y in edges:
        at[names.index(x), names.index(y)] = 1
    out, rank = at.sum(1), np.full(len(names), 1 / len(names))
    for _ in range(500):
        rank = 0.5 / len(names) + 0.5 * (at.T @ (rank / np.maximum(out, 1)) + rank[out == 0].sum() / len(names))
    hub = np.ones(len(names))
    for _ in range(500):
        authority = at.T @ hub
        hub = at @ authority
        hub, authority = hub / hub.sum(), authority / authority.sum()
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r.node: r.pagerank for r in graph.pagerank(df, damping=0.5, tolerance=1e-6).collect()}
    assert [got[x] for x in names] == pytest.approx(rank.tolist(), abs=1e-5)  # a change below 6e-6 leaves an error below that, as each round halves it
    got = {r.node: (r.hub, r.authority) for r in graph.hits(df, tolerance=1e-4).collect()}
    assert [got[x][0] for x in names] == pytest.approx(hub.tolist(), abs=1e-3)
    assert [got[x][1] for x in names] == pytest.approx(authority.tolist(), abs=1e-3)


def test_running_sums_over_several_ranges(spark):
    rows = [(i * 37 % 101, f"k{i % 7}", None if i % 10 == 0 else i) for i in range(101)]
    df = spark.createDataFrame(rows, "k long, name string, n long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r.k, r.before, r.ones) for r in prefix.sums_before(df, ["k"], before=F.col("n"), ones=F.lit(1)).collect())
        falling = sorted((r.place, r.k) for r in prefix.numbered(df, [F.desc("k")], "place").collect())
        assert prefix.sums_before(df.where("k < 0"), ["k"], before=F.col("n")).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, want = 0, []
    for i, (k, _, n) in enumerate(sorted(rows)):
        want.append((k, total, i))
        total += n or 0
    assert got == want
    assert falling == [(i + 1, 100 - i) for i in range(101)]


def test_blocks_of_lists_compress_and_come_back(spark):
    df = spark.createDataFrame([("a", d, d % 5 + 1) for d in (0, 1, 7, 8, 15, 16, 900)] + [("b", 3, 2)], "term string, doc_id long, tf long")
    blocks = index.list_blocks(df, 8)
    assert {(r.term, r.block, tuple(r.docid), r.df) for r in blocks.collect()} == {("a", 0, (0, 1, 7), 3), ("a", 1, (8, 15), 2), ("a", 2, (16,), 1), ("a", 112, (900,), 1), ("b", 0, (3,), 1)}
    for d_gaps in (True, False):
        packed = C.compress_index(blocks, d_gaps)
        assert {tuple(r) for r in C.fetch_posting(packed, "a", d_gaps).collect()} == {(d, d % 5 + 1) for d in (0, 1, 7, 8, 15, 16, 900)}


def test_heaps_samples_and_language(spark):
    df = spark.createDataFrame([(1, "a b " * 60), (2, "c d " * 60)], "doc_id long, text string")
    assert [(r.n, r.v) for r in laws.heaps_samples(df, text.letter_words(F.col("text"))).orderBy("n").collect()] == [(100, 2), (200, 4)]
    train = spark.createDataFrame([("en", "the thing there"), ("es", "que quiero queso")], "lang string, text string")
    test = spark.createDataFrame([(1, "then the"), (2, "queseo"), (3, "")], "id long, text string")
    assert {r.id: r.lang for r in langid.by_correlation(train, test).collect()} == {1: "en", 2: "es", 3: None}
    train = spark.createDataFrame([("en", "abab"), ("es", "baaabbb")], "lang string, text string")
    test = spark.createDataFrame([(1, "abab"), (2, "aab")], "id long, text string")
    assert {r.id: r.lang for r in langid.by_chain(langid.chain_scores(train, test)).collect()} == {1: "en", 2: "es"}


def test_readers(spark, tmp_path):
    (tmp_path / "doc7.txt").write_text("hola\nmundo")
    assert [tuple(r) for r in readers.numbered_texts(spark, str(tmp_path)).collect()] == [(7, "hola\nmundo")]
    trec = tmp_path / "t"
    trec.mkdir()
    (trec / "a").write_text("<DOC><DOCNO> 1 </DOCNO>x\ny</DOC><DOC>z</DOC>")
    assert {tuple(r) for r in readers.trec_documents(spark, str(trec)).collect()} == {("1", "x\ny"), ("?", "z")}
    log = tmp_path / "q"
    log.mkdir()
    (log / "a").write_text("9968:casa perro\n\n9967:a:b\n")
    assert {tuple(r) for r in readers.query_log(spark, str(log)).collect()} == {(9968, "casa perro"), (9967, "a:b")}
    dump = tmp_path / "d"
    dump.mkdir()
    (dump / "a").write_text("t:_:3,1,\n")
    assert sorted((r.term, r.doc_id, r.tf) for r in readers.index_dump(spark, str(dump)).collect()) == [("t", 1, 1), ("t", 3, 1)]
    lines = tmp_path / "l"
    lines.mkdir()
    (lines / "es.txt").write_bytes("ñandú\n\n fin ".encode("latin-1"))
    assert [tuple(r) for r in readers.latin1_lines(spark, str(lines)).collect()] == [(1, "ñandú"), (3, "fin")]


def test_streamed_frequencies(spark, docs, tmp_path):
    from tessera.streaming import incremental

    src = str(tmp_path / "in")
    docs.repartition(3).write.parquet(src)
    stream = incremental.document_stream(spark, src, docs.schema, 1)
    incremental.write_frequencies(incremental.stream_frequencies(stream, text.letter_words(F.col("text"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {(r.term, r.df) for r in incremental.latest(spark, str(tmp_path / "out")).collect()} == {("casa", 2), ("perro", 2), ("auto", 1), ("gato", 1)}


def test_contract():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "daat_cosine_topk" in names and set(entry.oracle_sql()) <= set(names)


def test_whole_texts_rank_by_every_word(spark, tmp_path):
    from tessera.plans import catalogue

    texts = {1: "aa bb aa ff", 2: "hh gg hh ii", 3: "cc zz", 4: "zz yy", 5: "yy xx"}
    asked = "aa bb cc dd ee ff gg hh hh"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, asked)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = {k: [(r.doc_id, r.score) for r in catalogue.queries()[k](spark, str(tmp_path)).orderBy("rank").collect()] for k in ("daat_count_whole", "taat_count_whole", "daat_count")}
    assert run["daat_count_whole"] == run["taat_count_whole"] == [(1, 3.0), (2, 3.0), (3, 1.0)]
    assert run["daat_count"] == [(1, 3.0), (3, 1.0)]  # its SQL asks for six words
    for name in ("vsm_rank", *catalogue.MODELS):
        assert {r.doc_id for r in catalogue.queries()[f"{name}_whole"](spark, str(tmp_path)).collect()} == {1, 2, 3}
    (row,) = catalogue.queries()["query_length_stats_whole"](spark, str(tmp_path)).collect()
    assert (row.terms, row.min_postings) == (6, 6)
    assert not {k for k in catalogue.oracle_sql() if k.endswith("_whole")}


def test_links_by_a_parser(spark):
    markup = "<a href=plain.html>x</a><!-- <a href='no'> --><A HREF='../b?x=1&amp;y=2#f'>y</A><a name=z><a href=\"mailto:q@r\"><a href='#top'><a href=//h.org/p>"
    got = web.parsed_links(spark.createDataFrame([(1, "http://s.org/d/e/f.html", markup), (2, "http://s.org/", None)], "page_id long, url string, html string")).orderBy("pos").collect()
    assert [r.href for r in got] == ["plain.html", "../b?x=1&y=2#f", "mailto:q@r", "#top", "//h.org/p"]
    assert [r.target for r in got] == ["http://s.org/d/e/plain.html", "http://s.org/d/b?x=1&y=2", None, None, "http://h.org/p"]
    assert [r.simple for r in got] == ["http://s.org/d/e/plain.html", "http://s.org/d/b?x=1&y=2", "mailto:q@r", "http://s.org/d/e/f.html", "http://h.org/p"]


def test_block_sort_build_merges_to_the_postings(spark, docs, postings):
    ids = index.term_ids(index.tokens(docs, text.letter_words(F.col("text"))))
    runs = index.block_sort_tuples(postings, ids, index.block_sort_chunks(postings, 2))
    assert runs.select("chunk").distinct().count() > 1
    for part in runs.rdd.glom().collect():
        keys = [(r.chunk, r.term_id, r.doc_id) for r in part]
        assert keys == sorted(keys)
    merged = index.block_sort_merge(runs).collect()
    assert [(r.term_id, r.doc_id) for r in merged] == sorted((r.term_id, r.doc_id) for r in merged)
    names = {r.term_id: r.term for r in ids.collect()}
    assert {(names[r.term_id], r.doc_id, r.tf) for r in merged} == {(r.term, r.doc_id, r.tf) for r in postings.select("term", "doc_id", "tf").collect()}
    sizes = {r.percent: r.n_chunks for r in index.block_sort_sensitivity(postings).collect()}
    assert sizes[100] == 1 and all(sizes[a] >= sizes[b] for a, b in zip(sorted(sizes), sorted(sizes)[1:]))


def test_recall_at_several_cuts(spark):
    run = spark.createDataFrame([("m", "q", 1, 3.0, 1), ("m", "q", 2, 2.0, 2), ("m", "q", 3, 1.0, 3)], "name string, qid string, doc_id long, score double, rank int")
    judged = spark.createDataFrame([("q", 1, 1), ("q", 3, 1), ("q", 9, 1), ("q", 2, 0)], "qid string, doc_id long, label int")
    got = {r.cut: r.recall for r in evaluation.recall_at(run, judged, (1, 2, 3)).collect()}
    assert got == pytest.approx({1: 1 / 3, 2: 1 / 3, 3: 2 / 3})


def test_stop_words_and_stems_at_index_and_query_time_agree(spark):
    docs = spark.createDataFrame([(1, "the runners were running"), (2, "cats and a dog")], "doc_id long, text string")
    w = text.analyzed(text.letter_words(F.col("text"), text.ENGLISH), text.STOP_WORDS)
    kept = {(r.term, r.doc_id): r.tf for r in stemmers.stem_postings(index.postings_of(docs, w), "porter").collect()}
    assert kept == {("runner", 1): 1, ("run", 1): 1, ("cat", 2): 1, ("dog", 2): 1}
