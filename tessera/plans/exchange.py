"""Queries that write the driver's tables with a sink, or as files of a reader's format, and read them back.

Their SQL reads the tables themselves, so a reader or sink that loses or changes anything shows. Formats of one line a record carry whole
tables; formats of one file a document carry ``nation`` and ``region``, whose sizes never change.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import codecs as C
from tessera.functions import text as T
from tessera.operators import index, ranking
from tessera.sources import readers, writers
from tessera.storage import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_ONE_LINE = r"[\r\n\x0b\x0c\x85]"


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL of what it should give."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return put


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(rows: DataFrame, line: Column, name: str) -> str:
    """The path of a text table with a line per row."""
    path = _folder(rows.sparkSession, name)
    rows.select(line.alias("value")).write.text(path)
    return path


def _files(spark: SparkSession, files: Mapping[str, bytes], name: str) -> str:
    """The path of a folder with a few files, written by the driver into whatever store it is."""
    base = _folder(spark, name)
    for at, data in files.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{at}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(data))
        out.close()
    return base


def _nations(spark: SparkSession, d: str) -> list[tuple[int, str, int]]:
    return [(r.n_nationkey, r.n_name, r.n_regionkey) for r in _read(spark, d, "nation").collect()]  # 25 rows at every scale


# --- one file a document ---


@query("SELECT n_nationkey::BIGINT AS doc_id, n_name || chr(10) || n_regionkey AS text FROM nation")
def read_numbered_texts(spark, d):
    return readers.numbered_texts(spark, _files(spark, {f"doc{k}.txt": f"{n}\n{r}".encode() for k, n, r in _nations(spark, d)} | {"notes.md": b"no text file"}, "numbered"))


@query("SELECT 'n' || n_nationkey || '.txt' AS name, n_name AS text FROM nation")
def read_named_texts(spark, d):
    return readers.named_texts(spark, _files(spark, {f"n{k}.txt": n.encode() for k, n, _ in _nations(spark, d)}, "named"))


@query("SELECT 'r' || n_regionkey || '/n' || n_nationkey || '.html' AS path, n_name || ' & r' || n_regionkey AS text FROM nation")
def read_html_tree(spark, d):
    pages = {f"r{r}/n{k}.html": f"<html><script>no text</script><body><p> {n} </p><b>&amp; r{r}</b><!-- none --></body></html>".encode() for k, n, r in _nations(spark, d)}
    return readers.html_tree(spark, _files(spark, pages, "html")).select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), "text")


_MIXED = "'r' || n_regionkey || '/n' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.html' ELSE '.txt' END"


@query(f"SELECT row_number() OVER (ORDER BY {_MIXED}) AS doc_id, 'n' || n_nationkey AS name, n_name AS text FROM nation")
def read_mixed_tree(spark, d):
    files = {f"r{r}/n{k}.html": f"<p>{n}</p>".encode() for k, n, r in _nations(spark, d) if k % 2 == 0} | {f"r{r}/n{k}.txt": n.encode() for k, n, r in _nations(spark, d) if k % 2}
    return readers.mixed_tree(spark, _files(spark, files, "mixed")).select("doc_id", "name", "text")


@query("SELECT 'n' || n_nationkey AS docno, 'n' || n_nationkey || '.dat' AS filename, n_name AS text FROM nation")
def read_files_with_names(spark, d):
    rows = readers.files_with_names(spark, _files(spark, {f"a/n{k}.dat": n.encode() for k, n, _ in _nations(spark, d)}, "files"))
    return rows.withColumn("filename", F.regexp_extract("filename", r"([^/]+)$", 1))


@query("SELECT (2 * row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS line_no, 'ñandú é ' || n_name AS text FROM nation")
def read_latin1_lines(spark, d):
    text = "\r\n\r\n".join(f" ñandú é {n} " for _, n, _ in sorted(_nations(spark, d)))
    return readers.latin1_lines(spark, _files(spark, {"lines.txt": text.encode("latin-1")}, "latin1"))


@query("SELECT 'r' || r_regionkey AS lang, 'è ' || r_name AS text FROM region")
def read_latin1_training(spark, d):
    regions = _read(spark, d, "region").collect()  # 5 rows at every scale
    return readers.latin1_training(spark, _files(spark, {f"r{r.r_regionkey}.txt": f"è {r.r_name}".encode("latin-1") for r in regions}, "training"))


@query("SELECT string_agg(lower(n_name), chr(10) ORDER BY n_nationkey) AS text FROM nation")
def read_book(spark, d):
    return readers.book(spark, _files(spark, {"book.txt": "\n".join(n for _, n, _ in sorted(_nations(spark, d))).encode()}, "book"))


@query("SELECT 'n' || n_nationkey AS docno, CASE WHEN n_nationkey % 2 = 0 THEN 'http://r' || n_regionkey END AS url, n_name AS text FROM nation")
def read_records(spark, d):
    return readers.records(spark, [{"docno": f"n{k}", "text": n} | ({"url": f"http://r{r}"} if k % 2 == 0 else {}) for k, n, r in _nations(spark, d)])


# --- one line, or element, a record ---


@query("SELECT doc_id::VARCHAR AS docno, md5(coalesce(text, '')) AS text_md5 FROM documents")
def read_trec_documents(spark, d):
    line = F.concat(F.lit("<DOC>\n<DOCNO> "), F.col("doc_id").cast("string"), F.lit(" </DOCNO>"), F.coalesce("text", F.lit("")), F.lit("</DOC>"))
    rows = readers.trec_documents(spark, _lines(_read(spark, d, "documents"), line, "trec"))
    return rows.select("docno", F.md5(F.regexp_replace("text", r"\A\n", "").cast("binary")).alias("text_md5"))


@query("SELECT item_id::VARCHAR AS qid, trim(text) AS query FROM benchmark")
def read_trec_topics(spark, d):
    line = F.concat(F.lit("<top>\n<num>"), F.col("item_id").cast("string"), F.lit("</num>\n<title>"), "text", F.lit("</title>\n</top>"))
    return readers.trec_topics(spark, _lines(_read(spark, d, "benchmark"), line, "topics"))


@query("SELECT toxic::VARCHAR AS qid, 'D' || doc_id AS docno, quality AS label FROM labels")
def read_qrels(spark, d):
    line = F.concat_ws(" \t", F.col("toxic").cast("string"), F.lit("0"), F.concat(F.lit("D"), F.col("doc_id").cast("string")), F.col("quality").cast("string"))
    return readers.qrels(spark, _lines(_read(spark, d, "labels"), line, "qrels"))


@query("SELECT DISTINCT source AS term FROM documents WHERE source IS NOT NULL")
def read_stop_words(spark, d):
    return readers.stop_words(spark, _lines(_read(spark, d, "documents").where("source IS NOT NULL"), F.concat(F.lit(" "), "source", F.lit(" ")), "stop"))


@query(rf"SELECT item_id::INT AS qid, trim(regexp_replace(text, '{_ONE_LINE}', ' ', 'g')) AS query FROM benchmark")
def read_query_log(spark, d):
    line = F.concat(F.col("item_id").cast("string"), F.lit(":"), F.regexp_replace("text", _ONE_LINE, " "))
    return readers.query_log(spark, _lines(_read(spark, d, "benchmark"), line, "log"))


@query(rf"SELECT query, len(list_filter(regexp_split_to_array(query, '\s+'), lambda x: x <> ''))::INT AS n_terms FROM (SELECT trim(regexp_replace(text, '{_ONE_LINE}', ' ', 'g')) AS query FROM benchmark) WHERE query <> ''")
def read_plain_queries(spark, d):
    rows = readers.plain_queries(spark, _lines(_read(spark, d, "benchmark"), F.regexp_replace("text", _ONE_LINE, " "), "queries"))
    return rows.select("query", F.size("terms").alias("n_terms"))


@query("SELECT p_name AS term, unnest([p_partkey, p_partkey + 1])::BIGINT AS doc_id, 1::BIGINT AS tf FROM (SELECT DISTINCT s_name AS p_name, s_suppkey AS p_partkey FROM supplier)")
def read_index_dump(spark, d):
    rows = _read(spark, d, "supplier").select("s_name", "s_suppkey").distinct()
    line = F.concat("s_name", F.lit(":2:"), (F.col("s_suppkey") + 1).cast("string"), F.lit(","), F.col("s_suppkey").cast("string"), F.lit(","))
    return readers.index_dump(spark, _lines(rows, line, "dump"))


@query("SELECT c_custkey::DOUBLE AS n, c_nationkey::DOUBLE AS v FROM customer")
def numeric_pairs_there_and_back(spark, d):
    path = _folder(spark, "pairs")
    writers.pairs_lines(_read(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.col("c_nationkey").alias("v")), path)
    return readers.numeric_pairs(spark, path)


@query("SELECT url, md5(html) AS content_md5, html IS NOT NULL AS ok FROM pages")
def fetched_pages(spark, d):
    return readers.fetched_pages(_read(spark, d, "pages")).select("url", F.md5(F.col("content").cast("binary")).alias("content_md5"), "ok")


@query("SELECT page_id, row_number() OVER (ORDER BY page_id) AS position, url FROM pages")
def crawl_cache_there_and_back(spark, d):
    path = _folder(spark, "crawl")
    pages = _read(spark, d, "pages").select("page_id", "url")
    make = lambda: (index.doc_ids(pages.select(F.format_string("%019d", "page_id").alias("path"))).select(F.col("path").cast("long").alias("page_id"), F.col("doc_id").alias("position")), pages)
    readers.crawl_cache(spark, path, make)

    def none():
        raise AssertionError("a stored crawl is not made again")

    order, stored = readers.crawl_cache(spark, path, none)
    return order.join(stored, "page_id")


# --- sinks over the stored index ---


def _index(spark, d) -> dict[str, DataFrame]:
    from tessera.plans.catalogue import stored

    return stored(spark, d)


def _base() -> str:
    from tessera.plans.sql import _BASE

    return _BASE


@query()
def index_json_there_and_back(spark, d):
    path, tables = _folder(spark, "index-json"), _index(spark, d)
    writers.index_json(index.inverted_lists(tables["postings"]), tables["collection"], path)
    statistics = spark.read.json(f"{path}/statistics")
    rows = spark.read.json(f"{path}/data").select("term", "df", F.size("docid").cast("long").alias("n_docids"), F.aggregate("freq", F.lit(0).cast("long"), lambda a, x: a + x).alias("cf"))
    return rows.join(statistics.select("N", "num_terms", "num_tokens"))


@query()
def term_lines_there_and_back(spark, d):
    path = _folder(spark, "terms")
    writers.term_lines(_index(spark, d)["vocab"], path)
    parts = F.split("value", " ")
    return spark.read.text(path).select(parts[0].alias("term"), parts[1].cast("long").alias("cf"), parts[2].cast("long").alias("df"))


@query()
def extreme_terms(spark, d):
    return writers.extremes(_index(spark, d)["vocab"])


@query("SELECT doc_id || ' ' || coalesce(lang, 'None') AS line FROM documents")
def labelled_lines_there_and_back(spark, d):
    path = _folder(spark, "labelled")
    writers.labelled_lines(_read(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query()
def compressed_index_there_and_back(spark, d):
    path = _folder(spark, "compressed")
    writers.compressed_index(C.compress_index(index.list_blocks(_index(spark, d)["postings"]), True), path)
    rows = C.decompress_index(spark.read.parquet(path), True)
    return rows.select("term", F.posexplode("docid").alias("pos", "doc_id"), "freq").select("term", "doc_id", F.get("freq", F.col("pos")).cast("long").alias("tf"))


@query()
def index_in_memory(spark, d):
    return index.vocabulary(_index(spark, d)["postings"].persist()).select("term", "df", "cf")


@query()
def result_lines_of_counts(spark, d):
    tables = _index(spark, d)
    docs = _read(spark, d, "documents")
    topics = ranking.query_terms(_read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("qid"), "text"), F.slice(T.analyzed(T.letter_words(F.col("text"))), 1, 6))
    run = ranking.count_scores(ranking.matches(tables["by_doc"].drop("pos"), topics, tables["vocab"], F.lit(1)), "daat", 20)
    return ranking.result_lines(run, docs.select("doc_id", F.col("source").alias("name")))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.2f KB', floor(n / 1024.0::DOUBLE * 100 + 0.5) / 100) ELSE printf('%.2f MB', floor(n / 1048576.0::DOUBLE * 100 + 0.5) / 100) END AS size FROM (SELECT doc_id, n_chars::BIGINT * 300 AS n FROM documents)")
def byte_sizes(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.byte_size(F.col("n_chars").cast("long") * 300).alias("size"))


def oracles() -> dict[str, str]:
    """SQL by query name; that over the index shares its tables with the catalogue's."""
    base = _base()
    topics = "tq AS (SELECT item_id::VARCHAR AS qid, unnest(list_slice(w, 1, 6)) AS term FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-záéíóúüñ]+'), lambda x: length(x) BETWEEN 2 AND 23) AS w FROM benchmark)), q AS (SELECT qid, term, count(*) AS qtf FROM tq GROUP BY ALL)"
    ranked = "g AS (SELECT qid, doc_id, sum(qtf)::DOUBLE AS score FROM q JOIN p USING (term) GROUP BY ALL), r AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) <= 20)"
    return ORACLES | {
        "index_json_there_and_back": base + "SELECT term, df, df AS n_docids, cf, n_docs AS \"N\", n_terms AS num_terms, n_tokens AS num_tokens FROM v, cs",
        "term_lines_there_and_back": base + "SELECT term, cf, df FROM v",
        "extreme_terms": base + "(SELECT 'top' AS which, term, cf FROM v ORDER BY cf DESC, term LIMIT 10) UNION ALL (SELECT 'bottom', term, cf FROM v ORDER BY cf, term DESC LIMIT 10)",
        "compressed_index_there_and_back": base + "SELECT term, doc_id, tf FROM p",
        "index_in_memory": base + "SELECT term, df, cf FROM v",
        "result_lines_of_counts": base + f", {topics}, {ranked} SELECT qid, coalesce(source, '__doc_' || doc_id || '__') || ':' || doc_id || ':' || printf('%.6f', score) AS line FROM r JOIN documents USING (doc_id)",
    }
