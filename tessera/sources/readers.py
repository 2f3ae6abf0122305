"""Readers for collections, topics, judgements and other inputs of text retrieval experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

_NAME = r"([^/]+)$"


def _whole(spark: SparkSession, path: str, pattern: str, recursive: bool = False) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).option("ignoreMissingFiles", True)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def numbered_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of ``doc<N>.txt`` files."""
    number = F.regexp_extract("path", r"(\d+)\.txt$", 1)
    return _whole(spark, path, "*.txt").where(number != "").select(number.cast("long").alias("doc_id"), "text")


def named_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of ``*.txt`` files."""
    return _whole(spark, path, "*.txt").select(F.regexp_extract("path", _NAME, 1).alias("name"), "text")


def html_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all ``*.html`` below a folder, as text nodes; files without text are left out."""
    return _whole(spark, path, "*.html", True).select("path", T.html_text_nodes("text").alias("text")).where("text IS NOT NULL")


def mixed_tree(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, name, path, text) of all html and txt files below a folder; ids from 1 in path order, over paths alone."""
    from tessera.operators.index import doc_ids

    rows = html_tree(spark, path).unionByName(_whole(spark, path, "*.txt", True))
    return rows.join(doc_ids(rows.select("path")), "path").select("doc_id", T.name_of_path(F.col("path")).alias("name"), "path", "text")


def document_words(path: Column, text: Column, words: Column, tokenizer) -> Column:
    """Words of a record however it comes: given words, a page, or a text."""
    return F.coalesce(words, F.when(path.endswith(".html"), tokenizer(T.html_text(text))).otherwise(tokenizer(text)))


def trec_documents(spark: SparkSession, path: str) -> DataFrame:
    """(docno, text) of ``<DOC>`` elements; ``?`` without a DOCNO."""
    raw = spark.read.text(path, wholetext=True)
    docs = raw.select(F.explode(F.regexp_extract_all("value", F.lit("(?s)<DOC>(.*?)</DOC>"), F.lit(1))).alias("doc"))
    docno = F.trim(F.regexp_extract("doc", "(?s)<DOCNO>(.*?)</DOCNO>", 1))
    return docs.select(F.when(docno != "", docno).otherwise("?").alias("docno"), T.strip_docno(F.col("doc")).alias("text"))


def trec_topics(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query) of ``<top>`` elements with a number."""
    raw = spark.read.text(path, wholetext=True)
    tops = raw.select(F.explode(F.split("value", "<top>")).alias("top"))
    number = F.regexp_extract("top", r"<num>(\d+)</num>", 1)
    return tops.where(number != "").select(number.alias("qid"), F.trim(F.regexp_extract("top", "(?s)<title>(.*?)</title>", 1)).alias("query"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docno, label) of four white-space separated columns."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) >= 4).select(parts[0].alias("qid"), parts[2].alias("docno"), parts[3].cast("int").alias("label"))


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(term), one a line."""
    return spark.read.text(path).select(F.trim("value").alias("term")).where("term <> ''").distinct()


def query_log(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query) of lines ``qid:text``."""
    parts = F.split("value", ":", 2)
    return spark.read.text(path).where(F.size(parts) == 2).select(F.trim(parts[0]).cast("int").alias("qid"), F.trim(parts[1]).alias("query"))


def plain_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query, terms), one a line."""
    terms = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("query"), terms.alias("terms"))


def index_dump(spark: SparkSession, path: str) -> DataFrame:
    """Postings (term, doc_id, tf = 1) of lines ``term:_:d1,d2,``."""
    parts = F.split("value", ":")
    ids = F.array_sort(F.transform(F.filter(F.split(parts[2], ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long")))
    return spark.read.text(path).where(F.size(parts) >= 3).select(parts[0].alias("term"), F.explode(ids).alias("doc_id")).withColumn("tf", F.lit(1).cast("long"))


def latin1_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text) from 1 of a latin-1 file, trimmed, blank lines left out."""
    lines = F.split(F.decode("content", "ISO-8859-1"), r"\r\n|\n|\r")
    return spark.read.format("binaryFile").load(path).select(F.posexplode(lines).alias("at", "text")).select((F.col("at") + 1).alias("line_no"), F.trim("text").alias("text")).where("text <> ''")


def latin1_training(spark: SparkSession, path: str) -> DataFrame:
    """(lang, text): one latin-1 file per language, named by it."""
    return spark.read.format("binaryFile").load(path).select(T.name_of_path(F.col("path")).alias("lang"), F.decode("content", "ISO-8859-1").alias("text"))


def numeric_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(n, v) separated by white space."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) == 2).select(parts[0].cast("double").alias("n"), parts[1].cast("double").alias("v"))


def book(spark: SparkSession, path: str) -> DataFrame:
    """(text) of one file, lower-cased."""
    return spark.read.text(path, wholetext=True).select(F.lower("value").alias("text"))


def records(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Documents from dictionaries (docno, url, text)."""
    return spark.createDataFrame([(r["docno"], r.get("url"), r["text"]) for r in rows], "docno string, url string, text string")


def files_with_names(spark: SparkSession, path: str) -> DataFrame:
    """(docno, filename, text): every file a document."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("filename"), F.col("value").alias("text"))
    return rows.select(T.name_of_path(F.col("filename")).alias("docno"), "filename", "text")


def fetched_pages(pages: DataFrame) -> DataFrame:
    """(url, content, ok): a table of pages in the place of the web; null contents are failed fetches."""
    return pages.select("url", F.col("html").alias("content"), F.col("html").isNotNull().alias("ok"))


def crawl_cache(spark: SparkSession, path: str, make) -> tuple[DataFrame, DataFrame]:
    """(order, edges) of a stored crawl; ``make()`` is asked, and its result stored, where there is none."""
    try:
        return spark.read.parquet(f"{path}/order"), spark.read.parquet(f"{path}/edges")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    order, edges = make()
    order.write.parquet(f"{path}/order")
    edges.write.parquet(f"{path}/edges")
    return spark.read.parquet(f"{path}/order"), spark.read.parquet(f"{path}/edges")
