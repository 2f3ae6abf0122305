"""Tokens, postings, vocabularies and statistics; building, storing and reading an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import text as T
from tessera.operators import counting
from tessera.operators.prefix import numbered, sums_before

POSTING_BYTES = 8
BLOCK_DOCS = 4096
COMMON_TERMS = 400_000


def tokens(docs: DataFrame, words: Column) -> DataFrame:
    """(doc_id, pos, term) of a words column over ``docs``; positions from 0."""
    return docs.select("doc_id", F.posexplode(words).alias("pos", "term"))


def postings_of(docs: DataFrame, words: Column) -> DataFrame:
    """(term, doc_id, tf). A row's words are counted in Arrow before the one shuffle."""
    return counting.words_by_row(docs, words).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))


def vocabulary(postings: DataFrame) -> DataFrame:
    """(term, df, cf, max_tf, cf_as_coded): collection frequency as the sum of tf, and as documents counted once."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"), F.count("*").alias("cf_as_coded"))


def doc_stats(postings: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_terms)."""
    return postings.groupBy("doc_id").agg(F.sum("tf").alias("n_tokens"), F.count("*").alias("n_terms"))


def collection(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """One row (n_docs, n_tokens, n_terms, n_pointers, avg_dl), over all documents, empty ones included."""
    return collection_of(docs, postings.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")))


def collection_of(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """``collection`` from a vocabulary (term, df, cf)."""
    p = vocab.agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("n_tokens"), F.count("*").alias("n_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("n_pointers"))
    n = docs.agg(F.count("*").alias("n_docs"))
    return n.join(p).select("n_docs", "n_tokens", "n_terms", "n_pointers", F.try_divide(F.col("n_tokens"), F.col("n_docs")).alias("avg_dl"))


def corpus_statistics(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: totals, means, mean term length, shortest and longest document by distinct terms (ties to the smaller id), hapax count."""
    per_doc = doc_stats(postings).agg(
        F.min_by("doc_id", F.struct("n_terms", "doc_id")).alias("shortest_doc"), F.min("n_terms").alias("shortest_terms"),
        F.max_by("doc_id", F.struct(F.col("n_terms"), -F.col("doc_id"))).alias("longest_doc"), F.max("n_terms").alias("longest_terms"),
        F.sum("n_terms").alias("sum_terms"),
    )
    per_term = vocabulary(postings).agg(F.count("*").alias("n_terms"), F.sum("cf").alias("n_tokens"), F.avg(F.length("term")).alias("mean_term_length"), F.count(F.when(F.col("cf") == 1, 1)).alias("n_hapax"))
    n = docs.agg(F.count("*").alias("n_docs"))
    return n.join(per_doc).join(per_term).select(
        "n_docs", "n_tokens", "n_terms", F.try_divide("n_tokens", "n_docs").alias("mean_tokens"), F.try_divide("sum_terms", "n_docs").alias("mean_terms"),
        "mean_term_length", "shortest_doc", "shortest_terms", "longest_doc", "longest_terms", "n_hapax",
    )


def stem_statistics(tokens_: DataFrame, stem_map: DataFrame) -> DataFrame:
    """(stem, cf, df): distinct surface forms per document counted once each for cf, documents for df."""
    forms = tokens_.select("doc_id", "term").distinct().join(stem_map, "term")
    return forms.groupBy("stem").agg(F.count("*").alias("cf"), F.count_distinct("doc_id").alias("df"))


def inverted_lists(postings: DataFrame) -> DataFrame:
    """(term, docid, freq, df): postings of a term in document order. A list is as long as the term's df."""
    pairs = F.array_sort(F.collect_list(F.struct("doc_id", "tf")))
    lists = postings.groupBy("term").agg(pairs.alias("p"))
    return lists.select("term", F.col("p.doc_id").alias("docid"), F.col("p.tf").alias("freq"), F.size("p").cast("long").alias("df"))


def list_blocks(postings: DataFrame, span: int = BLOCK_DOCS) -> DataFrame:
    """(term, block, docid, freq, df): the lists cut at multiples of ``span`` document ids; df is the block's own. However common a term, no row or task holds more than one block of it."""
    pairs = F.array_sort(F.collect_list(F.struct("doc_id", "tf")))
    blocks = postings.groupBy("term", F.floor(F.col("doc_id") / span).alias("block")).agg(pairs.alias("p"))
    return blocks.select("term", "block", F.col("p.doc_id").alias("docid"), F.col("p.tf").alias("freq"), F.size("p").cast("long").alias("df"))


def tf_idf(postings: DataFrame, vocab: DataFrame, n_docs: Column, weight=N.log_tf, idf=N.idf_ln) -> DataFrame:
    """``postings`` with (df, weight)."""
    return with_terms(postings, vocab.select("term", "df")).withColumn("weight", weight(F.col("tf"), idf(n_docs, F.col("df"))))


def with_terms(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """``postings`` joined with a stored table (term, df, ...) on the term.

    Common terms, ``COMMON_TERMS`` at most whatever the collection, are broadcast, and so the bulk of the postings stays where it is;
    only those of rarer terms are shuffled, none of which has many.
    """
    pointers = terms.agg(F.sum("df")).first()[0] or 0
    often = F.col("df") > pointers // COMMON_TERMS
    common, rare = terms.where(often), terms.where(~often)
    marked = postings.join(F.broadcast(common), "term", "left")
    rest = marked.where(F.col("df").isNull()).select(*postings.columns)
    return marked.where(F.col("df").isNotNull()).unionByName(rest.join(rare, "term").select(*marked.columns))


def doc_norms(weighted: DataFrame) -> DataFrame:
    """(doc_id, norm)."""
    return weighted.groupBy("doc_id").agg(N.norm(F.col("weight")).alias("norm"))


def term_ids(tokens_: DataFrame) -> DataFrame:
    """(term, term_id): ids from 1 in order of first appearance."""
    first = tokens_.groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    return numbered(first, ["first"], "term_id").select("term", "term_id")


def term_ids_of(by_doc: DataFrame) -> DataFrame:
    """``term_ids`` from (term, doc_id, pos) with a row per term and document, pos being its first place there: by hashing, as no structs are compared."""
    place = F.coalesce(F.min_by("pos", "doc_id"), F.min("pos"))
    first = by_doc.groupBy("term").agg(F.min("doc_id").alias("doc_id"), place.alias("pos"))
    return numbered(first, [F.asc_nulls_last("doc_id"), F.asc("pos")], "term_id").select("term", "term_id")


def seeks(vocab: DataFrame) -> DataFrame:
    """(term, term_id, df, seek): byte offsets of fixed-size postings laid out by term_id."""
    return sums_before(vocab, ["term_id"], seek=F.col("df") * POSTING_BYTES)


def doc_ids(paths: DataFrame) -> DataFrame:
    """(doc_id, path): ids from 1 in path order."""
    return numbered(paths.select("path"), ["path"], "doc_id").select("doc_id", "path")


def block_sort_chunks(postings: DataFrame, tuples: int) -> DataFrame:
    """(doc_id, chunk): the chunk of a block-sort build in which a document's tuples fall; one ends at the first document boundary with ``tuples`` or more."""
    per_doc = doc_stats(postings).select("doc_id", "n_terms")

    # the running count restarts at each flush, which no window frame says; the input has a row per document
    def walk(batches):
        held, chunk = 0, 1
        for pdf in batches:
            out = []
            for n in pdf["n_terms"]:
                out.append(chunk)
                held += n
                if held >= tuples:
                    held, chunk = 0, chunk + 1
            yield pdf[["doc_id"]].assign(chunk=out)

    return per_doc.repartition(1).sortWithinPartitions("doc_id").mapInPandas(walk, "doc_id long, chunk long")


def block_sort_tuples(postings: DataFrame, ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """The build's runs: (chunk, term_id, doc_id, tf), each chunk sorted by term and document. Chunks are dealt over the tasks; each is bounded by its tuples."""
    rows = (with_terms(postings, ids) if "df" in ids.columns else postings.join(ids, "term")).join(chunks, "doc_id").select("chunk", "term_id", "doc_id", "tf")
    return rows.repartition("chunk").sortWithinPartitions("chunk", "term_id", "doc_id")


def block_sort_merge(runs: DataFrame) -> DataFrame:
    """The runs merged: (term_id, doc_id, tf, chunk), by ranges of terms and sorted within them."""
    return runs.repartitionByRange("term_id", "doc_id").sortWithinPartitions("term_id", "doc_id").select("term_id", "doc_id", "tf", "chunk")


def block_sort_sensitivity(postings: DataFrame, percents: tuple[int, ...] = (10, 20, 30, 50, 60, 80, 100)) -> DataFrame:
    """(percent, tuples, n_chunks): how many chunks a build makes where a chunk holds that share of all tuples."""
    total = postings.count()
    out = None
    for percent in percents:
        tuples = max(1, total * percent // 100)
        row = block_sort_chunks(postings, tuples).agg(F.coalesce(F.max("chunk"), F.lit(0)).alias("n_chunks")).select(F.lit(percent).alias("percent"), F.lit(tuples).cast("long").alias("tuples"), "n_chunks")
        out = row if out is None else out.unionByName(row)
    return out


def in_ranges(postings: DataFrame, partitions: int | None = None) -> DataFrame:
    """``postings`` by ranges of (term, doc_id), sorted within them."""
    ranged = postings.repartitionByRange(partitions, "term", "doc_id") if partitions else postings.repartitionByRange("term", "doc_id")
    return ranged.sortWithinPartitions("term", "doc_id")


def write_index(postings: DataFrame, docs: DataFrame, path: str, partitions: int | None = None) -> None:
    """Store postings range-partitioned and sorted by (term, doc_id), with vocabulary, documents and collection statistics.

    Sorted files give row-group statistics that prune scans for a term.
    """
    in_ranges(postings, partitions).write.mode("overwrite").parquet(f"{path}/postings")
    spark = postings.sparkSession
    stored = spark.read.schema(postings.schema).parquet(f"{path}/postings")
    vocabulary(stored).write.mode("overwrite").parquet(f"{path}/vocab")
    doc_stats(stored).write.mode("overwrite").parquet(f"{path}/doc_stats")
    collection(docs, stored).write.mode("overwrite").parquet(f"{path}/collection")


def read_index(spark: SparkSession, path: str, in_memory: bool = False) -> dict[str, DataFrame]:
    """The stored tables by name; ``in_memory`` keeps the postings in the executors' memory."""
    out = {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "vocab", "doc_stats", "collection")}
    if in_memory:
        out["postings"] = out["postings"].persist()
    return out


def posting_lookup(postings: DataFrame, docs: DataFrame, term: str) -> DataFrame:
    """(name, doc_id, tf) of a term in document order; documents without a name get one from their id."""
    found = postings.where(F.col("term") == term)
    named = found.join(docs.select("doc_id", "name"), "doc_id", "left")
    return named.select(F.coalesce("name", F.format_string("__doc_%d__", "doc_id")).alias("name"), "doc_id", "tf").orderBy("doc_id")


def index_sizes(vocab: DataFrame, collection_bytes: Column) -> DataFrame:
    """One row (index_bytes, collection_bytes, overhead_percent)."""
    return vocab.agg(F.sum(F.col("df") * POSTING_BYTES).alias("index_bytes"), F.first(collection_bytes).alias("collection_bytes")).withColumn("overhead_percent", N.percent(F.col("index_bytes"), F.col("collection_bytes")))


def df_distribution(vocab: DataFrame) -> DataFrame:
    """(df, n_terms)."""
    return vocab.groupBy("df").agg(F.count("*").alias("n_terms"))


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, lo, hi, n) over equal bins from the least to the largest value, the largest in the last bin."""
    span = values.agg(F.min(column).cast("double").alias("a"), F.max(column).cast("double").alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(F.col("b") > F.col("a"), F.least(F.lit(bins), F.floor((F.col(column) - F.col("a")) / width) + 1)).otherwise(1)
    n = values.join(F.broadcast(span)).groupBy(at.cast("int").alias("bin"), "a", "b").agg(F.count("*").alias("n"))
    return n.select("bin", (F.col("a") + width * (F.col("bin") - 1)).alias("lo"), (F.col("a") + width * F.col("bin")).alias("hi"), "n")
