"""Boolean retrieval: a query's text becomes one plan.

AND and OR have the same precedence, left to right within parentheses; NOT is a prefix of the next operand; operators are the upper-case
words; operands are lower-cased; spare closing parentheses are tolerated; unknown terms match nothing. The plan filters the
postings to the query's terms, groups once by document and tests one boolean expression. All documents are read only if the
expression holds for a document with none of its terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import ranking
from tessera.storage import materialize


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Not:
    of: Term | Not | Both


@dataclass(frozen=True)
class Both:
    op: str
    left: Term | Not | Both
    right: Term | Not | Both


Node = Term | Not | Both


def parse(query: str) -> Node | None:
    """The query's tree; None for an empty query. ``ValueError`` for a missing operator, operand or a double NOT."""
    words = query.replace("(", " ( ").replace(")", " ) ").split()
    at = 0

    def operand() -> Node:
        nonlocal at
        if at >= len(words):
            raise ValueError("an operand is missing")
        word = words[at]
        at += 1
        if word == "NOT":
            if at < len(words) and words[at] == "NOT":
                raise ValueError("NOT NOT")
            return Not(operand())
        if word == "(":
            return frame(True)
        if word in ("AND", "OR", ")"):
            raise ValueError(f"{word} where an operand should be")
        return Term(word.lower())

    def frame(nested: bool) -> Node:
        nonlocal at
        left = operand()
        while at < len(words):
            word = words[at]
            at += 1
            if word == ")":
                if nested:
                    return left
                continue
            if word not in ("AND", "OR"):
                raise ValueError(f"an operator is missing before {word}")
            left = Both(word, left, operand())
        return left

    while words and words[0] == ")":
        words.pop(0)
    return frame(False) if words else None


def terms_of(node: Node) -> set[str]:
    """The words of a tree."""
    if isinstance(node, Term):
        return {node.word}
    return terms_of(node.of) if isinstance(node, Not) else terms_of(node.left) | terms_of(node.right)


def holds(node: Node, present: set[str]) -> bool:
    """The tree's value for a document with these words."""
    if isinstance(node, Term):
        return node.word in present
    if isinstance(node, Not):
        return not holds(node.of, present)
    a, b = holds(node.left, present), holds(node.right, present)
    return a and b if node.op == "AND" else a or b


def _column(node: Node, names: dict[str, str]) -> Column:
    if isinstance(node, Term):
        return F.col(names[node.word])
    if isinstance(node, Not):
        return ~_column(node.of, names)
    a, b = _column(node.left, names), _column(node.right, names)
    return a & b if node.op == "AND" else a | b


def evaluate(postings: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """(doc_id) of the matching documents, in order."""
    tree = parse(query)
    if tree is None:
        return docs.select("doc_id").where("false")
    words = sorted(terms_of(tree))
    names = {w: f"has_{i}" for i, w in enumerate(words)}
    hits = postings.where(F.col("term").isin(words)).groupBy("doc_id").agg(*[F.max(F.col("term") == w).alias(names[w]) for w in words])
    if holds(tree, set()):
        hits = docs.select("doc_id").join(hits, "doc_id", "left").select("doc_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in names.values()])
    return hits.where(_column(tree, names)).select("doc_id").orderBy("doc_id")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents in both lists."""
    return a.select("doc_id").intersect(b.select("doc_id"))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents in one list or the other."""
    return a.select("doc_id").union(b.select("doc_id")).distinct()


def neither(docs: DataFrame, a: DataFrame) -> DataFrame:
    """Documents outside a list."""
    return docs.select("doc_id").join(a.select("doc_id"), "doc_id", "left_anti")


PATTERNS = {
    "and": lambda a, b, c: a & b,
    "or": lambda a, b, c: a | b,
    "and_not": lambda a, b, c: a & ~b,
    "and_and": lambda a, b, c: a & b & c,
    "or_and_not": lambda a, b, c: (a | b) & ~c,
    "and_or": lambda a, b, c: (a & b) | c,
}


def batch(postings: DataFrame, log: DataFrame, pattern: str, vocab: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id) of a whole log (qid, terms) of two- or three-term queries under one pattern, in one plan.

    Queries of another length, or with a term outside the vocabulary (``vocab``, or else the postings' terms), are left out, as the timing runs do.
    """
    n = 2 if pattern in ("and", "or", "and_not") else 3
    asked = ranking.small(materialize(log.where(F.size("terms") == n).select("qid", F.posexplode("terms").alias("at", "term")), "asked"))
    found = materialize(asked.join(postings.groupBy("term").agg(F.count("*").alias("df")) if vocab is None else vocab.select("term", "df"), "term"), "known")
    known = found.groupBy("qid").agg(F.count("*").alias("known")).where(F.col("known") == n).select("qid")
    hits = ranking.by_document(postings, materialize(found.join(known, "qid", "left_semi"), "batch-terms")).groupBy("qid", "doc_id").agg(*[F.max(F.col("at") == i).alias(f"h{i}") for i in range(3)])
    return hits.where(PATTERNS[pattern](F.col("h0"), F.col("h1"), F.col("h2"))).select("qid", "doc_id")
