"""URL filters: host and path rules, then a weighted vocabulary matched by Aho-Corasick.

The automaton is built from the vocabulary once per task; it is a fixed parameter and never grows with the
data. A term counts where the characters beside it are no letters or digits. A URL is rejected on one
strict term, or where the weights of its distinct soft terms reach ``SOFT_LIMIT``. A rule, where one fits, goes
before the vocabulary; of several the longest wins.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule, and is judged by
its vocabulary alone (null: allowed); repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
STRICT: tuple[str, ...] = ("porn", "xxx", "xvideos", "hentai", "camgirls", "escort", "escorts", "warez", "torrent", "casino", "viagra", "cialis", "phishing", "malware", "crackz")
SOFT: Mapping[str, float] = {
    "adult": 1.0, "sex": 1.0, "sexy": 1.0, "nude": 1.0, "cam": 0.5, "dating": 0.5, "bet": 0.5, "betting": 1.0, "poker": 1.0, "slots": 1.0,
    "jackpot": 1.0, "gambling": 1.0, "pills": 1.0, "pharmacy": 0.5, "loan": 0.5, "loans": 0.5, "payday": 1.0, "crack": 1.0, "keygen": 1.0,
    "serial": 0.5, "hack": 0.5, "free": 0.5, "download": 0.5, "cheap": 0.5, "replica": 1.0, "spam": 1.0, "click": 0.5, "ads": 0.5,
}
SOFT_LIMIT = 2.0
_HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    m = _HOST.search(url) if url else None
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def matcher(strict: Sequence[str] = STRICT, soft: Mapping[str, float] = SOFT) -> ahocorasick.Automaton:
    """The vocabulary's automaton; a strict term has no weight."""
    found = ahocorasick.Automaton()
    for term, weight in [*soft.items(), *((t, None) for t in strict)]:
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def vocabulary_verdict(url: str, terms: ahocorasick.Automaton, limit: float = SOFT_LIMIT) -> str:
    """``block`` on one strict term or soft terms of enough distinct weight."""
    low, soft = url.translate(_UPPER), {}
    for end, (term, weight) in terms.iter(low):
        start = end - len(term) + 1
        if (start and low[start - 1].isalnum()) or (end + 1 < len(low) and low[end + 1].isalnum()):
            continue
        if weight is None:
            return "block"
        soft[term] = weight
    return "block" if len(soft) > 1 and sum(soft.values()) >= limit else "allow"


class Rules:
    """Rules by host; a lookup walks the host's suffixes at label borders."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest that fits, or None."""
        best = None
        while host:
            for prefix, verdict in self.by_host.get(host, ()):
                if path.startswith(prefix) and (best is None or len(host) + len(prefix) > len(best[0])):
                    best = (host + prefix, verdict)
            host = host.partition(".")[2]
        return best


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Mapping[str, float] = SOFT, limit: float = SOFT_LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages``; no shuffle."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, by = matcher(strict, soft), Rules(rules)
        for batch in batches:
            hosts, paths, fits, verdicts = [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = by.find(host, path) if host else None
                hosts.append(host)
                paths.append(path)
                fits.append(rule and rule[0])
                verdicts.append(rule[1] if rule else vocabulary_verdict(url or "", terms, limit))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, fits, verdicts))], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    rules = ",\n  ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    terms = ",\n  ".join([*(f"('{t}', NULL)" for t in STRICT), *(f"('{t}', {w})" for t, w in SOFT.items())])
    return rf"""
WITH rules(v, h, p) AS (VALUES
  {rules}
), terms(t, w) AS (VALUES
  {terms}
), parts AS (
  SELECT page_id, url, row_number() OVER () AS k,
    coalesce(translate(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), fits AS (
  SELECT k, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(v, length(h) + length(p)) AS v
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k
), hits AS (
  SELECT k, count(*) FILTER (w IS NULL) AS strict, count(w) AS soft, sum(w) AS weight
  FROM parts JOIN terms ON regexp_matches(lower(url), '(^|[^\p{{L}}\p{{N}}])' || t || '($|[^\p{{L}}\p{{N}}])') GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(fits.v, CASE WHEN strict > 0 OR soft > 1 AND weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (k) LEFT JOIN hits USING (k)
"""


ORACLE = _sql()
