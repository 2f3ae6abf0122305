"""DuckDB SQL for the catalogue's queries."""

from __future__ import annotations

from tessera.functions import text as T
from tessera.operators.laws import SHARES
from tessera.operators.web import DYNAMIC, HREF

PAGERANK_ROUNDS = 5
TOPICS = [("q1", "the of and to"), ("q2", "der die und ein"), ("q3", "la de el que"), ("q4", "le la des pour")]

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_BASE = """
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-záéíóúüñ]+')) AS term FROM documents),
w AS (SELECT doc_id, term FROM tok WHERE length(term) BETWEEN 2 AND 23),
p AS (SELECT term, doc_id, count(*) AS tf FROM w GROUP BY ALL),
v AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf FROM p GROUP BY term),
ds AS (SELECT doc_id, sum(tf)::BIGINT AS n_tokens, count(*) AS n_terms FROM p GROUP BY doc_id),
n AS (SELECT count(*) AS n_docs FROM documents),
cs AS (SELECT n_docs, (SELECT sum(cf)::BIGINT FROM v) AS n_tokens, (SELECT count(*) FROM v) AS n_terms, (SELECT sum(df)::BIGINT FROM v) AS n_pointers, (SELECT sum(cf) FROM v)::DOUBLE / n_docs AS avg_dl FROM n)
"""
_WORDS = "list_filter(regexp_extract_all(lower(text), '[a-záéíóúüñ]+'), lambda x: length(x) BETWEEN 2 AND 23)"


def _flat(pattern: str) -> str:
    return pattern.replace("'", "''")


_TYPED = _flat(T.typed_pattern(lookahead=False))
_TOPIC_ITEMS = f""",
tq AS (SELECT item_id::VARCHAR AS qid, unnest(list_slice({_WORDS}, 1, 6)) AS term, generate_subscripts(list_slice({_WORDS}, 1, 6), 1) - 1 AS pos FROM benchmark),
q AS (SELECT qid, term, count(*) AS qtf, min(pos) AS first_at FROM tq GROUP BY ALL)
"""
_TOPIC_FIXED = ",\ntq AS (SELECT qid, unnest(string_split(query, ' ')) AS term FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in TOPICS) + ") x(qid, query)),\nq AS (SELECT qid, term, count(*) AS qtf FROM tq GROUP BY ALL)\n"
_HITS = """,
h AS (SELECT q.qid, p.doc_id, p.term, p.tf, q.qtf, v.df, v.cf, n.n_docs FROM q JOIN v USING (term) JOIN p USING (term), n)
"""
_LENGTHS = """,
hl AS (SELECT h.*, ds.n_tokens AS dl, cs.avg_dl, cs.n_tokens FROM h JOIN ds USING (doc_id), cs)
"""


def _top(scores: str, k: int, by: str = "doc_id") -> str:
    return f"""SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {by})::INT AS rank FROM (SELECT * REPLACE (round(score, 6) AS score) FROM ({scores}))) WHERE rank <= {k}"""


_WEIGHTS = {
    "tf_sum": "tf::DOUBLE * qtf",
    "tf_idf_robertson": "qtf * (1.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) * log2(n_docs / df + 1)",
    "bm25": "(9.0 * qtf / (8.0 + qtf)) * (2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) * log2((n_docs - df + 0.5) / (df + 0.5))",
    "hiemstra_lm": "qtf * ln(1 + (0.15 * tf * n_tokens) / (0.85 * cf * dl))",
    "dirichlet_lm": "qtf * (ln(1 + tf / (1000.0 * cf / n_tokens)) + ln(1000.0 / (dl + 1000.0)))",
}
_RUN = (
    _BASE + _TOPIC_FIXED + _HITS + _LENGTHS + ",\nrun AS (" + " UNION ALL ".join(f"SELECT '{m}' AS name, * FROM ({_top(f'SELECT qid, doc_id, sum({_WEIGHTS[m]}) AS score FROM hl GROUP BY ALL', 50)})" for m in ("bm25", "dirichlet_lm")) + """),
qrels AS (SELECT qid, doc_id, 1 AS label FROM documents JOIN (VALUES ('q1', 'en'), ('q2', 'de'), ('q3', 'es'), ('q4', 'fr')) x(qid, lang) USING (lang)),
tot AS (SELECT qid, count(*) AS n_rel FROM qrels GROUP BY qid),
j AS (SELECT r.*, coalesce(label, 0) AS rel, n_rel FROM run r LEFT JOIN qrels USING (qid, doc_id) JOIN tot USING (qid)),
pr AS (SELECT *, sum(rel) OVER w::BIGINT AS hits, sum(rel) OVER w / rank::DOUBLE AS prec, sum(rel) OVER w / n_rel::DOUBLE AS rec FROM j WINDOW w AS (PARTITION BY name, qid ORDER BY rank)),
lv AS (SELECT unnest(range(11)) AS l),
ip AS (SELECT name, qid, l / 10.0 AS level, coalesce(max(prec) FILTER (round(rec * 10, 9) >= l), 0) AS prec FROM pr, lv GROUP BY ALL),
best AS (SELECT qid, sum(1 / log2(k + 1)) FILTER (k <= 10) AS idcg10, sum(1 / log2(k + 1)) AS idcg FROM (SELECT qid, row_number() OVER (PARTITION BY qid) AS k FROM qrels) GROUP BY qid),
m AS (SELECT name, qid, coalesce(sum(prec) FILTER (rel = 1), 0) / any_value(n_rel) AS ap, coalesce(sum(rel) FILTER (rank <= 10), 0) / 10.0 AS p_cut, coalesce(sum(rel) FILTER (rank <= 10), 0) / any_value(n_rel)::DOUBLE AS r_cut,
  coalesce(sum(rel) FILTER (rank <= n_rel), 0) / any_value(n_rel)::DOUBLE AS r_precision, coalesce(max(prec) FILTER (hits * 2 >= n_rel), 0) AS p_half_recall, coalesce(1.0 / min(rank) FILTER (rel = 1), 0) AS rr,
  coalesce(sum(rel / log2(rank + 1)) FILTER (rank <= 10), 0) / any_value(idcg10) AS ndcg_cut, sum(rel / log2(rank + 1)) / any_value(idcg) AS ndcg, sum(rel) / any_value(n_rel)::DOUBLE AS recall
  FROM pr JOIN best USING (qid) GROUP BY name, qid)
"""
)


def _round(names: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in names.split())


_HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_DEPTH = f"len(list_filter(string_split({_PATH}, '/'), lambda x: x <> ''))"
_LAST = f"string_split(regexp_replace({_PATH}, '/+$', ''), '/')[-1]"
_KIND = rf"CASE WHEN regexp_matches(url, '^[^?#]*\?[^#]+') OR list_contains([{', '.join(f"'{x}'" for x in DYNAMIC)}], lower(regexp_extract({_LAST}, '\.([^.]*)$', 1))) THEN 'dynamic' ELSE 'static' END"
_TAGS = f"""
WITH tags AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{_flat(HREF)}')) AS tag, generate_subscripts(regexp_extract_all(html, '{_flat(HREF)}'), 1) - 1 AS pos FROM pages),
links AS (SELECT page_id, url, pos, CASE WHEN regexp_extract(tag, '{_flat(HREF)}', 1) <> '' THEN regexp_extract(tag, '{_flat(HREF)}', 1) ELSE regexp_extract(tag, '{_flat(HREF)}', 2) END AS href FROM tags)
"""
_TRADE = """
WITH e AS (SELECT DISTINCT c_nationkey::VARCHAR AS src, s_nationkey::VARCHAR AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey < s_nationkey OR (c_nationkey + s_nationkey) % 3 = 0)
"""


def _pagerank(damping: float) -> str:
    out = ", deg AS (SELECT src, count(*) AS degree FROM e GROUP BY src), nd AS (SELECT src AS node FROM e UNION SELECT dst FROM e), nn AS (SELECT count(*) AS c FROM nd), r0 AS (SELECT node, 1.0::DOUBLE / c AS pr FROM nd, nn)"
    for i in range(PAGERANK_ROUNDS):
        out += f""", g{i} AS (SELECT dst, sum(pr / degree) AS got FROM e JOIN r{i} ON src = node JOIN deg USING (src) GROUP BY dst),
l{i} AS (SELECT coalesce(sum(pr), 0) AS lost FROM r{i} WHERE node NOT IN (SELECT src FROM e)),
r{i + 1} AS (SELECT node, {1 - damping!r} / c + {damping!r} * (coalesce(got, 0) + lost / c) AS pr FROM nd LEFT JOIN g{i} ON node = dst, l{i}, nn)"""
    return out


def _hits() -> str:
    out = ", hn AS (SELECT src AS node FROM e UNION SELECT dst FROM e), h0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM hn) AS h FROM hn)"
    for i in range(PAGERANK_ROUNDS):
        out += f""", b{i} AS (SELECT dst AS node, sum(h) AS a FROM e JOIN h{i} ON src = node GROUP BY dst), a{i + 1} AS (SELECT node, a / (SELECT max(a) FROM b{i}) AS a FROM b{i}),
k{i} AS (SELECT src AS node, sum(a) AS h FROM e JOIN a{i + 1} ON dst = node GROUP BY src), h{i + 1} AS (SELECT node, coalesce(h, 0) / (SELECT max(h) FROM k{i}) AS h FROM hn LEFT JOIN k{i} USING (node))"""
    k = PAGERANK_ROUNDS
    return out + f", ha AS (SELECT node, h / (SELECT sum(h) FROM h{k}) AS hub, coalesce(a, 0) / (SELECT sum(a) FROM a{k}) AS authority FROM h{k} LEFT JOIN a{k} USING (node))"


_SCORED = _TRADE + _pagerank(0.85) + _hits() + f", sc AS (SELECT node, node::INT AS fifo, pr AS pagerank, authority FROM r{PAGERANK_ROUNDS} JOIN ha USING (node))"
_CURVES = _SCORED + """, o AS (SELECT *, row_number() OVER (ORDER BY round(authority, 12) DESC, fifo) AS best, row_number() OVER (ORDER BY round(pagerank, 12) DESC, fifo) AS by_rank, row_number() OVER (ORDER BY fifo) AS by_crawl, least(10, count(*) OVER ()) AS k FROM sc),
s AS (SELECT 'fifo' AS strategy, by_crawl AS position, best, k, node FROM o UNION ALL SELECT 'pagerank', by_rank, best, k, node FROM o UNION ALL SELECT 'ideal', best, best, k, node FROM o),
c AS (SELECT strategy, position, node, sum((best <= 10)::INT) OVER (PARTITION BY strategy ORDER BY position) / k * 100 AS overlap FROM s)
"""
_RANKS = _BASE + ", r AS (SELECT term, cf, row_number() OVER (ORDER BY cf DESC, term) AS rank FROM v)"
_FIT = _RANKS + ", f AS (SELECT -regr_slope(ln(cf), ln(rank)) AS alpha, exp(regr_intercept(ln(cf), ln(rank))) AS c FROM r)"
_COVER = _FIT + """, m AS (SELECT term, cf, rank, c * pow(rank, -alpha) AS model FROM r, f),
cov AS (SELECT term, rank, sum(cf) OVER (ORDER BY rank) / (SELECT sum(cf) FROM m) AS share, sum(model) OVER (ORDER BY rank) / (SELECT sum(model) FROM m) AS model_share FROM m),
th AS (SELECT u::DOUBLE AS share_of, coalesce(min(rank) FILTER (share >= u::DOUBLE), count(*) + 1) AS n_real, coalesce(min(rank) FILTER (model_share >= u::DOUBLE), count(*) + 1) AS n_model FROM cov, (VALUES """ + ", ".join(f"({s})" for s in SHARES) + """) x(u) GROUP BY u)
"""
_HEAPS = """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-záéíóúüñ]+')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[a-záéíóúüñ]+'), 1) AS pos FROM documents),
g AS (SELECT term, row_number() OVER (ORDER BY doc_id, pos) AS n FROM t),
f AS (SELECT n, row_number() OVER (PARTITION BY term ORDER BY n) = 1 AS fresh FROM g),
s AS (SELECT n, sum(fresh::INT) OVER (ORDER BY n)::BIGINT AS v FROM f QUALIFY n % 100 = 0)
"""


def _profile(source: str, key: str, name: str) -> str:
    return f"""{name}n AS (SELECT {key}, letter, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '\\p{{L}}')) AS letter FROM {source}) GROUP BY ALL),
{name} AS (SELECT {key}, letter, n / sum(n) OVER (PARTITION BY {key}) AS freq FROM {name}n)"""


_EVERY = "train AS (SELECT lang, text FROM documents), test AS (SELECT doc_id AS id, text, lang AS gold FROM documents)"
_SPLIT = "train AS (SELECT lang, text FROM documents WHERE doc_id % 2 = 0), test AS (SELECT doc_id AS id, text, lang AS gold FROM documents WHERE doc_id % 2 = 1)"
_CORR = f""", {_profile('train', 'lang', 'tp')}, {_profile('test', 'id', 'sp')},
sc AS (SELECT id, lang, CASE WHEN stddev_pop(tp.freq) * stddev_pop(sp.freq) > 1e-15 THEN covar_pop(tp.freq, sp.freq) / (stddev_pop(tp.freq) * stddev_pop(sp.freq)) END AS score FROM sp JOIN tp USING (letter) GROUP BY ALL),
b AS (SELECT id, arg_max(lang, score) FILTER (score > -1) AS lang, max(score) FILTER (score > -1) AS score FROM test LEFT JOIN sc USING (id) GROUP BY id)
"""
_TRANS = f"""WITH {_EVERY},
lt AS (SELECT lang, regexp_extract_all(lower(text), '\\p{{L}}') AS c FROM train),
pairs AS (SELECT lang, unnest(list_zip(c[:-2], c[2:])) AS z FROM lt WHERE len(c) > 1),
cnt AS (SELECT lang, z[1] AS a, z[2] AS b, count(*) AS n FROM pairs GROUP BY ALL),
tr AS (SELECT lang, a, b, n / sum(n) OVER (PARTITION BY lang, a) AS p FROM cnt)
"""
_LISTS = _BASE + ", q AS (SELECT term, doc_id, tf, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY term) AS df FROM p), k AS (SELECT *, pos // greatest(1, floor(sqrt(df)))::BIGINT AS block FROM q)"
_GAPS = _BASE + ", g AS (SELECT term, doc_id, tf, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM p)"
_BITS = "CASE WHEN {0} > 0 THEN length(bin({0})) ELSE 0 END"
_VB = f"greatest(1, ceil(({_BITS}) / 7.0))"


def _vb(x: str) -> str:
    return _VB.format(x)


_LOG = {n: f", l AS (SELECT item_id AS qid, unnest(list_slice({_WORDS}, 1, {n})) AS term, generate_subscripts(list_slice({_WORDS}, 1, {n}), 1) - 1 AS pos FROM benchmark WHERE len({_WORDS}) >= {n}), ok AS (SELECT qid FROM l WHERE term IN (SELECT term FROM v) GROUP BY qid HAVING count(*) = {n}), x AS (SELECT qid, doc_id, bool_or(pos = 0) AS a, bool_or(pos = 1) AS b, bool_or(pos = 2) AS c FROM l JOIN p USING (term) WHERE qid IN (SELECT qid FROM ok) GROUP BY ALL) SELECT qid, doc_id FROM x WHERE " for n in (2, 3)}


def _has(term: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM p WHERE term = '{term}')"


ORACLES: dict[str, str] = {
    "term_stats": _BASE + "SELECT term, df, cf, df AS cf_as_coded FROM v",
    "lexicon": _BASE + "SELECT term, df, cf, max_tf FROM v",
    "top10_terms": _BASE + "SELECT term, cf FROM v ORDER BY cf DESC, term LIMIT 10",
    "bottom10_terms": _BASE + "SELECT term, cf FROM v ORDER BY cf, term DESC LIMIT 10",
    "corpus_stats": _BASE + "SELECT n_docs, n_tokens, n_terms, round(n_tokens::DOUBLE / n_docs, 6) AS mean_tokens, round(n_pointers::DOUBLE / n_docs, 6) AS mean_terms, (SELECT round(avg(length(term)), 6) FROM v) AS mean_term_length, s.doc_id AS shortest_doc, s.n_terms AS shortest_terms, l.doc_id AS longest_doc, l.n_terms AS longest_terms, (SELECT count(*) FROM v WHERE cf = 1) AS n_hapax FROM cs, (SELECT * FROM ds ORDER BY n_terms, doc_id LIMIT 1) s, (SELECT * FROM ds ORDER BY n_terms DESC, doc_id LIMIT 1) l".replace("SELECT n_docs, n_tokens, n_terms,", "SELECT n_docs, cs.n_tokens, cs.n_terms,").replace("round(n_tokens::DOUBLE", "round(cs.n_tokens::DOUBLE"),
    "collection_stats": _BASE + "SELECT n_docs, n_tokens, n_terms, n_pointers, round(avg_dl, 6) AS avg_dl FROM cs",
    "hapax": _BASE + "SELECT term FROM v WHERE cf = 1",
    "vocabulary_without_singletons": _BASE + "SELECT term, df FROM v WHERE df <> 1",
    "stopword_filtered_terms": _BASE + f"SELECT term, cf FROM v WHERE term NOT IN ({_STOP})",
    "plain_tokens": r"SELECT term, count(*) AS cf FROM (SELECT unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-záéíóúñ\s]', ' ', 'g'), '\s+')) AS term FROM documents) WHERE term <> '' GROUP BY term",
    "english_tokens": "SELECT term, count(*) AS cf FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY term",
    "typed_tokens": f"SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, trim(unnest(regexp_extract_all(text, '{_TYPED}'))) AS term FROM documents) WHERE length(term) BETWEEN 2 AND 23 GROUP BY term",
    "page_text": r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages",
    "url_labels": rf"SELECT page_id, CASE WHEN length(url) > 40 THEN substr(url, 1, 37) || '...' ELSE url END AS label, regexp_extract({_PATH}, '([^/]+?)(\.[^./]*)?$', 1) AS name FROM pages",
    "inverted_index": _BASE + "SELECT term, count(*) AS df, string_agg(doc_id, ',' ORDER BY doc_id) AS docids, string_agg(tf, ',' ORDER BY doc_id) AS freqs FROM p GROUP BY term",
    "tf_idf_weights": _BASE + "SELECT term, doc_id, round((1 + ln(tf)) * ln(n_docs / df), 6) AS weight FROM p JOIN v USING (term), n",
    "doc_norms": _BASE + "SELECT doc_id, round(sqrt(sum(pow((1 + ln(tf)) * ln(n_docs / df), 2))), 6) AS norm FROM p JOIN v USING (term), n GROUP BY doc_id",
    "vocab_seek": _BASE + f", o AS (SELECT doc_id, unnest({_WORDS}) AS term, generate_subscripts({_WORDS}, 1) AS pos FROM documents), f AS (SELECT term, min((doc_id, pos)) AS pos FROM o GROUP BY term), i AS (SELECT term, row_number() OVER (ORDER BY pos) AS term_id FROM f) SELECT term, term_id, df, coalesce(sum(df * 8) OVER (ORDER BY term_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seek FROM i JOIN v USING (term)",
    "posting_lookup": _BASE + "SELECT coalesce(source, '__doc_' || doc_id || '__') AS name, doc_id, tf FROM p JOIN documents USING (doc_id) WHERE term = 'thing'",
    "df_distribution": _BASE + "SELECT df, count(*) AS n_terms FROM v GROUP BY df",
    "df_histogram": _BASE + ", s AS (SELECT min(df)::DOUBLE AS a, max(df)::DOUBLE AS b FROM v) SELECT CASE WHEN b > a THEN least(50, floor((df - a) / ((b - a) / 50)) + 1) ELSE 1 END::INT AS bin, round(a + (b - a) / 50 * (CASE WHEN b > a THEN least(50, floor((df - a) / ((b - a) / 50)) + 1) ELSE 1 END::INT - 1), 6) AS lo, round(a + (b - a) / 50 * CASE WHEN b > a THEN least(50, floor((df - a) / ((b - a) / 50)) + 1) ELSE 1 END::INT, 6) AS hi, count(*) AS n FROM v, s GROUP BY ALL",
    "index_overhead": _BASE + ", z AS (SELECT sum(df * 8)::BIGINT AS index_bytes, (SELECT sum(octet_length(encode(text))) FROM documents)::INT AS collection_bytes FROM v) SELECT index_bytes, collection_bytes, round(index_bytes * 100.0 / collection_bytes, 6) AS overhead_percent FROM z",
    "bool_and": _BASE + f"SELECT doc_id FROM documents WHERE {_has('ther')} AND {_has('thing')}",
    "bool_or": _BASE + f"SELECT doc_id FROM documents WHERE {_has('ther')} OR {_has('thing')}",
    "bool_and_not": _BASE + f"SELECT doc_id FROM documents WHERE {_has('the')} AND NOT {_has('thing')}",
    "bool_not": _BASE + f"SELECT doc_id FROM documents WHERE NOT {_has('the')}",
    "bool_nested": _BASE + f"SELECT doc_id FROM documents WHERE ({_has('ther')} AND {_has('thing')}) OR ({_has('an')} AND NOT ({_has('the')} OR NOT {_has('der')}))",
    "bool_left_to_right": _BASE + f"SELECT doc_id FROM documents WHERE ({_has('the')} OR {_has('der')}) AND {_has('thing')}",
    "batch_and": _BASE + _LOG[2] + "a AND b",
    "batch_or": _BASE + _LOG[2] + "a OR b",
    "batch_and_not": _BASE + _LOG[2] + "a AND NOT b",
    "batch_and_and": _BASE + _LOG[3] + "a AND b AND c",
    "batch_or_and_not": _BASE + _LOG[3] + "(a OR b) AND NOT c",
    "batch_and_or": _BASE + _LOG[3] + "(a AND b) OR c",
    "skip_blocks": _LISTS + "SELECT term, block, max(doc_id) AS max_doc_id, min(pos) AS start FROM k GROUP BY ALL",
    "skip_and_counts": _LISTS + ", b AS (SELECT block, max(doc_id) AS top FROM k WHERE term = 'the' GROUP BY block), t AS (SELECT doc_id AS d FROM p WHERE term = 'thing'), o AS (SELECT d, count(*) FILTER (top < d) AS below, count(*) AS nb FROM t, b GROUP BY d), z AS (SELECT d, least(below, nb - 1) AS block, least(below + 1, nb) AS skips FROM o) SELECT d AS doc_id, bool_or(k.doc_id = d) AS found, skips AS skip_comparisons, least(count(*) FILTER (k.doc_id < d) + 1, count(*)) AS scan_comparisons FROM z JOIN k USING (block) WHERE term = 'the' GROUP BY d, skips",
    "skip_listing": _LISTS + "SELECT source || ':' || doc_id AS line FROM (SELECT block, max(doc_id) AS doc_id FROM k WHERE term = 'the' GROUP BY block) JOIN documents USING (doc_id)",
    "daat_cosine_topk": _BASE + ", q AS (SELECT 'q' AS qid, t AS term, 1 AS qtf FROM (VALUES ('ther'), ('thing'), ('the')) x(t))" + _HITS + ", nm AS (SELECT doc_id, sqrt(sum(pow(tf * log2(n_docs / df), 2))) AS norm FROM p JOIN v USING (term), n GROUP BY doc_id), qn AS (SELECT qid, sqrt(sum(qtf * pow(log2(n_docs / df), 2))) AS q_norm FROM q JOIN v USING (term), n GROUP BY qid), d AS (SELECT qid, doc_id, sum(qtf * log2(n_docs / df) * tf * log2(n_docs / df)) AS dot FROM h GROUP BY ALL) " + _top("SELECT qid, doc_id, coalesce(dot / nullif(norm * q_norm, 0), 0) AS score FROM d JOIN nm USING (doc_id) JOIN qn USING (qid)", 10, "doc_id DESC"),
    "vsm_rank": _BASE + _TOPIC_ITEMS + _HITS + ", nm AS (SELECT doc_id, sqrt(sum(pow((1 + ln(tf)) * ln(n_docs / df), 2))) AS norm FROM p JOIN v USING (term), n GROUP BY doc_id), d AS (SELECT qid, doc_id, sum((1 + ln(qtf)) * ln(n_docs / df) * (1 + ln(tf)) * ln(n_docs / df)) AS dot FROM h GROUP BY ALL) " + _top("SELECT qid, doc_id, coalesce(dot / nullif(norm, 0), 0) AS score FROM d JOIN nm USING (doc_id)", 10),
    "taat_count": _BASE + _TOPIC_ITEMS + ", h AS (SELECT qid, doc_id, sum(qtf)::DOUBLE AS score, min(first_at) AS touched FROM q JOIN p USING (term) GROUP BY ALL) " + _top("SELECT * FROM h", 20, "touched, doc_id"),
    "daat_count": _BASE + _TOPIC_ITEMS + ", h AS (SELECT qid, doc_id, sum(qtf)::DOUBLE AS score FROM q JOIN p USING (term) GROUP BY ALL) " + _top("SELECT * FROM h", 20),
    "query_length_stats": _BASE + _TOPIC_ITEMS + ", z AS (SELECT qid, count(*) AS postings, count(DISTINCT term) AS terms FROM q JOIN p USING (term) GROUP BY qid) SELECT terms, count(*) AS n, round(avg(postings), 6) AS mean_postings, min(postings) AS min_postings, max(postings) AS max_postings, round(coalesce(stddev_samp(postings), 0), 4) AS std_postings FROM z GROUP BY terms",
    **{m: _BASE + _TOPIC_ITEMS + _HITS + _LENGTHS + _top(f"SELECT qid, doc_id, sum({w}) AS score FROM hl GROUP BY ALL", 10) for m, w in _WEIGHTS.items()},
    "pr_at_rank": _RUN + "SELECT name, qid, rank::BIGINT AS rank, rel::BIGINT AS rel, round(prec, 6) AS precision, round(rec, 6) AS recall FROM pr",
    "interp_11pt": _RUN + "SELECT name, qid, round(level::DOUBLE, 6) AS level, round(prec, 6) AS precision FROM ip",
    "interp_11pt_mean": _RUN + "SELECT name, round(level::DOUBLE, 6) AS level, round(avg(prec), 6) AS precision FROM ip GROUP BY ALL",
    "per_query_measures": _RUN + f"SELECT name, qid, {_round('ap p_cut r_cut r_precision p_half_recall rr ndcg_cut ndcg recall')} FROM m",
    "map_p10_ndcg10": _RUN + "SELECT name, round(avg(ap), 6) AS ap, round(avg(p_cut), 6) AS p_cut, round(avg(ndcg_cut), 6) AS ndcg_cut FROM m GROUP BY name",
    "per_query_pivot": _RUN + f"SELECT name, qid, {_round('ap p_cut ndcg_cut')} FROM m",
    "interp_across_queries": _RUN + "SELECT name, round(l / 10.0, 6) AS level, round(coalesce(max(p_cut) FILTER (round(r_cut * 10, 9) >= l), 0), 6) AS precision FROM m, lv GROUP BY ALL",
    "recall_at_cuts": _RUN + "SELECT name, qid, cut::INT AS cut, round(coalesce(sum(rel) FILTER (rank <= cut), 0) / any_value(n_rel)::DOUBLE, 6) AS recall FROM pr, (VALUES (2), (3), (10), (20)) c(cut) GROUP BY ALL",
    "block_sort_postings": _BASE + f", o AS (SELECT doc_id, unnest({_WORDS}) AS term, generate_subscripts({_WORDS}, 1) AS pos FROM documents), f AS (SELECT term, min((doc_id, pos)) AS pos FROM o GROUP BY term), i AS (SELECT term, row_number() OVER (ORDER BY pos) AS term_id FROM f) SELECT term_id, doc_id, tf FROM p JOIN i USING (term)",
    "metric_histogram": _RUN + ", y AS (SELECT round(ap, 9) AS ap FROM m), s AS (SELECT min(ap) AS a, max(ap) AS b FROM y), z AS (SELECT CASE WHEN b > a THEN least(10, floor((ap - a) / ((b - a) / 10)) + 1) ELSE 1 END::INT AS bin, a, b FROM y, s) SELECT bin, round(a + (b - a) / 10 * (bin - 1), 6) AS lo, round(a + (b - a) / 10 * bin, 6) AS hi, count(*) AS n FROM z GROUP BY ALL",
    "ranking_agreement": _RUN + ", c AS (SELECT a.qid, a.rank AS ra, b.rank AS rb FROM run a JOIN run b USING (qid, doc_id) WHERE a.name = 'bm25' AND b.name = 'dirichlet_lm'), x AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ra) AS xa, row_number() OVER (PARTITION BY qid ORDER BY rb) AS xb FROM c) SELECT qid, round(count(*) FILTER (ra <= 10 AND rb <= 10) / 10.0, 6) AS overlap, round(CASE WHEN count(*) > 1 THEN covar_pop(xa, xb) / (stddev_pop(xa) * stddev_pop(xb)) END, 6) AS spearman FROM x GROUP BY qid",
    "frequency_ranks": _RANKS + "SELECT term, cf, rank FROM r",
    "zipf_fit": _FIT + "SELECT round(alpha, 3) AS alpha, round(c, 3) AS c FROM f",
    "zipf_coverage": _COVER + "SELECT term, rank, round(share, 6) AS share, round(model_share, 6) AS model_share FROM cov",
    "zipf_thresholds": _COVER + "SELECT * FROM th",
    "vocab_pruning": _COVER + f"SELECT share_of, count(*) AS n_pruned, count(*) FILTER (term IN ({_STOP})) AS n_stop, count(*) FILTER (term NOT IN ({_STOP})) AS n_other, round(count(*) FILTER (term IN ({_STOP})) * 100.0 / count(*), 6) AS stop_percent FROM cov JOIN th ON rank <= n_real GROUP BY share_of",
    "heaps_samples": _HEAPS + "SELECT n, v FROM s",
    "heaps_fit": _HEAPS + "SELECT round(exp(regr_intercept(ln(v), ln(n))), 4) AS k, round(regr_slope(ln(v), ln(n)), 4) AS b FROM s",
    "heaps_anchored": _HEAPS + "SELECT b, round(v / pow(n, b), 6) AS k FROM (SELECT n, v FROM s ORDER BY n LIMIT 1), (VALUES (0.4::DOUBLE), (0.5), (0.6)) x(b)",
    "letter_profile": f"WITH {_profile('documents', 'lang', 'lp')} SELECT lang, letter, round(freq, 9) AS freq FROM lp",
    "langid_corr": f"WITH {_EVERY}" + _CORR + "SELECT id, lang, round(score, 6) AS score FROM b",
    "bigram_matrix": _TRANS + "SELECT lang, a, b, round(p, 9) AS p FROM tr",
    "langid_chain": _TRANS + """, al AS (SELECT DISTINCT lang, unnest(c) AS letter FROM lt),
tx AS (SELECT id, string_split(text, '') AS c FROM test), ch AS (SELECT id, unnest(list_zip(c[:-2], c[2:])) AS z FROM tx WHERE len(c) > 1), ct AS (SELECT id, z[1] AS a, z[2] AS b, count(*) AS n FROM ch GROUP BY ALL),
ins AS (SELECT ct.*, x.lang FROM ct JOIN al x ON a = x.letter JOIN al y ON b = y.letter AND x.lang = y.lang),
sc AS (SELECT id, lang, sum(n * ln(p)) AS s, count(*) FILTER (p IS NULL) AS unseen FROM ins LEFT JOIN tr USING (lang, a, b) GROUP BY ALL),
ev AS (SELECT id, lang, coalesce(s, 0) AS s FROM test CROSS JOIN (SELECT DISTINCT lang FROM train) LEFT JOIN sc USING (id, lang) WHERE coalesce(unseen, 0) = 0)
SELECT id, first(ev.lang ORDER BY s DESC, CASE ev.lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'it' THEN 2 ELSE 3 END, ev.lang) AS lang, round(max(s), 3) AS score FROM test LEFT JOIN ev USING (id) GROUP BY id""",
    "langid_accuracy": f"WITH {_SPLIT}" + _CORR + "SELECT count(*) FILTER (lower(b.lang) = lower(gold)) AS n_equal, count(*) AS n_total, round(count(*) FILTER (lower(b.lang) = lower(gold)) * 100.0 / count(*), 6) AS percent FROM b JOIN test USING (id)",
    "dgaps": _GAPS + "SELECT term, doc_id, gap FROM g",
    "codec_sizes": _GAPS + f", s AS (SELECT term, sum({_vb('doc_id')}) AS plain, sum({_vb('gap')}) AS gapped, ceil(sum(2 * length(bin(tf)) - 1) / 8.0) AS freqs, count(*) * 8 AS raw FROM g GROUP BY term), t AS (SELECT sum(raw)::BIGINT AS raw, sum(plain)::BIGINT AS plain, sum(gapped)::BIGINT AS gapped, sum(freqs)::BIGINT AS freqs FROM s) SELECT *, round(raw::DOUBLE / (gapped + freqs), 6) AS ratio, round((raw - gapped - freqs) * 100.0 / raw, 6) AS saving FROM t",
    "codec_roundtrip": _BASE + "SELECT term, doc_id, tf FROM p",
    "page_links": _TAGS + "SELECT page_id, pos::BIGINT AS pos, href FROM links",
    "normalized_links": _TAGS + r""", b AS (SELECT *, regexp_extract(href, '^([^#]*)', 1) AS bare, lower(regexp_extract(regexp_extract(href, '^([^#]*)', 1), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root,
  regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/(?:[^?#]*/)?)?)', 1) AS folder FROM links)
SELECT page_id, pos::BIGINT AS pos, CASE WHEN bare = '' THEN NULL WHEN scheme IN ('http', 'https') THEN bare WHEN scheme <> '' THEN NULL WHEN starts_with(bare, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || bare
  WHEN starts_with(bare, '/') THEN root || bare WHEN starts_with(bare, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || bare ELSE CASE WHEN ends_with(folder, '/') THEN folder ELSE folder || '/' END || bare END AS target FROM b""",
    "url_parts": f"SELECT page_id, {_HOST} AS host, {_DEPTH}::BIGINT AS depth, {_KIND} AS kind FROM pages",
    "page_kind_dist": f"SELECT {_KIND} AS kind, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM pages GROUP BY 1",
    "depth_dist": f"SELECT {_DEPTH}::BIGINT AS depth, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM pages GROUP BY 1",
    "pages_per_host": f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1",
    "first_pages_per_host": f"SELECT page_id, {_HOST} AS host, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS nth FROM pages QUALIFY nth <= 20",
    "pagerank_k": _TAGS + f", e AS (SELECT DISTINCT 'p' || page_id AS src, {_HOST} || href AS dst FROM links)" + _pagerank(0.85) + f" SELECT node, round(pr, 9) AS pagerank FROM r{PAGERANK_ROUNDS}",
    "pagerank_trade": _TRADE + _pagerank(0.5) + f" SELECT node, round(pr, 9) AS pagerank FROM r{PAGERANK_ROUNDS}",
    "hits_k": _TRADE + _hits() + " SELECT node, round(hub, 9) AS hub, round(authority, 9) AS authority FROM ha",
    "crawled_graph": _TRADE + "SELECT src, dst FROM e WHERE src <> dst AND src::INT % 2 = 0 AND dst::INT % 2 = 0",
    "crawl_overlap": _CURVES + "SELECT strategy, position, round(overlap, 6) AS overlap FROM c",
    "pages_needed": _CURVES + "SELECT strategy, coalesce(min(position) FILTER (round(overlap, 9) >= 50), max(position)) AS pages FROM c GROUP BY strategy",
    "crawl_report": _CURVES + ", top AS (SELECT node FROM o WHERE best <= 10), a AS (SELECT strategy, avg(overlap) / 100 AS auc, count(*) FILTER (position <= 10) AS nf, count(*) FILTER (position <= 10 AND node IN (SELECT node FROM top)) AS sh FROM c GROUP BY strategy) SELECT strategy, round(auc, 6) AS auc, round(sh::DOUBLE / (nf + (SELECT count(*) FROM top) - sh), 6) AS jaccard, round((SELECT covar_pop(pagerank, authority) / (stddev_pop(pagerank) * stddev_pop(authority)) FROM sc), 6) AS pearson FROM a",
    "rerank_alpha": _SCORED + " SELECT node, round(0.7 * authority / (SELECT max(authority) FROM sc) + 0.3 * pagerank / (SELECT max(pagerank) FROM sc), 6) AS mixed FROM sc",
    "capped_links": _TAGS + f", e AS (SELECT 'p' || page_id AS src, pos::BIGINT AS pos, {_HOST} || href AS dst FROM links) SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY pos) <= 5",
}
