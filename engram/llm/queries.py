"""The queries of the operators and of the pipeline, for `__spark_entry__`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engram.llm.bpe import op3_byte_bpe
from engram.llm.decontaminate import op6_decontaminate
from engram.llm.divergence import op12_divergence
from engram.llm.infill import op13_infill
from engram.llm.jaccard import op7_ngram_jaccard
from engram.llm.licences import op9_licences
from engram.llm.quality import op10_quality_rules
from engram.llm.sequences import op11_token_sequences
from engram.llm.sharding import op1_sharding
from engram.llm.token_counts import op8_token_counts
from engram.llm.toxicity import op4_toxicity
from engram.llm.url_filter import op2_url_filter
from engram.llm.warc import op5_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding, op2_url_filter, op3_byte_bpe, op4_toxicity, op5_warc, op6_decontaminate, op7_ngram_jaccard, op8_token_counts, op9_licences, op10_quality_rules,
        op11_token_sequences, op12_divergence, op13_infill,
    )
}

#: The rules of op2 as a query of its own: the longest rule that fits, by comparison of hosts and paths.
_OP2 = """
WITH rules(verdict, host, path) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'), ('block','example.net','/de/8'), ('block','org','/es/')),
urls AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict
  FROM urls u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The windows of the benchmark by comparison with every run of as many words in a document.
_OP6 = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT k FROM wins),
runs AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM low, lengths, unnest(range(1, len(w) - k + 2)) AS r(i) WHERE len(w) >= k),
hits AS (SELECT doc_id, runs.k, i, item_id FROM runs JOIN wins USING (k, t)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + k)) AS r(p) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT low.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN words USING (doc_id) LEFT JOIN who USING (doc_id)
"""

#: Digests by hand, the newest page of each payload by a window.
_OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last > page_id THEN last END AS refers_to
FROM k
"""

#: Every two documents by their shared shingles, and the closure of the links.
_OP7 = r"""
WITH RECURSIVE low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM low, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes nx ON nx.doc_id = x JOIN sizes ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, ways.y FROM reach JOIN ways ON reach.other = ways.x)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

#: Every two sources of a language term by term, in whole numbers of 128 bits.
_OP12 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
occurrences AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM occurrences GROUP BY ALL HAVING count(DISTINCT r) >= 10),
counted AS (SELECT lang, source, term, count(*) AS c FROM occurrences SEMI JOIN kept USING (lang, term) GROUP BY ALL),
languages AS (SELECT lang, count(*) AS v, sum(total) AS all_n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
sums AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN counted USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT sums.lang, sums.source, kept.term, coalesce(c, 0) AS c, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 2)) // (n + 2 * v) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * (total + 2)) // (all_n + 2 * v) AS q
  FROM sums JOIN kept USING (lang) JOIN languages USING (lang) LEFT JOIN counted ON counted.lang = sums.lang AND counted.source = sums.source AND counted.term = kept.term),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed ON summed.lang = a.lang AND summed.source = a.source AND summed.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

#: Lists of lines, cut by rank; the text itself must come back.
_OP13 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
ranks AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b, CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM cut),
parts AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 100 THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM ranks)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""

ORACLE_SQL: dict[str, str] = {
    "op7_ngram_jaccard": _OP7, "op2_url_filter": _OP2, "op5_warc": _OP5, "op6_decontaminate": _OP6, "op12_divergence": _OP12, "op13_infill": _OP13,
}
