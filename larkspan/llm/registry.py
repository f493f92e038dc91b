"""The thin queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import divergence, exact_dedup, jaccard_join, language_id, mixing, packing, periodic_runs, secret_scan, sharding, substring_dedup, suffix_dedup, topk_search, url_filter
from larkspan.llm.common import WORD
from larkspan.session import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), threshold=0.8, size=5)


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2)
    return taken.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.refine(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=400)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    planted = docs.select("doc_id", periodic_runs.with_planted_tail(F.col("doc_id"), F.col("text"), WORD).alias("text"))
    found = periodic_runs.find_runs(planted, least_length=6, exponent=4)
    best = periodic_runs.strongest(F.col("runs"))
    held = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), periodic_runs.digest(F.col("runs")).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return held.select("doc_id", "n_runs", "best.*", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: The rules of the query; among allowed hosts one is blocked in part, and the other way round.
RULES = [
    url_filter.Rule("org", "/", "allow"), url_filter.Rule("example.org", "/es/", "block"), url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"), url_filter.Rule("com", "/de/", "block"),
]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), k=10, least_docs=10)


#: Every window's words as one string, counted over the corpus; a word goes with any repeated window that began up to 34 words before.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM d),
x AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN sha256(array_to_string(w[i:i + 34], ' ')) END AS window_words FROM p),
c AS (SELECT doc_id, i, word, window_words IS NOT NULL AND count(*) OVER (PARTITION BY window_words) > 1 AS again FROM x),
g AS (SELECT doc_id, i, word, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS 34 PRECEDING) = 1 AS gone FROM c),
k AS (SELECT doc_id, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP9_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


OP4_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: The least level at which the first source that isn't full takes its weight; then each source's documents by hash.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
c AS (
  SELECT *, 2 * source_size / w AS ratio, (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * total
             - coalesce((SELECT sum(2 * x.source_size) FROM c x WHERE x.ratio < c.ratio), 0)::DOUBLE)
            / (SELECT sum(x.w) FROM c x WHERE x.ratio >= c.ratio) AS level
  FROM c),
v AS (SELECT min_by(level, ratio) AS level FROM l WHERE ratio >= level),
t AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, v.level * w) AS target FROM s, v),
g AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (
  SELECT *, target - whole * source_size AS budget, sum(size) OVER (PARTITION BY source ORDER BY key) AS up,
         sum(size) OVER (PARTITION BY source, key) AS same FROM g),
k AS (
  SELECT source, min(key) AS cross_key FROM r WHERE up >= budget GROUP BY source)
SELECT doc_id, r.size, source_size, target,
       (r.size * (whole + CASE WHEN cross_key IS NULL OR key < cross_key THEN 1
                               WHEN key = cross_key AND up - budget <= budget - (up - same) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r LEFT JOIN k ON r.source IS NOT DISTINCT FROM k.source
"""


#: CRC-32 bit by bit; runs as stretches of equal 5-grams one period apart, which every run has.
OP11_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten([[ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(doc_id::VARCHAR, '')])),
                         lambda s, b: xor(xor(s, b) >> 1, (xor(s, b) & 1) * 3988292384::UBIGINT)), 4294967295::UBIGINT)::BIGINT AS h
  FROM documents),
s AS (SELECT *, len(w) AS n, h // 10 AS g FROM t),
d AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM s),
x AS MATERIALIZED (
  SELECT r, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM d)),
k AS (
  SELECT r, i, CASE WHEN lead(i, 4) OVER o IS NOT NULL THEN
         concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) END AS gram
  FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
m AS (SELECT r, i, gram FROM (SELECT *, count(*) OVER (PARTITION BY r, gram) AS c FROM k WHERE gram IS NOT NULL) WHERE c > 1),
q AS (SELECT a.r, a.i, b.i - a.i AS q FROM m a JOIN m b ON a.r = b.r AND a.gram = b.gram AND b.i > a.i),
e AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM q),
l AS (SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM e GROUP BY r, q, island),
u AS MATERIALIZED (
  SELECT r, start, length::BIGINT AS length, min(q) AS period FROM l WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
y AS (
  SELECT r, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256
  FROM u GROUP BY r),
b AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY length::HUGEINT * 1000000000000 // period DESC, start, period) AS place FROM u),
z AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u),
c AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN z USING (r, i) GROUP BY r)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length, b.period::BIGINT AS period,
       (1000 * b.length // b.period)::BIGINT AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256,
       sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN y USING (r) LEFT JOIN b ON b.r = d.r AND place = 1 LEFT JOIN c ON c.r = d.r
"""

#: Thirty steps of trust along the links and of distrust against them, in whole numbers.
OP12_SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
v AS (
  SELECT *, '.' || host AS dotted,
         CASE WHEN dotted LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN dotted LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN dotted LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN dotted LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN dotted LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM u),
e AS (
  SELECT DISTINCT host AS src, translate(dst, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
  FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '(?i)\bhref\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s<>]+)', 1)) AS dst FROM u)
  WHERE host <> ''),
m AS (
  SELECT src AS host, dst AS next, TRUE AS forward, count(*) OVER (PARTITION BY src) AS n FROM e WHERE src <> dst
  UNION ALL SELECT dst, src, FALSE, count(*) OVER (PARTITION BY dst) FROM e WHERE src <> dst),
w(step, host, trust, distrust) AS (
  SELECT 0, host, (1000000 * count_if(rule IN ('org/', 'com/fr/')))::BIGINT, (1000000 * count_if(rule NOT IN ('org/', 'com/fr/')))::BIGINT
  FROM v WHERE host <> '' GROUP BY host
  UNION ALL
  SELECT step + 1, m.next, sum(CASE WHEN forward THEN trust * 85 // (100 * n) ELSE 0 END)::BIGINT,
         sum(CASE WHEN forward THEN 0 ELSE distrust * 85 // (100 * n) END)::BIGINT
  FROM w JOIN m ON w.host = m.host WHERE step < 30 AND (trust > 0 OR distrust > 0) GROUP BY step, m.next),
h AS (SELECT host, sum(distrust) > sum(trust) AS blocked FROM w GROUP BY host)
SELECT page_id, v.host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM v LEFT JOIN h ON v.host = h.host
"""

#: Every group against every kept term of its lang.
OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
o AS (SELECT r, lang, source, unnest(t) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
c AS (SELECT o.lang, source, o.term, count(*) AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * v.v))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (k.n + 2)) // (v.total + 2 * v.v))::BIGINT AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM x)
SELECT * FROM z WHERE part = 'pair' OR rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_substring_dedup": op1_substring_dedup, "op2_secret_scan": op2_secret_scan, "op3_jaccard_join": op3_jaccard_join, "op4_topk_search": op4_topk_search, "op5_sharding": op5_sharding, "op6_language_id": op6_language_id, "op7_mixing": op7_mixing, "op8_packing": op8_packing, "op9_exact_dedup": op9_exact_dedup, "op10_suffix_dedup": op10_suffix_dedup, "op11_periodic_runs": op11_periodic_runs, "op12_url_filter": op12_url_filter, "op13_source_divergence": op13_source_divergence}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op4_topk_search": OP4_SQL, "op7_mixing": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op11_periodic_runs": OP11_SQL, "op12_url_filter": OP12_SQL, "op13_source_divergence": OP13_SQL}
