"""One query for each corpus operator, with production parameters over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, digests, filteraudit, linededup, packing, pivots, quality, simhash, substring, topk, urlrules, whitening, wordpiece
from corpusmill.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository; it imports this module

    return corpus_pipeline.run(spark, sf_dir)


#: (verdict, host, path)
URL_RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urlrules.judge(table(spark, sf_dir, "pages"), rules)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), decoded=True)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"),
    )


def op11_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.with_edits(table(spark, sf_dir, "documents"))


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES["op1_simhash"] = op1_simhash
QUERIES["op2_lines"] = op2_lines
QUERIES["op3_topk"] = op3_topk
QUERIES["op4_substring"] = op4_substring
QUERIES["op5_packing"] = op5_packing
QUERIES["op6_token_counts"] = op6_token_counts
QUERIES["op7_embeddings"] = op7_embeddings
QUERIES["op8_urls"] = op8_urls
QUERIES["op9_quality"] = op9_quality
QUERIES["op10_bpe"] = op10_bpe
QUERIES["op11_digests"] = op11_digests
QUERIES["op12_filters"] = op12_filters
QUERIES["op13_whitening"] = op13_whitening
QUERIES["pipeline"] = pipeline


# A run of three lines or more that occurred before is the union of its windows of three lines.
ORACLE["op2_lines"] = """
WITH t AS (SELECT text, min(doc_id) AS owner, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL GROUP BY text
), w AS (
  SELECT owner, s, sha256(array_to_string(lines[s : s + 2], chr(10))) AS h FROM (SELECT owner, lines, unnest(range(1, len(lines) - 1)) AS s FROM t)
), e AS (SELECT owner, s, min({'o': owner, 't': s}) OVER (PARTITION BY h) AS f FROM w
), gone AS (
  SELECT owner, list(DISTINCT p) AS gone FROM (SELECT owner, unnest(range(s, s + 3)) AS p FROM e WHERE f.o <> owner OR s - f.t >= 3) GROUP BY owner)
SELECT d.doc_id, coalesce(len(t.lines), 0)::BIGINT AS n_lines,
  CASE WHEN d.doc_id <> t.owner THEN len(t.lines) ELSE coalesce(len(gone), 0) END::BIGINT AS n_removed,
  sha256(CASE WHEN d.doc_id <> t.owner THEN '' WHEN gone IS NULL THEN d.text
    ELSE array_to_string(list_filter(t.lines, lambda x, i: NOT list_contains(gone, i)), chr(10)) END) AS kept_sha256
FROM documents d LEFT JOIN t ON d.text = t.text LEFT JOIN gone ON gone.owner = t.owner
"""

ORACLE["op3_topk"] = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

ORACLE["op4_substring"] = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), wins AS (
  SELECT doc_id, s, sha256(array_to_string(words[s : s + 34], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS s FROM w)
), twice AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM wins) WHERE n > 1
), gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(s, s + 35)) AS p FROM twice) GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(words) AS n, coalesce(len(g.gone), 0) AS r,
    CASE WHEN g.gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(g.gone, i)) END AS k
  FROM w LEFT JOIN gone g USING (doc_id)
)
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

ORACLE["op7_embeddings"] = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (SELECT u, w FROM links UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u
), comp AS (SELECT u, least(u, min(w)) AS c FROM reach GROUP BY u
), n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(comp.c, e.vec_id) AS component_id,
  coalesce(comp.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN comp ON comp.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""

ORACLE["op8_urls"] = """
WITH rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), rest AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), fits AS (
  SELECT c.*, rules.h || rules.p AS rule, rules.verdict AS v,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rules.h || rules.p) DESC NULLS LAST, length(rules.h) DESC) AS k
  FROM cut c LEFT JOIN rules ON (c.host = rules.h OR ends_with(c.host, '.' || rules.h)) AND starts_with(c.path, rules.p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits WHERE k = 1
"""

# Every order is applied step by step to the documents of each kind of failure.
ORACLE["op12_filters"] = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS owner FROM documents
), marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 50 THEN 'A' ELSE '' END ||
    CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) THEN 'C' ELSE '' END ||
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > owner THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN marks USING (doc_id)
), g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.l NOT IN (b.l, c.l, d.l, e.l) AND b.l NOT IN (c.l, d.l, e.l) AND c.l NOT IN (d.l, e.l) AND d.l <> e.l
), steps AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1 : step - 1] AS earlier FROM orders, range(1, 6) s(step)
), seen AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS hit, len(list_filter(string_split(earlier, ''), lambda x: contains(fails, x) AND x <> '')) > 0 AS gone
  FROM g, steps
), counted AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (NOT gone AND NOT hit) AS kept, sum(n) FILTER (NOT gone AND hit) AS removed,
    sum(n) FILTER (gone AND hit) AS redundant, sum(n) FILTER (fails = own) AS unique_fails,
    sum(good) FILTER (NOT gone AND hit) AS good_lost, sum(toxic) FILTER (NOT gone AND hit) AS toxic_lost
  FROM seen GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  sum(coalesce(removed, 0)) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM counted
"""
