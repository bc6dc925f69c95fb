"""Registered queries of the analytic operators and their oracle SQL, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import hashing, morphology
from corpusmill.functions import text as T
from corpusmill.functions.lineage import cut
from corpusmill.functions.numbering import long_bucket, positions
from corpusmill.operators import clean, dedup, inference, labels, metrics, profile, results, splits, training, windows
from corpusmill.plans.inputs import PREDICTIONS_SQL, labelled, predictions, table, with_label
from corpusmill.plans.registered import ORACLE, QUERIES, S, query, sql_clean, sql_collapse, sql_marks, sql_tags, sql_tokens, sql_unescape, sql_urls  # noqa: F401
from corpusmill.schema import SequenceParams

REGEX_STEPS = {**T.STEPS, "remove_html": T.remove_tags}
REGEX_TRACK = ["lowercase", "remove_urls", "remove_html", "remove_mentions", "remove_hashtags", "remove_symbols"]
STATS_SQL = """count(*) AS n, count_if(label = 1)::BIGINT AS n_fake, count_if(label = 0)::BIGINT AS n_real, round(count_if(label = 1) / count(*), 6) AS fake_ratio,
  round(avg(n_chars), 3) AS mean_chars, round(median(n_chars)::DOUBLE, 3) AS median_chars, round(avg(n_words), 3) AS mean_words, round(median(n_words)::DOUBLE, 3) AS median_words"""
LABELLED_SQL = "SELECT doc_id AS row_pos, text, source, lang, (1 - quality)::INTEGER AS label FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL"
MEASURED_SQL = f"""SELECT *, length({sql_collapse("text")}) AS c,
  length(regexp_replace(' ' || text, '^{S}+|{S}+$', '', 'g')) AS n_chars, len(list_filter(string_split({sql_collapse("text")}, ' '), lambda t: t <> '')) AS n_words"""


# --- flagship -----------------------------------------------------------------
@query(f"""
WITH c AS (SELECT row_pos, label, {sql_clean("text")} AS text FROM ({LABELLED_SQL})),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY row_pos) = 1),
m AS ({MEASURED_SQL} FROM k)
SELECT label, {STATS_SQL} FROM m GROUP BY label
""")
def flagship_labelled_profile(spark, d):
    """Clean, keep the first of each text, profile by class."""
    cleaned = clean.clean_columns(with_label(spark, d), REGEX_TRACK, ["text"], REGEX_STEPS).select("row_pos", "label", "text")
    kept = cleaned.join(dedup.exact_keep(cleaned).where("keep"), "row_pos", "left_semi")
    return profile.profile(kept, ["label"])


# --- labels (B3-B8, C1, E4, H6) -------------------------------------------------
EVENT_MAP = labels.MappingSpec("EVT", ("click", "purchase"), ("view",))
RAW_EVENT_SQL = "SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ' ' || upper(event_type) || ' ' WHEN 2 THEN 'None' ELSE event_type END AS raw, 'EVT' AS dataset_id FROM events"
TOKEN_SQL = "CASE WHEN lower(trim(raw)) IN ('', 'nan', 'none', 'null') THEN NULL ELSE replace(replace(lower(trim(raw)), '_', '-'), ' ', '-') END"
MAPPED_SQL = f"SELECT *, CASE WHEN t IN ('click', 'purchase') THEN 1 WHEN t IN ('view') THEN 0 END AS label FROM (SELECT *, {TOKEN_SQL} AS t FROM ({RAW_EVENT_SQL}))"


def raw_events(spark, d):
    e, r = F.col("event_type"), F.col("event_id") % 7
    raw = F.when(r == 0, None).when(r == 1, F.concat(F.lit(" "), F.upper(e), F.lit(" "))).when(r == 2, "None").otherwise(e)
    return table(spark, d, "events").select(F.lit("EVT").alias("dataset_id"), "event_id", raw.alias("label_raw"))


@query(f"SELECT dataset_id, count(*) AS n_raw, count_if(t IS NULL)::BIGINT AS n_missing, count_if(t IS NOT NULL AND label IS NULL)::BIGINT AS n_ambiguous, count(label) AS n_kept, count_if(label = 1)::BIGINT AS n_fake, count_if(label = 0)::BIGINT AS n_real FROM ({MAPPED_SQL}) GROUP BY dataset_id")
def label_mapping_report(spark, d):
    return labels.mapping_report(raw_events(spark, d), EVENT_MAP)


@query(f"SELECT event_id, label, row_number() OVER (ORDER BY event_id) - 1 AS row_pos, 'EVT_' || (row_number() OVER (ORDER BY event_id) - 1) AS uid FROM ({MAPPED_SQL}) WHERE label IS NOT NULL")
def label_binarize(spark, d):
    return labels.binarize(raw_events(spark, d), EVENT_MAP, "event_id").select("event_id", "label", "row_pos", "uid")


@query(f"SELECT bool_and(label IN (0, 1)) AS ok FROM ({MAPPED_SQL}) WHERE label IS NOT NULL")
def label_domain_check(spark, d):
    return labels.label_domain_ok(labels.binarize(raw_events(spark, d), EVENT_MAP, "event_id"))


@query(f"SELECT event_id, t AS token FROM (SELECT *, {TOKEN_SQL} AS t FROM ({RAW_EVENT_SQL}))")
def label_tokens(spark, d):
    return raw_events(spark, d).select("event_id", T.label_token(F.col("label_raw")).alias("token"))


# --- cleaning (C2-C17) -----------------------------------------------------------
@query(f"SELECT doc_id, sha256({sql_clean('text')}) AS cleaned FROM documents")
def clean_documents(spark, d):
    return clean.clean_columns(table(spark, d, "documents"), REGEX_TRACK, ["text"], REGEX_STEPS).select("doc_id", hashing.sha256(F.col("text")).alias("cleaned"))


@query(f"SELECT page_id, sha256({sql_clean('html')}) AS cleaned FROM pages")
def clean_pages(spark, d):
    """Tags and urls, which only pages have."""
    return clean.clean_columns(table(spark, d, "pages"), REGEX_TRACK, ["html"], REGEX_STEPS).select("page_id", hashing.sha256(F.col("html")).alias("cleaned"))


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS nfc FROM documents")
def clean_nfc(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.sha256(T.unicode_nfc(F.col("text"))).alias("nfc"))


STOPS = ["the", "of", "and", "to", "in", "is", "der", "die", "de", "la"]


@query(f"""SELECT doc_id, sha256(array_to_string(list_filter(string_split({sql_clean('text')}, ' '), lambda t: t <> '' AND t NOT IN ({', '.join(f"'{w}'" for w in STOPS)})), ' ')) AS kept FROM documents""")
def clean_stopwords(spark, d):
    cleaned = T.apply_steps(F.col("text"), REGEX_TRACK, REGEX_STEPS)
    return table(spark, d, "documents").select("doc_id", hashing.sha256(T.remove_stopwords(cleaned, STOPS)).alias("kept"))


# Nouns: endings and what replaces them, in the order of the Python list.
ENDINGS_SQL = ", ".join(f"('{end}', '{new}')" for end, new in T.NOUN_ENDINGS)
IRREGULAR_SQL = ", ".join(f"('{form}', '{base}')" for form, base in morphology.IRREGULAR.items())


def lemmas_sql(rows: str) -> str:
    """CTEs up to lem (word, lemma) of English ``rows`` (key, text, en): a form's neighbours take fewer bits coded by its base's."""
    words = sql_tokens(sql_marks(sql_unescape(sql_tags(sql_urls("lower(nfc_normalize(coalesce(text, '')))")))))
    return f"""r AS ({rows}), w AS (SELECT key, en, {words} AS ws FROM r), v AS (SELECT ['^'] || ws || ['$'] AS v FROM w WHERE en
), two AS (SELECT a, b, count(*) AS n FROM (SELECT unnest(v[:-2]) AS a, unnest(v[2:]) AS b FROM v) GROUP BY ALL
), cnt AS (SELECT b AS word, sum(n) AS n FROM two WHERE b <> '$' GROUP BY b
), total AS (SELECT sum(n) AS total FROM two
), forms AS (SELECT DISTINCT word, n, left(word, length(word) - length(e)) || c AS base FROM cnt, (VALUES {ENDINGS_SQL}) x(e, c) WHERE ends_with(word, e) AND NOT (e = 's' AND regexp_matches(word, '[siu]s$'))
), asked AS (SELECT forms.word, base, cnt.n AS n_base FROM forms JOIN cnt ON cnt.word = base WHERE length(base) >= 3 AND base <> forms.word AND cnt.n * 20 >= forms.n
), each AS (SELECT 0 AS s, b AS w, a AS x, n FROM two UNION ALL SELECT 1, a, b, n FROM two
), often AS (SELECT s, x, sum(n) AS nx FROM each GROUP BY ALL
), kinds AS (SELECT s, x, nx, total, CASE WHEN nx * 1000 >= total OR length(x) <= 3 THEN x ELSE '-' || right(x, 2) END AS kind FROM often, total
), share AS (SELECT s, kind, sum(nx) / any_value(total) AS p FROM kinds GROUP BY ALL
), beside AS (SELECT each.s, w, kind, sum(n) AS n FROM each JOIN kinds ON each.s = kinds.s AND each.x = kinds.x GROUP BY ALL
), bits AS (
  SELECT word, base, k.s, sum(k.n * log2(0.5 * coalesce(o.n, 0) / (n_base * p) + 0.5)) AS bits, sum(k.n) AS n FROM asked JOIN beside k ON k.w = word
  LEFT JOIN beside o ON o.s = k.s AND o.w = base AND o.kind = k.kind JOIN share ON share.s = k.s AND share.kind = k.kind GROUP BY ALL
), saved AS (SELECT word, base, sum(bits) AS gain FROM bits GROUP BY ALL HAVING sum(bits) > 0 AND min(bits / n) > -0.25
), lem AS (
  SELECT word, base AS lemma FROM saved WHERE word NOT IN (SELECT f FROM (VALUES {IRREGULAR_SQL}) i(f, b))
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY gain DESC, length(base)) = 1 UNION ALL SELECT f, b FROM (VALUES {IRREGULAR_SQL}) i(f, b))"""


def tracks_sql(rows: str) -> str:
    """(key, version, text_sha) of both tracks for ``rows`` (key, text, en)."""
    stops = ", ".join(f"'{w.replace(chr(39), chr(39) * 2)}'" for w in T.ENGLISH_STOPWORDS)
    neural = sql_collapse(sql_unescape(sql_tags(sql_urls("nfc_normalize(coalesce(text, ''))"))))
    return f"""WITH {lemmas_sql(rows)}, m AS (SELECT map(list(word), list(lemma)) AS m FROM lem
), k AS (SELECT key, en, list_filter(ws, lambda t: t NOT IN ({stops})) AS ws FROM w)
SELECT key, 'vCLEAN-C' AS version, sha256(array_to_string(list_transform(ws, lambda t: CASE WHEN en THEN coalesce(m[t], t) ELSE t END), ' ')) AS text_sha FROM k, m
UNION ALL SELECT key, 'vCLEAN-N', sha256({neural}) FROM r"""


def tracks(df, language=None):
    return clean.both_tracks(df, language=language).select("key", "version", hashing.sha256(F.col("text")).alias("text_sha"))


@query(tracks_sql("SELECT doc_id AS key, text, coalesce(lower(lang) = 'en', true) AS en FROM documents"))
def clean_both_tracks(spark, d):
    """Both full tracks: NFC, entities, stop words, and noun lemmas of English rows."""
    return tracks(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text", "lang"), "lang")


@query(f"WITH {lemmas_sql('SELECT doc_id AS key, text, true AS en FROM documents')} SELECT word, base AS lemma, round(gain, 6) AS gain FROM saved QUALIFY row_number() OVER (PARTITION BY word ORDER BY gain DESC, length(base)) = 1")
def clean_noun_lemmas(spark, d):
    """Words of all documents that are used as the word is that their ending points to."""
    return clean.corpus_lemmas(table(spark, d, "documents").select("text")).select("word", "lemma", F.round("gain", 6).alias("gain"))


@query(tracks_sql("SELECT page_id AS key, html AS text, true AS en FROM pages"))
def clean_page_tracks(spark, d):
    """Both full tracks of raw pages, which have tags, entities and urls."""
    return tracks(table(spark, d, "pages").select(F.col("page_id").alias("key"), F.col("html").alias("text")))


@query(f"SELECT doc_id, length(text) AS n_chars, len(list_filter(string_split({sql_collapse('text')}, ' '), lambda t: t <> ''))::INTEGER AS n_words FROM documents")
def text_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", T.char_length(F.col("text")).cast("long").alias("n_chars"), T.word_count(F.col("text")).alias("n_words"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS id, string_split(url, '/')[1] AS owner, string_split(url, '/')[-1] AS name FROM pages")
def text_identifiers(spark, d):
    parts = T.slug_parts(F.col("url"))
    return table(spark, d, "pages").select("page_id", T.sanitize_id(F.col("url")).alias("id"), parts["owner"].alias("owner"), parts["name"].alias("name"))


@query("SELECT event_id, try_cast(raw AS TIMESTAMP) AS ts FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw FROM events)")
def text_timestamps(spark, d):
    raw = F.when(F.col("event_id") % 11 == 0, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "events").select("event_id", T.parse_timestamp(raw).cast("timestamp_ntz").alias("ts"))


@query(f"SELECT doc_id AS row_pos, length(text) AS n_chars, round(length(regexp_replace(text, '[^\\p{{P}}]', '', 'g')) / greatest(length(text), 1), 6) AS punctuation_rate, round(length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) / greatest(length(text), 1), 6) AS capital_rate FROM documents")
def text_surface_features(spark, d):
    out = profile.surface_features(labelled(spark, d))
    return out.withColumn("n_chars", F.col("n_chars").cast("long"))


def tree_sql() -> str:
    """CTEs up to root (n, digest) of the hash tree of documents."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN 'N' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    row = " || ".join(part(c) for c in ("doc_id", "lang", "n_chars", "source", "text"))
    pieces = " || '|' || ".join(f"sum(('0x' || substr(h, {1 + 15 * k}, 15))::BIGINT)::VARCHAR" for k in range(4))
    out = f"""WITH l AS (SELECT doc_id >> {hashing.RANGE_BITS} AS node, sha256({row}) AS h FROM documents
), l0 AS (SELECT node, count(*) AS n, sha256(count(*) || '|' || {pieces}) AS digest FROM l GROUP BY node"""
    for k in range(1, hashing.LEVELS):
        above = "node - node" if k == hashing.LEVELS - 1 else f"node >> {hashing.RANGE_BITS}"
        out += f"\n), l{k} AS (SELECT {above} AS node, sum(n) AS n, sha256(string_agg(node || ':' || digest, '|' ORDER BY node)) AS digest FROM l{k - 1} GROUP BY {above}"
    return out + ")"


@query(f"{tree_sql()} SELECT n::BIGINT AS n, digest FROM l{hashing.LEVELS - 1}")
def hash_table(spark, d):
    """The root of the hash tree of all documents."""
    return hashing.hash_tree(table(spark, d, "documents"), "doc_id").where(F.col("level") == hashing.LEVELS - 1).select("n", "digest")


@query(f"""SELECT doc_id >> {hashing.RANGE_BITS} << {hashing.RANGE_BITS} AS low, (doc_id >> {hashing.RANGE_BITS} << {hashing.RANGE_BITS}) + {(1 << hashing.RANGE_BITS) - 1} AS high,
  count(*) AS n_left, count_if(doc_id % 1501 <> 7)::BIGINT AS n_right FROM documents GROUP BY ALL HAVING count_if(doc_id % 1501 = 7 OR (doc_id % 2003 = 11 AND upper(text) <> text)) > 0""")
def hash_difference(spark, d):
    """Ranges of documents in which a copy with changed and missing rows differs, found from the two hash trees."""
    docs = table(spark, d, "documents")
    changed = F.when(F.col("doc_id") % 2003 == 11, F.upper("text")).otherwise(F.col("text"))
    other = docs.where(F.col("doc_id") % 1501 != 7).withColumn("text", changed)
    return hashing.differing_ranges(*(cut(hashing.hash_tree(t, "doc_id")) for t in (docs, other)))


# --- exact and near duplicates (D1, D2, E5, E13, I1-I8) ---------------------------
@query("SELECT doc_id AS row_pos, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS keep FROM documents")
def dedup_exact(spark, d):
    return dedup.exact_keep(table(spark, d, "documents").select(F.col("doc_id").alias("row_pos"), "text"))


TOKENS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
TERMS_SQL = TOKENS_SQL.replace("lower(text)", "lower(coalesce(text, ''))")


def near_sql(rows: str, threshold: float, sides: str = "l.pos < r.pos") -> str:
    """CTEs up to e (a, b, cosine) of ``rows`` (pos, text) with 1- and 2-grams.

    Two unit vectors of that cosine share a term out of any set that holds more than 1 - threshold^2 of the
    square of one of them, so it is enough to look at each row's rarest terms up to that share.
    """
    return f"""WITH RECURSIVE rows AS ({rows}), wl AS (SELECT pos, {TERMS_SQL} AS ws FROM rows
), tok AS (SELECT pos, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM wl
), cnt AS (SELECT pos, term, count(*) AS tf FROM tok GROUP BY ALL
), voc AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM cnt GROUP BY term ORDER BY cf DESC, term LIMIT 50000
), w AS (SELECT pos, term, df, tf * (ln((1.0 + (SELECT count(*) FROM rows)) / (1 + df)) + 1) AS w FROM cnt JOIN voc USING (term)
), x AS MATERIALIZED (SELECT pos, term, df, w / sqrt(sum(w * w) OVER (PARTITION BY pos)) AS x FROM w
), rare AS (SELECT pos, term FROM (SELECT *, sum(x * x) OVER (PARTITION BY pos ORDER BY df, term ROWS UNBOUNDED PRECEDING) - x * x AS before FROM x) WHERE before <= {1 - threshold**2 + 1e-6}
), c AS (SELECT DISTINCT l.pos AS a, r.pos AS b FROM rare l JOIN x r ON l.term = r.term AND {sides}
), e AS (SELECT a, b, sum(l.x * r.x) AS cosine FROM c JOIN x l ON l.pos = a JOIN x r ON r.pos = b AND l.term = r.term GROUP BY ALL HAVING sum(l.x * r.x) >= {threshold} - 1e-9)"""


GREEDY_SQL = """, n AS (SELECT pos, row_number() OVER (ORDER BY pos) AS i FROM (SELECT DISTINCT b AS pos FROM e)
), walk(i, gone) AS (
  SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT n.i, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.b = n.pos AND NOT list_contains(walk.gone, e.a)) THEN list_append(walk.gone, n.pos) ELSE walk.gone END
  FROM walk JOIN n ON n.i = walk.i + 1), dropped AS (SELECT unnest(gone) AS row_pos FROM (SELECT gone FROM walk ORDER BY i DESC LIMIT 1))"""
DISTINCT_SQL = "SELECT min(doc_id) AS pos, text FROM documents GROUP BY text"


def distinct_texts(spark, d):
    return table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("row_pos")).select("row_pos", "text")


@query(f"{near_sql(DISTINCT_SQL, 0.90)} SELECT a, b, round(cosine, 6) AS cosine FROM e")
def dedup_similar_pairs(spark, d):
    """All distinct documents, with bigrams."""
    return dedup.similar_pairs(distinct_texts(spark, d), 0.90).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(f"{near_sql(DISTINCT_SQL, 0.90)}{GREEDY_SQL} SELECT row_pos FROM dropped")
def dedup_greedy(spark, d):
    """All distinct documents, with bigrams."""
    return dedup.greedy_dropped(dedup.similar_pairs(distinct_texts(spark, d), 0.90))


# what with_text makes of a document without a title
BODY_SQL = f"regexp_replace(' ' || coalesce(text, ''), '^{S}+|{S}+$', '', 'g')"
FIRST_SQL = f"SELECT min(doc_id) AS pos, t AS text FROM (SELECT doc_id, {BODY_SQL} AS t FROM documents) GROUP BY t"


@query(f"""{near_sql(FIRST_SQL, 0.95)}{GREEDY_SQL}, n0 AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM rows) AS k, (SELECT count(*) FROM dropped) AS g)
SELECT 'DOC' AS dataset_id, n AS n_before, n - k AS n_exact_removed, g AS n_near_removed, k - g AS n_kept, round(100 * (n - k + g) / n, 4) AS pct_removed FROM n0""")
def dedup_documents(spark, d):
    """The whole of it with bigrams at 0.95: counts of exact and near duplicates."""
    return dedup.dedup_report(dedup.dedup_flags(labelled(spark, d)), "DOC")


@query(f"""{near_sql(FIRST_SQL, 0.95)}{GREEDY_SQL}
SELECT pos AS pre_dedup_index, row_number() OVER (ORDER BY pos) - 1 AS row_pos FROM rows WHERE pos NOT IN (SELECT row_pos FROM dropped)""")
def dedup_survivors(spark, d):
    """Rows that exact and near dedup keep, renumbered, each with its place before."""
    return dedup.deduplicate(labelled(spark, d)).select("pre_dedup_index", "row_pos")


ODD_SQL = f"SELECT doc_id AS pos, {BODY_SQL} AS text FROM documents"


@query(f"{near_sql(ODD_SQL, 0.90, 'l.pos % 2 = 0 AND r.pos % 2 <> 0')} SELECT DISTINCT b AS row_pos FROM e")
def dedup_across(spark, d):
    """Odd documents too close to an even one, with bigrams; the two sides hold all rows."""
    df = labelled(spark, d).withColumn("odd", F.coalesce(F.col("row_pos") % 2 != 0, F.lit(False)))
    return dedup.across_dropped(df.where("NOT odd").drop("odd"), df.where("odd").drop("odd"))


@query(f"""{near_sql(ODD_SQL, 0.90, 'l.pos % 2 = 0 AND r.pos % 2 <> 0')}, p AS (SELECT count_if(pos % 2 <> 0)::BIGINT AS n, (SELECT count(DISTINCT b) FROM e) AS k FROM rows)
SELECT 'EVEN' AS train_id, 'ODD' AS test_id, n AS n_test_before, k AS n_removed, n - k AS n_test_after, round(100 * k / n, 4) AS pct_removed, 'halves' AS note FROM p""")
def dedup_overlap_report(spark, d):
    """Counts before and after decontamination of the odd half against the even one."""
    df = labelled(spark, d).withColumn("odd", F.coalesce(F.col("row_pos") % 2 != 0, F.lit(False)))
    test = df.where("odd").drop("odd")
    return dedup.overlap_report("EVEN", "ODD", test, dedup.across_dropped(df.where("NOT odd").drop("odd"), test), "halves")


@query("""WITH d AS (SELECT source AS id, CASE WHEN ends_with(source, '9') THEN 'probe' ELSE 'transfer' END AS role, max(lang) AS src FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT a.id AS train_id, b.id AS test_id, CASE WHEN a.src = b.src THEN 'same source family' ELSE '' END AS note FROM d a JOIN d b ON a.id <> b.id WHERE a.role = 'transfer'""")
def dedup_transfer_pairs(spark, d):
    """Sources of documents as corpora, some of them probes; those with one last language count as a family."""
    role = F.when(F.col("source").endswith("9"), "probe").otherwise("transfer")
    known = table(spark, d, "documents").where("source IS NOT NULL").groupBy(F.col("source").alias("dataset_id")).agg(F.first(role).alias("role"), F.max("lang").alias("source"))
    return dedup.transfer_pairs(known)


@query("SELECT doc_id AS pre_dedup_index, row_number() OVER (ORDER BY doc_id) - 1 AS row_pos FROM (SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1)")
def dedup_lineage(spark, d):
    """Survivors renumbered, each with its place before."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("row_pos"), "text")
    kept = rows.join(dedup.exact_keep(rows).where("keep"), "row_pos", "left_semi").withColumnRenamed("row_pos", "pre_dedup_index")
    return positions(kept.select("pre_dedup_index"), ["pre_dedup_index"], long_bucket("pre_dedup_index"))


# --- splits (J1-J7, F1, F3, F4, H4, H5) ---------------------------------------------
STRATIFIED_SQL = f"""WITH r AS (SELECT row_pos, label, sha256('13:' || row_pos) AS h FROM ({LABELLED_SQL})),
c AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM r GROUP BY label),
s AS (SELECT *, total - ceil((0.15::DOUBLE + 0.15::DOUBLE) * total) AS s_train, ceil((0.15::DOUBLE + 0.15::DOUBLE) * total) - ceil(0.5 * ceil((0.15::DOUBLE + 0.15::DOUBLE) * total)) AS s_val FROM c),
t AS (SELECT *, n * s_train / total AS e, floor(n * s_train / total) AS b FROM s),
u AS (SELECT *, b + CASE WHEN row_number() OVER (ORDER BY round(b - e, 9), label) <= s_train - sum(b) OVER () THEN 1 ELSE 0 END AS q_train FROM t),
v AS (SELECT *, (n - q_train) * s_val / sum(n - q_train) OVER () AS e2 FROM u),
y AS (SELECT *, floor(e2) + CASE WHEN row_number() OVER (ORDER BY round(floor(e2) - e2, 9), label) <= s_val - sum(floor(e2)) OVER () THEN 1 ELSE 0 END AS q_val FROM v),
k AS (SELECT r.row_pos, r.label, row_number() OVER (PARTITION BY r.label ORDER BY h, row_pos) - 1 AS k, q_train, q_val FROM r JOIN y USING (label)),
split AS (SELECT row_pos, CASE WHEN k < q_train THEN 'train' WHEN k < q_train + q_val THEN 'val' ELSE 'test' END AS part FROM k)"""


@query(f"{STRATIFIED_SQL} SELECT * FROM split")
def split_stratified(spark, d):
    return splits.stratified(with_label(spark, d), 13, "row_pos")


SOURCE_SQL = """WITH g AS (SELECT source AS src, count(*) AS size, sha256('13:' || source) AS h FROM documents GROUP BY source),
b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY h, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM g),
t AS (SELECT *, before < floor(total * 0.7) AS tr, sum(CASE WHEN before < floor(total * 0.7) THEN size ELSE 0 END) OVER () AS n_train FROM b),
split AS (SELECT doc_id AS row_pos, source, CASE WHEN tr THEN 'train' WHEN before - n_train < floor(total * 0.15) THEN 'val' ELSE 'test' END AS part FROM documents JOIN t ON source = src)"""


@query(f"{SOURCE_SQL} SELECT row_pos, part FROM split")
def split_source_disjoint(spark, d):
    return splits.source_disjoint(labelled(spark, d), 13)


@query(f"{SOURCE_SQL} SELECT source AS src, count(DISTINCT part) AS parts FROM split GROUP BY source HAVING count(DISTINCT part) > 1")
def split_shared_sources(spark, d):
    df = labelled(spark, d)
    return splits.shared_sources(splits.source_disjoint(df, 13), df)


@query("""WITH e AS (SELECT event_id AS row_pos, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS ts FROM events),
k AS (SELECT row_pos, row_number() OVER (ORDER BY ts ASC NULLS LAST, row_pos) - 1 AS k, count(*) OVER () AS n FROM e)
SELECT row_pos, CASE WHEN k < round(n * 0.7) THEN 'train' WHEN k < round(n * 0.85) THEN 'val' ELSE 'test' END AS part FROM k""")
def split_temporal(spark, d):
    ev = table(spark, d, "events").select(F.col("event_id").alias("row_pos"), F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("ts"))
    return splits.temporal(ev)


@query(f"{STRATIFIED_SQL} SELECT part, count(*) AS n, sum(row_pos)::BIGINT AS ids FROM split GROUP BY part")
def split_part_sizes(spark, d):
    return splits.stratified(with_label(spark, d), 13, "row_pos").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("row_pos").alias("ids"))


@query("SELECT 'DOC' AS dataset_id, r AS regime, s::INTEGER AS seed, (SELECT count(*) FROM documents) AS n_rows, true AS ok FROM (VALUES ('S-RAND', 13), ('S-RAND', 42), ('S-SRC', 13), ('S-SRC', 42)) v(r, s)")
def split_partition_check(spark, d):
    """All regimes of all documents cover every row once."""
    df = labelled(spark, d).withColumn("label", F.coalesce(F.col("label_raw").cast("int"), F.lit(2))).withColumn("uid", F.col("row_pos").cast("string"))
    n = df.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    return splits.partition_check(splits.all_regimes(df, [13, 42], "source"), n)


@query(f"""WITH r AS (SELECT row_pos, label, row_number() OVER (PARTITION BY label ORDER BY sha256(row_pos::VARCHAR), row_pos) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM ({LABELLED_SQL})),
d AS (SELECT label, ('0x' || substr(sha256('13:' || label || ':' || k), 1, 15))::BIGINT % n AS k FROM r) SELECT r.row_pos, r.label FROM d JOIN r USING (label, k)""")
def split_resample(spark, d):
    """A bootstrap sample of each class, drawn by a generator of counters that SQL can replay."""
    return splits.stratified_resample(with_label(spark, d).select("row_pos", "label"), 13)


# --- statistics (E1-E3) ---------------------------------------------------------------
@query(f"WITH m AS ({MEASURED_SQL} FROM documents), j AS (SELECT m.*, (1 - quality)::INTEGER AS label FROM m LEFT JOIN labels USING (doc_id)) SELECT source, {STATS_SQL} FROM j GROUP BY source")
def profile_sources(spark, d):
    df = labelled(spark, d).withColumn("label", (1 - F.col("label_raw").cast("int")).cast("int"))
    return profile.profile(df, ["source"])


@query(f"""{STRATIFIED_SQL}, m AS ({MEASURED_SQL} FROM ({LABELLED_SQL})), j AS (
  SELECT NULL::INTEGER AS seed, 'full' AS part, * FROM m UNION ALL SELECT 13, part, m.* FROM m JOIN split USING (row_pos))
SELECT 'DOC' AS dataset_id, 'vBIN' AS version, seed, part, {STATS_SQL} FROM j GROUP BY seed, part""")
def profile_parts(spark, d):
    full = with_label(spark, d).withColumn("version", F.lit("vBIN"))
    parts = splits.stratified(full, 13, "row_pos").select(F.lit("DOC").alias("dataset_id"), F.lit(13).alias("seed"), "part", "row_pos")
    return profile.profile_parts(full, parts)


# --- metrics (K1-K8, E6-E9, F5, F6) ------------------------------------------------------
CORE_SQL = f"""WITH p AS ({PREDICTIONS_SQL}), c AS (SELECT model_id, seed, count_if(y_true = 1 AND y_pred = 1) AS tp, count_if(y_true = 0 AND y_pred = 1) AS fp,
  count_if(y_true = 1 AND y_pred = 0) AS fn, count_if(y_true = 0 AND y_pred = 0) AS tn FROM p GROUP BY ALL)"""


@query(f"""{CORE_SQL} SELECT model_id, seed, (tp + fp + fn + tn)::BIGINT AS n, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy,
  round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 9) AS macro_f1, round((tp / (tp + fp) + tn / (tn + fn)) / 2, 9) AS macro_precision,
  round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS macro_recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1_fake, round(2 * tn / (2 * tn + fp + fn), 9) AS f1_real FROM c""")
def metrics_core(spark, d):
    out = metrics.core_metrics(predictions(spark, d), ["model_id", "seed"])
    return out.select("model_id", "seed", "n", *[F.round(c, 9).alias(c) for c in out.columns[3:]])


@query(f"""WITH p AS ({PREDICTIONS_SQL}), r AS (SELECT *, rank() OVER (PARTITION BY model_id, seed ORDER BY y_prob) + (count(*) OVER (PARTITION BY model_id, seed, y_prob) - 1) / 2 AS rk FROM p),
a AS (SELECT model_id, seed, (sum(CASE WHEN y_true = 1 THEN rk END) - count_if(y_true = 1) * (count_if(y_true = 1) + 1) / 2) / (count_if(y_true = 1) * count_if(y_true = 0)) AS auc FROM r GROUP BY ALL),
s AS (SELECT model_id, seed, y_prob, count_if(y_true = 1) AS pos, count(*) AS k FROM p GROUP BY ALL),
t AS (SELECT *, sum(pos) OVER w AS tp, sum(k) OVER w AS seen, sum(pos) OVER (PARTITION BY model_id, seed) AS total FROM s WINDOW w AS (PARTITION BY model_id, seed ORDER BY y_prob DESC)),
v AS (SELECT model_id, seed, sum(pos / total * tp / seen) AS ap FROM t GROUP BY ALL)
SELECT model_id, seed, round(auc, 9) AS roc_auc, round(ap, 9) AS pr_auc FROM a JOIN v USING (model_id, seed)""")
def metrics_ranking(spark, d):
    out = metrics.ranking_metrics(predictions(spark, d), ["model_id", "seed"])
    return out.select("model_id", "seed", F.round("roc_auc", 9).alias("roc_auc"), F.round("pr_auc", 9).alias("pr_auc"))


BINS_SQL = f"""WITH p AS ({PREDICTIONS_SQL}), b AS (SELECT model_id, seed, least(floor(greatest(y_prob, 1 - y_prob) * 15), 14)::INTEGER AS bin,
  greatest(y_prob, 1 - y_prob) AS conf, ((y_prob >= 0.5)::INTEGER = y_true)::INTEGER::DOUBLE AS hit FROM p),
g AS (SELECT model_id, seed, bin, count(*) AS n, avg(conf) AS confidence, avg(hit) AS accuracy FROM b GROUP BY ALL)"""


@query(f"{BINS_SQL} SELECT model_id, seed, round(sum(n * abs(accuracy - confidence)) / sum(n), 9) AS ece FROM g GROUP BY ALL")
def metrics_ece(spark, d):
    return metrics.ece(predictions(spark, d), ["model_id", "seed"]).select("model_id", "seed", F.round("ece", 9).alias("ece"))


@query(f"{BINS_SQL} SELECT model_id, seed, bin, n, round(confidence, 9) AS confidence, round(accuracy, 9) AS accuracy FROM g")
def metrics_calibration_bins(spark, d):
    out = metrics.calibration_bins(predictions(spark, d), ["model_id", "seed"])
    return out.select("model_id", "seed", "bin", "n", F.round("confidence", 9).alias("confidence"), F.round("accuracy", 9).alias("accuracy"))


RANKING_SQL = f"""r AS (SELECT *, rank() OVER (PARTITION BY model_id, seed ORDER BY y_prob) + (count(*) OVER (PARTITION BY model_id, seed, y_prob) - 1) / 2 AS rk FROM p),
a AS (SELECT model_id, seed, (sum(CASE WHEN y_true = 1 THEN rk END) - count_if(y_true = 1) * (count_if(y_true = 1) + 1) / 2) / (count_if(y_true = 1) * count_if(y_true = 0)) AS auc FROM r GROUP BY ALL),
s AS (SELECT model_id, seed, y_prob, count_if(y_true = 1) AS pos, count(*) AS k FROM p GROUP BY ALL),
t AS (SELECT *, sum(pos) OVER w AS tp, sum(k) OVER w AS seen, sum(pos) OVER (PARTITION BY model_id, seed) AS total FROM s WINDOW w AS (PARTITION BY model_id, seed ORDER BY y_prob DESC)),
v AS (SELECT model_id, seed, sum(pos / total * tp / seen) AS ap FROM t GROUP BY ALL)"""


@query(f"""{CORE_SQL}, {RANKING_SQL}, b AS (SELECT model_id, seed, least(floor(greatest(y_prob, 1 - y_prob) * 15), 14) AS bin, greatest(y_prob, 1 - y_prob) AS conf, ((y_prob >= 0.5)::INTEGER = y_true)::INTEGER AS hit FROM p),
g AS (SELECT model_id, seed, bin, count(*) AS k, avg(conf) AS confidence, avg(hit) AS accuracy FROM b GROUP BY ALL), e AS (SELECT model_id, seed, sum(k * abs(accuracy - confidence)) / sum(k) AS ece FROM g GROUP BY ALL)
SELECT model_id, seed, (tp + fp + fn + tn)::BIGINT AS n, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 9) AS macro_f1,
  round((tp / (tp + fp) + tn / (tn + fn)) / 2, 9) AS macro_precision, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS macro_recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1_fake,
  round(2 * tn / (2 * tn + fp + fn), 9) AS f1_real, round(auc, 9) AS roc_auc, round(ap, 9) AS pr_auc, CASE WHEN model_id <> 'llm_zero_shot' THEN round(ece, 9) END AS ece
FROM c JOIN a USING (model_id, seed) JOIN v USING (model_id, seed) JOIN e USING (model_id, seed)""".replace(PREDICTIONS_SQL, PREDICTIONS_SQL.replace("'M2'", "'llm_zero_shot'")))
def metrics_all(spark, d):
    """All metrics side by side; the second model counts as one without probabilities."""
    p = predictions(spark, d).withColumn("model_id", F.when(F.col("model_id") == "M2", "llm_zero_shot").otherwise(F.col("model_id")))
    out = metrics.all_metrics(p, ["model_id", "seed"])
    return out.select("model_id", "seed", "n", *[F.round(c, 9).alias(c) for c in out.columns[3:]])


@query(f"""{CORE_SQL}, f AS (SELECT model_id, seed, (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2 AS macro_f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c),
l AS (SELECT model_id, 'macro_f1' AS metric, macro_f1 AS v FROM f UNION ALL SELECT model_id, 'accuracy', accuracy FROM f)
SELECT model_id, metric, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS std, count(*) AS n FROM l GROUP BY ALL""")
def metrics_over_seeds(spark, d):
    out = metrics.aggregate_metrics(metrics.core_metrics(predictions(spark, d), ["model_id", "seed"]), ["model_id"], ["macro_f1", "accuracy"])
    return out.select("model_id", "metric", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "n")


@query(f"""{CORE_SQL}, f AS (SELECT model_id, seed, (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2 AS f1 FROM c)
SELECT a.model_id, round(avg(a.f1 - b.f1), 9) AS delta_f1_mean, round(stddev_pop(b.f1), 9) AS cross_f1_std FROM f a JOIN f b ON a.model_id = b.model_id AND a.seed = 0 AND b.seed > 0 GROUP BY ALL""")
def metrics_transfer(spark, d):
    """Seed 0 as the home domain, the others as targets."""
    f1 = metrics.core_metrics(predictions(spark, d), ["model_id", "seed"])
    home = f1.where("seed = 0").select("model_id", F.col("macro_f1").alias("in_f1"))
    rows = f1.where("seed > 0").join(home, "model_id").select("model_id", F.col("seed").alias("target"), "in_f1", F.col("macro_f1").alias("cross_f1"))
    out = metrics.transfer_metrics(rows, ["model_id"])
    return out.select("model_id", F.round("delta_f1_mean", 9).alias("delta_f1_mean"), F.round("cross_f1_std", 9).alias("cross_f1_std"))


PAIRED_SQL = f"WITH p AS ({PREDICTIONS_SQL}), j AS (SELECT a.seed, a.row_pos, a.y_true, a.y_pred AS pa, b.y_pred AS pb, 0.9 + (a.row_pos % 10) / 100.0::DOUBLE AS sim FROM p a JOIN p b ON a.row_pos = b.row_pos AND a.model_id = 'M1' AND b.model_id = 'M2')"


def paired(spark, d):
    p = predictions(spark, d)
    pairs = inference.model_pairs(spark.createDataFrame([("M1", 0), ("M2", 1)], "model_id string, ord int"))
    return inference.align(p, pairs)


@query(f"""{PAIRED_SQL} SELECT seed, round(avg((pa = y_true)::INTEGER), 9) AS clean_accuracy, round(avg((pb = y_true)::INTEGER), 9) AS attacked_accuracy,
  round(count_if(pa = y_true AND pb <> y_true) / count_if(pa = y_true), 9) AS attack_success_rate, round(avg(CASE WHEN pa = y_true AND pb <> y_true THEN sim END), 9) AS success_similarity FROM j GROUP BY seed""")
def metrics_robustness(spark, d):
    rows = paired(spark, d).withColumnsRenamed({"pred_a": "clean_pred", "pred_b": "attacked_pred"}).withColumn("similarity", 0.9 + (F.col("row_pos") % 10) / 100.0)
    out = metrics.robustness_metrics(rows, ["seed"])
    return out.select("seed", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query("""SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE (b.p_size < a.p_size AND b.p_retailprice >= a.p_retailprice)
  OR (b.p_size = a.p_size AND b.p_retailprice > a.p_retailprice))""")
def metrics_pareto(spark, d):
    """Frontier of size against price (ties in both are settled by the key)."""
    return metrics.pareto(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice")


SHORTCUT_SQL = f"""SELECT row_pos, label AS y_true, length(text) AS n_chars, (c > 0.02)::INTEGER AS y_pred, CASE WHEN c > 0.02 THEN least(1.0, 0.5 + c * 5) ELSE 1 - c * 5 END AS p_pred
  FROM (SELECT *, round(length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) / greatest(length(text), 1), 6) AS c FROM ({LABELLED_SQL}))"""


def shortcut(spark, d):
    """(row_pos, y_true, n_chars, y_pred, y_prob): labelled documents under a rule that looks at capital letters only."""
    rows = with_label(spark, d)
    c = F.col("capital_rate")
    prob = F.when(c > 0.02, F.least(F.lit(1.0), 0.5 + c * 5)).otherwise(c * 5)
    seen = profile.surface_features(rows).select("row_pos", F.col("n_chars").cast("long").alias("n_chars"), (c > 0.02).cast("int").alias("y_pred"), prob.alias("y_prob"))
    return rows.select("row_pos", F.col("label").alias("y_true")).join(seen, "row_pos")


BUCKETS_SQL = "SELECT *, least(floor((row_number() OVER (ORDER BY n_chars, row_pos) - 1) * 4 / count(*) OVER ()), 3)::INTEGER AS bucket FROM s"


@query(f"""WITH s AS ({SHORTCUT_SQL}), b AS ({BUCKETS_SQL})
SELECT bucket, count(*) AS n, min(n_chars) AS shortest, max(n_chars) AS longest, round(avg((y_pred = y_true)::INTEGER), 9) AS accuracy FROM b GROUP BY bucket""")
def metrics_length_buckets(spark, d):
    """Accuracy of a shortcut by quarters of length."""
    rows = metrics.length_buckets(shortcut(spark, d), "n_chars")
    right = (F.col("y_pred") == F.col("y_true")).cast("int")
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.round(F.avg(right), 9).alias("accuracy"))


@query(f"""WITH s AS ({SHORTCUT_SQL}), b AS ({BUCKETS_SQL}),
k AS (SELECT bucket, CASE WHEN y_pred = 1 THEN CASE WHEN y_true = 1 THEN 'hit' ELSE 'false alarm' END ELSE CASE WHEN y_true = 0 THEN 'correct rejection' ELSE 'miss' END END AS kind, p_pred >= 0.9 AS confident FROM b)
SELECT bucket, kind, confident, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY bucket), 9) AS share FROM k GROUP BY bucket, kind, confident""")
def metrics_error_taxonomy(spark, d):
    """Kinds of outcome of a shortcut by quarters of length, and how sure it was."""
    rows = metrics.length_buckets(shortcut(spark, d), "n_chars")
    return metrics.error_taxonomy(rows, ["bucket"]).withColumn("share", F.round("share", 9))


# --- inference (L1-L8, F7, F8, D7, D10) ------------------------------------------------------
# P(Z > z) by Simpson's rule: the tail of the chi-square with one degree of freedom is twice that at its root.
NORMAL_TAIL_SQL = """(SELECT sum(w * exp(-z * z / 2)) * h / 3 / sqrt(2 * pi()) FROM (
  SELECT root + (12.0 - root) / 2000 * i AS z, (12.0 - root) / 2000 AS h, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(2001) r(i)) GROUP BY h)"""


def mcnemar_sql(keys: str) -> str:
    return f"""k AS (SELECT {keys}, count_if(pa = y_true AND pb <> y_true)::BIGINT AS n_b, count_if(pb = y_true AND pa <> y_true)::BIGINT AS n_c FROM j GROUP BY ALL
), m AS (SELECT *, n_b + n_c AS n, least(n_b, n_c) AS lo, n_b + n_c < 25 AS exact, power(greatest(abs(n_b - n_c) - 1, 0), 2) / nullif(n_b + n_c, 0) AS chi FROM k
), t AS (SELECT *, sqrt(chi) AS root FROM m)
SELECT {keys}, n_b, n_c, round(CASE WHEN exact THEN lo ELSE chi END, 9) AS statistic, exact, round(CASE WHEN exact
  THEN least(1.0, 2 * list_sum(list_transform(range(0, lo + 1), lambda i: factorial(n::INTEGER)::DOUBLE / factorial(i::INTEGER)::DOUBLE / factorial((n - i)::INTEGER)::DOUBLE)) * power(0.5, n))
  ELSE 2 * {NORMAL_TAIL_SQL} END, 7) AS p_value FROM t"""


def mcnemar_of(rows, by):
    return inference.mcnemar(rows, by).select(*by, "n_b", "n_c", F.round("statistic", 9).alias("statistic"), "exact", F.round("p_value", 7).alias("p_value"))


@query(f"{PAIRED_SQL}, {mcnemar_sql('seed')}")
def inference_mcnemar(spark, d):
    """Many discordant rows in each group: the chi-square branch."""
    return mcnemar_of(paired(spark, d), ["seed"])


@query(f"{PAIRED_SQL.replace('a.seed, a.row_pos', '(a.row_pos // 1000) // 16 AS block, a.row_pos')}, {mcnemar_sql('block')}")
def inference_mcnemar_exact(spark, d):
    """Groups of a few orders: mostly the exact branch."""
    rows = paired(spark, d).withColumn("block", F.floor(F.floor(F.col("row_pos") / 1000) / 16))
    return mcnemar_of(rows, ["block"])


@query(f"{PAIRED_SQL} SELECT seed, y_true::INTEGER AS y, pa AS a, pb AS b, count(*) AS n FROM j GROUP BY ALL")
def inference_paired_cells(spark, d):
    """The joint counts that bootstraps draw from."""
    return inference.paired_cells(paired(spark, d), ["seed"])


@query("""WITH v AS (SELECT p_brand AS g, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS side, p_size AS value FROM part)
SELECT x.g AS brand, round(avg(sign(x.value - y.value)), 9) AS cliffs_delta FROM v x JOIN v y ON x.g = y.g AND x.side = 'a' AND y.side = 'b' GROUP BY x.g""")
def inference_cliffs_delta(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b").alias("side"), F.col("p_size").alias("value"))
    return inference.cliffs_delta(rows, ["brand"]).select("brand", F.round("cliffs_delta", 9).alias("cliffs_delta"))


P_VALUES_SQL = "SELECT n_nationkey AS k, n_regionkey AS f, ((n_nationkey * 37 + 11) % 101) / 1000.0::DOUBLE AS p_value FROM nation"


@query(f"""WITH p AS ({P_VALUES_SQL}), r AS (SELECT *, p_value * count(*) OVER (PARTITION BY f) / row_number() OVER (PARTITION BY f ORDER BY p_value) AS raw FROM p),
a AS (SELECT *, least(1.0, min(raw) OVER (PARTITION BY f ORDER BY p_value DESC ROWS UNBOUNDED PRECEDING)) AS adj FROM r)
SELECT k, f, round(adj, 9) AS p_adjusted, adj < 0.05 AS significant FROM a""")
def inference_bh_fdr(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("f"), (((F.col("n_nationkey") * 37 + 11) % 101) / 1000.0).alias("p_value"))
    return inference.bh_fdr(rows, ["f"]).select("k", "f", F.round("p_adjusted", 9).alias("p_adjusted"), "significant")


@query("""WITH v AS (SELECT l_orderkey % 40 AS block, l_returnflag AS t, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)
SELECT block, t, rank() OVER (PARTITION BY block ORDER BY value DESC) + (count(*) OVER (PARTITION BY block, value) - 1) / 2 AS rank FROM v""")
def inference_ranks(spark, d):
    v = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 40).alias("block"), F.col("l_returnflag").alias("t")).agg(F.sum("l_quantity").alias("value"))
    return inference.average_ranks(v, "block", "t", "value")


BLOCKS_SQL = """WITH v AS (SELECT l_orderkey % 40 AS block, l_returnflag AS t, sum(l_quantity) AS value FROM lineitem GROUP BY ALL),
r AS (SELECT block, t, rank() OVER (PARTITION BY block ORDER BY value DESC) + (count(*) OVER (PARTITION BY block, value) - 1) / 2 AS rk FROM v)"""


def blocks(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 40).alias("block"), F.col("l_returnflag").alias("t")).agg(F.sum("l_quantity").alias("value"))


# Three treatments leave two degrees of freedom, whose tail is exp(-x / 2).
@query(f"""{BLOCKS_SQL}, s AS (SELECT t, sum(rk) AS s, count(*) AS n FROM r GROUP BY t), o AS (SELECT sum(s * s) AS ss, count(*) AS k, max(n) AS n FROM s),
ties AS (SELECT sum(power(c, 3) - c) AS ties FROM (SELECT count(*) AS c FROM v GROUP BY block, value)),
f AS (SELECT n, k, (12 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (n * (k * k * k - k))) AS x FROM o, ties)
SELECT n, k, round(x, 9) AS statistic, round(exp(-x / 2), 9) AS p_value FROM f""")
def inference_friedman(spark, d):
    out = inference.friedman(blocks(spark, d), "block", "t", "value")
    return out.select("n", "k", F.round("statistic", 9).alias("statistic"), F.round("p_value", 9).alias("p_value"))


# The normal distribution on a grid of 1/1000, by the trapezoid rule; values between its points by interpolation.
@query(f"""{BLOCKS_SQL}, m AS (SELECT t, avg(rk) AS rk, count(*) AS n FROM r GROUP BY t), k AS (SELECT count(*) AS k FROM m),
p AS (SELECT x.t AS a, y.t AS b, x.rk AS rank_a, y.rk AS rank_b, abs(x.rk - y.rk) / sqrt(k * (k + 1) / (6 * x.n)) * sqrt(2) AS q, k FROM m x JOIN m y ON x.t < y.t, k),
g AS (SELECT i, i / 1000.0 - 10 AS z, exp(-power(i / 1000.0 - 10, 2) / 2) / sqrt(2 * pi()) AS f FROM range(20001) t(i)),
c AS (SELECT i, z, f, (sum(f) OVER (ORDER BY i) - f / 2 - exp(-50.0) / sqrt(2 * pi()) / 2) / 1000 AS cdf FROM g),
s AS (SELECT a, b, rank_a, rank_b, k, c.f, c.cdf, c.i + floor(q * 1000)::BIGINT AS at, q * 1000 - floor(q * 1000) AS part FROM p, c),
u AS (SELECT s.*, coalesce(lo.cdf, 1) * (1 - part) + coalesce(hi.cdf, 1) * part AS above FROM s LEFT JOIN c lo ON lo.i = s.at LEFT JOIN c hi ON hi.i = s.at + 1)
SELECT a, b, round(rank_a, 9) AS rank_a, round(rank_b, 9) AS rank_b, round(least(1, greatest(0, 1 - sum(k * f * power(greatest(above - cdf, 0), k - 1)) / 1000)), 5) AS p_value FROM u GROUP BY ALL""")
def inference_nemenyi(spark, d):
    out = inference.nemenyi(blocks(spark, d), "block", "t", "value")
    return out.select("a", "b", F.round("rank_a", 9).alias("rank_a"), F.round("rank_b", 9).alias("rank_b"), F.round("p_value", 5).alias("p_value"))


def bootstrap_sql(keys: list[str], joined: str, draws: int = inference.RESAMPLES) -> str:
    """CTEs up to boot (keys, n, observed_diff, mean_diff, ci_low, ci_high, p_value) of ``joined`` (keys, y_true, pa, pb).

    Draw by draw: a binomial for each cell of a class out of what the cells before left, by its distribution function.
    """
    k = ", ".join(keys)
    stream = " || ':' || ".join(["'13'", *keys, "y"])
    f1 = lambda p, q: " + ".join(f"coalesce(2.0 * {c} / nullif({c} * 2 + {w}, 0), 0)" for c, w in ((p[0], f"{p[1]} + {q[0]}"), (q[1], f"{q[0]} + {p[1]}")))
    classes = lambda p, q: " + ".join(f"({c} * 2 + {w} > 0)::INT" for c, w in ((p[0], f"{p[1]} + {q[0]}"), (q[1], f"{q[0]} + {p[1]}")))
    # counts of truth y and prediction, for a and for b, from cells x<y><a><b>
    a = [["x000 + x001", "x010 + x011"], ["x100 + x101", "x110 + x111"]]
    b = [["x000 + x010", "x001 + x011"], ["x100 + x110", "x101 + x111"]]
    score = lambda t: f"({f1([f'({v})' for v in t[0]], [f'({v})' for v in t[1]])}) / nullif({classes([f'({v})' for v in t[0]], [f'({v})' for v in t[1]])}, 0)"
    out = f"""c AS (SELECT {k}, y, list(coalesce(n, 0) ORDER BY i) AS c FROM (SELECT DISTINCT {k} FROM {joined}) g CROSS JOIN range(2) a(y) CROSS JOIN range(4) b(i)
  LEFT JOIN (SELECT {k}, y_true AS y, pa * 2 + pb AS i, count(*) AS n FROM {joined} GROUP BY ALL) m USING ({k}, y, i) GROUP BY ALL
), d0 AS (SELECT {k}, y, draw, c, list_sum(c)::BIGINT AS m, list_sum(c)::BIGINT AS rest, []::BIGINT[] AS xs FROM c, range({draws}) r(draw)"""
    for j in range(3):
        out += f"""
), u{j} AS (SELECT *, CASE WHEN rest > 0 THEN c[{j + 1}] / rest ELSE 0 END AS p, (('0x' || substr(sha256({stream} || ':{j}:' || draw), 1, 15))::BIGINT::DOUBLE + 0.5) / power(2.0, 60) AS u FROM d{j}
), s{j} AS (SELECT {k}, y, m, p, floor(m * p)::BIGINT AS mid, ceil(12 * sqrt(m * p * (1 - p)) + 5)::BIGINT AS reach FROM u{j} WHERE p > 0 AND p < 1 GROUP BY ALL
), f{j} AS (SELECT {k}, y, m, x, CASE WHEN x = least(m, mid + reach) THEN 2.0 ELSE sum(exp(lgamma(m + 1) - lgamma(x + 1) - lgamma(m - x + 1) + x * ln(p) + (m - x) * ln(1 - p))) OVER (PARTITION BY {k}, y, m ORDER BY x) END AS cdf
  FROM (SELECT *, unnest(range(greatest(0, mid - reach), least(m, mid + reach) + 1)) AS x FROM s{j})
), d{j + 1} AS (SELECT {k}, y, draw, c, m - x AS m, rest - c[{j + 1}] AS rest, list_append(xs, x) AS xs FROM (
  SELECT u{j}.*, CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN u{j}.m ELSE f{j}.x END AS x FROM u{j} ASOF LEFT JOIN f{j} ON {" AND ".join(f"u{j}.{c} = f{j}.{c}" for c in (*keys, "y", "m"))} AND u{j}.u <= f{j}.cdf)"""
    cells = ", ".join(f"max(CASE WHEN y = {y} THEN xs[{i + 1}] END) AS x{y}{i // 2}{i % 2}" for y in (0, 1) for i in range(4))
    seen = cells.replace("xs[", "c[")
    return out + f"""
), whole AS (SELECT {k}, y, draw, list_append(xs, m) AS xs FROM d3
), diffs AS (SELECT {k}, {score(a)} - {score(b)} AS diff FROM (SELECT {k}, draw, {cells} FROM whole GROUP BY ALL)
), obs AS (SELECT {k}, x000 + x001 + x010 + x011 + x100 + x101 + x110 + x111 AS n, {score(a)} - {score(b)} AS observed_diff FROM (SELECT {k}, {seen} FROM c GROUP BY ALL)
), boot AS (SELECT {k}, any_value(n)::BIGINT AS n, any_value(observed_diff) AS observed_diff, avg(diff) AS mean_diff, quantile_cont(diff, 0.025) AS ci_low, quantile_cont(diff, 0.975) AS ci_high,
  least(1.0, 2 * least(avg((diff <= 0)::INT), avg((diff >= 0)::INT))) AS p_value FROM diffs JOIN obs USING ({k}) GROUP BY {k})"""


BOOT_SQL = "n, round(observed_diff, 9) AS observed_diff, round(mean_diff, 9) AS mean_diff, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, round(p_value, 9) AS p_value"


def rounded_boot(df, keys):
    return df.select(*keys, "n", *[F.round(c, 9).alias(c) for c in ("observed_diff", "mean_diff", "ci_low", "ci_high", "p_value")])


@query(f"{PAIRED_SQL}, {bootstrap_sql(['seed'], 'j')} SELECT seed, {BOOT_SQL} FROM boot")
def inference_bootstrap(spark, d):
    return rounded_boot(inference.paired_bootstrap(paired(spark, d), ["seed"]), ["seed"])


@query(f"{PAIRED_SQL.replace('SELECT a.seed', 'SELECT a.model_id AS a_id, b.model_id AS b_id, a.seed')}, {bootstrap_sql(['a_id', 'b_id'], 'j')} SELECT a_id, b_id, {BOOT_SQL} FROM boot")
def inference_pairwise_bootstrap(spark, d):
    """The pairwise driver's bootstrap over the rows of all seeds."""
    p = predictions(spark, d)
    scores = metrics.core_metrics(p, ["model_id", "seed"]).select("model_id", "seed", F.col("macro_f1").alias("value"))
    out = inference.pairwise_comparisons(p, spark.createDataFrame([("M1", 0), ("M2", 1)], "model_id string, ord int"), scores)
    return rounded_boot(out, ["a_id", "b_id"])


@query()
def inference_pairwise(spark, d):
    p = predictions(spark, d)
    scores = metrics.core_metrics(p, ["model_id", "seed"]).select("model_id", "seed", F.col("macro_f1").alias("value"))
    return inference.pairwise_comparisons(p, spark.createDataFrame([("M1", 0), ("M2", 1)], "model_id string, ord int"), scores)


# --- arrays and windows (N1-N5, E11, M9, D11) ---------------------------------------------------
@query(f"""WITH t AS (SELECT doc_id, len(list_filter(string_split({sql_collapse('text')}, ' '), lambda t: t <> ''))::INTEGER AS n FROM documents),
w AS (SELECT doc_id, n, unnest(range(0, 1 + ceil(greatest(n - 510, 0) / 128)::BIGINT)) AS i FROM t)
SELECT doc_id, i::INTEGER AS window_idx, (i * 128)::INTEGER AS "start", least(i * 128 + 510, n)::INTEGER AS "end" FROM w""")
def windows_spans(spark, d):
    p = SequenceParams()
    counted = table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("n"))
    rows = counted.select("doc_id", F.posexplode(windows.window_spans(F.col("n"), p.content, p.stride_tokens)).alias("window_idx", "span"))
    return rows.select("doc_id", "window_idx", F.col("span.start").alias("start"), F.col("span.end").alias("end"))


@query(f"""WITH t AS (SELECT doc_id, len({sql_tokens('text')}) AS n FROM documents),
w AS (SELECT doc_id, n, unnest(range(0, 1 + ceil(greatest(n - 510, 0) / 128)::BIGINT)) AS i FROM t)
SELECT doc_id AS doc_idx, i::INTEGER AS window_idx, 512 AS width, (least(i * 128 + 510, n) - i * 128 + 2)::INTEGER AS used FROM w""")
def windows_tokens(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc_idx"), F.lit(0).alias("label"), "text")
    return windows.token_windows(docs).select("doc_idx", "window_idx", F.size("input_ids").alias("width"), F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("used"))


@query(f"SELECT doc_id AS doc_idx, 0 AS window_idx, 64 AS width, (least(len({sql_tokens('text')}), 62) + 2)::INTEGER AS used, 101 AS first, CASE WHEN len({sql_tokens('text')}) < 62 THEN 0 ELSE 102 END AS last FROM documents")
def windows_title_only(spark, d):
    """One window of at most 64 ids, special ones included."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc_idx"), F.lit(0).alias("label"), "text")
    out = windows.token_windows(docs, title_only=True)
    used = F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b)
    return out.select("doc_idx", "window_idx", F.size("input_ids").alias("width"), used.alias("used"), F.element_at("input_ids", 1).alias("first"), F.element_at("input_ids", -1).alias("last"))


@query(f"""WITH t AS (SELECT doc_id, label, {sql_tokens('text')} AS ws FROM (SELECT doc_id, 0 AS label, text FROM documents)),
w AS (SELECT doc_id, ws, unnest(range(0, 1 + ceil(greatest(len(ws) - 510, 0) / 128)::BIGINT)) AS i FROM t)
SELECT doc_id AS doc_idx, i::INTEGER AS window_idx, sum(length(x) + 1)::BIGINT AS id_sum FROM (SELECT doc_id, i, unnest(ws[i * 128 + 1 : least(i * 128 + 510, len(ws))] || ['', '']) AS x FROM w) GROUP BY ALL""")
def windows_ids(spark, d):
    """Ids of a tokenizer that is handed in (here the length of a word plus one; special ids are 1, padding 0)."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc_idx"), F.lit(0).alias("label"), "text")
    out = windows.token_windows(docs, cls_id=1, sep_id=1, ids=lambda c: F.transform(T.tokens(c), lambda t: F.length(t) + 1))
    return out.select("doc_idx", "window_idx", F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, b: a + b).alias("id_sum"))


@query("""WITH e AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM e GROUP BY ALL)
SELECT label, max(n) AS n_windows, round(sum(m * m), 6) AS norm2 FROM m GROUP BY label""")
def windows_mean_pool(spark, d):
    e = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("logits"))
    return windows.mean_pool(e, "label").select("label", "n_windows", F.round(F.aggregate("logits", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"))


@query("""WITH l AS (SELECT vec_id // 4 AS doc_idx, avg(embedding[1]::DOUBLE) AS a, avg(embedding[2]::DOUBLE) AS b, count(*) AS n_windows FROM embeddings GROUP BY ALL)
SELECT doc_idx, n_windows, round(1 / (1 + exp(a - b)), 9) AS y_prob, (1 / (1 + exp(a - b)) >= 0.5)::INTEGER AS y_pred FROM l""")
def windows_document_predictions(spark, d):
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("doc_idx"), F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("logits"))
    return windows.document_predictions(e).withColumn("y_prob", F.round("y_prob", 9))


@query("SELECT conv_id AS doc_idx, arg_min(length(text), turn) AS label FROM conversations GROUP BY conv_id")
def windows_first_label(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_idx"), F.col("turn").alias("window_idx"), F.length("text").cast("long").alias("label"))
    return windows.first_label(rows)


# --- training logic (E10, O3, O4) ------------------------------------------------------------------
@query("SELECT quality AS label, count(*) AS n, round(sum(count(*)) OVER () / (2 * count(*)), 9) AS weight FROM labels GROUP BY quality")
def training_class_weights(spark, d):
    return training.class_weights(table(spark, d, "labels").select(F.col("quality").alias("label"))).select("label", "n", F.round("weight", 9).alias("weight"))


@query("""WITH f AS (SELECT count(*) AS total, floor(count(*) * 0.06::DOUBLE)::BIGINT AS w FROM labels)
SELECT s AS step, round(CASE WHEN s < w THEN s / greatest(1, w)::DOUBLE ELSE greatest(0.0, 0.5 * (1 + cos(pi() * least(1.0, (s - w) / greatest(1, total - w)::DOUBLE)))) END, 9) AS factor FROM (SELECT *, unnest(range(total)) AS s FROM f)""")
def training_schedule(spark, d):
    """The factor of every step of an epoch that takes the labelled documents one by one."""
    return training.schedule(spark, table(spark, d, "labels").count()).select("step", F.round("factor", 9).alias("factor"))


@query("""WITH r AS (SELECT o_orderkey % 50 AS run_id, (o_orderkey // 50)::INTEGER AS epoch, o_totalprice AS score FROM orders),
u AS (SELECT *, coalesce(score > max(score) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS up FROM r),
g AS (SELECT *, sum(up::INTEGER) OVER (PARTITION BY run_id ORDER BY epoch) AS streak FROM u),
b AS (SELECT *, row_number() OVER (PARTITION BY run_id, streak ORDER BY epoch) - 1 AS bad FROM g),
s AS (SELECT run_id, min(epoch) FILTER (WHERE bad = 3) AS stop FROM b GROUP BY run_id)
SELECT run_id, arg_max(epoch, score) AS best_epoch, max(score)::DOUBLE AS best_score, stop AS stopped_epoch FROM r JOIN s USING (run_id) WHERE epoch <= coalesce(stop, epoch) GROUP BY run_id, stop""")
def training_early_stopping(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_orderkey") % 50).alias("run_id"), F.floor(F.col("o_orderkey") / 50).cast("int").alias("epoch"), F.col("o_totalprice").alias("score"))
    return training.early_stopping(rows)


# --- result rows (E6, E15, G1, D8, D9, H2) ------------------------------------------------------------
@query(f"""{BINS_SQL}, c AS (SELECT model_id, seed, count_if(y_true = 1 AND y_pred = 1) AS tp, count_if(y_true = 0 AND y_pred = 1) AS fp, count_if(y_true = 1 AND y_pred = 0) AS fn, count_if(y_true = 0 AND y_pred = 0) AS tn FROM p GROUP BY ALL),
x AS (SELECT model_id, seed, sum(n * abs(accuracy - confidence)) / sum(n) AS ece FROM g GROUP BY ALL),
f AS (SELECT model_id, avg((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2) AS macro_f1, avg(ece) AS ece FROM c JOIN x USING (model_id, seed) GROUP BY model_id),
z AS (SELECT * FROM f UNION ALL SELECT model_id || '-large', macro_f1, ece FROM f UNION ALL SELECT model_id || '-worse', macro_f1, ece + 0.1 FROM f)
SELECT model_id, round(macro_f1, 9) AS macro_f1 FROM z ORDER BY z.macro_f1 DESC, ece, length(model_id), model_id LIMIT 1""")
def results_best_model(spark, d):
    """Twins with more parameters and with a larger calibration error: all four sort keys decide."""
    p = predictions(spark, d)
    f1 = metrics.core_metrics(p, ["model_id", "seed"]).join(metrics.ece(p, ["model_id", "seed"]), ["model_id", "seed"])
    twins = f1.withColumn("n_params", F.lit(10)).unionByName(f1.withColumns({"model_id": F.concat("model_id", F.lit("-large")), "n_params": F.lit(20)}))
    twins = twins.unionByName(f1.withColumns({"model_id": F.concat("model_id", F.lit("-worse")), "n_params": F.lit(5), "ece": F.col("ece") + 0.1}))
    return results.best_model(twins.withColumn("n_params", F.col("n_params").cast("long"))).select("model_id", F.round("macro_f1", 9).alias("macro_f1"))


@query(f"""WITH p AS ({PREDICTIONS_SQL}), c AS (SELECT m AS model_id, s::INTEGER AS seed FROM (VALUES ('M1'), ('M2'), ('M3')) a(m), range(6) b(s))
SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.model_id = c.model_id AND p.seed = c.seed)""")
def results_missing_cells(spark, d):
    return results.missing_cells(results.sweep_cells(spark, ["M1", "M2", "M3"], list(range(6))), predictions(spark, d))


@query(f"""{CORE_SQL}, f AS (SELECT model_id, seed, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c)
SELECT 'EXP-1' AS experiment_id, model_id, 'LI' AS dataset_id, 'S-RAND' AS split_regime, 'accuracy' AS metric, round(avg(accuracy), 9) AS mean, round(stddev_samp(accuracy), 9) AS std, count(*) AS n FROM f GROUP BY model_id""")
def results_over_seeds(spark, d):
    rows = metrics.core_metrics(predictions(spark, d), ["model_id", "seed"]).select("model_id", "seed", "accuracy")
    built = results.result_rows(rows, experiment_id="EXP-1", run_id="r1", dataset_id="LI", train_version="vDEDUP", test_version="vDEDUP", split_regime="S-RAND")
    out = results.over_seeds(results.validate(built, same_version=True))
    return out.select(*results.GROUP, "metric", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "n")
