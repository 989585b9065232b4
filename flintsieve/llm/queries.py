"""Registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flintsieve.llm import alignment, bpe, decontaminate, jaccard_join, language_id, pii, secrets, set_hash, target_sampling, token_store, url_filter, vector_join, word_pieces
from flintsieve.llm.common import documents

#: Rules of the URL query: action, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=2)
    return token_store.read_back(spark, store)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in found.dtypes])


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_groups(documents(spark, sf_dir), words=4, percent=85)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return word_pieces.count_tokens(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "n_words", "n_tokens")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = language_id.held_out(F.col("doc_id"))
    models = language_id.train(docs.where(~out), vocabulary("piece_bpe_32k.model"))
    return language_id.identify(docs.select("doc_id", out.alias("held_out"), "text"), models).drop("text")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(documents(spark, sf_dir))


def op9_set_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_hash.fingerprints(documents(spark, sf_dir))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.98)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_sampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=10, runs=1, buckets=10_000, least_words=20, seed=2024)


def _grams(words: str, size: str) -> str:
    """SQL of the distinct runs of so many words of a list."""
    return f"list_distinct([array_to_string({words}[i : i + {size} - 1], ' ') for i in range(1, len({words}) - {size} + 2)])"


_W = r"'[\p{L}\p{N}_]+'"
#: Every passage against every item that shares a word, scored and verified without an index.
OP2_SQL = rf"""
WITH items AS (
  SELECT row_number() OVER () AS k, item_id, w, len(w) AS n, CASE WHEN a = 0 THEN len(w) ELSE a END AS a FROM (
    SELECT item_id, regexp_extract_all(lower(text), {_W}) AS w,
           len(regexp_extract_all(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[.!?]+\s+')[-1], {_W})) AS a
    FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
figures AS (SELECT count(*) AS items, avg(n) AS mean, max(n) AS step FROM items),
tf AS (SELECT k, n, t, count(*) AS f FROM (SELECT k, n, unnest(w) AS t FROM items) GROUP BY k, n, t),
idf AS (SELECT t, ln(1 + (items - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf CROSS JOIN figures GROUP BY t, items),
parts AS (SELECT k, t, idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean)) AS v FROM tf JOIN idf USING (t) CROSS JOIN figures),
weights AS (SELECT k, t, v / sum(v) OVER (PARTITION BY k) AS v FROM parts),
docs AS (SELECT doc_id, w, step FROM (SELECT doc_id, regexp_extract_all(lower(text), {_W}) AS w FROM documents WHERE text IS NOT NULL) CROSS JOIN figures WHERE len(w) > 0),
starts AS (SELECT doc_id, w, step, unnest(range(0, greatest(1, len(w) - step), step)) AS place FROM docs),
passages AS (SELECT doc_id, place, w[place + 1 : place + 2 * step] AS p FROM starts),
found AS (
  SELECT doc_id, place, k, sum(v) AS score FROM (SELECT DISTINCT doc_id, place, unnest(p) AS t FROM passages) JOIN weights USING (t)
  GROUP BY doc_id, place, k HAVING sum(v) >= 0.5 - 1e-9),
read AS (
  SELECT doc_id, place, k, item_id, score, p, w, w[n - a + 1 :] AS answer, CASE WHEN n > a THEN w[: n - a] ELSE w END AS question
  FROM found JOIN passages USING (doc_id, place) JOIN items USING (k)),
grams AS (
  SELECT *, {_grams("w", "least(5, len(w))")} AS wg, {_grams("p", "least(5, len(w))")} AS wp,
         {_grams("question", "least(5, len(question))")} AS qg, {_grams("p", "least(5, len(question))")} AS qp FROM read),
shared AS (
  SELECT doc_id, place, k, item_id, score, len(list_intersect(wg, wp)) / len(wg) AS gram_overlap, len(list_intersect(qg, qp)) / len(qg) AS question_overlap,
         len(list_intersect(list_distinct(answer), list_distinct(p))) / len(list_distinct(answer)) AS answer_overlap FROM grams)
SELECT doc_id, item_id, round(score, 6) AS score, round(gram_overlap, 6) AS gram_overlap, round(question_overlap, 6) AS question_overlap, round(answer_overlap, 6) AS answer_overlap
FROM shared WHERE gram_overlap >= 0.8 AND question_overlap >= 0.5 AND answer_overlap >= 0.5
QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY score DESC, gram_overlap DESC, place) = 1
"""

#: Every two different sets that share a shingle, counted, and what their links reach.
OP3_SQL = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] 
    ELSE list_sort(list_distinct([x[1] || ' ' || x[2] || ' ' || x[3] || ' ' || x[4] for x in list_zip(w[: len(w) - 3], w[2 : len(w) - 2], w[3 : len(w) - 1], w[4 :])])) END AS g FROM split),
named AS (SELECT doc_id, g, len(g) AS n, min(doc_id) OVER (PARTITION BY g) AS c FROM sets WHERE len(g) > 0),
shingles AS (SELECT c, n, unnest(g) AS s FROM named WHERE doc_id = c),
pairs AS (
  SELECT a.c AS x, b.c AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT DISTINCT c, c AS r FROM named UNION SELECT reach.c, links.y FROM reach JOIN links ON reach.r = links.x),
least_of AS (SELECT c, min(r) AS component_id FROM reach GROUP BY c)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id FROM named JOIN least_of USING (c)
UNION ALL SELECT doc_id, CAST(0 AS BIGINT), doc_id FROM sets WHERE len(g) = 0
"""

OP10_SQL = r"""
WITH parts AS (
  SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(action, r_host, r_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
urls AS (SELECT DISTINCT host, path FROM hp),
best AS (
  SELECT host, path, max_by(r_host || r_path, length(r_host || r_path)) AS rule, max_by(action, length(r_host || r_path)) AS action
  FROM urls JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY ALL)
SELECT page_id, hp.host, hp.path, rule, coalesce(action, 'allow') AS verdict
FROM hp LEFT JOIN best ON hp.host = best.host AND hp.path = best.path
"""

#: All pairs of usable vectors of one label, and what their links reach.
OP11_SQL = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT DISTINCT x AS c, x AS r FROM pairs UNION SELECT reach.c, pairs.y FROM reach JOIN pairs ON reach.r = pairs.x),
least_of AS (SELECT c AS vec_id, min(r) AS low FROM reach GROUP BY c),
counted AS (SELECT x AS vec_id, count(*) AS n FROM pairs GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(low, vec_id) AS component_id, vec_id = coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN counted USING (vec_id) LEFT JOIN least_of USING (vec_id)
"""

#: The checksum of each distinct word, byte by byte through a table of 256 entries, then buckets, gains and ranks.
OP13_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
texts AS (
  SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
split AS (
  SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
seen AS (SELECT side, unnest(w) AS word, count(*) AS n FROM split GROUP BY side, word),
bytes AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM seen)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, [CAST('0x' || h[2 * i - 1 : 2 * i] AS BIGINT) for i in range(1, len(h) // 2 + 1)]), lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INT) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes CROSS JOIN crc_table),
counts AS (
  SELECT bucket, sum(CASE WHEN side = 'd' THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 'b' THEN n ELSE 0 END) AS t FROM seen JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM counts CROSS JOIN totals),
sums AS (
  SELECT doc_id, CAST(sum(gain) AS BIGINT) AS g FROM (SELECT doc_id, unnest(w) AS word FROM split WHERE side = 'd') JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
weights AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE CAST((g - ((g % len(w)) + len(w)) % len(w)) // len(w) AS BIGINT) END AS weight,
         CAST('0x' || sha256('2024:' || doc_id)[:8] AS BIGINT) AS h FROM split LEFT JOIN sums USING (doc_id) WHERE side = 'd'),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM weights),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM placed) // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""

QUERIES = {"op1_token_store": op1_token_store, "op2_decontaminate": op2_decontaminate, "op3_jaccard_join": op3_jaccard_join, "op4_bpe": op4_bpe, "op5_pii": op5_pii, "op6_token_counts": op6_token_counts, "op7_language": op7_language, "op8_secrets": op8_secrets, "op9_set_hash": op9_set_hash, "op10_url_filter": op10_url_filter, "op11_vectors": op11_vectors, "op12_alignment": op12_alignment, "op13_resample": op13_resample}
SQL = {"op2_decontaminate": OP2_SQL, "op3_jaccard_join": OP3_SQL, "op10_url_filter": OP10_SQL, "op11_vectors": OP11_SQL, "op13_resample": OP13_SQL}
