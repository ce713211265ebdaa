"""The operators applied to the corpus tables with production parameters, and SQL where it can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popgauge.llm import archive, decontaminate, negatives, outliers, packing, pseudolikelihood, pseudonyms, quality, runs, sharding, simhash, substrings, tokens
from popgauge.session import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Where the vocabulary of the public byte-level tokenizer lies.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: Key of the pseudonyms; a production run passes its own.
PSEUDONYM_KEY = "popgauge"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_best_fit_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return packing.packed(packing.token_lengths(docs, TOKENIZER), docs.count())


OP4_SQL = """
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) r(i)),
d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size,
    xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS text_crc32
  FROM documents, crc),
k AS (SELECT DISTINCT key FROM d),
n AS (
  SELECT key, node, -ln((CAST('0x' || substr(md5(node || ':' || key), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE) AS draw
  FROM k, (SELECT 'region' || i AS node FROM range(2) r(i) UNION ALL SELECT 'rack' || i FROM range(8) r(i) UNION ALL SELECT 'shard' || i FROM range(41) r(i))),
r AS (SELECT key, arg_min(i, draw) AS region, min(draw) / 20 AS least FROM n JOIN range(2) r(i) ON node = 'region' || i GROUP BY key),
c AS (
  SELECT key, any_value(region) AS region, any_value(least) AS least, arg_min(i, draw) AS rack
  FROM r JOIN n USING (key) JOIN range(8) r(i) ON node = 'rack' || i AND i // 4 = region GROUP BY key),
s AS (
  SELECT key, any_value(least) AS least, arg_min(i, draw) AS shard
  FROM c JOIN n USING (key) JOIN range(40) r(i) ON node = 'shard' || i AND i // 5 = rack GROUP BY key),
p AS (SELECT key, shard, CASE WHEN draw < least THEN 40 ELSE shard END AS grown_shard FROM s JOIN n USING (key) WHERE node = 'shard40'),
b AS (
  SELECT *, CAST('0x' || substr(md5('slot:' || key), 1, 12) AS BIGINT) % (SELECT CAST(ceil(count(*) / 800000) AS BIGINT) + 1 FROM documents) AS bucket
  FROM d JOIN p USING (key))
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard,
  CAST(shard // 20 AS INTEGER) AS region, CAST(shard // 5 AS INTEGER) AS rack
FROM b
"""


@query("op4_weighted_hash_tree", OP4_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.place(table(spark, folder, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack",
    )


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (
  SELECT DISTINCT item_id, array_to_string(ws[i:least(i + 9, len(ws))], ' ') AS phrase, least(10, len(ws)) AS size
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM p),
d AS (
  SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS i FROM w, sizes WHERE len(ws) >= size)),
h AS (SELECT d.doc_id, d.i, d.size, p.item_id FROM d JOIN p ON p.phrase = d.phrase AND p.size = d.size),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS place FROM h) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
  FROM h GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op7_fm_index", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items_sha256",
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op9_arrow_sequences")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    manifest = tokens.write_sequences(docs, shared_path(spark, "token-sequences"), TOKENIZER)
    return tokens.read_documents(spark, manifest, dict(docs.dtypes)["doc_id"])


@query("op6_simhash_byte_index")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.fingerprint_classes(table(spark, folder, "documents"))


@query("op8_fourier_ridge")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_feistel_pseudonyms")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonyms.with_counts(table(spark, folder, "documents"), PSEUDONYM_KEY)


@query("op2_robust_outliers")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.judged(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@query("op10_pseudo_likelihood")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return pseudolikelihood.scored(table(spark, folder, "documents"))


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)),
r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
gone AS (
  SELECT doc_id, list(DISTINCT place) AS places
  FROM (SELECT doc_id, unnest(generate_series(i, i + 34)) AS place FROM g SEMI JOIN r USING (h)) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN places IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""


@query("op3_suffix_automata", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.deduplicated(table(spark, folder, "documents")).drop("spans")


OP12_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE size >= 100 GROUP BY digest)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""


@query("op12_content_archive", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    place = shared_path(spark, "web-archive")
    archive.write_archive(pages, place)
    return archive.records(spark, place, dict(pages.dtypes)["page_id"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def planted(doc_id, words: list[bytes]) -> list[bytes]:
    """The words with the contract's periodic tail: in a tenth of the documents, those after ``a`` repeat with period ``p``."""
    if doc_id is None or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[: n - a]


OP11_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) r(i)),
d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS h
  FROM documents, crc),
a AS (SELECT *, len(ws) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (SELECT k, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE ws[1:a] || list_transform(range(a, n), lambda i: ws[a + (i - a) % p + 1]) END AS ws FROM p),
e AS (SELECT k, n, unnest(range(n)) AS i, unnest(ws) AS word FROM w),
m AS (SELECT x.k, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.k = y.k AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM m),
r AS (
  SELECT k, min(i) AS start, count(*) + q AS length, q AS period FROM s GROUP BY k, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
u AS (SELECT k, start, length, min(period) AS period FROM r GROUP BY k, start, length),
o AS (
  SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM u GROUP BY k),
b AS (
  SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY k ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS place FROM u x) WHERE place = 1),
gone AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM u),
kept AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS text FROM e ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length,
  CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM w LEFT JOIN o USING (k) LEFT JOIN b USING (k) LEFT JOIN kept USING (k)
"""


@query("op11_lcp_kruskal", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.runs(table(spark, folder, "documents"), rewrite=planted).withColumn("best", runs.greatest())
    told = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(told, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit(""))).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.vector, b.vector) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same)
  WHERE place <= 5),
n AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query("op13_multi_index", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table(spark, folder, "embeddings").where(finite).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)
