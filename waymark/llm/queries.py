"""One query for each operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waymark.llm import bpe, collocations, decontamination, hard_negatives, labelled_pages, main_text, mixing, near_vectors, quality, records, repeats, sharding, similar_sets, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SHARDS = [f"shard-{n:04d}" for n in range(256)]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


QUALITY_THRESHOLD = 0.3


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; labels of held-out documents are never read."""
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    scored = quality.scored(docs, model)
    return scored.select("doc_id", F.coalesce(quality.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


# Fixed values of the url contract.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def ruled(pages: DataFrame) -> DataFrame:
    named = pages.select("page_id", "url", url_rules.host(F.col("url")).alias("host"), url_rules.path(F.col("url")).alias("path"))
    return named.withColumn("rule", url_rules.fixed_rule(F.col("host"), F.col("path"), URL_RULES))


def rule_verdict(rule: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in URL_RULES.items() for x in pair])[rule]


@query
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; the urls that a fixed rule judges are the labels of the mined rules."""
    pages = ruled(read(spark, sf_dir, "pages"))
    mined = url_rules.mine(pages.select("url", rule_verdict(F.col("rule")).alias("label")))
    judged = url_rules.judge(pages, mined)
    return judged.select("page_id", "host", "path", "rule", F.coalesce(rule_verdict(F.col("rule")), F.col("verdict")).alias("verdict"), "mined_rule")


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, item_id, share): every benchmark item that a document holds, verbatim or nearly so."""
    return decontamination.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from the record files."""
    index = records.write(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    shuffled = index.repartition("shard")
    return records.digests(shuffled).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents"))


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, shard): the shard among 256 of every document."""
    return sharding.place(read(spark, sf_dir, "documents").select("doc_id"), SHARDS)


SQL["op6_sharding"] = f"""
SELECT doc_id, [{",".join(map(str, sharding.fill(SHARDS)))}][1 +
       CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, {sharding.DIGITS}) AS BIGINT) % {sharding.TABLE_SIZE}] AS shard
FROM documents"""


@query
def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings of earlier ones."""
    left = repeats.without_repeats(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_similar_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and the smallest id of its linked group, at 4 words and a similarity of 0.85."""
    return similar_sets.linked_groups(read(spark, sf_dir, "documents"))


@query
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text and its length."""
    model = main_text.train(labelled_pages.labelled_pages())
    texts = main_text.extracted(read(spark, sf_dir, "pages").select("page_id", "url", "html"), model)
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at a cosine of 0.95 or more and the smallest id of its linked group."""
    return near_vectors.linked_vectors(read(spark, sf_dir, "embeddings"))


@query
def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens = bpe.encode(read(spark, sf_dir, "documents"), path, decoded=True)
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                         F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives of each of five positives of every anchor; some rows get a wrong label first, as the contract says."""
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mined = hard_negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)
    return mined.select(*[F.col(c).cast("int" if c == "rank" else "long").alias(c) for c in mined.columns])


SQL["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
       s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language."""
    return collocations.collocations(read(spark, sf_dir, "documents"))


SQL["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
sized AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM lists),
phrases AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
            FROM (SELECT lang, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM sized WHERE len(w) >= k)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM phrases GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.cut], ' ')
              JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1 :], ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_sized AS (SELECT lang, w, k, a, unnest(range(2, k)) AS size FROM candidates),
around AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM inner_sized))
  GROUP BY ALL),
ranked AS (
  SELECT w.lang, w.phrase, w.a, w.l, w.r, w.score::BIGINT AS score,
         row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, encode(w.phrase)) AS rank
  FROM worst w LEFT JOIN around o ON o.lang = w.lang AND o.phrase = w.phrase
  WHERE o.longer IS NULL OR 100::HUGEINT * o.longer < 80::HUGEINT * w.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
