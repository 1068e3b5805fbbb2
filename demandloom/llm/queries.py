"""One query per operator on the shared tables, with its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm import (
    divergence,
    exact_dedup,
    hard_negatives,
    language_id,
    license_scan,
    line_dedup,
    minhash,
    mixing,
    quality_rules,
    query,
    sentencepiece_codec,
    simhash,
    token_counts,
    toxicity,
)

from demandloom.plans.storage import cut_lineage

PIECE_MODEL = "piece_bpe_32k.model"
TOXIC_FOLDS, TOXIC_HELD_OUT = 3, 1
TOXIC_FROM = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM n
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def toxic_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Learned from the labelled rows outside the held-out fold."""
    cfg = toxicity.FTRLConfig()
    outside = toxicity.fold("doc_id", TOXIC_FOLDS) != TOXIC_HELD_OUT
    known = labels.where(outside).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.train(toxicity.labelled_sample(docs, known, cfg.max_rows), cfg)


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    fold = toxicity.fold("doc_id", TOXIC_FOLDS)
    return toxicity.score(docs, toxic_model(docs, labels)).select(
        "doc_id",
        F.coalesce(fold == TOXIC_HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


@query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, plan = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"))
    quotas = mixing.quota_table(spark, plan)
    taken = mixing.mixed_sizes(rows, plan).withColumn("source", F.col("pattern")[0])
    # one row per source: bounded like the patterns
    return taken.join(F.broadcast(quotas), taken["source"].eqNullSafe(quotas["source"])).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def encoded_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes): n_bytes is where the last piece ends."""
    model = public_tokenizers.path(PIECE_MODEL)
    return sentencepiece_codec.encode(docs, model, with_decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).alias("n_bytes"),
    )


@query()
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digest(table(spark, sf_dir, "documents"))


@query()
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 5, 0


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = toxicity.fold("doc_id", LANGUAGE_FOLDS)
    model = language_id.train(docs.where(fold != LANGUAGE_HELD_OUT))
    found = language_id.identify(docs, model)
    held_out = F.coalesce(fold == LANGUAGE_HELD_OUT, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


RANK_FILE = "byte_bpe_50k.tiktoken"


@query()
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(RANK_FILE), "rb") as f:
        ranks = f.read()
    lengths = token_counts.token_lengths(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return token_counts.length_histogram(lengths)


@query()
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_union("base_labels", F.transform("detections", lambda d: d["label"])))
    sure = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        sure.alias("score"),
    )


@query()
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a few counts per document, read by the learner and by the verdict
    stats = cut_lineage(quality_rules.text_stats(table(spark, sf_dir, "documents")))
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))
    rules = quality_rules.learn_rules(stats, labels)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = stats.select("doc_id", *counts, failed.alias("base_failed"), quality_rules.verdict(rules).alias("rule"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


@query()
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.near_duplicate_lines(table(spark, sf_dir, "documents"), min_chars=line_dedup.SHORTEST)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text
  FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
grp AS (SELECT DISTINCT lang, source FROM d),
used AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
own AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM used GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(u.n, 0) + 2) // (coalesce(o.total, 0) + 2 * s.v) AS p,
         1 + 1000000000::HUGEINT * (k.n + 2) // (s.total + 2 * s.v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN sums s USING (lang)
  LEFT JOIN own o USING (lang, source) LEFT JOIN used u USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item,
         coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
""")
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(table(spark, sf_dir, "documents"))


@query()
def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


@query("""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id, b.label = a.label AS alike,
         list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM s WHERE alike
  QUALIFY place <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id)::INT AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN s n ON n.anchor = p.anchor AND NOT n.alike
  AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)
