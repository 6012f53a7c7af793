"""Registered queries of the thirteen operators and the pipeline, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import (centroids, hard_negatives, language, mixing, packing, permutation_index, pii, quality, simhash, site_style_tree,
               token_counts, toxicity, url_filter)
from .common import read_table

VOCABULARY = "word_bpe_49k.json"
#: Labels of host names whose hosts make up the block list (the tables hold no list of their own).
BLOCKED_LABELS = ["ads-track", "cheap-pills"]


def vocabulary_path() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; hosts on the derived block list are blocked unless a rule decides."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("key")).distinct()
    labels = "|".join(BLOCKED_LABELS)
    listed = hosts.where(F.concat(F.lit("."), F.col("key"), F.lit(".")).rlike(rf"\.({labels})\."))
    return url_filter.judge_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parsed AS (
  SELECT page_id,
         translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), ruled AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parsed
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches('.' || host || '.', '\\.(ads-track|cheap-pills)\\.') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens, one row per piece."""
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary_path()).drop("ids")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the learned clause grammar."""
    documents = read_table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(documents, toxicity.train(documents, read_table(spark, sf_dir, "labels")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the trees' verdict on every document."""
    documents = read_table(spark, sf_dir, "documents")
    return quality.judge_quality(documents, quality.train(documents, read_table(spark, sf_dir, "labels")))


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector."""
    return permutation_index.search(read_table(spark, sf_dir, "embeddings"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base counts and hash, and all selected spans."""
    documents = read_table(spark, sf_dir, "documents")
    return pii.find_pii(documents, pii.train(documents))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chosen by the production weights, one row per epoch that takes them."""
    chosen = mixing.mix(read_table(spark, sf_dir, "documents"))
    return chosen.select("doc_id", F.col("__domain").alias("domain"), "lang", "source", F.col("__tokens").alias("tokens"),
                         F.col("__epoch").alias("epoch"), F.col("__taken").alias("taken"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by compression."""
    documents = read_table(spark, sf_dir, "documents")
    return language.identify_language(documents, language.train_dictionaries(documents))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, found by scanning flat token files for separators."""
    counted = token_counts.count_document_tokens(read_table(spark, sf_dir, "documents"), vocabulary_path())
    return counted.select("doc_id", "n_tokens")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh label is first moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


OP11_SQL = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n
  ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) <= 5
"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of every kept vector, with the sums and the centroid's digest."""
    found = centroids.cluster(read_table(spark, sf_dir, "embeddings"))
    each = found.summary().select("cluster", "cluster_inertia", "centroid_sha256")
    total = sum(r["cluster_inertia"] for r in each.select("cluster_inertia").collect())  # one number per centroid
    return (found.assigned.join(F.broadcast(each), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256"))


def _lloyd_sql(rounds: int) -> str:
    def assign(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, v, CAST(min(d * 8 + c) % 8 AS INTEGER) AS cluster, CAST(min(d * 8 + c) // 8 AS BIGINT) AS distance
  FROM (SELECT k.r, k.vec_id, k.v, c.c,
               CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS HUGEINT) AS d
        FROM kept k CROSS JOIN c{i} c) x
  GROUP BY r, vec_id, v
)"""

    steps = []
    for i in range(rounds):
        steps += [assign(i), f"""m{i} AS (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
  FROM (SELECT cluster, i, sum(x) AS s, count(*) AS n
        FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) e GROUP BY cluster, i) t
  GROUP BY cluster
), c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.c)"""]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS c, v FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= 8
), {", ".join([*steps, assign(rounds)])}
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.cluster
"""


OP12_SQL = _lloyd_sql(centroids.ROUNDS)


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its site's style tree."""
    return site_style_tree.extract_main_text(read_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of ``corpus_pipeline`` over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_simhash, op3_packing, op4_toxicity, op5_quality, op6_permutation_index, op7_pii, op8_mixing,
    op9_language, op10_token_counts, op11_hard_negatives, op12_centroids, op13_main_text, pipeline)}
ORACLE = {"op1_url_filter": OP1_SQL, "op11_hard_negatives": OP11_SQL, "op12_centroids": OP12_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
