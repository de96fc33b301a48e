"""Retrieval queries: label centroids ask for the nearest vectors of their label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import retrieval as R
from docloom.plans.stored import stored
from docloom.registry import sql
from docloom.registry.tables import documents, table


def chunks(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").alias("application"), "embedding"
    )


def centroids(spark, d) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    dims = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    means = dims.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    vector = F.sort_array(F.collect_list(F.struct("dim", "mean"))).alias("parts")
    return means.groupBy("label").agg(vector).select(
        F.col("label").alias("query_id"), F.col("label").alias("application"), F.col("parts.mean").alias("embedding")
    )


def hits(spark, d) -> DataFrame:
    return R.knn_join(centroids(spark, d), chunks(spark, d))


def scored(spark, d) -> DataFrame:
    found = stored(hits(spark, d), "hits")
    asked = F.concat(F.col("query_id").cast("string"), F.lit(":"), F.col("chunk_id").cast("string"))
    replies = found.select(
        "query_id", "chunk_id", F.concat(F.lit("Score: "), F.substring(F.md5(asked), 1, 3)).alias("reply")
    )
    return R.attach_scores(found, replies)


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


def knn_join(spark, d):
    return _rounded(hits(spark, d))


def knn_join_global(spark, d):
    return _rounded(R.knn_join(centroids(spark, d), chunks(spark, d), metric="cosine", scope="global"))


def knn_lsh(spark, d):
    """Every 20th vector asks for its 20 nearest; against exact search 0.9 of them are found, from a fifth of all pairs."""
    every = stored(chunks(spark, d), "chunks")
    asked = stored(every.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding"), "asked")
    tuning = R.tuned(asked, every.select("chunk_id", "embedding"))
    near = R.candidates(asked, every.select("chunk_id", "embedding"), tuning=tuning)
    by_cells = tuning.setting is not None and tuning.setting.probes is not None
    near = stored(near, "near") if by_cells else near
    found = stored(R.knn_lsh(asked, every, near=near if by_cells else None, tuning=tuning), "found")
    exact = R.knn_join(asked, every, scope="global").select("query_id", "chunk_id")
    hit = F.col("hit").isNotNull().cast("double")
    recall = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left").agg(F.avg(hit)).first()[0]
    pruned = near.count() <= 0.2 * asked.count() * every.count()
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    return found.groupBy("query_id").agg(
        first("chunk_id").alias("nearest"),
        F.round(first("distance"), 6).alias("distance"),
        F.count("*").alias("n_hits"),
        F.lit(recall >= 0.9).alias("recalled"),
        F.lit(pruned).alias("pruned"),
    )


def filter_application(spark, d):
    return R.filter_application(chunks(spark, d), "3").select("chunk_id", "application")


def fetch_by_ids(spark, d):
    docs = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "text")
    return R.fetch_by_ids(docs, hits(spark, d))


def attach_scores(spark, d):
    return scored(spark, d).select("query_id", "chunk_id", "rank", F.col("score").cast("bigint").alias("score"))


def rerank_topn(spark, d):
    return R.rerank_topn(scored(spark, d), R.TOP_N["gemma"]).select("query_id", "chunk_id", "rerank")


def build_context(spark, d):
    kept = R.rerank_topn(scored(spark, d), R.TOP_N["gemma"])
    docs = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("document"))
    return R.build_context(kept.join(docs, "chunk_id")).select(
        "query_id", "context", F.length("context").cast("bigint").alias("context_len_c")
    )


TEMPLATE = "Answer in a few words. Text: <CONTEXT> Question: <QUERY>"


def retrieve_prompt(spark, d):
    texts = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("document"))
    asked = centroids(spark, d).withColumn("question", F.concat(F.lit("What is said of "), F.col("query_id").cast("string"), F.lit("?")))
    every = chunks(spark, d).join(texts, "chunk_id", "left")
    pair = F.concat(F.col("query_id").cast("string"), F.lit(":"), F.col("chunk_id").cast("string"))
    # one reply per vector of the query's label, as a model would have been asked
    replies = chunks(spark, d).select(F.col("application").alias("query_id"), "chunk_id").withColumn(
        "reply", F.concat(F.lit("Score: "), F.substring(F.md5(pair), 1, 3))
    )
    return R.retrieve_prompt(stored(asked, "asked"), every, replies, TEMPLATE, R.TOP_N["gemma"])


QUERIES = {
    "retrieve_prompt": retrieve_prompt,
    "knn_join": knn_join,
    "knn_join_global": knn_join_global,
    "knn_lsh": knn_lsh,
    "filter_application": filter_application,
    "fetch_by_ids": fetch_by_ids,
    "attach_scores": attach_scores,
    "rerank_topn": rerank_topn,
    "build_context": build_context,
}

ORACLES = {
    "knn_join": f"WITH {sql.HITS} SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM hits",
    "knn_join_global": f"""WITH {sql.CENTROIDS}, near AS (
        SELECT q.query_id, c.chunk_id, 1 - list_cosine_similarity(q.v, c.v) AS distance,
          row_number() OVER (PARTITION BY q.query_id ORDER BY 1 - list_cosine_similarity(q.v, c.v), c.chunk_id) AS rank
        FROM centroids q CROSS JOIN vectors c)
      SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM near WHERE rank <= 20""",
    "knn_lsh": f"""WITH {sql.CENTROIDS}, near AS (
        SELECT q.chunk_id AS query_id, c.chunk_id, list_distance(q.v, c.v) ** 2 AS distance,
          row_number() OVER (PARTITION BY q.chunk_id ORDER BY list_distance(q.v, c.v), c.chunk_id) AS rank
        FROM vectors q CROSS JOIN vectors c WHERE q.chunk_id % 20 = 0)
      SELECT query_id, chunk_id AS nearest, round(distance, 6) AS distance, (SELECT least(20, count(*)) FROM vectors) AS n_hits,
        true AS recalled, true AS pruned FROM near WHERE rank = 1""",
    "retrieve_prompt": f"""WITH {sql.RERANKED}, texts AS (
        SELECT query_id, string_agg(chr(10) || chr(10) || text, '' ORDER BY chunk_id) FILTER (text IS NOT NULL) AS context,
          count(*) AS n_chunks
        FROM reranked LEFT JOIN documents ON doc_id = chunk_id GROUP BY query_id)
      SELECT query_id, replace('Answer in a few words. Text: ' || context || ' Question: What is said of ' || query_id || '?',
        chr(10) || chr(10), chr(10)) AS prompt, n_chunks FROM texts""",
    "filter_application": "SELECT vec_id AS chunk_id, label AS application FROM embeddings WHERE label = 3",
    "fetch_by_ids": f"""WITH {sql.HITS} SELECT doc_id AS chunk_id, text FROM documents
      WHERE doc_id IN (SELECT chunk_id FROM hits)""",
    "attach_scores": f"WITH {sql.HITS} SELECT query_id, chunk_id, rank, CAST(score AS BIGINT) AS score FROM scored",
    "rerank_topn": f"WITH {sql.RERANKED} SELECT query_id, chunk_id, rerank FROM reranked",
    "build_context": f"""WITH {sql.RERANKED}, texts AS (
        SELECT query_id, string_agg(chr(10) || chr(10) || text, '' ORDER BY chunk_id) AS context
        FROM reranked JOIN documents ON doc_id = chunk_id GROUP BY query_id)
      SELECT query_id, context, length(context) AS context_len_c FROM texts""",
}
