"""Nearest chunks, reranking and context."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.metrics import dot, norm, squared_l2
from docloom.functions.prompts import build_prompt, parse_rank_score
from docloom.operators import sketches
from docloom.operators.nearest import nearest, pairs_within
from docloom.plans.stored import stored

# Hits kept by distance; chunks kept after reranking per model flavour.
N_HITS = 20
TOP_N = {"gemma": 10, "phi": 6}

#: Chunks of one shard, about.
SHARD_ROWS = 50_000


def filter_application(chunks: DataFrame, application: str | None) -> DataFrame:
    """Chunks of one application, or all of them when it is None."""
    return chunks if application is None else chunks.filter(F.col("application") == application)


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest per query. Each task drops all but its own k before the shuffle."""
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return pairs.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


def _distance(metric: str) -> Column:
    q, c = F.col("query_vec"), F.col("chunk_vec")
    if metric == "l2":
        return squared_l2(q, c)
    if metric == "cosine":
        size = F.col("query_norm") * F.col("chunk_norm")
        return F.lit(1.0) - F.when(size > 0, dot(q, c) / size).otherwise(F.lit(0.0))
    raise ValueError(f"unknown metric {metric!r}")


def knn_join(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = N_HITS,
    metric: str = "l2",
    scope: str = "application",
    shards: int | None = None,
) -> DataFrame:
    """(query_id, chunk_id, distance, rank) of the k nearest chunks of each query.

    ``queries`` has query_id, embedding and (for application scope) application;
    ``chunks`` has chunk_id, embedding, application. Chunks are dealt over shards
    and the queries repeated once per shard, so that the join is by equal keys, an
    application with a third of all chunks is many tasks, and no side has to be
    broadcast; Spark still does so where the queries are few. There are as many shards
    as the number of chunks asks for. Vectors travel as they are stored; null ones take no part.
    All queries with all chunks by ``l2`` meet in cells, as matrices (``nearest``).
    """
    queries, chunks = (side.where("embedding IS NOT NULL") for side in (queries, chunks))
    if scope not in ("application", "global"):
        raise ValueError(f"unknown scope {scope!r}")
    if scope == "global" and metric == "l2":
        return _top(nearest(queries, chunks, k, shards), k)
    if shards is None:
        shards = max(1, -(-chunks.count() // SHARD_ROWS))
    on = ["shard", "application"] if scope == "application" else ["shard"]
    with_norm = metric == "cosine"
    asked = queries.select(
        "query_id",
        *[c for c in on if c != "shard"],
        F.col("embedding").alias("query_vec"),
        *([norm(F.col("embedding")).alias("query_norm")] if with_norm else []),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    dealt = chunks.select(
        "chunk_id",
        *[c for c in on if c != "shard"],
        F.col("embedding").alias("chunk_vec"),
        *([norm(F.col("embedding")).alias("chunk_norm")] if with_norm else []),
        F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int").alias("shard"),
    )
    pairs = dealt.join(asked, on).select("query_id", "chunk_id", _distance(metric).alias("distance"))
    return _top(pairs, k)


def knn_lsh(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = N_HITS,
    seed: int = 7,
    near: DataFrame | None = None,
    tuning: sketches.Tuning | None = None,
) -> DataFrame:
    """Approximate l2 search over all chunks: candidates by hashing, exact distances.

    ``candidates`` names the pairs worth comparing (``near``, if they are at hand); only these meet the vectors. Without
    buckets they are a share of all pairs, so they are ranked where their sketches meet. A query with
    fewer than k of them is searched exactly, so every query gets its k hits. Vectors that
    are null take no part.
    """
    asked = queries.select("query_id", "embedding").where("embedding IS NOT NULL")
    held = chunks.select("chunk_id", "embedding").where("embedding IS NOT NULL")
    if near is None and tuning is None:
        tuning = tuned(asked, held, k, seed)
    if near is None and tuning.setting and not tuning.setting.probes:
        top = nearest(asked, held, k, allowed=tuning.allowed(asked.sparkSession))
    else:
        near = candidates(asked, held, k, seed, tuning) if near is None else near
        pairs = near.join(asked.withColumnRenamed("embedding", "query_vec"), "query_id")
        pairs = pairs.join(held.withColumnRenamed("embedding", "chunk_vec"), "chunk_id")
        top = pairs.select("query_id", "chunk_id", _distance("l2").alias("distance"))
    top = stored(_top(top, k), "nearest")
    served = top.filter(F.col("rank") == k).select("query_id")
    filled = knn_join(asked.join(served, "query_id", "left_anti"), held, k, "l2", "global")
    return top.join(served, "query_id", "left_semi").unionByName(filled)


def tuned(asked: DataFrame, held: DataFrame, k: int = N_HITS, seed: int = 7) -> sketches.Tuning:
    """How ``candidates`` searches these tables.

    ``sketches.MEASURED`` queries, a bounded set that does not depend on the partitions, are answered
    exactly first; they set how many cells are opened and how far sketches may differ.
    """
    asked, held = (side.where("embedding IS NOT NULL") for side in (asked, held))
    if held.isEmpty() or asked.isEmpty():
        return sketches.Tuning(None, None)
    shape, points = sketches.draw(held, seed)
    some = stored(asked.orderBy(F.xxhash64("embedding"), "query_id").limit(sketches.MEASURED), "measured")
    exact = knn_join(some, held, k, "l2", "global").select("query_id", "chunk_id")
    pairs = exact.join(some.withColumnRenamed("embedding", "query_vec"), "query_id").join(held, "chunk_id")
    # MEASURED * k rows
    near: dict = {}
    for row in pairs.select("query_id", "query_vec", "embedding").collect():
        near.setdefault(row["query_id"], (np.array(row["query_vec"], float), []))[1].append(row["embedding"])
    return sketches.Tuning(shape, sketches.measure(shape, points, [(q, np.array(vs, float)) for q, vs in near.values()]))


def candidates(
    asked: DataFrame, held: DataFrame, k: int = N_HITS, seed: int = 7, tuning: sketches.Tuning | None = None
) -> DataFrame:
    """Distinct (query_id, chunk_id) that hold ``sketches.RECALL`` of the k nearest chunks or more.

    ``tuning`` is that of ``tuned``, if it is at hand. Only ids
    and sketches go through the buckets. A bucket with very many rows is a skewed join key, which Spark splits.
    """
    asked, held = (side.where("embedding IS NOT NULL") for side in (asked, held))
    tuning = tuned(asked, held, k, seed) if tuning is None else tuning
    shape, setting = tuning.shape, tuning.setting
    if setting is None:
        return asked.select("query_id").limit(0).crossJoin(held.select("chunk_id").limit(0))
    if not setting.probes:
        return pairs_within(asked, held, tuning.allowed(asked.sparkSession))
    left, right = sketches.sketched(asked, shape, "query_sketch"), sketches.sketched(held, shape, "chunk_sketch")
    left, right = sketches.bucketed(left, shape, setting.probes), sketches.bucketed(right, shape)
    met = left.drop("embedding").join(right.drop("embedding"), "bucket")
    return met.where(sketches.apart("query_sketch", "chunk_sketch") <= setting.apart).select("query_id", "chunk_id").distinct()


def fetch_by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def attach_scores(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Model scores, kept in a table by query and chunk, joined to the hits.

    ``scores`` holds either a ``score`` or the model's ``reply`` to be parsed; a
    hit without one scores 0.
    """
    if "score" not in scores.columns:
        scores = scores.withColumn("score", parse_rank_score(F.col("reply")))
    # a hit scored twice keeps its best score
    best = scores.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return hits.join(best, ["query_id", "chunk_id"], "left").withColumn(
        "score", F.coalesce("score", F.lit(0))
    )


def rerank_topn(scored: DataFrame, n: int) -> DataFrame:
    """The n best by score per query; ties keep the order of retrieval."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank")
    return scored.withColumn("rerank", F.row_number().over(order).cast("bigint")).filter(
        F.col("rerank") <= n
    )


def build_context(selected: DataFrame, order: str = "chunk_id") -> DataFrame:
    """(query_id, context): chunk texts of a query, each after an empty line.

    Chunks come by the number their id ends with (``md_2`` before ``md_10``).
    ``selected`` holds the few chunks reranking kept, with their ``document``.
    """
    number = F.regexp_extract(F.col(order).cast("string"), "([0-9]+)$", 1).try_cast("bigint")
    place = F.struct(number.alias("number"), F.col(order).alias("at"), F.col("document").alias("text"))
    parts = F.sort_array(F.collect_list(place))
    return selected.groupBy("query_id").agg(parts.alias("parts")).select(
        "query_id", F.concat(F.lit("\n\n"), F.array_join("parts.text", "\n\n")).alias("context")
    )


def retrieve_prompt(
    queries: DataFrame, chunks: DataFrame, scores: DataFrame, template: str, n: int, k: int = N_HITS
) -> DataFrame:
    """(query_id, prompt, n_chunks): from queries to prompts.

    Nearest chunks of the query's application, model scores (``scores``: query_id,
    chunk_id and score or reply), the ``n`` best, their texts in order, the prompt.
    A query whose application has no chunk, or a null vector, gets a prompt without context and 0 chunks.
    ``queries`` has query_id, application, embedding, question; ``chunks`` has chunk_id,
    application, embedding, document.
    """
    found = stored(knn_join(queries, chunks, k), "hits")
    kept = rerank_topn(attach_scores(found, scores), n).select("query_id", "chunk_id")
    texts = fetch_by_ids(chunks, kept).select("chunk_id", "document")
    context = build_context(kept.join(texts, "chunk_id"))
    counts = kept.groupBy("query_id").agg(F.count("*").alias("n_chunks"))
    ready = queries.select("query_id", "question").join(context, "query_id", "left").join(counts, "query_id", "left")
    prompt = build_prompt(F.lit(template), F.coalesce("context", F.lit("")), F.col("question"))
    return ready.select("query_id", prompt.alias("prompt"), F.coalesce("n_chunks", F.lit(0)).cast("bigint").alias("n_chunks"))
