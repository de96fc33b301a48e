"""Gold answers, similarity and metric records."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import metrics as M
from docloom.functions.text import strip
from docloom.plans.lookup import lookup

REQUEST = ["application_id", "question_id"]


def _last_entries(gold: DataFrame) -> DataFrame:
    """Rows of the last entry of each application: it replaces the earlier ones as a whole."""
    last = gold.groupBy("application_id").agg(F.max("ordinal").alias("ordinal"))
    return gold.join(last, ["application_id", "ordinal"])


def _last_gold(gold: DataFrame) -> DataFrame:
    return _last_entries(gold).groupBy(*REQUEST).agg(F.max("answer").alias("gold"))


def join_gold(answers: DataFrame, gold: DataFrame, spread_by: list[str]) -> DataFrame:
    """Add ``gold``; null where the request has no (or an empty) gold answer."""
    trimmed = answers.withColumn("application_id", strip(F.col("application_id")))
    known = _last_gold(gold).filter(F.col("gold") != "")
    return lookup(trimmed, known, REQUEST, spread_by)


def join_gold_default(answers: DataFrame, gold: DataFrame, spread_by: list[str]) -> DataFrame:
    """Add ``gold``; the empty string where the request has none."""
    return lookup(answers, _last_gold(gold), REQUEST, spread_by).withColumn(
        "gold", F.coalesce("gold", F.lit(""))
    )


def tfidf_pair_similarity(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, similarity): TF-IDF cosine of two texts, fitted on just the two; nothing is moved.

    Every pair keeps its row; the similarity is null where a text is null or neither has a token.
    """
    return pairs.select(key, M.tfidf_cosine(F.col(left), F.col(right)).alias("similarity"))


def pairwise_run_similarity(
    answers: DataFrame, spread_by: list[str], vector: str = "embedding"
) -> DataFrame:
    """Add ``n_others`` and ``similarity_sum``: cosine to every other answer of the request.

    The sum of the cosines of one unit vector with all others is its product with
    the sum of all of them, less itself. So one vector sum per request replaces
    all pairs. An answer without vector is compared with none and counts for none.
    """
    size = M.norm(F.col(vector))
    unit = F.transform(
        vector, lambda x: F.when(F.col("vector_size") > 0, x.cast("double") / F.col("vector_size")).otherwise(0.0)
    )
    units = answers.withColumn("vector_size", size).withColumn("unit", unit)
    sums = units.filter(F.col(vector).isNotNull()).groupBy(*REQUEST).agg(
        Summarizer.sum(array_to_vector("unit")).alias("total"), F.count(F.lit(1)).alias("n")
    ).select(*REQUEST, vector_to_array("total").alias("total"), "n")
    compared = F.col(vector).isNotNull()
    self_product = F.when(F.col("vector_size") > 0, 1.0).otherwise(0.0)
    return (
        lookup(units, sums, REQUEST, spread_by)
        .withColumns(
            {
                "n_others": F.when(compared, F.col("n") - 1).otherwise(0).cast("bigint"),
                "similarity_sum": F.when(compared, M.dot(F.col("unit"), F.col("total")) - self_product).otherwise(0.0),
            }
        )
        .drop("vector_size", "unit", "total", "n")
    )


def consistency(answers: DataFrame, spread_by: list[str], vector: str = "embedding") -> DataFrame:
    """Add ``consistency``: mean similarity to the other answers, 1 when there is none."""
    mean = F.when(F.col("n_others") > 0, F.col("similarity_sum") / F.col("n_others")).otherwise(1.0)
    return (
        pairwise_run_similarity(answers, spread_by, vector)
        .withColumn("consistency", mean)
        .drop("n_others", "similarity_sum")
    )


def readability(df: DataFrame, text: str) -> DataFrame:
    """Add word_count, char_count, sentence_count and flesch_reading_ease of ``text``.

    Words exclude bare punctuation and characters exclude whitespace; syllables are
    vowel groups. Stepwise, so that each pattern runs once per row: blanks are made even, then marks are left out.
    """
    body = F.col(text)
    bare = df.withColumn("_even", M.even_blanks(body)).withColumn("_spoken", M.spoken(F.col("_even")))
    counted = bare.withColumns(
        {
            "word_count": M.spoken_words(F.col("_spoken")),
            "char_count": M.solid_chars(F.col("_even")),
            "sentence_count": M.long_sentences(F.col("_spoken")),
            "_syllables": M.syllable_count(body),
        }
    )
    ease = M.reading_ease(F.col("word_count"), F.col("sentence_count"), F.col("_syllables"))
    return counted.withColumn("flesch_reading_ease", ease).drop("_syllables", "_even", "_spoken")


def score_answers(
    answers: DataFrame, gold: DataFrame, key: str, chunk_size: int = 2000, chunk_overlap: int = 300
) -> DataFrame:
    """The metric record of locally generated answers.

    ``answers`` has ``key`` (unique), run, model, application_id, question_id,
    question, answer, time_rag_s, time_res_s, context_len_c, full_promt,
    input_token_cout and output_token_count.
    """
    judged = readability(join_gold(answers, gold, [key]), "answer")
    judged = judged.withColumn("similarity", M.tfidf_cosine(F.col("answer"), F.col("gold")))
    total = F.col("time_res_s") + F.col("time_rag_s")
    answer = F.col("answer")
    return judged.select(
        key,
        "run",
        "model",
        "application_id",
        "question_id",
        strip(F.col("question")).alias("question"),
        "answer",
        F.col("similarity").alias("accuracy"),
        "time_rag_s",
        "time_res_s",
        total.alias("time_total_s"),
        M.throughput(F.col("output_token_count"), total).alias("throughput"),
        "context_len_c",
        F.length("full_promt").cast("bigint").alias("full_promt_len_c"),
        M.word_count(answer).alias("word_count_answ"),
        M.sentence_marks(answer).alias("sentence_count"),
        "input_token_cout",
        "output_token_count",
        (F.col("input_token_cout") + F.col("output_token_count")).alias("total_tokens"),
        F.col("flesch_reading_ease").alias("reading_ease"),
        M.char_count(answer).alias("answer_len_c"),
        F.lit(chunk_size).cast("bigint").alias("chunk_size_c"),
        F.lit(chunk_overlap).cast("bigint").alias("chunk_overlap_c"),
        "full_promt",
    )


def score_answers_hosted(
    answers: DataFrame, gold: DataFrame, vectors: DataFrame, key: str, empty_vec_id: int | None = None
) -> DataFrame:
    """The metric record of answers from a hosted model.

    ``answers`` has ``key`` (unique), run, application_id, question_id, answer,
    latency, prompt_tokens, completion_tokens and answer_vec_id. ``gold`` carries
    ``gold_vec_id`` next to each answer; ``vectors`` (vec_id, embedding) holds the
    vectors an embedding model gave. A request without gold is held against the empty
    answer, whose vector is ``empty_vec_id``; without that its accuracy is null.
    """
    best = _last_entries(gold).groupBy(*REQUEST).agg(F.max("gold_vec_id").alias("gold_vec_id"))
    by_gold = vectors.select(F.col("vec_id").alias("gold_vec_id"), F.col("embedding").alias("gold_vec"))
    known = best.join(by_gold, "gold_vec_id").drop("gold_vec_id")
    # both sides are large here: adaptive execution splits a vector many answers share
    by_answer = vectors.select(F.col("vec_id").alias("answer_vec_id"), F.col("embedding"))
    judged = lookup(answers, known, REQUEST, [key]).join(by_answer, "answer_vec_id", "left")
    if empty_vec_id is not None:
        empty = vectors.filter(F.col("vec_id") == empty_vec_id).agg(F.first("embedding")).scalar()
        judged = judged.withColumn("gold_vec", F.coalesce("gold_vec", empty))
    scored = readability(judged, "answer").withColumns(
        {
            "total_tokens": F.col("prompt_tokens") + F.col("completion_tokens"),
            "total_cost": M.token_cost(F.col("prompt_tokens"), F.col("completion_tokens")),
            "throughput": M.throughput(F.col("completion_tokens"), F.col("latency")),
            "accuracy": F.when(
                F.col("gold_vec").isNotNull() & F.col("embedding").isNotNull(), M.embedding_cosine(F.col("embedding"), F.col("gold_vec"))
            ),
        }
    ).drop("gold_vec", "answer_vec_id")
    return consistency(scored, [key]).drop("embedding")
