"""Request, gold answer and metric queries over question and answer turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import metrics as M
from docloom.operators import requests as Q
from docloom.operators import scoring as S
from docloom.registry import sql
from docloom.registry.tables import documents, table

ID = ["pair_id", "application_id", "question_id"]


def pairs(spark, d) -> DataFrame:
    """Every user turn that an assistant turn follows."""
    turns = table(spark, d, "conversations")
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    told = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(told, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"),
        F.concat(F.lit("app"), (F.col("conv_id") % 20).cast("string")).alias("application_id"),
        (F.floor(F.col("conv_id") / 20) % 5 + 1).cast("bigint").alias("question_id"),
        "question",
        "answer",
    )


def gold(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(
        F.concat(F.lit("app"), (F.col("item_id") % 20).cast("string")).alias("application_id"),
        (F.floor(F.col("item_id") / 20) % 5 + 1).cast("bigint").alias("question_id"),
        F.col("text").alias("answer"),
        F.floor(F.col("item_id") / 100).alias("ordinal"),
        "item_id",
    )


def _vector_of(spark, d) -> Column:
    """The vector number of a pair: turns of a conversation and conversations all get their own."""
    size = table(spark, d, "embeddings").agg(F.count("*").alias("n")).scalar()
    conv, turn = F.floor(F.col("pair_id") / 1000), F.col("pair_id") % 1000
    return (conv * 7 + turn) % size


def with_vectors(spark, d) -> DataFrame:
    """Answers with the vector an embedding table holds for them, null where it holds none."""
    vectors = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("vec_of"), F.col("embedding")
    )
    p = pairs(spark, d).withColumn("vec_of", _vector_of(spark, d))
    return p.join(vectors, "vec_of", "left").drop("vec_of")


def request_grid(spark, d):
    apps = documents(spark, d).select(F.col("source").alias("application_id")).distinct()
    questions = table(spark, d, "benchmark").select((F.col("item_id") + 1).alias("ordinal"), F.col("text").alias("line"))
    return Q.request_grid(apps, questions)


def zip_by_ordinal(spark, d):
    lines = table(spark, d, "benchmark").select((F.col("item_id") + 1).alias("ordinal"), F.col("text").alias("line"))
    prompts = table(spark, d, "documents").select(
        (F.col("doc_id") + 1).alias("ordinal"), F.concat(F.lit("Text: <CONTEXT> "), "text").alias("line")
    )
    return Q.zip_by_ordinal(lines, prompts)


def attach_outputs(spark, d):
    """User turns with the answer and the vector a model gave, where it gave them."""
    asked = table(spark, d, "conversations").filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    told = with_vectors(spark, d).select(
        F.floor(F.col("pair_id") / 1000).alias("conv_id"), (F.col("pair_id") % 1000).alias("turn"), "answer",
        F.size("embedding").alias("vector_size"),
    )
    found = Q.attach_outputs(asked, told, ["conv_id", "turn"])
    return found.withColumn("vector_size", F.coalesce("vector_size", F.lit(0)))


def join_gold(spark, d):
    return S.join_gold(pairs(spark, d), gold(spark, d), ["pair_id"]).select(*ID, "gold")


def join_gold_default(spark, d):
    return S.join_gold_default(pairs(spark, d), gold(spark, d), ["pair_id"]).select(*ID, "gold")


def pairwise_run_similarity(spark, d):
    return S.pairwise_run_similarity(with_vectors(spark, d), ["pair_id"]).select(
        *ID, "n_others", F.round("similarity_sum", 6).alias("similarity_sum")
    )


def consistency(spark, d):
    return S.consistency(with_vectors(spark, d), ["pair_id"]).select(
        *ID, F.round("consistency", 6).alias("consistency")
    )


def tfidf_pair_similarity(spark, d):
    """Every answer against its question's gold answer; null where there is none."""
    judged = S.join_gold(pairs(spark, d), gold(spark, d), ["pair_id"])
    return S.tfidf_pair_similarity(judged, "pair_id", "answer", "gold").withColumn("similarity", F.round("similarity", 6))


def tfidf_cosine(spark, d):
    """The column by itself, where a missing gold answer is an empty text."""
    judged = S.join_gold_default(pairs(spark, d), gold(spark, d), ["pair_id"])
    return judged.select("pair_id", F.round(M.tfidf_cosine(F.col("answer"), F.col("gold")), 6).alias("similarity"))


def throughput(spark, d):
    seconds = (F.length("question") % 50) / 10
    return pairs(spark, d).select(
        "pair_id", F.round(M.throughput(M.word_count(F.col("answer")), seconds), 6).alias("throughput")
    )


def token_cost(spark, d):
    return pairs(spark, d).select(
        "pair_id",
        F.round(M.token_cost(M.word_count(F.col("question")), M.word_count(F.col("answer"))), 9).alias("cost"),
    )


def answer_counts(spark, d):
    return documents(spark, d).select(
        "doc_id", *[c.alias(n) for n, c in M.answer_counts(F.col("text")).items()]
    )


def readability(spark, d):
    # every second document with no-break and wide blanks
    blanks = F.translate("text", " \n", "\u00a0\u3000")
    texts = documents(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, blanks).otherwise(F.col("text")).alias("text"))
    counted = S.readability(texts, "text").drop("text")
    return counted.withColumn("flesch_reading_ease", F.round("flesch_reading_ease", 6))


def embedding_cosine(spark, d):
    """Every vector against the one with the next number."""
    v = table(spark, d, "embeddings")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(other, "vec_id").select(
        "vec_id", F.round(M.embedding_cosine(F.col("embedding"), F.col("other")), 6).alias("cosine")
    )


def _answers(spark, d) -> DataFrame:
    return pairs(spark, d).select(
        *ID,
        (F.col("pair_id") % 3 + 1).alias("run"),
        F.lit("gemma").alias("model"),
        "question",
        "answer",
        (F.length("question") / 100).alias("time_rag_s"),
        (F.length("answer") / 50).alias("time_res_s"),
        F.length("question").cast("bigint").alias("context_len_c"),
        F.concat(F.lit("Text: "), "question").alias("full_promt"),
        M.word_count(F.col("question")).alias("input_token_cout"),
        M.word_count(F.col("answer")).alias("output_token_count"),
    )


def local_records(spark, d) -> DataFrame:
    return S.score_answers(_answers(spark, d), gold(spark, d), "pair_id")


def score_answers(spark, d):
    records = local_records(spark, d)
    return records.withColumns(
        {
            c: F.round(c, 6)
            for c in ("accuracy", "time_rag_s", "time_res_s", "time_total_s", "throughput", "reading_ease")
        }
    )


def hosted_records(spark, d) -> DataFrame:
    answers = pairs(spark, d).select(
        *ID,
        (F.col("pair_id") % 3 + 1).alias("run"),
        "answer",
        (F.length("answer") / 50).alias("latency"),
        M.word_count(F.col("question")).alias("prompt_tokens"),
        M.word_count(F.col("answer")).alias("completion_tokens"),
        _vector_of(spark, d).alias("answer_vec_id"),
    )
    best = gold(spark, d).withColumnRenamed("item_id", "gold_vec_id")
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return S.score_answers_hosted(answers, best, vectors, "pair_id")


def score_answers_hosted(spark, d):
    places = {"latency": 6, "total_cost": 9, "throughput": 6, "flesch_reading_ease": 6, "accuracy": 6, "consistency": 6}
    return hosted_records(spark, d).withColumns({c: F.round(c, n) for c, n in places.items()})


QUERIES = {
    "request_grid": request_grid,
    "zip_by_ordinal": zip_by_ordinal,
    "attach_outputs": attach_outputs,
    "join_gold": join_gold,
    "join_gold_default": join_gold_default,
    "pairwise_run_similarity": pairwise_run_similarity,
    "consistency": consistency,
    "tfidf_pair_similarity": tfidf_pair_similarity,
    "tfidf_cosine": tfidf_cosine,
    "throughput": throughput,
    "token_cost": token_cost,
    "answer_counts": answer_counts,
    "readability": readability,
    "embedding_cosine": embedding_cosine,
    "score_answers": score_answers,
    "score_answers_hosted": score_answers_hosted,
}

_ID = "pair_id, application_id, question_id"


def n_words(x: str) -> str:
    return f"len({sql.words(x)})"


def _marks(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[.!?]'))"


_BLANKS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _lexicon(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{_BLANKS}]*[\\p{{L}}\\p{{N}}_][^{_BLANKS}]*'))"


def _sentences(x: str) -> str:
    return f"greatest(len(list_filter(regexp_split_to_array({x}, '[.!?]+'), lambda p: {_lexicon('p')} >= 3)), 1)"


def _ease(x: str) -> str:
    syllables = f"len(regexp_extract_all(lower({x}), '[{M.VOWELS}]+'))"
    w, s = _lexicon(x), _sentences(x)
    return (
        f"CASE WHEN {w} > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * ({w}::DOUBLE / {s}) "
        f"- 84.6::DOUBLE * ({syllables}::DOUBLE / {w}) ELSE 0.0::DOUBLE END"
    )


def _solid(x: str) -> str:
    return f"length(regexp_replace({x}, '[{_BLANKS}]', '', 'g'))"


_JUDGED = f"""{sql.PAIRS},
judged AS (
  SELECT p.*, g.gold FROM pairs p LEFT JOIN last_gold g USING (application_id, question_id))"""
_VECTORED = f"""{sql.PAIRS},
vectored AS (
  SELECT p.*, e.embedding::DOUBLE[] AS v FROM pairs p
  LEFT JOIN embeddings e ON e.vec_id = ((p.pair_id // 1000) * 7 + p.pair_id % 1000) % (SELECT count(*) FROM embeddings)),
peers AS (
  SELECT a.pair_id, count(*) AS n_others, sum(list_cosine_similarity(a.v, b.v)) AS similarity_sum
  FROM vectored a JOIN vectored b ON a.application_id = b.application_id AND a.question_id = b.question_id
    AND a.pair_id <> b.pair_id AND a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY a.pair_id)"""

hosted_sql = f"""{_VECTORED},
hosted AS (
  SELECT pair_id, length(answer) / 50.0::DOUBLE AS latency,
    {n_words('question')} / 1000.0::DOUBLE * 0.0003::DOUBLE + {n_words('answer')} / 1000.0::DOUBLE * 0.0025::DOUBLE AS total_cost,
    CASE WHEN length(answer) > 0 THEN {n_words('answer')} / (length(answer) / 50.0::DOUBLE) ELSE 0 END AS throughput,
    {_ease('answer')} AS flesch_reading_ease,
    list_cosine_similarity(v, e.embedding::DOUBLE[]) AS accuracy,
    coalesce(similarity_sum / n_others, 1) AS consistency
  FROM vectored LEFT JOIN last_gold g USING (application_id, question_id)
    LEFT JOIN embeddings e ON e.vec_id = g.item_id LEFT JOIN peers USING (pair_id))"""

ORACLES = {
    "request_grid": """SELECT run, source AS application_id, item_id + 1 AS question_id, text AS question
      FROM (SELECT DISTINCT source FROM documents) CROSS JOIN benchmark CROSS JOIN range(1, 4) r(run)""",
    "zip_by_ordinal": """SELECT b.item_id + 1 AS ordinal, b.text AS question, 'Text: <CONTEXT> ' || d.text AS template
      FROM benchmark b JOIN documents d ON d.doc_id = b.item_id""",
    "attach_outputs": f"""WITH {_VECTORED} SELECT conv_id, turn, text AS question, answer, coalesce(len(v), 0)::INT AS vector_size
      FROM conversations LEFT JOIN vectored ON pair_id = conv_id * 1000 + turn WHERE role = 'user'""",
    "join_gold": f"WITH {_JUDGED} SELECT {_ID}, gold FROM judged",
    "join_gold_default": f"WITH {_JUDGED} SELECT {_ID}, coalesce(gold, '') AS gold FROM judged",
    "pairwise_run_similarity": f"""WITH {_VECTORED} SELECT {_ID}, coalesce(n_others, 0) AS n_others,
      round(coalesce(similarity_sum, 0), 6) AS similarity_sum FROM vectored LEFT JOIN peers USING (pair_id)""",
    "consistency": f"""WITH {_VECTORED} SELECT {_ID}, round(coalesce(similarity_sum / n_others, 1), 6) AS consistency
      FROM vectored LEFT JOIN peers USING (pair_id)""",
    "tfidf_pair_similarity": f"""WITH {_JUDGED}, {sql.TFIDF}
      SELECT pair_id, round(similarity, 6) AS similarity FROM pairs LEFT JOIN cosines USING (pair_id)""",
    "tfidf_cosine": f"""WITH {_JUDGED}, {sql.TFIDF}
      SELECT pair_id, round(coalesce(similarity, CASE WHEN regexp_matches(answer, '[\\p{{L}}\\p{{N}}_]{{2}}') THEN 0 END), 6) AS similarity
      FROM pairs LEFT JOIN cosines USING (pair_id)""",
    "throughput": f"""WITH {sql.PAIRS} SELECT pair_id, round(CASE WHEN length(question) % 50 > 0
      THEN {n_words('answer')} / ((length(question) % 50) / 10.0::DOUBLE) ELSE 0 END, 6) AS throughput FROM pairs""",
    "token_cost": f"""WITH {sql.PAIRS} SELECT pair_id, round({n_words('question')} / 1000.0::DOUBLE * 0.0003::DOUBLE
      + {n_words('answer')} / 1000.0::DOUBLE * 0.0025::DOUBLE, 9) AS cost FROM pairs""",
    "answer_counts": f"""SELECT doc_id, {n_words('text')} AS word_count, {_marks('text')} AS sentence_count,
      length(text) AS char_count FROM documents""",
    "readability": f"""WITH texts AS (
        SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN translate(text, ' ' || chr(10), chr(160) || chr(12288)) ELSE text END AS text FROM documents)
      SELECT doc_id, {_lexicon('text')} AS word_count, {_solid('text')} AS char_count,
      {_sentences('text')} AS sentence_count, round({_ease('text')}, 6) AS flesch_reading_ease FROM texts""",
    "embedding_cosine": """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "score_answers": f"""WITH {_JUDGED}, {sql.TFIDF}
      SELECT pair_id, pair_id % 3 + 1 AS run, 'gemma' AS model, application_id, question_id,
        {sql.strip('question')} AS question, answer, round(similarity, 6) AS accuracy,
        round(length(question) / 100.0::DOUBLE, 6) AS time_rag_s, round(length(answer) / 50.0::DOUBLE, 6) AS time_res_s,
        round(length(answer) / 50.0::DOUBLE + length(question) / 100.0::DOUBLE, 6) AS time_total_s,
        round(CASE WHEN length(answer) + length(question) > 0 THEN {n_words('answer')}
          / (length(answer) / 50.0::DOUBLE + length(question) / 100.0::DOUBLE) ELSE 0 END, 6) AS throughput,
        length(question) AS context_len_c, 6 + length(question) AS full_promt_len_c,
        {n_words('answer')} AS word_count_answ, {_marks('answer')} AS sentence_count,
        {n_words('question')} AS input_token_cout, {n_words('answer')} AS output_token_count,
        {n_words('question')} + {n_words('answer')} AS total_tokens,
        round({_ease('answer')}, 6) AS reading_ease, length(answer) AS answer_len_c,
        2000::BIGINT AS chunk_size_c, 300::BIGINT AS chunk_overlap_c, 'Text: ' || question AS full_promt
      FROM judged LEFT JOIN cosines USING (pair_id)""",
    "score_answers_hosted": f"""WITH {_VECTORED}
      SELECT pair_id, application_id, question_id, pair_id % 3 + 1 AS run, answer,
        round(length(answer) / 50.0::DOUBLE, 6) AS latency, {n_words('question')} AS prompt_tokens,
        {n_words('answer')} AS completion_tokens, {n_words('question')} + {n_words('answer')} AS total_tokens,
        round({n_words('question')} / 1000.0::DOUBLE * 0.0003::DOUBLE
          + {n_words('answer')} / 1000.0::DOUBLE * 0.0025::DOUBLE, 9) AS total_cost,
        round(CASE WHEN length(answer) > 0 THEN {n_words('answer')} / (length(answer) / 50.0::DOUBLE) ELSE 0 END, 6) AS throughput,
        {_lexicon('answer')} AS word_count, {_solid('answer')} AS char_count, {_sentences('answer')} AS sentence_count,
        round({_ease('answer')}, 6) AS flesch_reading_ease,
        round(list_cosine_similarity(v, e.embedding::DOUBLE[]), 6) AS accuracy,
        round(coalesce(similarity_sum / n_others, 1), 6) AS consistency
      FROM vectored LEFT JOIN last_gold g USING (application_id, question_id)
        LEFT JOIN embeddings e ON e.vec_id = g.item_id LEFT JOIN peers USING (pair_id)""",
}
