"""Vocabulary, token row, batch and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.arrays import MAX_BATCH_LENGTH, MAX_DATASET_LENGTH
from docloom.functions.arrays import attention_mask as mask_of
from docloom.functions.arrays import truncate_ids as cut
from docloom.operators import dataset as D
from docloom.operators import tokens as K
from docloom.plans.stored import stored
from docloom.registry import sql
from docloom.registry.tables import documents

BATCH = 8


def _docs(spark, d):
    return documents(spark, d).select("doc_id", "source", "text")


def _shown(ids):
    return F.array_join(ids.cast("array<string>"), ",")


def _rows(spark, d):
    docs = _docs(spark, d)
    vocab = stored(K.build_vocab(docs, "text"), "vocab")
    return stored(K.encode_tokens(docs, vocab, ["doc_id", "source"], "text"), "tokens")


def build_vocab(spark, d):
    return K.build_vocab(_docs(spark, d), "text")


def encode_tokens(spark, d):
    """With a small head, so that both ways of looking a word up are taken."""
    docs = _docs(spark, d)
    vocab = stored(K.build_vocab(docs, "text"), "vocab")
    rows = K.encode_tokens(docs, vocab, ["doc_id"], "text", head_words=500)
    return rows.select("doc_id", _shown(F.col("input_ids")).alias("ids"))


def truncate_ids(spark, d):
    return _rows(spark, d).select("doc_id", _shown(cut(F.col("input_ids"))).alias("ids"))


def attention_mask(spark, d):
    return _rows(spark, d).select("doc_id", _shown(mask_of(F.col("input_ids"))).alias("mask"))


def make_batches(spark, d):
    return K.make_batches(documents(spark, d).select("doc_id"), "doc_id", BATCH).select("doc_id", "batch_id")


def pad_batch(spark, d):
    rows = _rows(spark, d).withColumn("attention_mask", mask_of(F.col("input_ids")))
    batched = K.make_batches(rows, "doc_id", BATCH, seed=None)
    return K.pad_batch(batched).select(
        "doc_id",
        "batch_id",
        *[_shown(F.col(c)).alias(c) for c in ("input_ids", "attention_mask", "labels")],
    )


def holdout_groups(spark, d):
    training, held = D.holdout_groups(documents(spark, d).select("doc_id", "source"), "source")
    return training.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("eval"))).select(
        "doc_id", "source", "part"
    )


def train_test_split(spark, d):
    return D.train_test_split(documents(spark, d).select("doc_id"), "doc_id").select("doc_id", "is_test")


def make_dataset(spark, d):
    return D.make_dataset(_rows(spark, d), "source").select(
        "doc_id", _shown(F.col("input_ids")).alias("ids"), _shown(F.col("attention_mask")).alias("mask")
    )


def dataset_stats(spark, d):
    split = D.train_test_split(_rows(spark, d), "doc_id")
    return D.dataset_stats(split, F.when(F.col("is_test"), "test").otherwise("train"))


QUERIES = {
    "build_vocab": build_vocab,
    "encode_tokens": encode_tokens,
    "truncate_ids": truncate_ids,
    "attention_mask": attention_mask,
    "make_batches": make_batches,
    "pad_batch": pad_batch,
    "holdout_groups": holdout_groups,
    "train_test_split": train_test_split,
    "make_dataset": make_dataset,
    "dataset_stats": dataset_stats,
}

_SPLIT = """
ordered AS (
  SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS pos, count(*) OVER () AS n
  FROM documents)"""
_HELD = "held AS (SELECT DISTINCT source FROM documents ORDER BY source DESC LIMIT 15)"
_ONES = "array_to_string(list_transform(range({n}), lambda x: 1), ',')"

ORACLES = {
    "build_vocab": f"WITH {sql.VOCAB} SELECT word, n, token_id FROM vocab",
    "encode_tokens": f"WITH {sql.ENCODED} SELECT doc_id, array_to_string(ids, ',') AS ids FROM encoded",
    "truncate_ids": f"WITH {sql.ENCODED} SELECT doc_id, array_to_string(ids[1:{MAX_DATASET_LENGTH}], ',') AS ids FROM encoded",
    "attention_mask": f"""WITH {sql.ENCODED} SELECT doc_id, {_ONES.format(n='len(ids)')} AS mask
      FROM encoded""",
    "make_batches": f"""SELECT doc_id, (row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1) // {BATCH} AS batch_id
      FROM documents""",
    "pad_batch": f"""WITH {sql.ENCODED},
      batched AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS batch_id FROM encoded),
      wide AS (SELECT doc_id, batch_id, ids[1:{MAX_BATCH_LENGTH}] AS ids,
        least(max(len(ids)) OVER (PARTITION BY batch_id), {MAX_BATCH_LENGTH}) AS width FROM batched)
      SELECT doc_id, batch_id,
        array_to_string(ids || list_transform(range(width - len(ids)), lambda x: 0), ',') AS input_ids,
        array_to_string(list_transform(range(width), lambda x: CASE WHEN x < len(ids) THEN 1 ELSE 0 END), ',') AS attention_mask,
        array_to_string(ids || list_transform(range(width - len(ids)), lambda x: -100), ',') AS labels
      FROM wide""",
    "holdout_groups": f"""WITH {_HELD} SELECT doc_id, source,
      CASE WHEN source IN (SELECT source FROM held) THEN 'eval' ELSE 'train' END AS part FROM documents""",
    "train_test_split": f"WITH {_SPLIT} SELECT doc_id, pos <= ceil(n * CAST(0.01 AS DOUBLE)) AS is_test FROM ordered",
    "make_dataset": f"""WITH {sql.ENCODED}, {_HELD}
      SELECT doc_id, array_to_string(ids[1:{MAX_DATASET_LENGTH}], ',') AS ids,
        {_ONES.format(n=f'least(len(ids), {MAX_DATASET_LENGTH})')} AS mask
      FROM encoded WHERE source NOT IN (SELECT source FROM held)""",
    "dataset_stats": f"""WITH {sql.ENCODED}, {_SPLIT}
      SELECT CASE WHEN pos <= ceil(n * CAST(0.01 AS DOUBLE)) THEN 'test' ELSE 'train' END AS part,
        count(*) AS n_rows, CAST(sum(len(ids)) AS BIGINT) AS n_tokens
      FROM encoded JOIN ordered USING (doc_id) GROUP BY 1""",
}
