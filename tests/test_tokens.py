import math
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from docloom.operators import dataset as D
from docloom.operators import tokens as K


@pytest.fixture(scope="module")
def lines(spark):
    texts = [f"the w{i % 7} the x{i} {'the ' * (i % 5)}" for i in range(60)] + ["", "  "]
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, input string").repartition(5)


def counted(lines):
    return Counter(w for r in lines.collect() for w in r.input.split())


def test_vocab_ranks_by_frequency(lines):
    counts = counted(lines)
    order = sorted(counts, key=lambda w: (-counts[w], md5(w.encode()).hexdigest(), w))
    got = {r.word: (r.n, r.token_id) for r in K.build_vocab(lines).collect()}
    assert got == {w: (counts[w], K.FIRST_WORD_ID + i) for i, w in enumerate(order)}


@pytest.mark.parametrize("head", [0, 3, 20_000])
def test_encode_tokens(lines, head):
    vocab = K.build_vocab(lines).filter("word <> 'x5'")
    ids = {r.word: r.token_id for r in vocab.collect()}
    got = {r.id: (r.input_ids, r.attention_mask) for r in K.encode_tokens(
        lines, vocab, ["id"], with_mask=True, head_words=head).collect()}
    for r in lines.collect():
        expected = [K.BOS_ID, *(ids.get(w, K.UNKNOWN_ID) for w in r.input.split()), K.EOS_ID]
        assert got[r.id] == (expected, [1] * len(expected))


def test_split_is_exact_and_stable(spark):
    rows = spark.range(1037).withColumnRenamed("id", "k")
    for ratio in (0.01, 0.1, 1 / 3, 1.0):
        split = D.train_test_split(rows, "k", ratio, digits=1)
        test = {r.k for r in split.filter("is_test").collect()}
        assert len(test) == math.ceil(1037 * ratio) and split.count() == 1037
        again = D.train_test_split(rows.repartition(3), "k", ratio, digits=3)
        assert {r.k for r in again.filter("is_test").collect()} == test
    assert D.train_test_split(rows, "k", 0).filter("is_test").count() == 0
    some = rows.unionByName(rows.limit(30).withColumn("k", F.lit(None).cast(rows.schema["k"].dataType)))
    split = D.train_test_split(some, "k", 0.3)
    assert split.count() == 1067 and split.filter("k IS NULL AND NOT is_test").count() == 30
    assert split.filter("is_test").count() == math.ceil(1037 * 0.3)
    assert D.train_test_split(some.filter("k IS NULL"), "k", 0.3).filter("NOT is_test").count() == 30


@pytest.mark.parametrize("groups", [14, 15, 16, 40])
def test_holdout_groups(spark, groups):
    rows = spark.range(200).select("id", F.format_string("g%02d", F.col("id") % groups).alias("g"))
    training, held = D.holdout_groups(rows, "g")
    names = sorted({f"g{i % groups:02d}" for i in range(200)})
    assert {r.g for r in training.collect()} == set(names[:-15] if len(names) > 15 else [])
    assert training.count() + held.count() == 200


def test_batches_and_padding(spark):
    rows = spark.range(21).select(
        "id", F.sequence(F.lit(1), (F.col("id") % 6 + 1).cast("int")).alias("input_ids")
    ).withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1).cast("tinyint")))
    for seed in (None, 42):
        batched = K.make_batches(rows.repartition(3), "id", 4, seed=seed)
        sizes = Counter(r.batch_id for r in batched.collect())
        assert sizes == {0: 4, 1: 4, 2: 4, 3: 4, 4: 4, 5: 1}
    assert all(r.batch_id == r.id // 4 for r in K.make_batches(rows, "id", 4, seed=None).collect())
    batch = {r.id: r for r in K.pad_batch(K.make_batches(rows, "id", 4, seed=None), max_length=3).collect()}
    assert batch[0].input_ids == [1, 0, 0] and batch[0].labels == [1, -100, -100]
    assert batch[0].attention_mask == [1, 0, 0]
    assert batch[3].input_ids == [1, 2, 3] and batch[3].labels == [1, 2, 3]
    assert batch[20].input_ids == [1, 2, 3]
    odd = rows.withColumn("id", F.when(F.col("id") >= 3, F.col("id") % 10))  # null and equal keys
    got = K.make_batches(odd, "id", 4, seed=None)
    assert got.columns == [*rows.columns, "batch_id"]
    got = got.select("batch_id", "id").collect()
    assert Counter(r.batch_id for r in got) == {0: 4, 1: 4, 2: 4, 3: 4, 4: 4, 5: 1}
    assert sorted(((r.batch_id, -1 if r.id is None else r.id) for r in got)) == [
        (n // 4, k) for n, k in enumerate(sorted(-1 if i < 3 else i % 10 for i in range(21)))
    ]
    free = {r.id: r for r in K.pad_batch(K.make_batches(rows, "id", 4, seed=None), max_length=None).collect()}
    assert len(free[0].input_ids) == 4


def test_make_dataset(spark):
    rows = spark.createDataFrame(
        [(f"g{i:02d}", list(range(i + 1))) for i in range(18)] + [("g00", None)], "g string, input_ids array<int>"
    )
    got = {r.g: (r.input_ids, r.attention_mask) for r in D.make_dataset(rows, "g", 2).collect()}
    assert got == {"g00": ([0], [1]), "g01": ([0, 1], [1, 1]), "g02": ([0, 1], [1, 1])}


def test_malformed_token_lines_are_not_lost_silently(spark):
    rows = spark.createDataFrame(
        [(f"g{i:02d}", [i], None) for i in range(18)] + [("g00", None, "{bad")], "g string, input_ids array<int>, corrupt_record string"
    )
    with pytest.raises(Exception, match="malformed token line"):
        D.make_dataset(rows, "g").collect()
    assert D.make_dataset(rows, "g", skip_malformed=True).count() == 3


def test_known_words_are_no_rows(spark):
    texts = [(1, "a b a c"), (2, None), (3, "  \x1c"), (4, "zz a b"), (5, "a c"), (5, "zz b")]
    lines = spark.createDataFrame(texts, "id bigint, input string")
    vocab = spark.createDataFrame([("a", 3, 4), ("b", 2, 5), ("c", 1, 6)], "word string, n bigint, token_id bigint")
    out = K.encode_tokens(lines, vocab, ["id"], head_words=1)
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.input_ids for r in out.collect()} == {
        1: [2, 4, 5, 4, 6, 1], 2: [2, 1], 3: [2, 1], 4: [2, 3, 4, 5, 1], 5: [2, 3, 4, 5, 6, 1]
    }
