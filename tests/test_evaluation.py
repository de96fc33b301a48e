import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import metrics as M
from docloom.functions import prompts as P
from docloom.operators import requests as Q
from docloom.operators import retrieval as R
from docloom.operators import scoring as S
from docloom.plans.lookup import lookup

VEC = "array<float>"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    return rng.normal(size=(300, 12)).astype("float32")


@pytest.fixture(scope="module")
def frames(spark, vectors):
    # two thirds of all chunks in one application
    chunks = [(i, "hot" if i % 3 else f"a{i % 2}", v.tolist()) for i, v in enumerate(vectors)]
    queries = [(q, app, vectors[q].tolist()) for q, app in enumerate(["hot", "a0", "hot", "a1", "nowhere"])]
    return (
        spark.createDataFrame(queries, f"query_id bigint, application string, embedding {VEC}"),
        spark.createDataFrame(chunks, f"chunk_id bigint, application string, embedding {VEC}"),
    )


def nearest(frames, k, metric, scope):
    queries, chunks = (f.collect() for f in frames)
    out = {}
    for q in queries:
        a = np.array(q.embedding, dtype=float)
        found = []
        for c in chunks:
            if scope == "application" and c.application != q.application:
                continue
            b = np.array(c.embedding, dtype=float)
            d = ((a - b) ** 2).sum() if metric == "l2" else 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)
            found.append((d, c.chunk_id))
        out[q.query_id] = [c for _, c in sorted(found)[:k]]
    return {q: ids for q, ids in out.items() if ids}


@pytest.mark.parametrize("metric, scope", [("l2", "application"), ("cosine", "global")])
def test_knn_is_exact(frames, metric, scope):
    got = {}
    for r in sorted(R.knn_join(*frames, k=7, metric=metric, scope=scope).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == nearest(frames, 7, metric, scope)


def _recall(spark, points, asked, k=20):
    """Recall of ``knn_lsh`` with its defaults and the share of all pairs whose vectors it compares."""
    frame = lambda ids, name: spark.createDataFrame([(int(i), points[i].tolist()) for i in ids], f"{name} long, embedding array<float>")
    queries, chunks = frame(asked, "query_id").cache(), frame(range(len(points)), "chunk_id").cache()
    near = R.candidates(queries, chunks, k).cache()
    assert near.count() == near.distinct().count()
    got, hits = {}, 0
    for r in R.knn_lsh(queries, chunks, k, near=near).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    stored = points.astype("f4").astype(float)
    for i in asked:
        exact = np.lexsort((np.arange(len(points)), ((stored - stored[i]) ** 2).sum(axis=1)))[:k]
        assert len(got[i]) == k
        hits += len(got[i] & set(exact.tolist()))
    return hits / k / len(asked), near.count() / len(asked) / len(points)


def test_lsh_finds_neighbours_in_clusters_by_its_cells(spark, monkeypatch):
    opened = []
    measure = R.sketches.measure
    monkeypatch.setattr(R.sketches, "measure", lambda *a: opened.append(measure(*a)) or opened[-1])
    rng = np.random.default_rng(3)
    points = np.repeat(rng.normal(size=(60, 32)), 50, axis=0) + 0.1 * rng.normal(size=(3000, 32))
    recall, share = _recall(spark, points, range(0, 3000, 20))
    assert opened[0].probes and recall >= 0.9 and share < 0.1


def test_lsh_finds_neighbours_without_any_structure(spark):
    recall, share = _recall(spark, np.random.default_rng(4).normal(size=(3000, 32)), range(0, 3000, 20))
    assert recall >= 0.9 and share < 0.2


def test_nearest_in_cells_is_the_plain_join(spark, monkeypatch):
    from docloom.operators import nearest as N

    monkeypatch.setattr(N, "QUERIES", 7), monkeypatch.setattr(N, "CHUNKS", 40), monkeypatch.setattr(N, "_MATRIX", 100), monkeypatch.setattr(N, "_GAPS", 50)
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(200)]  # many equal distances
    rows += [(3, [0.5, 0.25, 0.1]), (None, [0.1, 0.2, 0.3]), (300, [1.0, None, 0.0]), (301, [1.0, 2.0]), (302, [math.nan, 0.0, 0.0]), (303, [math.inf, 1.0, 1.0]), (304, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    queries = chunks.selectExpr("chunk_id AS query_id", "embedding").where("query_id IS NULL OR query_id % 20 < 4")
    pairs = queries.where("embedding IS NOT NULL").withColumnRenamed("embedding", "query_vec").crossJoin(chunks.where("embedding IS NOT NULL").withColumnRenamed("embedding", "chunk_vec"))
    plain = R._top(pairs.select("query_id", "chunk_id", R._distance("l2").alias("distance")), 20)
    seen = lambda df: Counter(map(str, df.collect()))
    assert seen(R.knn_join(queries, chunks, 20, "l2", "global")) == seen(plain)


def test_lsh_without_cells_ranks_where_sketches_meet(spark, monkeypatch):
    points = np.random.default_rng(4).normal(size=(500, 32))
    chunks = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "chunk_id long, embedding array<float>")
    queries = chunks.selectExpr("chunk_id AS query_id", "embedding").where("query_id % 20 = 0")
    tuning = R.tuned(queries, chunks)
    assert tuning.setting.probes is None
    near = R.candidates(queries, chunks, tuning=tuning)
    want = sorted(R.knn_lsh(queries, chunks, near=near).collect())
    # no pair is a row of its own on the way
    monkeypatch.setattr(R, "candidates", None)
    assert sorted(R.knn_lsh(queries, chunks, tuning=tuning).collect()) == want


def test_lsh_of_few_null_and_equal_vectors(spark, frames):
    queries, chunks = frames
    exact = {tuple(r) for r in R.knn_join(queries, chunks, 5000, "l2", "global").select("query_id", "chunk_id").collect()}
    assert {(r.query_id, r.chunk_id) for r in R.knn_lsh(queries, chunks, 5000).collect()} <= exact
    few = spark.createDataFrame([(i, [1.0, 2.0] if i else None) for i in range(30)], "chunk_id long, embedding array<float>")
    one = few.selectExpr("chunk_id AS query_id", "embedding").where("query_id < 3")
    got = sorted((r.query_id, r.chunk_id) for r in R.knn_lsh(one, few, 4).collect())
    assert got == [(q, c) for q in (1, 2) for c in (1, 2, 3, 4)]
    assert R.knn_lsh(one, few.limit(0)).count() == 0 == R.knn_lsh(one.limit(0), few).count()


def test_prompt_of_a_query_without_chunks(spark):
    queries = spark.createDataFrame([(1, "a", [1.0], "q?"), (2, "none", [1.0], "r?"), (3, "a", None, "s?")], "query_id int, application string, embedding array<float>, question string")
    chunks = spark.createDataFrame([("c1", "a", [1.0], "text")], "chunk_id string, application string, embedding array<float>, document string")
    scores = spark.createDataFrame([], "query_id int, chunk_id string, score int")
    got = {r.query_id: (r.prompt, r.n_chunks) for r in R.retrieve_prompt(queries, chunks, scores, "<CONTEXT>|<QUERY>", 3).collect()}
    assert got == {1: ("\ntext|q?", 1), 2: ("|r?", 0), 3: ("|s?", 0)}


def test_rerank_keeps_retrieval_order_on_ties(spark):
    hits = spark.createDataFrame([(1, c, n) for n, c in enumerate("abcd", 1)], "query_id int, chunk_id string, rank int")
    replies = spark.createDataFrame(
        [(1, "a", "none"), (1, "b", "about 7."), (1, "c", "7")], "query_id int, chunk_id string, reply string"
    )
    scored = R.attach_scores(hits, replies)
    assert {r.chunk_id: r.score for r in scored.collect()} == {"a": 0, "b": 7, "c": 7, "d": 0}
    top = R.rerank_topn(scored, 3).orderBy("rerank").collect()
    assert [r.chunk_id for r in top] == ["b", "c", "a"]


def test_context_and_prompt(spark):
    parts = spark.createDataFrame([(1, 2, "two"), (1, 1, "one\n\n\nend")], "query_id int, chunk_id int, document string")
    context = R.build_context(parts).first().context
    assert context == "\n\none\n\n\nend\n\ntwo"
    row = spark.createDataFrame([("T: <CONTEXT> Q: <QUERY>", context, "q?")], "template string, context string, question string")
    got = Q.prepare_prompts(row).first()
    assert got.full_promt == "T: <CONTEXT> Q: <QUERY>".replace("<CONTEXT>", context).replace("<QUERY>", "q?").replace("\n\n", "\n")
    assert (got.context_len_c, got.full_promt_len_c) == (len(context), len(got.full_promt))


def test_templates_fill_in(spark):
    row = spark.createDataFrame([("q %s", "d")], "q string, d string")
    got = row.select(P.rerank_prompt(F.col("q"), F.col("d")).alias("r"), P.summary_prompt(F.col("q"), F.col("d")).alias("s")).first()
    assert got.r == P.RERANK_TEMPLATE % ("q %s", "d") and got.s == P.SUMMARY_TEMPLATE % ("d", "q %s")


def test_request_grid(spark):
    apps = spark.createDataFrame([("a",), ("b",)], "application_id string")
    lines = spark.createDataFrame([(2, "second"), (1, "first")], "ordinal bigint, line string")
    got = sorted(map(tuple, Q.request_grid(apps, lines, runs=3).collect()))
    assert got == [(r, a, n, t) for r in (1, 2, 3) for a in "ab" for n, t in ((1, "first"), (2, "second"))]
    many = spark.range(1, 20_001).selectExpr("id AS ordinal", "concat('q', id) AS line")
    assert Q.request_grid(apps, many, runs=1).count() == 40_000


GOLD = "application_id string, question_id bigint, answer string, ordinal bigint"


def test_gold_joins(spark):
    gold = spark.createDataFrame([("a", 1, "old", 0), ("a", 1, "new", 3), ("b", 1, "", 1)], GOLD)
    answers = spark.createDataFrame(
        [(i, a, 1) for i, a in enumerate(["a"] * 50 + ["b", "c"])], "id bigint, application_id string, question_id bigint"
    )
    local = {r.id: r.gold for r in S.join_gold(answers, gold, ["id"]).collect()}
    hosted = {r.id: r.gold for r in S.join_gold_default(answers, gold, ["id"]).collect()}
    assert local == {**{i: "new" for i in range(50)}, 50: None, 51: None}
    assert hosted == {**{i: "new" for i in range(50)}, 50: "", 51: ""}


def test_lookup_keeps_every_row_of_a_hot_key(spark):
    rows = spark.range(1000).withColumn("k", F.when(F.col("id") < 900, 1).otherwise(F.col("id")))
    facts = spark.createDataFrame([(1, "x"), (950, "y")], "k bigint, v string")
    got = lookup(rows, facts, ["k"], ["id"], salts=7)
    counts = {r.v: r["count"] for r in got.groupBy("v").count().collect()}
    assert counts == {"x": 900, "y": 1, None: 99}


def tfidf(a, b):
    ta, tb = (Counter(re.findall(r"\b\w\w+\b", t.lower())) for t in (a, b))
    if not ta and not tb:
        return None
    idf = {t: math.log(3 / (1 + (t in ta) + (t in tb))) + 1 for t in {*ta, *tb}}
    va, vb = ({t: n * idf[t] for t, n in c.items()} for c in (ta, tb))
    size = math.sqrt(sum(x * x for x in va.values())) * math.sqrt(sum(x * x for x in vb.values()))
    return sum(x * vb.get(t, 0) for t, x in va.items()) / size if size else 0.0


def test_tfidf_cosine(spark):
    texts = [("Yes it is", "Yes"), ("a b c", "d"), ("", "word"), ("Tree works Tree", "tree WORKS for trees"),
             ("été à la mer", "ÉTÉ mer_1"), ("same text", "same text"), ("no", "yes")]
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "id int, a string, b string")
    got = {r.id: r.similarity for r in S.tfidf_pair_similarity(pairs, "id", "a", "b").collect()}
    for i, (a, b) in enumerate(texts):
        expected = tfidf(a, b)
        assert got[i] == (None if expected is None else pytest.approx(expected)), texts[i]


def test_consistency_equals_all_pairs(spark, vectors):
    rows = [(i, f"a{i % 4}", 1 if i % 5 else i, vectors[i].tolist()) for i in range(60)]
    rows.append((60, "a0", 1, [0.0] * 12))
    df = spark.createDataFrame(rows, f"id bigint, application_id string, question_id bigint, embedding {VEC}")
    got = {r.id: r.consistency for r in S.consistency(df, ["id"]).collect()}
    for i, app, q, v in rows:
        sims = []
        for j, app2, q2, w in rows:
            if i != j and (app, q) == (app2, q2):
                size = np.linalg.norm(v) * np.linalg.norm(w)
                sims.append(float(np.dot(v, w) / size) if size else 0.0)
        assert got[i] == pytest.approx(np.mean(sims) if sims else 1.0, abs=1e-6)


def test_metrics(spark):
    text = "Yes, it is.  The tree works - are planned! Really?"
    df = spark.createDataFrame([(text, 100, 40, 2.0, 0.0)], "t string, p int, c int, s double, z double")
    got = df.select(
        M.word_count(F.col("t")), M.sentence_marks(F.col("t")), M.lexicon_count(F.col("t")),
        M.solid_char_count(F.col("t")), M.spoken_sentences(F.col("t")),
        M.throughput(F.col("c"), F.col("s")), M.throughput(F.col("c"), F.col("z")), M.token_cost(F.col("p"), F.col("c")),
    ).first()
    assert list(got[:5]) == [10, 3, 9, len(re.sub(r"\s", "", text)), 2]
    assert list(got[5:]) == [20.0, 0.0, pytest.approx(0.1 * 0.0003 + 0.04 * 0.0025)]


def test_context_follows_chunk_numbers(spark):
    rows = [(1, f"md_{n}", f"t{n}") for n in (10, 9, 2, 100)] + [(2, "b", "x"), (2, "a", "y")]
    got = R.build_context(spark.createDataFrame(rows, "query_id int, chunk_id string, document string")).collect()
    assert {r.query_id: r.context.split() for r in got} == {1: ["t2", "t9", "t10", "t100"], 2: ["y", "x"]}


def test_duplicate_scores_keep_one_hit(spark):
    hits = spark.createDataFrame([(1, "a", 1)], "query_id int, chunk_id string, rank int")
    scores = spark.createDataFrame([(1, "a", 3), (1, "a", 5)], "query_id int, chunk_id string, score int")
    assert [r.score for r in R.attach_scores(hits, scores).collect()] == [5]


def test_last_entry_replaces_the_application(spark):
    gold = spark.createDataFrame([("a", 1, "x", 0), ("a", 2, "y", 0), ("a", 1, "z", 1), ("b", 2, "w", 0)], GOLD)
    asked = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 2)], "k int, application_id string, question_id bigint")
    assert {r.k: r.gold for r in S.join_gold(asked, gold, ["k"]).collect()} == {1: "z", 2: None, 3: "w"}


def test_answers_without_vector_do_not_count(spark):
    rows = [(1, "a", 1, [1.0, 0.0]), (2, "a", 1, [0.0, 1.0]), (3, "a", 1, None), (4, "b", 1, None)]
    frame = spark.createDataFrame(rows, "k int, application_id string, question_id bigint, embedding array<double>")
    got = {r.k: round(r.consistency, 9) for r in S.consistency(frame, ["k"]).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 1.0, 4: 1.0}


def test_all_unicode_blanks_part_words(spark):
    blanks = "\u00a0 \u2003\u3000\u202f\u2028\x85\x1f\x0b\t"
    texts = [f"one{b}two three! Four{b}five six?" for b in blanks]
    got = S.readability(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    for r in got:
        assert (r.word_count, r.char_count, r.sentence_count) == (len(r.t.split()), len("".join(r.t.split())), 2) == (6, 24, 2)
    words = spark.createDataFrame([(t,) for t in texts], "t string").select(M.word_count(F.col("t")).alias("n")).collect()
    assert {r.n for r in words} == {6}


def test_readability_of_one_long_word(spark):
    texts = [("x" * 100_000,), ("-" * 100_000,), ("a b c. - - - d! e f g h?",)]
    got = S.readability(spark.createDataFrame(texts, "t string"), "t").collect()
    assert [(r.word_count, r.sentence_count) for r in got] == [(1, 1), (0, 1), (8, 2)]


def test_attach_outputs(spark):
    asked = spark.createDataFrame([(1, "q1"), (2, "q2")], "id int, question string")
    told = spark.createDataFrame([(1, "a1", 0.5)], "id int, answer string, seconds double")
    got = sorted(map(tuple, Q.attach_outputs(asked, told, ["id"]).collect()))
    assert got == [(1, "q1", "a1", 0.5), (2, "q2", None, None)]
    with pytest.raises(Exception, match="more than one output"):
        Q.attach_outputs(asked, told.union(told), ["id"]).collect()


def test_readability_tries_patterns_once_a_row(spark):
    texts = ["One two three. No! a - b -- c... d", " x　y\x1cz.?", "... ?! --", "", None, "é_1 ß² ٣ . . a b", "a -b- c d!e f g"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = S.readability(df, "t")
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    spoken = lambda t: [w for w in t.split() if re.search(r"\w", w)]
    for r in out.collect():
        if r.t is not None:
            long = sum(len(spoken(p)) >= 3 for p in re.split("[.!?]+", r.t))
            assert (r.word_count, r.char_count, r.sentence_count) == (len(spoken(r.t)), len("".join(r.t.split())), max(long, 1))
