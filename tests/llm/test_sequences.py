"""Token pieces, ranked search and periodic runs against the library, brute force and edge cases."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from docloom.llm import pieces, queries, ranking, runs
from docloom.llm.words import letter_words

DATA = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, " \n"), (4, "x" * 30_000), (5, "word " * 20_000), (6, "İK ſ É \U0001f600 a▁ "), (6, "İK ſ É \U0001f600 a▁ "),
    (None, "some text"), (7, " " * 100_000 + "\n" * 1_000),
]


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "'x' AS found", "2 AS score", "3 AS rank")


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# pieces

LIBRARY = SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
CODEC = pieces.Pieces()
SOME = st.one_of(st.sampled_from(["  ", "▁", "\n", "\r\n", "é", "é", "①", "\x00", "日本", "5", ".", "²."]), st.sampled_from(sorted(CODEC.ids)), st.text(max_size=4))


@settings(max_examples=400, deadline=None)
@given(st.lists(SOME, max_size=20).map("".join))
def test_ids_are_the_librarys(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode(text)
    assert CODEC.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 262), st.integers(0, len(CODEC.names) - 1)), max_size=12))
def test_any_ids_decode_like_the_librarys(ids):
    assert CODEC.decode(ids) == LIBRARY.decode(ids)


def test_forgotten_parts_change_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_PARTS", 8)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 8)
    codec, text = pieces.Pieces(), "the words and the wordless, unreachable reaching " * 5
    assert codec.encode(text) == LIBRARY.encode(text)
    assert len(codec.parts) <= 8 and sum(map(len, codec.pairs)) <= 8


def test_pieces_of_documents(spark):
    rows = ODD + [(d, t) for d, t in duckdb.sql(f"SELECT doc_id + 100, text FROM '{DATA}/documents.parquet'").fetchall()]
    got = pieces.digest(_docs(spark, rows)).collect()
    expected = []
    for d, text in rows:
        ids = LIBRARY.encode(text or "")
        expected.append((d, len(ids), _sha(",".join(map(str, ids))), _sha(LIBRARY.decode(ids))))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert pieces.digest(_docs(spark, [])).count() == 0
    both = pieces.decode(pieces.encode(_docs(spark, ODD))).collect()
    assert [r.decoded for r in both] == [LIBRARY.decode(LIBRARY.encode(t or "")) for _, t in ODD]
    assert pieces.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>")).collect()[0].decoded == ""


# ranked search


def _ranked(docs, items, k=10):
    texts: dict = {}
    for i, t in dict.fromkeys(items):
        if i is not None and t is not None:
            texts.setdefault(i, []).extend(letter_words(t))
    words = [(d, Counter(letter_words(t))) for d, t in docs]
    words = [(d, c) for d, c in words if c]
    n_docs, length = len(words), sum(c.total() for _, c in words)
    df = Counter(t for _, c in words for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for i, terms in texts.items():
        scored = []
        for d, c in words:
            m = 25 + 75 * c.total() * n_docs // length
            s = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0 and d is not None:
                scored.append((-s, d))
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_terms, numbers", [(ranking.BLOCK_TERMS, ranking.NUMBERS), (40, 500)])
def test_ranked_search(spark, monkeypatch, block_terms, numbers):
    monkeypatch.setattr(ranking, "NUMBERS", numbers)
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(f"W{int(x)}" for x in rng.zipf(1.4, n) if x < 90)
    docs = ODD + [(d, word(int(rng.integers(1, 200)))) for d in range(10, 120)]
    docs += [(d, docs[20][1]) for d in range(200, 230)]  # equal scores
    items = [(i, word(int(rng.integers(1, 40)))) for i in range(15)]
    items += [items[3], (4, "w1 w2 w2"), (None, "w1"), (20, None), (21, "!?"), (22, "no such"), (23, "word " * 1000), (24, items[3][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS term", "2 AS n")
    got = ranking.rank(_docs(spark, docs), benchmark, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == _ranked(docs, items)


def test_ranked_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranking.rank(_docs(spark, []), items).count() == 0
    assert ranking.rank(_docs(spark, [(1, "b")]), items.where("item_id = 2")).count() == 0
    named = ranking.rank(_docs(spark, [(1, "b"), (2, "c")]), items.selectExpr("'q' AS item_id", "text"))
    assert [tuple(r)[:3] for r in named.collect()] == [("q", 1, 1)]


def test_graph_shares_and_sums():
    common = {b"a": 1, b"b": 3, b"c": 2}
    items = [{**common, b"x": 1}, {**common, b"y": 2}, common, {b"a": 1, b"z": 1}, {b"b": 7}]
    graph = ranking.Graph(items)
    parts = np.arange(3 * len(graph.terms)).reshape(-1, 3) ** 2
    expected = [sum(n * parts[graph.terms[t]] for t, n in item.items()) for item in items]
    assert (graph.scores(parts) == np.array(expected)).all()
    assert len(graph.left[2]) == 1  # one accumulator for the whole shared set
    assert sum(map(len, graph.left)) + len(graph.sums) < sum(bin(n).count("1") for item in items for n in item.values())


# periodic runs


def _runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


PART = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=30), st.integers(1, 9))
TEXT = st.lists(PART, max_size=8).map(lambda ps: [w for p, n in ps for w in p * n])


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_runs_are_all_runs(texts):
    assert runs.find_runs([np.array(t, np.int64) for t in texts]) == [_runs(t) for t in texts]


def test_runs_of_long_texts():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    rng = np.random.default_rng(5)
    texts = [[0] * 3000, [0, 1, 2] * 1000, ([0] * 99 + [1]) * 30, b, rng.integers(0, 2, 3000).tolist(), list(range(700)) * 4, [*range(700)] * 4 + [0]]
    assert runs.find_runs([np.array(t, np.int64) for t in texts]) == [_runs(t) for t in texts]


def test_sums_beyond_one_prime():
    words = np.concatenate([np.arange(60_000), np.tile(np.arange(60_000, 61_000), 5), np.arange(60_000)])
    assert runs.find_runs([words]) == [[(60_000, 5_000, 1_000)]]
    # a sum of squares that is the first prime itself is a zero modulo it, but no match
    line = np.array([0, 0, 0, 0, *_squares(runs.PRIMES[0][0]), *[0] * 16], np.uint64)
    _, distances = next(runs.Matcher().zeros(line, np.array([0]), 4, int(line.max())))
    assert 4 not in distances


def _squares(n):
    """Four numbers whose squares sum to ``n``."""
    root = math.isqrt(n)
    for a in range(root, root - 50, -1):
        for b in range(math.isqrt(n - a * a) + 1):
            rest = n - a * a - b * b
            for c in range(math.isqrt(rest) + 1):
                d = math.isqrt(rest - c * c)
                if d * d == rest - c * c:
                    return a, b, c, d
    return None


def test_runs_of_documents(spark):
    rows = ODD + [(d, " ".join(f"w{i}" for i in range(d))) for d in range(20, 120)]
    got = {(r.doc_id, r.collapsed_sha256): r for r in runs.digest(_docs(spark, rows)).collect()}
    for d, text in rows:
        words = (text or "").split() if d != 6 else text.split(" ")[:-1]
        h = zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(len(words))]
        found = [(0, 20_000, 1)] if d == 5 else _runs(words)
        dropped = {i for a, n, q in found for i in range(a + q, a + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        r = got[d, _sha(" ".join(w for i, w in enumerate(words) if i not in dropped))]
        assert r.n_runs == len(found) and r.runs_sha256 == _sha("".join(f"{a},{n},{q}\n" for a, n, q in found))
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert sum(r.n_runs > 0 for r in got.values()) > 5
    assert runs.digest(_docs(spark, [])).count() == 0
    kept = runs.collapse(_docs(spark, [(1, "a b a b a b a b c"), (2, None), (3, "")])).collect()
    assert [r.text for r in kept] == ["a b c", None, ""]
    assert [[tuple(x) for x in r.runs] for r in runs.runs(_docs(spark, [(1, "c a b a b a b a b c"), (2, None)])).collect()] == [[(1, 8, 2)], []]


# SQL twins


@pytest.mark.parametrize("name", ["op12_shared_ranking", "op13_block_convolution"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    relation = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(relation.columns)
    rows = sorted(tuple(r[c] for c in relation.columns) for r in got.collect())
    assert rows == sorted(relation.fetchall(), key=lambda r: tuple(r)) and rows
