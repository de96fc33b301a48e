"""Nearest neighbours against brute force, and the pipeline against its parts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from docloom.llm import ann, pii, toxicity
from docloom.llm.words import letter_words

DATA = "/root/testdata/sf0.001"


def _brute(rows, query, k=5):
    rows = [(i, np.asarray(v, float)) for i, v in rows]
    own = next(v for i, v in rows if i == query)
    found = {}
    for i, v in rows:
        if i != query:
            s = float(np.dot(v, own) / np.linalg.norm(v) / np.linalg.norm(own))
            found[i] = max(s, found.get(i, -2))
    return sorted(found.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]


def _frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in rows], "vec_id long, embedding array<float>")


def test_everything_opened_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype("f4")) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(20)]  # equal vectors
    bad = [(900, None), (950, [0.0] * 8), (901, [float("nan")] + [1.0] * 7), (902, [float("inf")] + [1.0] * 7), (903, [1.0] * 3), (None, [1.0] * 8)]
    frame = _frame(spark, rows + bad).selectExpr("*", "1 AS leaf", "2 AS entry")
    got = ann.nearest(frame, frame.where("vec_id % 50 = 0"), 5, leaf_rows=16, cell=10).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert set(by) == set(range(0, 320, 50))
    for q, found in by.items():
        assert found == [(i, round(s, 9)) for i, s in _brute(rows, q)]


def test_few_and_no_candidates(spark):
    two = _frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])])
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.digest(two).collect()] == [(0, 1, 1)]
    assert ann.digest(two.limit(0)).count() == 0
    assert ann.digest(_frame(spark, [(0, [1.0, 0.0])])).count() == 0


@pytest.mark.parametrize("sample", [ann.SAMPLE, 64])
def test_recall_on_clustered_vectors(spark, sample):
    """Also with levels below the sample's depth."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.3 * rng.normal(size=16)).astype("f4")) for i in range(4000)]
    frame = _frame(spark, rows)
    got = {}
    for r in ann.nearest(frame, frame.where("vec_id % 200 = 0"), 5, leaf_rows=32, search=1500, sample=sample).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[q] & {i for i, _ in _brute(rows, q)}) for q in range(0, 4000, 200)]
    assert np.mean(hits) / 5 >= 0.9


@pytest.mark.parametrize("n", [10_000, 240_000])
def test_recall_without_structure_at_the_default_search(spark, n):
    import pyarrow as pa

    x = np.random.default_rng(2).normal(size=(n, 48)).astype("f4")
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float32()))})).repartition(8)
    got = {}
    for r in ann.nearest(frame, frame.where(f"vec_id % {n // 100} = 0"), 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.arange(0, n, n // 100)
    hits = [len(got[q] & set(np.argsort(-s)[1:6].tolist())) for q, s in zip(asked.tolist(), unit[asked] @ unit.T)]
    assert np.mean(hits) / 5 >= 0.9


def test_pipeline_stages_and_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    clashing = docs.selectExpr("*", "1 AS found", "2 AS row", "3 AS fp", "4 AS length")
    odd = spark.createDataFrame([(None, None, None, None, None, 1, 2, 3, 4), (7, "", "en", "s", 0, 1, 2, 3, 4), (7, "", "en", "s", 0, 1, 2, 3, 4)], clashing.schema)
    rows = clashing.union(odd)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, DATA)
        if name != "packing":
            assert out.columns == rows.columns and out.count() <= rows.count()
            assert stage(spark, rows.limit(0), DATA).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "personal_data", "packing"]
    packed = corpus_pipeline.run(spark, DATA).collect()
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():  # gapless from 0
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert {r.doc_id for r in packed} <= {r.doc_id for r in docs.collect()}


def _toxic(model, text):
    words = set(letter_words(text))
    score = sum(model.weights.get((w, 0), 0.0) for w in words)
    beginnings = Counter(w[:k] for w in words for k in toxicity.BEGINNINGS if len(w) > k)
    score += sum(model.weights.get((b, level), 0.0) for b, n in beginnings.items() for level in toxicity.LEVELS if n >= level)
    return 1 / (1 + math.exp(model.thresholds[-1] - score)) >= 0.5


def _print(text):
    words = [w.encode() for w in re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split(" ") for w in re.split("[\t-\r]", w) if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def _smallest_of_groups(docs):
    prints, root = {d: _print(t) for d, t in docs.items()}, {d: d for d in docs}
    moved = True
    while moved:
        moved = False
        for a in docs:
            for b in docs:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    moved = True
    return {d: t for d, t in docs.items() if root[d] == d}


def _contaminated(text, windows):
    words, hit = letter_words(text), set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(words)


def _redacted(text):
    digits = lambda s: "".join(re.findall("[0-9]", s))
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    spans = sorted((m.start(), -m.end(), k) for k, (pattern, right) in enumerate(kinds) for m in re.finditer(pattern, text) if right(m[0]))
    out, at = "", 0
    for start, end, k in spans:
        if -end > at:
            out += text[at : max(at, start)] + (f"<{pii.KINDS[k].upper()}>" if start >= at else "")
            at = -end
    return out + text[at:]


def test_pipeline_equals_plain_python(spark):
    frame, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    docs = {r.doc_id: r.text for r in frame.collect()}
    assert len(docs) == frame.count()
    model = toxicity.fit(frame, toxicity.graded(labels))
    kept = {d: t for d, t in docs.items() if not _toxic(model, t)}
    assert len(kept) < len(docs)
    single = _smallest_of_groups(kept)
    assert len(single) < len(kept)
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        words = letter_words(r.text)
        windows |= {tuple(words[i : i + 13]) for i in range(max(1, len(words) - 12)) if words}
    clean = {d: t for d, t in single.items() if not _contaminated(t, windows)}
    assert len(clean) < len(single)
    texts = {d: _redacted(t or "") for d, t in clean.items()}
    assert sum(texts[d] != (clean[d] or "") for d in texts) > 3
    exact, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), set()
    exact.encode_special_tokens = False
    for d, t in texts.items():
        ids = [*exact.encode(t, add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.add((d, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = corpus_pipeline.run(spark, DATA).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
