"""Near copies and repeated passages against brute force."""

from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from docloom.llm import simhash, substring
from docloom.llm.graph import components
from docloom.llm.words import blank_words, letter_words


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = rng.integers(0, 60, (50, 2)).tolist() + [[i, i + 1] for i in range(100, 130)] + [[200, k] for k in range(201, 230)] + [[7, 7]]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x != r}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _fingerprint(text):
    words = blank_words(text)
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "A b C d", "x " * 5000, "É é É ü\x0b ÉÉ \u00a0 z"])
def test_fingerprint_of_one_text(text):
    got = simhash.fingerprint_of(blank_words(text)) & (2**64 - 1)
    assert got == _fingerprint(text)


def _classes(prints):
    """Brute force: smallest id reachable over links of 3 bits or fewer."""
    least = {f: min((d for d, g in prints if g == f and d is not None), default=None) for _, f in prints}
    root = {f: f for f in least}
    for _ in least:
        for a in least:
            for b in least:
                if (a ^ b).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    ids = {r: min((least[f] for f in least if root[f] == r and least[f] is not None), default=None) for r in root.values()}
    return {f: ids[root[f]] for f in least}


def test_simhash_links_everything_within_three_bits(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, 8, dtype=np.uint64)
    prints, doc = [], 0
    for c in centres.tolist() + [0, 2**64 - 1]:
        for bits in (0, 0, 1, 2, 3, 3, 4, 5):
            flip = rng.choice(64, bits, replace=False)
            prints.append((doc, c ^ sum(1 << int(b) for b in flip)))
            doc += 1
    signed = [(d, f - 2**64 if f >= 2**63 else f) for d, f in prints]
    frame = spark.createDataFrame(signed, "doc_id long, fp long").repartition(5)
    got = {r.fp % 2**64: r.component_id for r in simhash.component_ids(frame).collect()}
    assert got == _classes(prints)


def test_simhash_blocks_give_the_same_links(spark):
    rng = np.random.default_rng(6)
    base = int(rng.integers(0, 2**62))
    near = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 4)), replace=False)) for _ in range(300)})
    frame = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in near], "fp long")
    whole, cut = (components(simhash.links(frame, block=b)).count() for b in (10_000, 7))
    assert whole == cut
    edges = simhash.links(frame, block=10_000).count()
    assert edges < 33 * 2 * len(near)  # spanning forests, not pairs


def test_simhash_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (9, "q r s t u"), (None, "lonely words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(simhash.digest(docs).collect(), key=str)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (None, 4), (9, 9), (None, None)}
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16}
    clashing = docs.selectExpr("*", "1 AS fp", "2 AS group", "3 AS rank", "'x' AS near")
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == [(1, None), (4, "a b c d"), (9, "q r s t u")]
    assert kept.where("doc_id IS NULL").count() == 1
    assert simhash.digest(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def _words(rng, n, vocabulary=4000):
    return [f"w{x}" for x in rng.integers(0, vocabulary, n)]


def test_compact_windows_match_their_definition():
    rng = np.random.default_rng(1)
    for case in range(60):
        n = int(rng.integers(20, 250))
        h = rng.integers(0, 2**62, n).astype(np.uint64) & ~np.uint64(1023)
        if case % 3 == 0:  # ties
            h = rng.integers(0, 20, n).astype(np.uint64) << np.uint64(40)
        want = []
        for c in range(n):
            left = right = c
            while left and h[left - 1] > h[c]:
                left -= 1
            while right < n - 1 and h[right + 1] >= h[c]:
                right += 1
            if right - left + 1 >= substring._RUN:
                want.append((left, c, right))
        assert sorted(zip(*(x.tolist() for x in substring.compact_windows(h)))) == sorted(want)


def test_tokens_depend_on_five_words_only():
    a, none, empty, b, short = substring.tokens(["a b c d e f", None, "", "x, B c D e f!", "a b c d"])
    assert len(a) == 2 and len(b) == 2 and a[1] == b[1] and a[0] != b[0]
    assert len(none) == len(empty) == len(short) == 0


def test_repeated_passages(spark):
    rng = np.random.default_rng(3)
    passage, other = _words(rng, 60), _words(rng, 200)
    fresh = lambda n: _words(rng, n)
    edited = list(passage)
    edited[30] = "changed"
    rows = [(d, fresh(100)) for d in range(20, 40)]  # clean
    rows += [(d, fresh(80 + d) + passage + fresh(70)) for d in range(1, 9)]
    rows += [(10, fresh(90) + edited + fresh(15)), (11, other), (12, other), (13, other[:40] + fresh(100)), (14, passage[:45])]
    rows += [(15, fresh(40) + passage[:40] + fresh(5) + passage[:40])]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows] + [(50, None), (51, ""), (None, " ".join(other)), (12, " ".join(other))], "doc_id long, text string")
    got = {r.doc_id: r for r in substring.digest(docs.selectExpr("*", "1 AS start", "2 AS hash", "3 AS leader")).collect()}
    assert set(got) == {*range(1, 9), 10, 11, 12}
    assert {r.class_id for d, r in got.items() if d < 11} == {1} and got[11].class_id == got[12].class_id == 11
    texts = dict(rows)
    for d in range(1, 9):  # the passage and hardly more
        covered = {i for s in got[d].passages for i in range(s["start"], s["end"])}
        at = 80 + d
        assert set(range(at, at + 60)) <= covered and len(covered) <= 60 + 10
    assert got[11].n_repeated == 200 and got[11].n_links == 1
    assert substring.digest(docs.limit(0)).count() == 0
    assert len(texts) == len(rows)


def test_verbatim_passages_of_the_driver_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = {r.doc_id: letter_words(r.text) for r in docs.collect()}
    holders = defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - 49):
            holders[tuple(w[i : i + 50])].add(d)
    repeated = {d for ds in holders.values() if len(ds) > 1 for d in ds}
    got = {r.doc_id for r in substring.digest(docs).collect()}
    assert repeated and repeated <= got


def test_passages_are_found_behind_a_smaller_document_with_a_part(spark):
    rng = np.random.default_rng(8)
    line, rows = _words(rng, 20), []
    for i in range(20):
        passage = _words(rng, 50)
        part = passage[:30] if i % 2 else passage[10:40]
        rows += [(i, _words(rng, 60) + part + _words(rng, 60)), (100 + i, _words(rng, 70) + passage + _words(rng, 40)), (200 + i, passage + _words(rng, 30))]
    # a frequent line, which alone is no repeat, inside passages of two documents
    rows += [(300 + i, _words(rng, 40) + line + _words(rng, 40)) for i in range(200)]
    for i in range(10):
        passage = _words(rng, 15) + line + _words(rng, 15)
        rows += [(600 + i, passage + _words(rng, 30)), (700 + i, _words(rng, 20) + passage)]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in substring.digest(docs).collect()}
    assert got == {**{k + i: 100 + i for k in (100, 200) for i in range(20)}, **{k + i: 600 + i for k in (600, 700) for i in range(10)}}


@pytest.mark.parametrize("frequent", [False, True])
def test_every_passage_at_the_least_similarity_is_found(spark, frequent, monkeypatch):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(100):
        passage = _words(rng, 50)
        edited = list(passage)
        edited[5 + i % 40] = "changed"  # five of 46 tokens
        rows += [(i, _words(rng, 70) + passage + _words(rng, 60)), (100 + i, _words(rng, 30) + edited + _words(rng, 40))]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    if frequent:  # whatever tokens come last in the order
        tokens = np.concatenate(substring.tokens([" ".join(w) for _, w in rows[::3]]))
        monkeypatch.setattr(substring, "hot", lambda texts: np.unique(tokens))
    assert {r.doc_id: r.class_id for r in substring.digest(docs).collect()} == {k + i: i for k in (0, 100) for i in range(100)}


def test_documents_that_share_a_line_alone_are_not_verified(spark, monkeypatch):
    rng = np.random.default_rng(12)
    line, passage = _words(rng, 20), _words(rng, 60)
    rows = [(i, _words(rng, 40) + line + _words(rng, 40)) for i in range(30)]
    rows += [(100 + i, line + passage + _words(rng, 20)) for i in range(3)]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    checked, met = substring._checked, []

    def counted(texts, pairs):
        met.append(pairs.select("doc_id", "leader").distinct().count())
        return checked(texts, pairs)

    monkeypatch.setattr(substring, "_checked", counted)
    got = {r.doc_id: (r.class_id, r.n_links) for r in substring.digest(docs).collect()}
    assert got == {100 + i: (100, 2) for i in range(3)}
    assert met[0] == 34 and met[1] <= 3  # with the smallest document; then every two others before


def test_tables_that_are_used_up_are_deleted(spark):
    rng = np.random.default_rng(13)
    passage = _words(rng, 60)
    docs = spark.createDataFrame([(i, " ".join(_words(rng, 30) + passage)) for i in range(3)], "doc_id long, text string")
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {p.name for p in root.glob("*/*")}
    assert substring.digest(docs).count() == 3
    left = {p.name.partition("-")[0] for p in root.glob("*/*") if p.name not in before}
    assert "links" in left and not left & {"keys", "check", "open", "windows", "cut", "runs"}


def test_runs_are_compared_once_and_texts_are_not_sorted(spark, monkeypatch):
    rng = np.random.default_rng(14)
    passage = _words(rng, 60)
    docs = spark.createDataFrame([(i, " ".join(_words(rng, 30) + passage)) for i in range(3)], "doc_id long, text string")
    plans, stored = defaultdict(list), substring.stored

    def noted(df, label, *path):
        plans[label].append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, label, *path)

    monkeypatch.setattr(substring, "stored", noted)
    assert substring.digest(docs).count() == 3
    assert len(plans["held"]) == 2
    for plan in plans["held"]:  # not once to choose the pairs and again for their passages
        assert plan.count("MapInArrow") + plan.count("ArrowEvalPython") == 1
    for label in ("shared", "cut", "near"):  # the large side streams past the small one
        assert plans[label] and all("strategy=shuffle_hash" in plan for plan in plans[label])
    for plan in plans["cut"]:  # no shuffle of tokens for the rows of an id
        assert plan.split("MapInArrow")[0].count("Aggregate") == 0 and "Generate" not in plan.split("MapInArrow")[0]


def test_keys_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(15)
    texts = [None, "", "a b c", " ".join(_words(rng, 49)), "x y z w v " * 60, " ".join(_words(rng, 90) * 3)]
    texts += [" ".join(_words(rng, int(rng.integers(40, 400)), 60 if i % 2 else 4000)) for i in range(20)]
    hashes = substring.tokens(texts)
    frequent = np.unique(hashes[5][::7])
    got = [tuple(x) for part in substring._keys_of(hashes, frequent) for x in zip(*(c.tolist() for c in part))]
    want = []
    for i, h in enumerate(hashes):
        order = (substring._mixed(h * substring._ODD[2]) >> np.uint64(1)) | (np.isin(h, frequent).astype(np.uint64) << np.uint64(63))
        least = [sorted(order[k : k + substring._RUN].tolist())[substring.KEYS - 1] for k in range(len(h) - substring._RUN + 1)]
        places = [p for p in range(len(h)) if any(order[p] <= least[k] for k in range(max(0, p - substring._RUN + 1), min(len(least), p + 1)))]
        seen = set()
        for p in substring._thinned(h, np.array(places, np.int64)).tolist():
            around = tuple(h[p + k] if 0 <= p + k < len(h) else 0 for k in range(1 - substring._RUN, substring._RUN))
            want.append((int(h[p]), i, p, around not in seen))
            seen.add(around)
    assert got == want and any(not first for *_, first in got)
    assert sum(len(p[0]) for p in substring._keys_of([], frequent)) == 0


def test_equal_surroundings_are_compared_once(spark):
    rng = np.random.default_rng(15)
    width = 2 * substring._NEAR + 1
    base = rng.integers(1, 256, width, dtype=np.uint8)
    close = base.copy()
    close[:3] = 0  # out of reach of the key
    sides = [base.tobytes(), close.tobytes(), rng.integers(1, 256, width, dtype=np.uint8).tobytes()]
    # many keys of one hash in three kinds of surroundings; under the second hash none is open with another
    rows = [(1, i, i % 3, i % 9 != 2) for i in range(90)] + [(2, 200, 0, True), (2, 201, 2, False)]
    near = spark.createDataFrame([(h, d, k, o, bytearray(sides[k])) for h, d, k, o in rows], "hash long, doc_id long, kind long, open boolean, near binary")
    got = [tuple(r) for r in substring.alike_kinds(near).collect()]
    assert sorted(got) == sorted([*((1, a, b) for a in (0, 1) for b in (0, 1)), (1, 2, 2), (2, 0, 0)])
    met = substring.alike_kinds(near.where("hash = 1"))
    assert met.count() == 5  # 90 keys would meet in thousands of pairs


def test_surroundings_and_runs_are_compared_by_their_definitions():
    rng = np.random.default_rng(16)
    width, reach = 2 * substring._NEAR + 1, range(substring._NEAR - substring._REACH, substring._NEAR + substring._REACH + 1)
    near = rng.integers(1, 256, (600, width)).astype(np.uint8)
    theirs = rng.integers(1, 256, (600, width)).astype(np.uint8)
    for i in range(600):  # from nothing in common to more than enough, side by side or moved by eight
        n, by = int(rng.integers(30, 60)), i % 2 * 8
        theirs[i, 70 + by : 70 + by + n] = near[i, 70 : 70 + n]
    near[::5, :90], theirs[::7, 150:] = 0, 0
    want = []
    for a, b in zip(near.tolist(), theirs.tolist()):
        common = [a[k] in set(b) - {0} for k in reach]
        want.append(any(sum(common[k : k + substring._RUN]) >= substring._SHARED for k in range(len(common) - substring._RUN + 1)))
    sides = [pa.array([x.tobytes() for x in side], pa.binary()) for side in (near, theirs)]
    assert substring._alike(*sides).tolist() == want and 50 < sum(want) < 550
    assert substring._alike(*(s.slice(7, 300) for s in sides)).tolist() == want[7:307]
    assert substring._alike(*(s.slice(0, 0) for s in sides)).tolist() == []

    mine = [rng.integers(0, 400, int(rng.integers(0, 150))).astype(np.uint32) for _ in range(200)]
    other = [np.concatenate([m[3:], rng.integers(0, 400, 20).astype(np.uint32)]) if i % 2 else rng.integers(0, 400, 90).astype(np.uint32) for i, m in enumerate(mine)]

    def spans(own, there):
        good = [k for k in range(len(own) - substring._RUN + 1) if sum(x in there for x in own[k : k + substring._RUN]) >= substring._SHARED]
        out = []
        for k in good:
            if out and k <= out[-1][1]:
                out[-1][1] = k + substring.PASSAGE_WORDS
            else:
                out.append([k, k + substring.PASSAGE_WORDS])
        return out

    both = {i: (spans(m.tolist(), set(o.tolist())), spans(o.tolist(), set(m.tolist()))) for i, (m, o) in enumerate(zip(mine, other))}
    columns = [pa.array(range(200)), pa.array(range(200)), pa.array([0] * 200, pa.int32()), pa.array([0] * 200, pa.int32())]
    columns += [pa.array([x.tobytes() for x in side], pa.binary()) for side in (mine, other)]
    batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "leader", "at", "from_", "mine", "theirs"])
    got = [r for out in substring._verified(iter([batch.slice(0, 90), batch.slice(90), batch.slice(0, 0)])) for r in out.to_pylist()]
    got = {r["doc_id"]: tuple([[s["start"], s["end"]] for s in r[side]] for side in ("mine", "theirs")) for r in got}
    assert got == {i: x for i, x in both.items() if x[0] and x[1]} and len(got) > 30


def test_rows_of_one_id_are_cut_once(spark):
    rng = np.random.default_rng(17)
    texts = [" ".join(_words(rng, n)) for n in (80, 60)]
    docs = spark.createDataFrame([(1, texts[0])] * 3 + [(2, texts[1])], "doc_id long, text string")
    need = spark.createDataFrame([(1, [(0, 50), (70, 90), (500, 600)]), (2, [(10, 1000)])], "doc_id long, runs array<struct<start: int, end: int>>")
    half = [(h >> np.uint64(32)).astype(np.uint32) for h in substring.tokens(texts)]
    rows = substring._cut_out(docs, need).collect()
    got = {(r.doc_id, r.start, r.end, bytes(r.hashes)) for r in rows}
    assert got == {(1, 0, 50, half[0][:50].tobytes()), (1, 70, 90, half[0][70:].tobytes()), (1, 500, 600, b""), (2, 10, 1000, half[1][10:].tobytes())}
    assert len(rows) == 4
