"""Per-text operators against brute force and edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docloom.llm import brown, decontaminate, licenses, packing, pii, toxicity, urlfilter
from docloom.llm.words import blank_words, letter_words

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "x" * 30_000), (5, "word " * 20_000), (6, "İK ſ É \U0001f600 a"), (6, "İK ſ É \U0001f600 a"), (None, "some text")]


def _docs(spark, rows, extra=""):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.selectExpr("*", *extra.split(",")) if extra else frame


# decontamination


def _contamination(text, items, n=13):
    words, hit, found = letter_words(text), set(), set()
    for item, item_text in items:
        own = letter_words(item_text)
        for i in range(max(1, len(own) - n + 1) if own and item is not None else 0):
            window = own[i : i + n]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(str(item))
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("chars", [decontaminate.AUTOMATON_CHARS, 300])
def test_decontamination(spark, chars):
    rng = np.random.default_rng(2)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 30, n)]
    items = [(i, " ".join(word(int(n)))) for i, n in enumerate([3, 13, 14, 30, 50, 2, 20])]
    items += [(7, items[1][1]), (1, items[1][1]), (None, "w1"), (8, None), (9, "!?"), (10, "w5")]
    rows = list(ODD)
    for d in range(20, 60):
        part = letter_words(items[d % 7][1])
        rows.append((d, " ".join([*word(40), *(w.decode().upper() for w in part[d % 3 :]), *word(int(rng.integers(0, 300)))]).replace(" ", ", ", 7)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = _docs(spark, rows, "1 AS found,2 AS items")
    found = decontaminate.contamination(docs.select("doc_id", "text"), benchmark, "found", automaton_chars=chars)
    got = found.select(
        "doc_id", "text", "found.n_words", decontaminate.n_hit("found").alias("n_hit"), "found.chars", "found.items", decontaminate.contaminated("found").alias("c")
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        sha = hashlib.sha256(",".join(r["items"]).encode()).hexdigest()
        assert (r.n_words, r.n_hit, len(r["items"]), sha, r.c) == _contamination(r.text, items)
        assert sum(len(letter_words(r.text[s.start : s.end])) for s in r.chars) == r.n_hit
    clean = decontaminate.clean(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(not r.c for r in got)
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == len(rows)
    assert decontaminate.digest(docs.limit(0), benchmark).count() == 0


# packing


def test_best_fit_plan_places_everything_once():
    rng = np.random.default_rng(0)
    for case in range(30):
        capacity = int(rng.integers(5, 200))
        counts = {int(k): int(rng.integers(1, 50)) for k in rng.integers(1, capacity + 1, 20)}
        used = Counter()
        for length in counts:
            ranks = []
            for of, first, last, each, sequence, offset in packing.best_fit(counts, capacity):
                if of == length:
                    ranks += range(first, last)
                    for r in range(last - first):
                        assert offset + (r % each + 1) * length <= capacity
                        used[sequence + r // each] += length
            assert sorted(ranks) == list(range(counts[length]))
        total = sum(k * n for k, n in counts.items())
        assert max(used.values()) <= capacity and len(used) >= -(-total // capacity)
        # no two sequences could have been one, as best fit guarantees
        rest = sorted(used.values())
        assert len(rest) < 2 or rest[0] + rest[1] > capacity or rest[1] > capacity / 2


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    rows = [*ODD, (7, "a <|endoftext|> b <|x|>"), *[(100 + i, "same length text") for i in range(50)], (8, "one two three " * 900)]
    docs = _docs(spark, rows, "1 AS piece,2 AS length,3 AS rank")
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in rows:
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024)]
        for k, a in enumerate(cuts):
            part = ids[a : cuts[k + 1] if k + 1 < len(cuts) else len(ids)]
            want[(d, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    packed = packing.pack(docs)
    got = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    lines = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert sum(map(len, lines.values())) == sum(r.length for r in got) and max(map(len, lines.values())) <= 1024
    for r in got:
        assert lines[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert packing.digest(docs.limit(0)).count() == 0


# personal data

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def _spans(text):
    out = []
    for k, (_, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if k == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if k == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(4)
    parts = ["a@b.c", "@", "a@b", "x.y+z@q-r.s.t", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 567-8901", "+12", " ", ".", "_", "é", "-", "7", "+", "a", "x@y.z@w.v"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, int(rng.integers(1, 9))))
        assert pii.base_spans(text) == _spans(text), text
    assert pii.base_spans(None) == [] and len(pii.base_spans("a" * 200_000 + "@" * 1000 + "1" * 5000)) == 0


def test_contexts_find_unseen_identifiers(spark):
    seeds = [(200 + i, f"please phone office +1 (202) 555-{1000 + i} today or later {i}") for i in range(30)]
    rows = [*seeds, (100, "please phone office 0203-7744-91 today"), (101, "order number 0203774491 shipped"), (102, "nothing"), *ODD]
    docs = _docs(spark, rows, "1 AS found,2 AS row,3 AS value,20 AS n_chars")
    got = {r.doc_id: r for r in pii.digest(docs).collect()}
    assert got[100].n_phone == 0 and got[100].spans == "phone:20:32" and got[101].spans == "" and got[3].spans == ""
    redacted = pii.redact(docs)
    assert redacted.columns == docs.columns and redacted.count() == len(rows)
    by_id = {r.doc_id: r for r in redacted.collect()}
    assert by_id[100].text == "please phone office <PHONE> today" and by_id[100].n_chars == len(by_id[100].text)
    assert by_id[1].text is None and by_id[5].text == ODD[4][1] and "<PHONE>" in by_id[207].text
    assert pii.digest(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0


def test_accepted_identifiers_teach_new_contexts(spark):
    numbers = [f"0{i}3 7744 {91 + i}" for i in range(8)]
    rows = [(200 + i, f"please phone office +1 (202) 555-{1000 + i} today or later") for i in range(30)]
    rows += [(300 + i, f"please phone office {n} today") for i, n in enumerate(numbers)]
    rows += [(400 + i, f"then dial desk {n} now") for i, n in enumerate(numbers)]  # a context no seed stands in
    rows += [(500, "then dial desk (0207) 99-18 now"), (501, "then order item (0207) 99-18 now"), (502, "then order item 55512 now")]
    got = {r.doc_id: r.spans for r in pii.digest(_docs(spark, rows)).collect()}
    assert got[300] == "phone:20:31" and got[400] == "phone:15:26"
    assert got[500] == "phone:15:27" and got[501] == "phone:16:28" and got[502] == ""


@pytest.mark.parametrize("seed", range(3))
def test_bootstrapping_equals_plain_python(spark, seed):
    rng = np.random.default_rng(seed)
    seen = [(None if v > 12 else int(v % 2), f"v{v}", [f"p{p}" for p in sorted({int(x) for x in rng.integers(0, 9, 3)} | {v % 9})]) for v in range(40) for _ in range(2)]
    edges: dict = {}
    for kind, value, patterns in seen:
        for p in patterns:
            edges[p, value] = kind
    accepted: dict = {}
    while True:
        sure = Counter((p, k if k is not None else accepted[v]) for (p, v), k in edges.items() if k is not None or v in accepted)
        n = Counter(p for p, _ in edges)
        admitted = {pk: c for pk, c in sure.items() if c >= 3 and n[pk[0]] >= 3}
        open_ = [(v, p, k) for (p, v), kind in edges.items() if kind is None and v not in accepted for q, k in admitted if q == p]
        scores = {(v, k): 0.0 for v, _, k in open_}
        for _ in range(pii.ROUNDS):
            trust = {(p, k): (c + sum(scores[v, k] for v, q, l in open_ if (q, l) == (p, k))) / (n[p] + pii.DOUBT) for (p, k), c in admitted.items()}
            scores = {(v, k): 1 - math.prod(1 - min(trust[q, l], 0.999) for w, q, l in open_ if (w, l) == (v, k)) for v, k in scores}
        new = {v: max((k for w, k in scores if w == v), key=lambda k: (scores[v, k], -k)) for v, _ in scores if max(scores[v, k] for w, k in scores if w == v) >= 0.7}
        if not new:
            break
        accepted |= new
    frame = spark.createDataFrame(seen, "kind int, value string, patterns array<string>")
    got = {r.value: r.kind for r in pii.bootstrap(frame, support=3, accept=0.7).collect()}
    assert got == accepted and accepted


@pytest.mark.parametrize("text, found", [
    ("call 555 123 4567 now", ["555 123 4567"]), ("(0207) 99-18.", ["(0207) 99-18"]), ("id AB-1234-77, 12 34", ["AB-1234-77", "12 34"]), ("x@y 1 2 3 4 5", ["1 2 3 4 5"]),
    ("1" * 500, ["1" * 500]), ("4 55 x", []), ("a@bcd e", ["a@bcd"]), ("12a 3456", []), ("99991234x", ["99991234x"]),
])
def test_candidates(text, found):
    assert [text[a:b] for a, b in pii._candidates(text, [])] == found


# toxicity


def test_ordinal_model_on_held_out_texts(spark):
    rng = np.random.default_rng(7)
    text = lambda kind, n: " ".join([*(f"n{x}" for x in rng.integers(0, 300, n)), *{0: [], 1: ["junk", "spam"], 2: [str(rng.choice(["vile", "awful", "gruesomely", "gruesomest"]))]}[kind]])
    kinds = rng.choice(3, 1200, p=[0.7, 0.15, 0.15]).tolist()
    docs = _docs(spark, [(i, text(k, int(rng.integers(5, 80)))) for i, k in enumerate(kinds)])
    labels = spark.createDataFrame([(i, int(k != 1), int(k == 2)) for i, k in enumerate(kinds) if i % 3] + [(None, 1, 1), (3, None, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.digest(docs, labels).collect()}
    unseen = [i for i in got if i % 3 == 0]
    right = np.mean([got[i].toxic == (kinds[i] == 2) for i in unseen])
    assert right > 0.95 and all(0 <= got[i].severity <= 2 for i in got)
    means = [np.mean([got[i].severity for i in unseen if kinds[i] == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    odd = _docs(spark, ODD, "1 AS judged,2 AS words,3 AS grade")
    kept = toxicity.keep_clean(odd.union(docs.selectExpr("*", "1", "2", "3")), labels)
    assert kept.columns == odd.columns and kept.where("text IS NULL OR text = ''").count() == 2
    assert kept.where("doc_id = 6 AND text = '" + ODD[5][1] + "'").count() == 2
    assert toxicity.digest(odd, labels.limit(0)).where("toxic").count() == 0
    assert toxicity.digest(docs.limit(0), labels).count() == 0


# language model


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(0)
    bigrams, n = np.zeros((13, 13)), 12
    at = 0
    for _ in range(20_000):  # even words follow odd ones and the other way round
        to = int(rng.integers(0, 6)) * 2 + (1 - at % 2)
        bigrams[at, to] += 1
        at = to
    classes = brown.exchange(bigrams, n, classes=2)
    assert len(set(classes[0:12:2])) == len(set(classes[1:12:2])) == 1 and classes[0] != classes[1] and classes[12] == 2


@pytest.mark.parametrize("head", [brown.HEAD, 20])
def test_language_model(spark, head, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", head)
    monkeypatch.setattr(brown, "CLUSTERED", 15)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(_docs(spark, ODD))
    rows = docs.collect()
    tokens = [[*blank_words(r.text), b""] for r in rows]
    out = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows]
    c = Counter(t for ts, o in zip(tokens, out) if not o for t in ts)
    n, v = sum(c.values()), len(c)
    want = Counter((r.doc_id, o, len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 6)) for r, o, ts in zip(rows, out, tokens))
    got = brown.digest(docs.selectExpr("*", "1 AS word", "2 AS row", "3 AS n")).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    if head > 20:
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)


@pytest.mark.parametrize("head", [brown.HEAD, 6])  # 6: all odd words are outside the dictionary
@pytest.mark.parametrize("rows", [2, 2000])
def test_words_outside_the_exchange_are_placed_by_their_neighbours(spark, head, rows, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", head)
    monkeypatch.setattr(brown, "CLUSTERED", 4)
    # words of one ending follow "left", those of the other one "right"; the odd ones have the wrong ending
    kinds = {f"{k}{e}": side for k in range(8) for e, side in (("aa", "left"), ("bb", "right"))}
    odd = {"odd1aa": "right", "odd2aa": "right", "odd3bb": "left", "odd4bb": "left"}
    train = [f"{side} {w} stop end" for w, side in [*kinds.items(), *kinds.items(), *odd.items()] for _ in range(10)]
    texts = [*train, *(f"{side} {w} stop end" for w in odd for side in ("left", "right")), None, "left new1aa stop end"]
    docs = _docs(spark, list(enumerate(texts)))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        got = {r.doc_id: r.score for r in brown.score(docs, docs.doc_id < len(train)).collect()}
    finally:
        spark.conf.set(key, before)
    for i, side in enumerate(odd.values()):
        left, right = (got[len(train) + 2 * i + k] for k in (0, 1))
        assert left > right + 0.1 if side == "left" else right > left + 0.1
    assert len(got) == len(texts) and all(x < 0 for x in got.values())


def test_best_class_is_the_most_probable_one():
    rng = np.random.default_rng(1)
    total = 7
    pairs = rng.integers(50, 500, (total, total)).astype(float)
    tokens, types = pairs.sum(axis=0), rng.integers(1, 50, total).astype(float)
    seen = rng.integers(0, 4, (40, 2 * total)).astype(float)
    seen[:, 0] += np.maximum(0, seen[:, total:].sum(axis=1) - seen[:, :total].sum(axis=1))
    seen[:, total] += seen[:, :total].sum(axis=1) - seen[:, total:].sum(axis=1)  # as many before as after
    own = rng.integers(0, total - 1, 40)
    want = []
    for w, home in zip(seen, own):
        before, after, n = w[:total], w[total:], w[:total].sum()
        value = []
        for k in range(total - 1):
            less = n if k == home else 0
            x = -n * math.log10(tokens[k] - less + 0.5 * (types[k] + 1 - (k == home)))
            for c in range(total):
                into, out = pairs[c, k] - before[c] * (k == home), pairs[k, c] - after[c] * (k == home)
                x += before[c] * math.log10((into + brown.PRIOR * (pairs[:, k].sum() - less + 1) / (pairs.sum() + total)) / (pairs[c].sum() + brown.PRIOR))
                x += after[c] * math.log10((out + brown.PRIOR * (pairs[:, c].sum() + 1) / (pairs.sum() + total)) / (pairs[k].sum() - less + brown.PRIOR))
            value.append(x)
        want.append(int(np.argmax(value)))
    assert brown.best_classes(seen, own, pairs, tokens, types).tolist() == want and len(set(want)) > 2


def test_language_model_is_a_distribution(spark):
    """Over known words, classes and emissions leave only the smoothing's share."""
    docs = _docs(spark, [(0, "a b a b"), (2, "b a c")])
    scored = brown.score(docs, docs.doc_id >= 0).collect()
    assert all(r.score <= 0 and r.n_known == r.n_tokens for r in scored)
    assert brown.digest(docs.limit(0)).count() == 0


# urls


@pytest.mark.parametrize("sizes", [{}, {"shard_keys": 7, "inline_shards": 0}, {"shard_keys": 7}])
def test_cascade_is_exact(spark, sizes):
    keys = spark.range(3000).selectExpr("concat('k', id) AS key", "id % 7 = 0 AS listed")
    cascade = urlfilter.Cascade(keys.union(keys.limit(100)), **sizes)
    assert len(cascade.words) > 1  # false positives were met
    got = cascade.listed(keys.selectExpr("key", "listed AS want"), keys.key, "listed")
    assert got.where("listed <> want").count() == 0 and got.count() == 3000
    nothing = urlfilter.Cascade(keys.where("NOT listed"), **sizes)
    assert nothing.listed(keys, keys.key, "found").where("found").count() == 0


def test_urls(spark):
    urls = [
        "http://www.Example.com/en/x?y", "https://example.com/en/", "ftp://a.example.com/EN/", "x://b.net/es/#q", "http://net/fr/", "http://a.com", "http://a.com/",
        "http://notcom/", "mailto:x", None, "", "a://b://c/d", "http://É.Net/es/\nz?utm_=1", "http://q.org/1?utm_source=x", "http://q.org/1", "http://q.org/1#a",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(14, "http://q.org/1")], "page_id long, url string").selectExpr("*", "1 AS key", "2 AS shard", "3 AS host")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.digest(pages).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[1][2:] == ("example.com/en/", "block")
    assert got[2][1:] == ("/EN/", "com/", "allow") and got[3][2:] == ("net/es/", "block") and got[4][2:] == ("net/fr/", "block")
    assert got[5] == ("a.com", "", None, "allow") and got[6][2] == "com/" and got[7][2] is None
    assert got[8] == got[9] == got[10] == ("", "", None, "allow") and got[11][:2] == ("b:", "//c/d")
    assert got[12] == ("É.net", "/es/\nz", "net/es/", "block")
    assert [got[k][3] for k in (13, 14, 15)] == ["block"] * 3
    assert urlfilter.digest(pages.limit(0)).count() == 0


# licences


def _license(text):
    words = [w.decode() for w in letter_words(text)]
    at = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, label in licenses.BASE.items()}
    every = sorted(i for places in at.values() for i in places)
    return len(words), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(k for k, v in at.items() if v))


def test_licenses(spark):
    notices = [n for n, _ in licenses.TEMPLATES.values()]
    rows = [*ODD, *[(10 + i, f"Some words. {n.upper()}! and more words of it") for i, n in enumerate(notices)]]
    rows += [(50, "CC  by, cc-by cc\nBY ccby xcc by cc bye"), (51, "All rights reserved. all RIGHTS Reserved"), (52, "licensed version license public"), (53, "mit license"), (54, "GNU General Public Licens\u212ae")]
    got = licenses.digest(_docs(spark, rows, "1 AS words,2 AS row,3 AS rare")).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _license(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    labels = {r.doc_id: r.labels.split(",") for r in got}
    for i, label in enumerate(licenses.TEMPLATES):
        assert label in labels[10 + i], label
    assert labels[52] == [""] and labels[50] == ["cc-by"]
    assert licenses.digest(_docs(spark, rows).limit(0)).count() == 0


def test_own_labels_equal_plain_python(spark):
    rng = np.random.default_rng(11)
    notices, rows = [n.split() for n, _ in licenses.TEMPLATES.values()], []
    for d in range(150):  # notices with words lost, changed or moved
        words = [f"w{x}" for x in rng.integers(0, 50, 20)]
        for k in rng.integers(0, len(notices), int(rng.integers(1, 4))):
            part = [w if rng.random() > 0.04 * (d % 8) else "x" for w in notices[k] if rng.random() > 0.01 * (d % 5)]
            words += part + [f"w{x}" for x in rng.integers(0, 50, 5)]
        rows.append((d, " ".join(words)))
    files = {d: [w.decode() for w in letter_words(t)] for d, t in rows}
    own = {label: [(w, i) for i, w in enumerate(n.split()) if w not in licenses.COMMON and n.split().count(w) == 1] for label, (n, _) in licenses.TEMPLATES.items()}
    df = Counter(w for words in files.values() for w in set(words))
    expected = {}
    for d, words in files.items():
        found = set()
        for label, places in own.items():
            rare = sorted({w for w, _ in places} & set(words), key=lambda w: (df[w], w))[: licenses.LOOKUPS]
            agree: dict = {}
            for word, at in places:
                for i in range(len(words) if word in rare else 0):
                    if words[i] == word:
                        agree.setdefault(i - at, set()).add(at)
            share = min(1.0, max(map(len, agree.values()), default=0) / min(licenses.LOOKUPS, len(places)))
            must = licenses.TEMPLATES[label][1].split()
            if share >= licenses.AGREE and any(words[i : i + len(must)] == must for i in range(len(words))):
                found.add(label)
        expected[d] = found
    got = {r.doc_id: set(r.found or []) for r in licenses.scan(_docs(spark, rows)).collect()}
    assert got == expected
    assert 100 < sum(map(len, expected.values())) and len(set().union(*expected.values())) == len(own)


def test_licenses_of_files_with_several_notices(spark):
    notices = [n for n, _ in licenses.TEMPLATES.values()]
    words = sorted({w for n in notices for w in n.split()})
    rng = np.random.default_rng(4)
    noise = " ".join(rng.choice(words, 30_000))  # a very long text of licence words, in no order
    rows = [(i, f"Some words. {n} and more") for i, n in enumerate(notices)]
    pairs = [(a, b) for a in range(len(notices)) for b in range(len(notices)) if a != b]
    rows += [(100 + i, f"Some words. {notices[a]} and more words. {notices[b]} and more") for i, (a, b) in enumerate(pairs)]
    rows += [(1000, " some words ".join(notices)), *[(1001 + i, f"{noise} some {n} words {noise}") for i, n in enumerate(notices)]]
    labels = {r.doc_id: set(r.labels.split(",")) for r in licenses.digest(_docs(spark, rows)).collect()}
    for i, (a, b) in enumerate(pairs):
        assert labels[100 + i] == labels[a] | labels[b]
    assert set(licenses.TEMPLATES) <= labels[1000]
    for i, label in enumerate(licenses.TEMPLATES):
        assert label in labels[1001 + i]


# SQL twins


@pytest.mark.parametrize("name", ["op2_bloom_cascade", "op4_decontamination"])
def test_query_equals_sql(spark, name):
    import duckdb

    from docloom.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    expected = con.sql(ORACLES[name])
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(expected.columns)
    rows = {tuple(r) for r in got.select(*expected.columns).collect()}
    assert rows == set(expected.fetchall())


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n" * 2_000_000, " \n" * 600_000 + "end", "a" + "　" * 120_000])
def test_very_long_blanks_are_packed(spark, run):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [*exact.encode(run, add_special_tokens=False).ids, 2]
    rows = packing.digest(_docs(spark, [(1, run), (2, "short")])).where("doc_id = 1").orderBy("piece").collect()
    assert sum(r.length for r in rows) == len(ids) and [r.start for r in rows] == [0, *np.cumsum([r.length for r in rows])[:-1]]
    for r in rows:
        assert r.length <= 1024 and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
