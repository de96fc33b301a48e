import random

import pytest

from docloom.operators import chunks as C


def split_by_rule(text, size, overlap, separators):
    """The splitting rule, spelled out step by step."""
    while separators[0] and separators[0] not in text:
        separators = separators[1:]
    sep, finer = separators[0], separators[1:]
    if sep:
        parts = text.split(sep)
        pieces = [parts[0]] + [sep + p for p in parts[1:]]
    else:
        pieces = list(text)
    pieces = [p for p in pieces if p]
    out, short = [], []

    def merge():
        held, total = [], 0
        for p in short:
            if total + len(p) > size and held:
                out.append("".join(held).strip())
                while total > overlap or (total + len(p) > size and total > 0):
                    total -= len(held.pop(0))
            held.append(p)
            total += len(p)
        if held:
            out.append("".join(held).strip())
        short.clear()

    for p in pieces:
        if len(p) < size:
            short.append(p)
        else:
            merge()
            out.extend(split_by_rule(p, size, overlap, finer) if finer else [p])
    merge()
    return [c for c in out if c]


def texts():
    rng = random.Random(5)
    for _ in range(200):
        yield "".join(rng.choices(["ab", "word", " ", "\n", "\n\n", "longerword", "é"], [4, 4, 5, 1, 1, 2, 1], k=rng.randint(1, 200)))


@pytest.mark.parametrize("size, overlap", [(20, 5), (50, 0), (10, 9), (2000, 300)])
def test_split_text(size, overlap):
    for text in texts():
        assert list(C.split_text(text, size, overlap)) == split_by_rule(text, size, overlap, C.SEPARATORS)


def test_split_text_by_hand():
    assert list(C.split_text("aa bb cc dd", 5, 2)) == ["aa bb", "cc", "dd"]
    assert list(C.split_text("abcdefgh", 4, 2)) == ["abcd", "cdef", "efgh"]


def test_chunk_documents(spark):
    docs = [(i, t) for i, t in enumerate(texts())] + [(900, " \n "), (901, None)]
    got = {}
    for r in C.chunk_documents(spark.createDataFrame(docs, "id bigint, text string"), "id", size=30, overlap=8).collect():
        got.setdefault(r.id, []).append((r.chunk, r.document))
    expected = {i: list(enumerate(split_by_rule(t, 30, 8, C.SEPARATORS))) for i, t in docs if t and t.strip()}
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_chunk_fixed_is_the_character_case(spark):
    docs = [(n, "".join(chr(97 + i % 26) for i in range(n))) for n in (0, 1, 9, 10, 11, 17, 18, 100)]
    got = {}
    for r in C.chunk_fixed(spark.createDataFrame(docs, "id bigint, text string"), "id", size=10, overlap=3).collect():
        got.setdefault(r.id, []).append((r.chunk, r.document))
    for n, text in docs:
        assert [c for _, c in sorted(got.get(n, []))] == (split_by_rule(text, 10, 3, ("",)) if text else [])


def test_numbers_are_dense(spark):
    rows = [(f"f{i}", n) for i in range(30) for n in range(i % 4 + 1)]
    got = C.number_chunks(spark.createDataFrame(rows, "path string, chunk bigint"), digits=1).collect()
    assert sorted(int(r.chunk_id[3:]) for r in got) == list(range(len(rows)))
    first = {r.path: int(r.chunk_id[3:]) - r.chunk for r in got}
    assert len(set(first.values())) == 30
