import json
import random

import pytest
from reader import Rejected, read

from docloom.operators import extract as X
from docloom.sources.documents import parse_elements

BOX, TICKED = '<input class="Checkbox"/>', '<input class="Checkbox" checked/>'
SCHEMA = "doc string, idx bigint, type string, text string, text_as_html string, page_number bigint, null_text boolean"


def random_doc(rng, n, box_share):
    doc = []
    for _ in range(n):
        kind = rng.choices(["Title", "Image", "Header", "FormKeysValues", "NarrativeText"], [1, 1, 1, 4, 4])[0]
        text = rng.choice(["Yes", "No", " Yes ", "", None, "a?", "b:", "plain", "more text", "\n"])
        html = rng.choice([BOX, TICKED]) if rng.random() < box_share else ""
        doc.append({"type": kind, "text": text, "html": html})
    return doc


def frame(spark, docs):
    rows = [
        (name, i, e["type"], e["text"], e["html"], i // 10, e["text"] is None)
        for name, doc in docs.items()
        for i, e in enumerate(doc)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def extracted(df, **kw):
    out = {}
    for r in X.extract_items(df, "doc", **kw).collect():
        out.setdefault(r.doc, []).append((r.idx, r.type, r.question, r.value_text, r.value_bool, r.section))
    return {k: sorted(v, key=lambda item: item[0]) for k, v in out.items()}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    made = {f"d{i}": random_doc(rng, rng.randint(1, 60), rng.choice([0.2, 0.6, 0.95])) for i in range(250)}
    # long runs of labelled checkboxes, to carry the swallowing rule over segments
    run = [{"type": "FormKeysValues", "text": rng.choice(["Yes", "No"]), "html": BOX} for _ in range(80)]
    made["run"] = [{"type": "NarrativeText", "text": "q?", "html": ""}] + run
    made["titled run"] = run[:30] + [{"type": "Title", "text": "Yes", "html": ""}] + run
    made["labels swallow titles"] = [
        e for _ in range(20) for e in (
            {"type": "FormKeysValues", "text": "x", "html": BOX}, {"type": "Title", "text": "No", "html": ""})
    ]
    return made


@pytest.mark.parametrize("segment_rows", [6, 8, 20, 200_000])
def test_items_equal_the_sequential_reader(spark, docs, segment_rows):
    expected = {k: items for k, doc in docs.items() if (items := read(doc))}
    assert extracted(frame(spark, docs), segment_rows=segment_rows) == expected


def test_segment_rows_are_checked(spark, docs):
    for bad in (4, 7):
        with pytest.raises(ValueError):
            X.extract_items(frame(spark, docs), "doc", segment_rows=bad)


@pytest.mark.parametrize("segment_rows", [6, 200_000])
def test_rejected_docs_equal_the_sequential_reader(spark, docs, segment_rows):
    expected = set()
    for name, doc in docs.items():
        try:
            read(doc, null_is_blank=False)
        except Rejected:
            expected.add(name)
    assert 0 < len(expected) < len(docs)
    got = {r.doc for r in X.rejected_docs(frame(spark, docs), "doc", segment_rows).collect()}
    assert got == expected


def by_hand(spark, *rows):
    doc = [{"type": t, "text": x, "html": h} for t, x, h in rows]
    return extracted(frame(spark, {"d": doc})).get("d", [])


def test_checkbox_without_label_is_text(spark):
    assert by_hand(spark, ("FormKeysValues", "lone", TICKED)) == [(0, "text", None, "lone", None, "Document Content")]


def test_label_before_wins_over_label_after(spark):
    items = by_hand(spark, ("Text", "Yes", ""), ("FormKeysValues", "", TICKED), ("Text", "No", ""))
    assert items == [(1, "checkbox", "Unknown question", None, True, "Document Content")]


def test_title_swallowed_as_label_opens_no_section(spark):
    items = by_hand(
        spark, ("Title", "S", ""), ("FormKeysValues", "", TICKED), ("Title", "Yes", ""), ("Text", "in S", "")
    )
    assert [i[5] for i in items] == ["S", "S", "S"]
    assert items[1][4] is True


def test_elements_before_the_first_title_are_dropped(spark):
    assert by_hand(spark, ("Text", "early", ""), ("Title", "T", "")) == [(1, "text", None, "T", None, "T")]


def test_empty_title_opens_a_nameless_section(spark):
    assert by_hand(spark, ("Title", " ", ""), ("Text", "x", "")) == [(1, "text", None, "x", None, "")]


def test_question_stays_pending_over_a_title(spark):
    items = by_hand(
        spark, ("Title", "A", ""), ("Text", "why?", ""), ("Title", "B", ""), ("Text", "Yes", ""), ("F", "", BOX)
    )
    assert items[-1] == (4, "checkbox", "why?", None, None, "B")


def test_look_back_never_sees_the_first_element(spark):
    assert by_hand(spark, ("Header", "why?", ""), ("Text", "Yes", ""), ("F", "", BOX))[-1][2] == "Unknown question"
    assert by_hand(spark, ("Text", "x", ""), ("Header", "why?", ""), ("Text", "Yes", ""), ("F", "", BOX))[-1][2] == "why?"


def test_count_items_line(spark, docs):
    counts = {r.doc: r.counts for r in X.count_items(X.extract_items(frame(spark, docs), "doc"), "doc").collect()}
    doc = spark.createDataFrame(
        [("d", "image"), ("d", "checkbox"), ("d", "checkbox"), ("d", "checkbox")], "doc string, type string"
    )
    assert X.count_items(doc, "doc").first().counts == "3 checkboxs, 1 image"
    assert set(counts) == {k for k, d in docs.items() if read(d)}


def test_parse_tells_absent_from_null(spark):
    element = {"type": "Text", "text": "t", "metadata": {}}
    files = {
        "absent page": [element],
        "null page": [{**element, "metadata": {"page_number": None}}],
        "no metadata": [{"type": "Text", "text": "t"}],
        "no type": [{"text": "t", "metadata": {}}],
        "null text": [{**element, "text": None}],
        "numeric text": [{**element, "text": 5}],
        "empty": [],
        "object": {"type": "Text"},
        "strings": ["a"],
    }
    rows = [(k, json.dumps(v)) for k, v in files.items()] + [("broken", "[{")]
    parsed = parse_elements(spark.createDataFrame(rows, "doc_path string, content string"))
    by_path = {r.doc_path: r for r in X.normalise_elements(parsed).collect()}
    assert by_path["absent page"].page_number == 0
    assert by_path["null page"].page_number is None
    assert by_path["null text"].null_text and not by_path["absent page"].null_text
    assert by_path["empty"].idx is None and not by_path["empty"].malformed
    rejected = {r.doc_path for r in X.rejected_docs(parsed).collect()}
    assert rejected == {"no metadata", "no type", "numeric text", "object", "strings", "broken"}
    sound, _ = X.quarantine_docs(parsed)
    assert {r.doc_path for r in X.extract_items(sound).collect()} == {"absent page", "null page"}


def test_rejected_documents_are_found_once(spark):
    rows = [("a", 0, "Title", "T", "", 1, False), ("b", 0, "Text", "x", "", 1, False), ("b", 1, "Text", "x", BOX, 1, True), ("b", 2, "Text", None, "", 1, True)]
    sound, rejected = X.quarantine_docs(spark.createDataFrame(rows, SCHEMA), "doc")
    for found in (sound, rejected):
        assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc for r in sound.collect()}.isdisjoint(r.doc for r in rejected.collect())


def test_sentences_are_counted_before_they_are_exploded(spark, tmp_path):
    from docloom.registry.tables import elements

    texts = [(1, "a. b. c", "s"), (2, "a", "s"), (3, None, "s"), (4, "", "s")]
    spark.createDataFrame(texts, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    made = elements(spark, str(tmp_path))
    assert "replace(" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.doc_id, r.n_elements) for r in made.collect()} == {(1, 5), (2, 1), (4, 1)}


def test_items_keep_columns_of_their_elements(spark):
    rows = [("a", 0, "Text", "x", "", 1, False, "app")]
    items = X.extract_items(spark.createDataFrame(rows, SCHEMA + ", source string"), "doc", keep=["source"])
    assert [(r.value_text, r.source) for r in items.collect()] == [("x", "app")]
