import csv
import json
import pathlib
import random
import types

import pytest
from pyspark.sql import functions as F

from docloom import sinks, sources
from docloom.operators.audit import corpus_audit
from docloom.plans import bloom
from docloom.plans.stored import stored
from docloom.session import _work_root, folder_exists, work_scope
from docloom.sinks import tables
from docloom.sources import ranges
from docloom.streaming import stream_ingest_docs


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_item_docs_have_a_two_typed_value(spark, tmp_path):
    items = [
        {"type": "text", "value": "v é", "section": "S", "page_number": 2},
        {"type": "checkbox", "question": "Q", "value": None, "section": "S", "page_number": 2},
        {"type": "checkbox", "question": "Q", "value": False, "section": "S", "page_number": 2},
    ]
    write(tmp_path / "app" / "a.json", json.dumps(items))
    write(tmp_path / "app" / "empty.json", "[]")
    write(tmp_path / "app" / "skipped.txt", "[]")
    rows = sources.read_item_docs(spark, str(tmp_path)).orderBy("doc_path", "idx").collect()
    assert [(r.idx, r.type, r.value_text, r.value_bool) for r in rows] == [
        (0, "text", "v é", None), (1, "checkbox", None, None), (2, "checkbox", None, False), (None, None, None, None)
    ]
    assert rows[0]["keys"] == ["page_number", "section", "type", "value"]


def test_markdown_docs(spark, tmp_path):
    write(tmp_path / "109428-CND-22" / "combined.md", "# t\n\nbody\n")
    write(tmp_path / "other" / "blank.md", " \n\n")
    rows = sources.read_markdown_docs(spark, str(tmp_path)).collect()
    assert [(r.application, r.filename, r.text) for r in rows] == [("109428-CND-22", "combined.md", "# t\n\nbody\n")]
    assert rows[0].path.endswith("/109428-CND-22/combined.md")


def test_ordered_lines(spark, tmp_path):
    write(tmp_path / "q.txt", "one\n\nthree\r\nlast")
    write(tmp_path / "p.txt", "only\n")
    rows = sources.read_ordered_lines(spark, str(tmp_path)).collect()
    got = {(r.file.rsplit("/", 1)[-1], r.ordinal): r.line for r in rows}
    assert got == {("q.txt", 1): "one", ("q.txt", 2): "", ("q.txt", 3): "three", ("q.txt", 4): "last", ("p.txt", 1): "only"}


def test_token_lines_skip_blanks(spark, tmp_path):
    write(tmp_path / "g1" / "t.json", '{"input_ids": [1, 2], "attention_mask": [1, 1]}\n\n{"input_ids": [3]}\n')
    write(tmp_path / "g1" / "t.jsonl", '{"input_ids": [9]}\n')
    rows = sources.read_token_jsonl(spark, str(tmp_path)).collect()
    assert sorted((r.input_ids, r.attention_mask) for r in rows) == [([1, 2], [1, 1]), ([3], None)]
    write(tmp_path / "g2" / "t.json", '{"input_ids": [1\n')
    rows = sources.read_token_jsonl(spark, str(tmp_path / "g2")).collect()
    assert [(r.input_ids, r.corrupt_record) for r in rows] == [(None, '{"input_ids": [1')]


def test_gold_answers_in_both_key_styles(spark, tmp_path):
    entries = [
        {"folder_id": "109428-CND-22 ", "questions": {"1": "a", "2": "b"}},
        {"folder_id": "109435", "questions": {"Question 1": "c"}},
    ]
    write(tmp_path / "gold.json", json.dumps({"application_summaries": entries}, indent=1))
    rows = sources.read_gold_answers(spark, str(tmp_path / "gold.json")).collect()
    assert sorted(map(tuple, rows)) == [
        ("109428-CND-22", 1, "a", 0, None), ("109428-CND-22", 2, "b", 0, None), ("109435", 1, "c", 1, None)
    ]
    write(tmp_path / "z.json", json.dumps({"application_summaries": entries[:1]}))
    write(tmp_path / "bad.json", "{")
    rows = sources.read_gold_answers(spark, str(tmp_path / "*.json")).collect()
    assert [r.corrupt_record for r in rows if r.question_id is None] == ["{"]
    assert len({r.ordinal for r in rows if r.application_id == "109428-CND-22"}) == 2  # one for each file


def test_item_key(spark):
    names = ["a/b.pdf.json", "b.json", "a.pdf.json/c.json", "x.pdf.json.pdf.json"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(sinks.item_key(F.col("n")).alias("k"))
    assert [r.k for r in df.collect()] == ["a/b.json", "b.json", "a.pdf.json/c.json", "x.json.json"]


def test_report_rounds_like_python(spark, tmp_path):
    values = [0.0003345, 0.0005265, 2.675, 1.005, 0.00005, 12345.678949999]
    rows = [(i, v, v, v) for i, v in enumerate(values)] + [(99, None, None, None)]
    df = spark.createDataFrame(rows, "id bigint, latency double, total_cost double, throughput double").coalesce(1)
    sinks.write_report_csv(df, str(tmp_path / "r"))
    (part,) = (tmp_path / "r").glob("*.csv")
    with part.open() as f:
        got = list(csv.reader(f))
    assert got[0] == ["id", "Latency (s)", "Total Cost ($)", "Throughput (tokens/s)"]
    assert got[1:] == [[str(i), f"{v:.4f}", f"{v:.6f}", f"{v:.2f}"] for i, v in enumerate(values)] + [["99", "", "", ""]]


def test_upsert_keeps_what_is_there(spark, tmp_path):
    path = str(tmp_path / "collection")

    def chunks(*rows):
        return spark.createDataFrame(list(rows), "chunk_id string, document string, application string")

    sinks.upsert_chunks(chunks(("md_0", "a", "x"), ("md_1", "b", "y")), path)
    sinks.upsert_chunks(chunks(("md_1", "changed", "y"), ("md_2", "c", "y"), ("md_2", "c", "y")), path)
    sinks.upsert_chunks(chunks(("md_1", "changed", "y")), path)
    got = sorted((r.chunk_id, r.document) for r in spark.read.parquet(path).collect())
    assert got == [("md_0", "a"), ("md_1", "b"), ("md_2", "c")]


def test_audit(spark):
    manifest = spark.createDataFrame([("a",), ("b",), ("gone",)], "doc string")
    docs = spark.createDataFrame([("a",), ("b",), ("new",)], "doc string")
    items = spark.createDataFrame([("a", "text"), ("a", "checkbox"), ("new", "image")], "doc string, type string")
    got = {(r.measure, r.name): r.n for r in corpus_audit(manifest, docs, items, "doc").collect()}
    assert got == {
        ("expected", ""): 3, ("present", ""): 3, ("missing", ""): 1, ("unlisted", ""): 1, ("empty", ""): 1,
        ("columns", "page_number,question,section,type,value"): 1, ("columns", "page_number,section,type"): 1,
        ("items", "text"): 1, ("items", "checkbox"): 1, ("items", "image"): 1,
    }


def test_stream_ingest_takes_new_files_only(spark, tmp_path):
    def element(text, **more):
        return {"type": "Text", "text": text, "metadata": {"page_number": 1}, **more}

    src, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    write(src / "x" / "1.json", json.dumps([element("one")]))
    stream_ingest_docs(spark, str(src), out, checkpoint).awaitTermination()
    write(src / "y" / "2.json", json.dumps([element("two?"), element("Yes"), element("", metadata={
        "text_as_html": '<input class="Checkbox" checked/>'})]))
    write(src / "y" / "bad.json", "{")
    stream_ingest_docs(spark, str(src), out, checkpoint).awaitTermination()
    items = spark.read.parquet(f"{out}/items").collect()
    assert sorted((r.epoch, r.type, r.value_text or r.question, r.value_bool) for r in items) == [
        (0, "text", "one", None), (1, "checkbox", "two?", True), (1, "text", "two?", None)
    ]
    assert [r.doc_path.rsplit("/", 1)[-1] for r in spark.read.parquet(f"{out}/rejected").collect()] == ["bad.json"]
    # a lost checkpoint offers all files again; a third one is new
    write(src / "z" / "3.json", json.dumps([element("three")]))
    stream_ingest_docs(spark, str(src), out, str(tmp_path / "other")).awaitTermination()
    stream_ingest_docs(spark, str(src), out, str(tmp_path / "third")).awaitTermination()
    items = spark.read.parquet(f"{out}/items").collect()
    assert sorted((r.epoch, r.value_text or r.question) for r in items) == [(0, "one"), (1, "two?"), (1, "two?"), (2, "three")]
    manifest = spark.read.parquet(f"{out}/manifest").collect()
    assert sorted((r.epoch, r.doc_path.rsplit("/", 1)[-1]) for r in manifest) == [(0, "1.json"), (1, "2.json"), (1, "bad.json"), (2, "3.json")]


def test_an_unfinished_micro_batch_is_written_over(spark, tmp_path, monkeypatch):
    write(tmp_path / "in" / "1.json", json.dumps([{"type": "Text", "text": "one", "metadata": {}}]))
    out = str(tmp_path / "out")
    spark.createDataFrame([(1,)], "half_written int").write.parquet(f"{out}/items/epoch=0")  # no manifest: never finished
    before = {p.name for p in pathlib.Path(_work_root(spark)).glob("epoch-*")}
    stream_ingest_docs(spark, str(tmp_path / "in"), out, str(tmp_path / "cp")).awaitTermination()
    assert [r.value_text for r in spark.read.parquet(f"{out}/items").collect()] == ["one"]
    assert {p.name for p in pathlib.Path(_work_root(spark)).glob("epoch-*")} == before


def test_work_folder_is_shared_or_refused(spark, monkeypatch):
    with work_scope(spark, "scope"):
        inner = stored(spark.range(3), "rows")
        assert inner.count() == 3 and "/scope-" in inner.inputFiles()[0]
        folder = inner.inputFiles()[0].rsplit("/", 1)[0]
        assert folder_exists(spark, folder)
    assert not folder_exists(spark, folder)

    class Cluster:
        sparkContext = types.SimpleNamespace(master="local-cluster[2,1,1024]", applicationId="a")
        conf = types.SimpleNamespace(get=lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _work_root(Cluster)


def _element(rng, depth=0):
    text = "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "é", "😀", "\n", "a", " ", '\\"', "}}"]) for _ in range(rng.randint(0, 12)))
    extra = {"more": [_element(rng, depth + 1)]} if depth < 3 and rng.random() < 0.4 else {}
    page = {"page_number": rng.choice([1, None])} if rng.random() < 0.7 else {}
    return {"type": "T{" if rng.random() < 0.2 else "T", "text": text, "metadata": {**page, "text_as_html": rng.choice([None, "<x a=\"}\">"])}, **extra}


def _rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_element_docs_in_ranges_equal_whole_ones(spark, tmp_path):
    rng = random.Random(7)
    for n in range(12):
        array = [_element(rng) if rng.random() < 0.9 else rng.choice([1, "x}", None, [{"a": "]"}], [], True]) for _ in range(n * 7)]
        write(tmp_path / "sound" / f"{n}.json", json.dumps(array, ensure_ascii=n % 2 == 0, indent=n % 3 or None))
    odd = ["", " ", "[]", " [ ]\n", "{}", '{"a": [{"b": 1}, {"c": 2}]}', '[{"a": 1}', '[{"a": 1},]', '[{"a": 1},,{"b": 2}]', '[{"a": 1} {"b": 2}]',
           '{"a": 1}]', '[{"a": "}]', "[1, 2]", '[1, {"a": {}}, 2]', '[{"a": [}]}]', "x", '[{"a": 1}, 2', '["}", "{"]', '[{"a": "\\\\"}, {"b": "\\""}]']
    for n, text in enumerate(odd):
        write(tmp_path / "odd" / f"{n}.json", text)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    whole = {k: _rows(sources.read_element_docs(spark, str(tmp_path / k))) for k in ("sound", "odd")}
    try:
        for block in ("300", "5000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
            for k, expected in whole.items():
                assert _rows(sources.read_element_docs(spark, str(tmp_path / k), whole_bytes=-1)) == expected, (k, block)
            both = sources.read_element_docs(spark, str(tmp_path / "sound"), whole_bytes=4000)
            assert _rows(both) == whole["sound"]
            assert both.selectExpr("count(DISTINCT doc_path)").first()[0] == 12
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_one_large_file_is_many_tasks(spark, tmp_path):
    write(tmp_path / "large.json", json.dumps([{"type": "T", "text": "x" * 200, "metadata": {}} for _ in range(2000)]))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        rows = ranges.large_files(spark, str(tmp_path), "*.json", 1000)
        assert rows.select("block").distinct().count() >= 8
        assert ranges.large_files(spark, str(tmp_path), "*.json", 10_000_000).isEmpty()
        got = sources.read_element_docs(spark, str(tmp_path), whole_bytes=1000)
        assert got.selectExpr("count(*)", "count(DISTINCT idx)", "max(idx)", "max(n_elements)").first() == (2000, 2000, 1999, 2000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


ITEMS = "app string, doc string, idx bigint, type string, question string, value_text string, value_bool boolean, section string, page_number bigint"


def test_packed_items_read_back(spark, tmp_path):
    rows = [("a", "long", i * 3, "text", None, f"v{i} é\r\n ", None, "S", i) for i in range(100)]
    rows += [("a", "short", 0, "checkbox", "Q", None, True, "S", 1), ("a", "short", 5, "checkbox", "Q", None, None, "S", None)]
    rows += [("b", "none", None, None, None, None, None, None, None), ("b", "long", 7, "image", None, None, None, None, 2)]
    items = spark.createDataFrame(rows, ITEMS)
    folder = str(tmp_path / "packed")
    sinks.write_items(items.repartition(5), folder, "app", "doc", segment_items=30)
    read = sources.read_item_docs(spark, folder)
    got = {}
    for r in read.collect():
        got.setdefault(tuple(r.doc_path.split("/")[-2:]), []).append((r.idx, r.type, r.value_text, r.value_bool, r.section, r.page_number, r.malformed))
    assert sorted(got["a", "long"]) == [(i, "text", f"v{i} é\r\n ", None, "S", i, False) for i in range(100)]
    assert sorted(got["a", "short"]) == [(0, "checkbox", None, True, "S", 1, False), (1, "checkbox", None, None, "S", None, False)]
    assert got["b", "none"] == [(None, None, None, None, None, None, False)] and got["b", "long"] == [(0, "image", None, None, None, 2, False)]
    # the index names bytes: every line can be had by itself
    index = spark.read.parquet(f"{folder}/index").collect()
    assert len(index) == 10 + 3 and len({r.file for r in index}) <= 5
    for r in index:
        with open(r.file.removeprefix("file://").removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            line = json.loads(f.read(r.length))
        assert (line["application"], line["document"], line["segment"], len(line["items"])) == (r.application, r.document, r.segment, r.n_items)
    # the same rows from a file per document
    sinks.write_item_files(items.withColumnRenamed("app", "application").withColumnRenamed("doc", "document"), str(tmp_path / "files"))
    single = sources.read_item_docs(spark, str(tmp_path / "files"), "part-*")
    assert sorted(map(str, single.drop("doc_path").collect())) == sorted(map(str, read.drop("doc_path").collect()))


def test_many_documents_in_few_files(spark, tmp_path):
    items = spark.range(30_000).selectExpr(
        "CAST(id % 7 AS STRING) AS application", "CAST(id AS STRING) AS document", "0L AS idx", "'text' AS type", "CAST(NULL AS STRING) AS question",
        "'v' AS value_text", "CAST(NULL AS BOOLEAN) AS value_bool", "'S' AS section", "1L AS page_number",
    )
    sinks.write_items(items, str(tmp_path / "packed"))
    assert len(list((tmp_path / "packed" / "items").glob("part-*"))) <= 8
    assert sources.read_item_docs(spark, str(tmp_path / "packed")).selectExpr("count(DISTINCT doc_path)").first()[0] == 30_000


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(0, 100_000, 2).selectExpr("concat('k', id) AS k").unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS k"))
    table = bloom.bloom_filter(keys, "k", 50_000)
    assert table.count() == 2
    held = bloom.may_hold(spark.range(100_000).selectExpr("id", "concat('k', id) AS k"), "k", table, 50_000)
    found = {r.id for r in held.collect()}
    assert found >= set(range(0, 100_000, 2)) and len(found) < 50_000 + 250
    with pytest.raises(ValueError):
        bloom.may_hold(keys, "k", table, bloom.MOST_KEYS + 1)


def test_appends_meet_only_possible_hits(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "collection")
    chunks = lambda a, b, text: spark.range(a, b).selectExpr("concat('md_', id) AS chunk_id", "CAST(id % 3 AS STRING) AS application", f"'{text}' AS document")
    sinks.upsert_chunks(chunks(0, 5000, "one"), path)
    met = []
    may_hold = tables.may_hold
    monkeypatch.setattr(tables, "may_hold", lambda *a: met.append(may_hold(*a)) or met[-1])
    new = sinks.new_chunks(chunks(4900, 5100, "two"), spark.read.parquet(path))
    assert met[0].count() <= 110 and new.count() == 100
    assert "Exchange" not in met[0]._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    for _ in range(2):  # a repeated append adds nothing
        sinks.upsert_chunks(chunks(4900, 5100, "two").unionByName(chunks(5099, 5101, "a")), path)
    got = spark.read.parquet(path)
    assert got.count() == got.select("chunk_id").distinct().count() == 5101
    assert {r.document: r["count"] for r in got.groupBy("document").count().collect()} == {"one": 5000, "two": 99, "a": 2}
    monkeypatch.setattr(tables, "MOST_KEYS", 10)
    sinks.upsert_chunks(chunks(5000, 5200, "three"), path)
    assert spark.read.parquet(path).count() == 5200
    assert not list(pathlib.Path(_work_root(spark)).glob("upsert-*"))


def test_packed_documents_are_read_as_files(spark, tmp_path):
    element = {"type": "NarrativeText", "text": "x", "metadata": {"page_number": 1, "text_as_html": ""}}
    texts = {"a/1.json": json.dumps([element] * 3), "a/2.json": "[]", "b/3.json": "no JSON", "b/4.md": "one\r\ntwo\n\nlast\n", "b/5.md": " \n"}
    for name, text in texts.items():
        write(tmp_path / "files" / name, text)
    folder = str(tmp_path / "one")
    sinks.write_packed_docs(spark.createDataFrame(list(texts.items()), "path string, content string"), folder)
    assert len(list((tmp_path / "one" / "packed").glob("part-*"))) <= 4

    def seen(df, where):
        return sorted(str({**r.asDict(), df.columns[0]: r[0].split(where)[1]}) for r in df.collect())

    for read, glob in ((sources.read_element_docs, "*.json"), (sources.read_markdown_docs, "*.md"), (sources.read_ordered_lines, "*.md"), (sources.read_item_docs, "*.json")):
        assert seen(read(spark, folder, glob), "/one/") == seen(read(spark, str(tmp_path / "files"), glob), "/files/")

    out = str(tmp_path / "out")
    for again in ("first", "second"):  # the manifest knows packed documents, too
        stream_ingest_docs(spark, folder, out, str(tmp_path / again)).awaitTermination()
        assert spark.read.parquet(f"{out}/items").count() == 3
        assert spark.read.parquet(f"{out}/manifest").count() == 3
    assert [r.doc_path for r in spark.read.parquet(f"{out}/rejected").collect()] == [f"{folder}/b/3.json"]


@pytest.mark.parametrize("ids", [(1, 2), (1, 1)])
def test_applications_ride_along_with_items(spark, tmp_path, ids):
    from docloom.registry import files

    rows = [(ids[0], "a. b?", "s"), (ids[1], "c. d", "t")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = files._applied_items(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("(doc_id" in plan.split("Join Inner")[-1]) if ids[0] == ids[1] else "Join Inner" not in plan
    n = files.items(spark, str(tmp_path)).count()
    assert found.count() == (n if ids[0] != ids[1] else 2 * n)
