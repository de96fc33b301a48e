"""Source and sink queries: driver tables written out and read back.

Each query writes below the shared work folder of the session, reads what it
wrote through the source under test, and so has to return the driver table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import sinks, sources
from docloom.operators import chunks as C
from docloom.operators import extract as X
from docloom.plans.stored import stored
from docloom.registry import sql
from docloom.registry.evaluation import hosted_records, hosted_sql, local_records, n_words
from docloom.registry.extraction import items
from docloom.registry.tables import documents, elements, table
from docloom.registry.trainlogs import SPEED, log
from docloom.session import work_folder
from docloom.sinks.tables import REPORT_DECIMALS, REPORT_HEADERS
from docloom.streaming import stream_ingest_docs, stream_token_speed

PART = "part-*"


def _doc_of(path: str) -> Column:
    return F.regexp_extract(path, r"doc=([0-9]+)", 1).cast("bigint")


def _packed(docs, spark: SparkSession, label: str) -> str:
    """Documents (application, doc, content) packed below a fresh folder, at the paths a file for each would have."""
    named = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    path = F.concat(F.lit("application="), named("application"), F.lit("/doc="), named("doc"), F.lit("/part-0.txt"))
    folder = work_folder(spark, label)
    sinks.write_packed_docs(docs.select(path.alias("path"), F.concat("content", F.lit("\n")).alias("content")), folder)
    return folder


def _element_files(spark: SparkSession, d: str) -> str:
    """Every document as one JSON array at a path below its application folder."""
    element = F.struct(
        "idx", "type", "text", F.struct("page_number", "text_as_html").alias("metadata")
    )
    docs = elements(spark, d).groupBy(F.col("source").alias("application"), F.col("doc_id").alias("doc")).agg(
        F.to_json(F.sort_array(F.collect_list(element))).alias("content")
    )
    return _packed(docs, spark, "elements")


def _text_files(spark: SparkSession, d: str) -> str:
    """Every document's text at a path below its application folder; rows of one document follow each other."""
    lines = F.collect_list(F.coalesce("text", F.lit("")))
    docs = documents(spark, d).groupBy(F.col("source").alias("application"), F.col("doc_id").alias("doc")).agg(
        F.array_join(lines, "\n").alias("content")
    )
    return _packed(docs, spark, "texts")


def read_element_docs(spark, d):
    read = sources.read_element_docs(spark, _element_files(spark, d), PART)
    return read.select(
        _doc_of("doc_path").alias("doc_id"), "idx", "type", "text", "text_as_html", "page_number"
    )


def _applied_items(spark: SparkSession, d: str) -> DataFrame:
    """Items with their document's application, which rides along where an id is one document; else items meet all of its rows."""
    apps = documents(spark, d).select("doc_id", F.col("source").alias("application"))
    if apps.groupBy("doc_id").count().where("count > 1").isEmpty():
        carried = X.extract_items(elements(spark, d), "doc_id", keep=["source"])
        return carried.where("doc_id IS NOT NULL").withColumnRenamed("source", "application")
    return items(spark, d).join(apps, "doc_id")


def read_item_docs(spark, d):
    """Items written by the item sink, read back with their two-typed value and the keys each kind has."""
    folder = work_folder(spark, "items")
    sinks.write_items(_applied_items(spark, d).withColumnRenamed("doc_id", "document"), folder)
    read = sources.read_item_docs(spark, folder)
    return read.select(
        sources.path_parts(F.col("doc_path"))["filename"].cast("bigint").alias("doc_id"),
        "type", "question", "value_text", "value_bool", "section", "page_number", F.array_join("keys", ",").alias("keys"),
    )


def read_markdown_docs(spark, d):
    read = sources.read_markdown_docs(spark, _text_files(spark, d), PART)
    return read.select(
        _doc_of("path").alias("doc_id"),
        F.regexp_extract("path", "application=([^/]+)", 1).alias("source"),
        F.regexp_replace("text", r"\n\z", "").alias("text"),
    )


def read_ordered_lines(spark, d):
    read = sources.read_ordered_lines(spark, _text_files(spark, d), PART)
    return read.select(_doc_of("file").alias("doc_id"), "ordinal", "line")


def read_token_jsonl(spark, d):
    """Token lines written by the line sink."""
    lengths = F.transform(F.split("text", " "), lambda w: F.length(w))
    rows = documents(spark, d).select("doc_id", F.concat(F.array(F.col("doc_id").cast("int")), lengths).alias("input_ids"))
    folder = work_folder(spark, "tokens")
    sinks.write_jsonl(rows.select("input_ids"), folder)
    read = sources.read_token_jsonl(spark, folder)
    return read.select(
        F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("ids"),
        F.col("attention_mask").isNull().alias("no_mask"),
    )


def write_jsonl(spark, d):
    folder = work_folder(spark, "lines")
    sinks.write_jsonl(documents(spark, d).select(F.col("text").alias("input")), folder)
    return spark.read.schema("input string").json(folder)


def read_gold_answers(spark, d):
    """Gold files in the nested form, one per application, both key styles."""
    b = table(spark, d, "benchmark")
    key = F.when(F.col("item_id") % 2 == 0, F.lit("Question ")).otherwise("")
    entry = F.struct(
        F.concat(F.lit("app"), F.col("item_id").cast("string")).alias("folder_id"),
        F.create_map(F.concat(key, (F.col("item_id") % 5 + 1).cast("string")), F.col("text")).alias("questions"),
    )
    folder = work_folder(spark, "gold")
    b.select(F.col("item_id").alias("part"), F.array(entry).alias("application_summaries")).write.partitionBy(
        "part"
    ).json(folder)
    return sources.read_gold_answers(spark, f"{folder}/part=*").select("application_id", "question_id", "answer")


def save_dataset(spark, d):
    path = work_folder(spark, "dataset")
    sinks.save_dataset(documents(spark, d), path)
    return sources.load_dataset(spark, path).select("doc_id", "text", "source")


def write_items(spark, d):
    """Every packed document: its key, its application and how many items of which kinds it holds."""
    folder = work_folder(spark, "written")
    rows = _applied_items(spark, d).withColumn("document", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf.json")))
    sinks.write_items(rows, folder, segment_items=20)
    read = sources.read_item_docs(spark, folder)
    name, application = (sources.path_parts(F.col("doc_path"))[c] for c in ("filename", "application"))
    return read.groupBy(sinks.item_key(F.concat_ws("/", application, name)).alias("key"), application.alias("application")).agg(
        F.count("idx").alias("n_items"), F.count(F.when(F.col("type") == "checkbox", 1)).alias("n_boxes"), F.bool_or("malformed").alias("malformed")
    )


def append_metrics_csv(spark, d):
    """The same records appended twice."""
    folder = work_folder(spark, "metrics")
    records = local_records(spark, d).select("pair_id", "run", "answer", "word_count_answ")
    sinks.append_metrics_csv(records, folder)
    sinks.append_metrics_csv(records, folder)
    schema = "pair_id bigint, run bigint, answer string, word_count_answ bigint"
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(folder)


def write_report_csv(spark, d):
    folder = work_folder(spark, "report")
    columns = ["pair_id", *REPORT_DECIMALS]
    sinks.write_report_csv(hosted_records(spark, d).select(*columns), folder)
    read = spark.read.option("header", True).csv(folder)
    names = {header: column for column, header in REPORT_HEADERS.items()}
    return read.select(F.col("pair_id").cast("bigint").alias("pair_id"), *[F.col(f"`{c}`").alias(names[c]) for c in read.columns[1:]])


def upsert_chunks(spark, d):
    """Chunks of labelled documents first, then all chunks with a mark: the first ones stay."""
    docs = documents(spark, d).select("doc_id", "source", "text")
    every = C.chunk_fixed(docs, "doc_id").withColumn(
        "chunk_id", F.concat_ws("_", F.lit("md"), F.col("doc_id").cast("string"), F.col("chunk").cast("string"))
    ).withColumn("application", (F.col("doc_id") % 20).cast("string"))
    first = every.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    path = work_folder(spark, "collection")
    sinks.upsert_chunks(first, path)
    sinks.upsert_chunks(every.withColumn("document", F.concat(F.lit("later "), "document")), path)
    return spark.read.parquet(path).select("chunk_id", F.md5("document").alias("digest"))


def populate_chunks(spark, d):
    path = work_folder(spark, "store")
    docs = documents(spark, d).select(
        F.col("doc_id").cast("string").alias("path"), F.col("source").alias("application"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"), "text",
    )
    sinks.populate_chunks(docs, path)
    return spark.read.parquet(path).select("chunk_id", "application", "filename", F.md5("document").alias("digest"))


def stream_speed(spark, d):
    """The batch rates from a file stream of the event log that comes in six micro-batches."""
    folder = work_folder(spark, "speed")
    points = stored(log(spark, d).select("run", "step", "ts"), "log")
    first, last = points.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    part = F.floor((F.unix_micros("ts") - first) * 6 / (last - first + 1))
    for k in range(6):  # one file each, in the order of time
        points.filter(part == k).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    stream = spark.readStream.schema("run bigint, step bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    stream_token_speed(stream, f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(
        "run", "step", F.round("tokens_per_second", 6).alias("tokens_per_second")
    )


def stream_ingest(spark, d):
    folder = work_folder(spark, "ingest")
    stream_ingest_docs(spark, _element_files(spark, d), f"{folder}/out", f"{folder}/checkpoint", PART).awaitTermination()
    return spark.read.parquet(f"{folder}/out/items").select(
        _doc_of("doc_path").alias("doc_id"), "idx", "type", "question", "value_text", "value_bool", "section", "page_number"
    )


QUERIES = {
    "read_element_docs": read_element_docs,
    "read_item_docs": read_item_docs,
    "read_markdown_docs": read_markdown_docs,
    "read_ordered_lines": read_ordered_lines,
    "read_token_jsonl": read_token_jsonl,
    "read_gold_answers": read_gold_answers,
    "load_dataset": save_dataset,
    "write_items": write_items,
    "write_jsonl": write_jsonl,
    "append_metrics_csv": append_metrics_csv,
    "write_report_csv": write_report_csv,
    "upsert_chunks": upsert_chunks,
    "populate_chunks": populate_chunks,
    "stream_token_speed": stream_speed,
    "stream_ingest_docs": stream_ingest,
}

_LABELLED = "doc_id IN (SELECT doc_id FROM labels)"

ORACLES = {
    "read_element_docs": f"WITH {sql.ELEMENTS} SELECT doc_id, idx, type, text, text_as_html, page_number FROM elements",
    "read_item_docs": f"""WITH {sql.ITEMS} SELECT doc_id, type, question, value_text, value_bool, section, page_number
      , array_to_string(list_sort(CASE type WHEN 'checkbox' THEN ['page_number','question','section','type','value']
        WHEN 'image' THEN ['page_number','section','type'] ELSE ['page_number','section','type','value'] END), ',') AS keys
      FROM items""",
    "read_markdown_docs": "SELECT doc_id, source, text FROM documents WHERE trim(text, ' ' || chr(10)) <> ''",
    "read_ordered_lines": """SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS ordinal,
      unnest(string_split(text, chr(10))) AS line FROM documents""",
    "read_token_jsonl": """SELECT doc_id || ',' || array_to_string(list_transform(string_split(text, ' '), lambda w: length(w)), ',') AS ids,
      true AS no_mask FROM documents""",
    "read_gold_answers": """SELECT 'app' || item_id AS application_id, item_id % 5 + 1 AS question_id, text AS answer
      FROM benchmark""",
    "load_dataset": "SELECT doc_id, text, source FROM documents",
    "write_items": f"""WITH {sql.ITEMS} SELECT source || '/' || doc_id || '.json' AS key, source AS application,
      count(*) AS n_items, count(*) FILTER (type = 'checkbox') AS n_boxes, false AS malformed FROM items GROUP BY doc_id, source""",
    "write_jsonl": "SELECT text AS input FROM documents",
    "append_metrics_csv": f"""WITH {sql.PAIRS} SELECT pair_id, pair_id % 3 + 1 AS run, answer,
      {n_words('answer')} AS word_count_answ FROM pairs CROSS JOIN range(2)""",
    "write_report_csv": f"""WITH {hosted_sql}
      SELECT pair_id, printf('%.4f', latency) AS latency, printf('%.6f', total_cost) AS total_cost,
        printf('%.2f', throughput) AS throughput, printf('%.2f', flesch_reading_ease) AS flesch_reading_ease,
        printf('%.4f', accuracy) AS accuracy, printf('%.4f', consistency) AS consistency FROM hosted""",
    "upsert_chunks": f"""WITH {sql.FIXED_CHUNKS} SELECT 'md_' || doc_id || '_' || chunk AS chunk_id,
      md5(CASE WHEN {_LABELLED} THEN document ELSE 'later ' || document END) AS digest FROM fixed""",
    "populate_chunks": f"""WITH RECURSIVE {sql.SPLIT_CHUNKS}
      SELECT 'md_' || (row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), chunk) - 1) AS chunk_id,
        source AS application, doc_id || '.md' AS filename, md5(document) AS digest
      FROM numbered JOIN documents USING (doc_id)""",
    "stream_token_speed": SPEED,
    "stream_ingest_docs": f"""WITH {sql.ITEMS}
      SELECT doc_id, idx, type, question, value_text, value_bool, section, page_number FROM items""",
}
