"""Extraction and item queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.compose import compose_input
from docloom.operators import extract as X
from docloom.operators import items as I
from docloom.operators.audit import corpus_audit
from docloom.plans.stored import stored
from docloom.registry import sql
from docloom.registry.tables import documents, elements, table

DOC = "doc_id"


def annotated(spark: SparkSession, d: str) -> DataFrame:
    return X.annotate_elements(elements(spark, d), DOC)


def items(spark: SparkSession, d: str) -> DataFrame:
    return X.extract_items(elements(spark, d), DOC)


def typed(spark: SparkSession, d: str) -> DataFrame:
    """Items with a few headers, unknown kinds and markup-only texts."""
    i = F.col("idx")
    return items(spark, d).select(
        "doc_id",
        "idx",
        F.when(i % 11 == 5, "table")
        .when((F.col("type") == "text") & (i % 7 == 3), "header")
        .otherwise(F.col("type"))
        .alias("type"),
        "question",
        F.when(F.col("value_text").isNotNull() & (i % 5 == 2), "<br> &nbsp;")
        .otherwise(F.col("value_text"))
        .alias("value_text"),
        "value_bool",
        F.when(i % 9 == 4, "<b></b>").otherwise(F.col("section")).alias("section"),
        "page_number",
    )


def normalise_elements(spark, d):
    return X.normalise_elements(elements(spark, d)).select("doc_id", "idx", "type", "text", "page_number")


def checkbox_state(spark, d):
    return annotated(spark, d).filter(F.col("state").isNotNull()).select("doc_id", "idx", "state")


def consume_label(spark, d):
    return annotated(spark, d).select("doc_id", "idx", "consumed")


def assign_section(spark, d):
    return annotated(spark, d).select("doc_id", "idx", "section")


def title_as_text(spark, d):
    return annotated(spark, d).filter(F.col("is_title") & ~F.col("consumed") & (F.col("text") != "")).select(
        "doc_id", "idx", F.col("text").alias("value"), "section"
    )


def pending_question(spark, d):
    return annotated(spark, d).filter("answers").select("doc_id", "idx", "pending")


def lookback_question(spark, d):
    return annotated(spark, d).filter(F.col("answers") & F.col("pending").isNull()).select(
        "doc_id", "idx", F.col("looked_back").alias("question")
    )


def count_items(spark, d):
    return X.count_items(items(spark, d), DOC, documents(spark, d))


def quarantine_docs(spark, d):
    e = stored(elements(spark, d).withColumn("null_text", F.col("text").isNull()), "elements")
    sound, rejected = X.quarantine_docs(e, DOC)
    per_doc = sound.groupBy(DOC).agg(F.count(F.lit(1)).alias("n_elements"))
    return per_doc.withColumn("rejected", F.lit(False)).unionByName(
        rejected.select(DOC, F.lit(0).cast("bigint").alias("n_elements"), F.lit(True).alias("rejected"))
    )


def route_by_type(spark, d):
    return I.route_by_type(typed(spark, d)).select("doc_id", "idx", "type")


def nonempty_after_clean(spark, d):
    return I.nonempty_after_clean(I.route_by_type(typed(spark, d))).select(
        "doc_id", "idx", "type", "value_text", "section"
    )


def order_by_type(spark, d):
    return I.order_by_type(stored(typed(spark, d), "items"), DOC).select("doc_id", "idx", "type", "out_idx")


def union_typed(spark, d):
    rows = stored(typed(spark, d), "items")

    def kind(name, *columns):
        return rows.filter(F.col("type") == name).select("doc_id", "idx", "type", "section", *columns)

    return I.union_typed(
        kind("text", "value_text"), kind("header", "value_text"),
        kind("checkbox", "question", "value_bool"), kind("image"),
    )


def has_type(spark, d):
    return I.has_type(typed(spark, d), DOC)


def compose(spark, d):
    line = compose_input(
        F.col("type"), F.col("section"), F.col("question"), F.col("value_text"), F.col("value_bool")
    )
    return I.route_by_type(typed(spark, d)).select("doc_id", "idx", line.alias("input"))


def compose_lines(spark, d):
    return I.compose_lines(stored(typed(spark, d), "items"), DOC, docs=documents(spark, d))


def empty_doc_line(spark, d):
    boxes = items(spark, d).filter(F.col("type") == "checkbox")
    return I.empty_doc_line(documents(spark, d), boxes, DOC)


def audit(spark, d):
    return corpus_audit(table(spark, d, "labels"), documents(spark, d), stored(items(spark, d), "items"), DOC)


def flagship(spark, d):
    """Lines per kind from documents to composed input."""
    found = stored(items(spark, d), "items")  # read for the lines and for the documents without any
    lines = I.compose_lines(found, DOC, docs=documents(spark, d))
    return lines.groupBy(F.substring_index("input", ":", 1).alias("kind")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("input")).cast("bigint").alias("n_chars")
    )


QUERIES = {
    "normalise_elements": normalise_elements,
    "checkbox_state": checkbox_state,
    "consume_label": consume_label,
    "assign_section": assign_section,
    "title_as_text": title_as_text,
    "pending_question": pending_question,
    "lookback_question": lookback_question,
    "extract_items": items,
    "count_items": count_items,
    "quarantine_docs": quarantine_docs,
    "route_by_type": route_by_type,
    "nonempty_after_clean": nonempty_after_clean,
    "order_by_type": order_by_type,
    "union_typed": union_typed,
    "has_type": has_type,
    "compose_input": compose,
    "compose_lines": compose_lines,
    "empty_doc_line": empty_doc_line,
    "corpus_audit": audit,
    "documents_to_lines": flagship,
}

_WRITTEN = "type IN ('text','header','checkbox','image')"
_LINE = """CASE type
  WHEN 'text' THEN 'Text: ' || section || ' ' || coalesce(value_text, 'None')
  WHEN 'header' THEN 'Header: ' || section || ' ' || coalesce(value_text, 'None')
  WHEN 'checkbox' THEN 'Checkbox: ' || section || 'QUESTION:' || question || ' ANSWER:' ||
    CASE value_bool WHEN true THEN 'True' WHEN false THEN 'False' ELSE 'None' END
  WHEN 'image' THEN 'Image: ' || section END"""
_SURVIVES = f"""(type = 'image' OR {sql.clean("coalesce(CASE WHEN type = 'checkbox' THEN question ELSE value_text END, 'MISSING')")} <> '')
  AND {sql.clean("coalesce(section, 'MISSING')")} <> ''"""

ORACLES = {
    "normalise_elements": f"WITH {sql.NORMALISED} SELECT doc_id, idx, type, text, page_number FROM plain",
    "checkbox_state": f"WITH {sql.STATES} SELECT doc_id, idx, state FROM stated WHERE state IS NOT NULL",
    "consume_label": f"WITH {sql.STATES} SELECT doc_id, idx, consumed FROM consumption",
    "assign_section": f"WITH {sql.ANNOTATED} SELECT doc_id, idx, section FROM annotated",
    "title_as_text": f"""WITH {sql.ANNOTATED} SELECT doc_id, idx, text AS value, section FROM annotated
      WHERE type = 'Title' AND NOT consumed AND text <> ''""",
    "pending_question": f"WITH {sql.ANNOTATED} SELECT doc_id, idx, pending FROM annotated WHERE answers",
    "lookback_question": f"""WITH {sql.ANNOTATED} SELECT doc_id, idx, looked_back AS question FROM annotated
      WHERE answers AND pending IS NULL""",
    "extract_items": f"""WITH {sql.ITEMS}
      SELECT doc_id, idx, type, question, value_text, value_bool, section, page_number FROM items""",
    "count_items": f"""WITH {sql.ITEMS}, per_type AS (SELECT doc_id, type, count(*) AS n FROM items GROUP BY ALL)
      SELECT doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_items,
        coalesce(string_agg(n || ' ' || type || CASE WHEN n <> 1 THEN 's' ELSE '' END, ', ' ORDER BY type), '') AS counts
      FROM documents LEFT JOIN per_type USING (doc_id) GROUP BY doc_id""",
    "quarantine_docs": f"""WITH {sql.ANNOTATED}, failing AS (
      SELECT DISTINCT doc_id FROM annotated WHERE NOT consumed AND (
        (contains(text_as_html, '<input class="Checkbox"') AND type <> 'Title'
          AND (coalesce(null1, false) OR coalesce(null_next, false)))
        OR (answers AND pending IS NULL AND (
          (idx-1 >= 1 AND null1)
          OR (idx-2 >= 1 AND null2 AND NOT (contains(back1,'?') OR back1 LIKE '%:'))
          OR (idx-3 >= 1 AND null3 AND NOT (contains(back1,'?') OR back1 LIKE '%:' OR contains(back2,'?') OR back2 LIKE '%:'))
          OR (idx-4 >= 1 AND null4 AND NOT (contains(back1,'?') OR back1 LIKE '%:' OR contains(back2,'?') OR back2 LIKE '%:'
              OR contains(back3,'?') OR back3 LIKE '%:'))))))
      SELECT doc_id, count(*) AS n_elements, false AS rejected FROM elements
      WHERE doc_id NOT IN (SELECT doc_id FROM failing) GROUP BY doc_id
      UNION ALL SELECT doc_id, 0, true FROM failing""",
    "route_by_type": f"WITH {sql.TYPED} SELECT doc_id, idx, type FROM typed WHERE {_WRITTEN}",
    "nonempty_after_clean": f"""WITH {sql.TYPED} SELECT doc_id, idx, type, value_text, section FROM typed
      WHERE {_WRITTEN} AND {_SURVIVES}""",
    "order_by_type": f"""WITH {sql.TYPED} SELECT doc_id, idx, type, row_number() OVER (PARTITION BY doc_id ORDER BY
      CASE type WHEN 'text' THEN 0 WHEN 'header' THEN 1 WHEN 'checkbox' THEN 2 ELSE 3 END, idx) AS out_idx
      FROM typed WHERE {_WRITTEN}""",
    "union_typed": f"""WITH {sql.TYPED} SELECT doc_id, idx, type, section,
      CASE WHEN type IN ('text','header') THEN value_text END AS value_text,
      CASE WHEN type = 'checkbox' THEN question END AS question,
      CASE WHEN type = 'checkbox' THEN value_bool END AS value_bool FROM typed WHERE {_WRITTEN}""",
    "has_type": f"""WITH {sql.TYPED} SELECT doc_id, bool_or(type='text') AS has_text, bool_or(type='header') AS has_header,
      bool_or(type='checkbox') AS has_checkbox, bool_or(type='image') AS has_image FROM typed GROUP BY doc_id""",
    "compose_input": f"WITH {sql.TYPED} SELECT doc_id, idx, {_LINE} AS input FROM typed WHERE {_WRITTEN}",
    "compose_lines": f"""WITH {sql.TYPED} SELECT doc_id, idx, {_LINE} AS input FROM typed
      WHERE {_WRITTEN} AND {_SURVIVES}
      UNION ALL SELECT doc_id, NULL, 'This file contains an image' FROM documents
      WHERE doc_id NOT IN (SELECT doc_id FROM typed)""",
    "empty_doc_line": f"""WITH {sql.ITEMS} SELECT doc_id, 'This file contains an image' AS input FROM documents
      WHERE doc_id NOT IN (SELECT doc_id FROM items WHERE type = 'checkbox')""",
    "corpus_audit": f"""WITH {sql.ITEMS}, shape AS (
        SELECT doc_id, 'page_number,' || CASE WHEN bool_or(type='checkbox') THEN 'question,' ELSE '' END || 'section,type'
          || CASE WHEN bool_or(type IN ('text','header','checkbox')) THEN ',value' ELSE '' END AS columns
        FROM items GROUP BY doc_id),
      expected AS (SELECT DISTINCT doc_id FROM labels), present AS (SELECT DISTINCT doc_id FROM documents)
      SELECT 'expected' AS measure, '' AS name, count(*) AS n FROM expected
      UNION ALL SELECT 'present', '', count(*) FROM present
      UNION ALL SELECT 'missing', '', count(*) FROM expected WHERE doc_id NOT IN (SELECT doc_id FROM present) HAVING count(*) > 0
      UNION ALL SELECT 'unlisted', '', count(*) FROM present WHERE doc_id NOT IN (SELECT doc_id FROM expected) HAVING count(*) > 0
      UNION ALL SELECT 'empty', '', count(*) FROM present WHERE doc_id NOT IN (SELECT doc_id FROM shape) HAVING count(*) > 0
      UNION ALL SELECT 'columns', columns, count(*) FROM shape GROUP BY columns
      UNION ALL SELECT 'items', type, count(*) FROM items GROUP BY type""",
    "documents_to_lines": f"""WITH {sql.ITEMS}, lines AS (SELECT {_LINE} AS input FROM items WHERE {_SURVIVES}
        UNION ALL SELECT 'This file contains an image' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM items))
      SELECT string_split(input, ':')[1] AS kind, count(*) AS n_lines, CAST(sum(length(input)) AS BIGINT) AS n_chars
      FROM lines GROUP BY kind""",
}
