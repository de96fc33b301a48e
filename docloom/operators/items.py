"""Routing, filtering, ordering and composing of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.compose import EMPTY_DOCUMENT_LINE, compose_input
from docloom.functions.text import clean_text, is_blank, survives_cleaning
from docloom.plans.segments import position

# Fixed value: item kinds that are written, in output order.
WRITTEN_TYPES = ("text", "header", "checkbox", "image")


def route_by_type(items: DataFrame) -> DataFrame:
    return items.filter(F.col("type").isin(*WRITTEN_TYPES))


def _subject() -> Column:
    """What has to be non-empty besides the section: value, question or nothing."""
    return F.when(F.col("type") == "checkbox", F.col("question")).otherwise(
        F.coalesce(F.col("value_text"), F.initcap(F.col("value_bool").cast("string")))
    )


def _survives() -> Column:
    spoken = (F.col("type") == "image") | survives_cleaning(_subject())
    return spoken & survives_cleaning(F.col("section"))


def nonempty_after_clean(items: DataFrame) -> DataFrame:
    """Keep items whose text and section are not empty once cleaned; both stay raw."""
    return items.filter(_survives())


def skip_blank(df: DataFrame, column: str) -> DataFrame:
    return df.filter(~is_blank(F.col(column)))


def type_rank() -> Column:
    rank = F.when(F.col("type") == WRITTEN_TYPES[0], 0)
    for place, kind in enumerate(WRITTEN_TYPES[1:], start=1):
        rank = rank.when(F.col("type") == kind, place)
    return rank


def order_by_type(
    items: DataFrame, doc: str = "doc_path", segment_rows: int = 1_000_000
) -> DataFrame:
    """Add ``out_idx``: texts, headers, checkboxes, images, each in source order."""
    ranked = route_by_type(items).withColumn("type_rank", type_rank())
    block = F.floor(F.col("idx") / segment_rows).cast("bigint")
    return position(
        ranked,
        [doc],
        [F.col("type_rank"), F.col("idx")],
        [F.col("type_rank"), block],
        "out_idx",
    ).drop("type_rank")


def union_typed(texts: DataFrame, headers: DataFrame, boxes: DataFrame, images: DataFrame) -> DataFrame:
    """One frame from the four kinds, which need not have the same columns."""
    out = texts
    for other in (headers, boxes, images):
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def has_type(items: DataFrame, doc: str = "doc_path") -> DataFrame:
    """Per document, which kinds occur."""
    return items.groupBy(doc).agg(
        *[F.bool_or(F.col("type") == kind).alias(f"has_{kind}") for kind in WRITTEN_TYPES]
    )


def compose_lines(
    items: DataFrame, doc: str = "doc_path", apply_cleaning: bool = False, docs: DataFrame | None = None
) -> DataFrame:
    """(doc, idx, input) for every item that is written.

    A row with a null ``idx`` stands for a document without items and becomes
    the fixed line, unless the file is ``malformed``: such a file is no document.
    So does every document of ``docs``, if given, that ``items`` lacks. Cleaning
    decides what is kept; the text is written as it is unless ``apply_cleaning`` is set.
    """
    if "malformed" in items.columns:
        items = items.filter(~F.col("malformed"))
    if docs is not None:
        items = items.unionByName(_bare(docs, items, doc), allowMissingColumns=True)
    bare = F.col("idx").isNull()
    written = items.filter(bare | (F.col("type").isin(*WRITTEN_TYPES) & _survives()))
    if apply_cleaning:
        written = written.withColumns(
            {
                name: F.when(F.col(name).isNotNull(), clean_text(F.col(name)))
                for name in ("section", "question", "value_text")
            }
        )
    line = compose_input(
        F.col("type"), F.col("section"), F.col("question"), F.col("value_text"), F.col("value_bool")
    )
    return written.select(
        doc, "idx", F.when(bare, EMPTY_DOCUMENT_LINE).otherwise(line).alias("input")
    )


def empty_doc_line(docs: DataFrame, items: DataFrame, doc: str = "doc_path") -> DataFrame:
    """The fixed line for every document that has no items."""
    return _bare(docs, items, doc).select(doc, F.lit(EMPTY_DOCUMENT_LINE).alias("input"))


def _bare(docs: DataFrame, items: DataFrame, doc: str) -> DataFrame:
    """Documents without items; a malformed file is none."""
    if "malformed" in docs.columns:
        docs = docs.filter(~F.col("malformed"))
    return docs.select(doc).distinct().join(items.select(doc).distinct(), doc, "left_anti")
