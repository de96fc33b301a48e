"""Item to input line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the only line of a document without items.
EMPTY_DOCUMENT_LINE = "This file contains an image"


def _shown(text: Column) -> Column:
    return F.coalesce(text, F.lit("None"))


def shown_value(value_text: Column, value_bool: Column) -> Column:
    """A value as printed: True, False, the text, or None."""
    return _shown(F.coalesce(value_text, F.initcap(value_bool.cast("string"))))


def compose_input(
    kind: Column, section: Column, question: Column, value_text: Column, value_bool: Column
) -> Column:
    """The training line of an item; null for kinds that are not written."""
    section, value = _shown(section), shown_value(value_text, value_bool)
    return (
        F.when(kind == "text", F.concat(F.lit("Text: "), section, F.lit(" "), value))
        .when(kind == "header", F.concat(F.lit("Header: "), section, F.lit(" "), value))
        .when(
            kind == "checkbox",
            F.concat(
                F.lit("Checkbox: "), section, F.lit("QUESTION:"), _shown(question), F.lit(" ANSWER:"), value
            ),
        )
        .when(kind == "image", F.concat(F.lit("Image: "), section))
    )
