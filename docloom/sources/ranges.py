"""Large JSON arrays read by many tasks.

A file is cut at every closing brace by Spark's splittable line reader, so each task reads a
byte range of it. Whether a brace closes an element of the array or stands in a string or deeper
down depends on all that comes before. Each row therefore tells what it does to the two things
that matter, being inside a string and the depth, for both ways it may be entered; a prefix
sum over the rows of a range, and one over the ranges of a file, then says which braces end an
element. The rows between two of them are put together again and parsed on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.plans.segments import carry_in
from docloom.plans.stored import stored

#: Files beyond this size are read in ranges; smaller ones are one row each.
WHOLE_BYTES = 64 << 20


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")


def _depth(text: Column) -> Column:
    """Brackets opened less brackets closed outside strings, for text that starts outside of one."""
    bare = F.regexp_replace(text, '"[^"]*("|$)', "")
    return _count(bare, "{[") - _count(bare, "}]")


def large_files(spark: SparkSession, folder: str, glob: str, beyond: int) -> DataFrame:
    """Rows between closing braces of the files with more than ``beyond`` bytes; the listing leaves out all others."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("lineSep", "}")
        .text(folder)
        .where(F.col("_metadata.file_size") > beyond)
        .select(
            F.col("_metadata.file_path").alias("doc_path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
            "value",
        )
    )


def array_parts(rows: DataFrame) -> DataFrame:
    """(doc_path, part, body): a stored table of the elements' texts, without the array's brackets and commas.

    Part k holds what ends with the k-th closing brace of an element; the last one what comes behind.
    ``body`` is null where the text cannot be part of an array.
    """
    clean = F.regexp_replace("value", r"(?s)\\.", "")
    told = rows.withColumns(
        {
            "quotes": _count(clean, '"'),
            "entered_outside": _depth(clean),
            "entered_inside": _depth(F.regexp_replace(clean, '^[^"]*("|$)', "")),
        }
    )
    before = Window.partitionBy("doc_path", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("doc_path", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))

    told = carry_in(told, ["doc_path"], "block", {"earlier_quotes": ("sum", F.sum("quotes"))})
    inside = (F.col("earlier_quotes") + so_far("quotes", before)) % 2 == 1
    told = told.withColumn("inside", inside)
    # the brace behind the row counts where the row ends outside a string
    closed = (F.col("inside").cast("bigint") + F.col("quotes")) % 2 == 0
    told = told.withColumns(
        {"closed": closed, "change": F.when(F.col("inside"), F.col("entered_inside")).otherwise(F.col("entered_outside")) - closed.cast("bigint")}
    )
    told = carry_in(told, ["doc_path"], "block", {"earlier_depth": ("sum", F.sum("change"))})
    told = told.withColumn("ends", F.col("closed") & (F.col("earlier_depth") + so_far("change", up_to) == 1))
    told = carry_in(told, ["doc_path"], "block", {"earlier_parts": ("sum", F.sum(F.col("ends").cast("bigint")))})
    told = told.withColumn("part", F.col("earlier_parts") + so_far(F.col("ends").cast("bigint"), before))

    pieces = F.sort_array(F.collect_list(F.struct("block", "row", "value"))).alias("pieces")
    parts = told.groupBy("doc_path", "part").agg(pieces, F.max("ends").alias("whole"))
    text = F.concat(F.array_join("pieces.value", "}"), F.when(F.col("whole"), "}").otherwise(""))
    begun = F.when(F.col("part") == 0, F.regexp_extract(text, r"(?s)^\s*\[(.*)$", 1))
    begun = begun.otherwise(F.regexp_extract(text, r"(?s)^\s*,(.*\S.*)$", 1))
    fits = F.when(F.col("part") == 0, text.rlike(r"^\s*\[")).otherwise(text.rlike(r"(?s)^\s*,\s*[^\]\s]"))
    # what follows the last element: the closing bracket, perhaps after elements that are no objects
    alone = (F.col("part") > 0) & text.rlike(r"^\s*\]\s*$")
    end = F.regexp_extract(begun, r"(?s)^(.*)\]\s*$", 1)
    body = F.when(F.col("whole"), F.when(fits, begun)).when(alone, F.lit("")).when(fits & text.rlike(r"\]\s*$"), end)
    return stored(parts.select("doc_path", "part", "whole", body.alias("body")), "array_parts")


def large_arrays(spark: SparkSession, folder: str, glob: str, beyond: int = WHOLE_BYTES) -> DataFrame | None:
    """(doc_path, broken, n_elements, idx, element) of all large files, or None where there are none.

    A file that is no JSON array is one row with ``broken`` set, and an empty array one without an element,
    as when a file is read whole. Content behind the closing bracket makes an array broken.
    """
    rows = large_files(spark, folder, glob, beyond)
    if rows.isEmpty():
        return None
    parts = array_parts(rows)
    array = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), "body", F.lit("]"))), "$", "array<variant>")
    parsed = parts.withColumn("array", array)
    # one row a part, so no file is brought together for its numbers
    counted = parsed.select("doc_path", "part", "whole", F.size("array").cast("bigint").alias("n"), F.col("array").isNull().alias("bad"))
    counted = counted.withColumn("stretch", F.floor(F.col("part") / 100_000))
    counted = stored(
        carry_in(
            counted,
            ["doc_path"],
            "stretch",
            {"earlier": ("sum", F.sum("n")), "broken": ("any", F.max(F.col("bad"))), "ended": ("any", F.max(~F.col("whole")))},
        ),
        "counted",
    )
    inner = Window.partitionBy("doc_path", "stretch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("earlier") + F.coalesce(F.sum("n").over(inner), F.lit(0))
    broken = F.col("broken") | ~F.col("ended")
    files = counted.groupBy("doc_path").agg(F.max(broken).alias("broken"), F.sum("n").alias("n_elements"))
    places = counted.where(~broken).select("doc_path", "part", offset.alias("offset"))
    elements = parsed.join(places, ["doc_path", "part"]).select("doc_path", "offset", F.posexplode("array").alias("at", "element"))
    totals = files.where(~F.col("broken")).select("doc_path", "n_elements")
    found = elements.join(totals, "doc_path").select(
        "doc_path", F.lit(False).alias("broken"), "n_elements", (F.col("offset") + F.col("at")).alias("idx"), "element"
    )
    # a null variant from the parser, since a literal one cannot be written
    nothing = F.try_parse_json(F.lit(None).cast("string"))
    empty = files.where(F.col("broken") | (F.col("n_elements") == 0)).select(
        "doc_path",
        "broken",
        F.when(~F.col("broken"), F.col("n_elements")).alias("n_elements"),
        F.lit(None).cast("bigint").alias("idx"),
        nothing.alias("element"),
    )
    return found.unionByName(empty)
