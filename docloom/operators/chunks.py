"""Chunking and chunk numbering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.lookup import lookup

# Fixed values of the splitter.
CHUNK_SIZE = 2000
CHUNK_OVERLAP = 300
SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Cut before every separator, so that each later piece starts with it."""
    if separator == "":
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in [first, *(separator + r for r in rest)] if p]


def _merged(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbouring pieces up to ``size``; the next chunk repeats the tail."""
    start = total = 0
    for end, piece in enumerate(pieces):
        if total + len(piece) > size and end > start:
            yield "".join(pieces[start:end])
            while total > overlap or (total > 0 and total + len(piece) > size):
                total -= len(pieces[start])
                start += 1
        total += len(piece)
    if start < len(pieces):
        yield "".join(pieces[start:])


def split_text(
    text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators=SEPARATORS
) -> Iterator[str]:
    """Chunks of one text: coarse separators first, finer ones for long pieces."""
    at = next(i for i, s in enumerate(separators) if s in text)
    finer = separators[at + 1 :]
    waiting: list[str] = []

    def flush() -> Iterator[str]:
        stripped = (chunk.strip() for chunk in _merged(waiting, size, overlap))
        yield from (chunk for chunk in stripped if chunk)

    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            waiting.append(piece)
            continue
        yield from flush()
        waiting = []
        if finer:
            yield from split_text(piece, size, overlap, finer)
        else:
            yield piece
    yield from flush()


def chunk_documents(
    docs: DataFrame,
    key: str = "path",
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    rows_per_batch: int = 512,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(key, chunk, document) and the columns in ``keep``; chunk counts from 0 inside each document.

    Whole texts go through Arrow batches; a document is split on its own, so no
    shuffle is needed.
    """
    carried = [key, *keep]
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)

    def split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), rows_per_batch):
                part = batch.iloc[at : at + rows_per_batch]
                found = [
                    (*own, n, chunk)
                    for *own, body in zip(*[part[c] for c in carried], part[text])
                    if body and body.strip()
                    for n, chunk in enumerate(split_text(body, size, overlap))
                ]
                if found:
                    yield pd.DataFrame(found, columns=[*carried, "chunk", "document"])

    return docs.select(*carried, text).mapInPandas(
        split_batches, schema=f"{types}, chunk bigint, document string"
    )


def chunk_fixed(
    docs: DataFrame,
    key: str = "path",
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Chunks of ``size`` characters every ``size - overlap``, inside the JVM."""
    stride = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / stride), F.lit(1)) - 1
    return (
        docs.filter(F.length(text) > 0)
        .select(key, text, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk"))
        .select(
            key,
            "chunk",
            F.substring(F.col(text), (F.col("chunk") * stride + 1).cast("int"), F.lit(size)).alias("document"),
        )
    )


def number_chunks(
    chunks: DataFrame, key: str = "path", prefix: str = "md_", digits: int = 5
) -> DataFrame:
    """Add ``chunk_id``: one running number over all documents.

    Documents come in the order of the md5 of their key, which cuts evenly into
    prefixes; numbers count per document first and per prefix next, so the
    chunks themselves are never brought together. ``chunks`` is read twice, so
    pass a stored table where making the chunks is the expensive part.
    """
    per_doc = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"))
    placed = _running_start(per_doc, key, digits)
    return lookup(chunks, placed, [key], ["chunk"]).withColumn(
        "chunk_id", F.concat(F.lit(prefix), (F.col("start") + F.col("chunk")).cast("string"))
    ).drop("start")


def _running_start(per_doc: DataFrame, key: str, digits: int) -> DataFrame:
    """(key, start): chunks of all earlier documents."""
    tagged = per_doc.withColumn("digest", F.md5(F.col(key).cast("string"))).withColumn(
        "part", F.substring("digest", 1, digits)
    )
    before_part = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        tagged.groupBy("part")
        .agg(F.sum("n_chunks").alias("in_part"))
        .select("part", F.coalesce(F.sum("in_part").over(before_part), F.lit(0)).alias("part_start"))
    )
    before_doc = (
        Window.partitionBy("part").orderBy("digest", key).rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.coalesce(F.sum("n_chunks").over(before_doc), F.lit(0))
    return (
        tagged.withColumn("inside", inside)
        .join(parts, "part")
        .select(key, (F.col("part_start") + F.col("inside")).cast("bigint").alias("start"))
    )
