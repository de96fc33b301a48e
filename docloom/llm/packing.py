"""Best-fit packing planned on the histogram of lengths.

Documents are tokenised once. The pieces' lengths, at most ``capacity`` different
ones, are counted; best fit runs over those counts on the driver and yields a plan
of a few rows per length: pieces of length L with ranks r0..r1 go to sequences s0
onwards, so many to a sequence, from that offset on. Pieces then take their slots by
joining on (length, rank within length). The work of the driver depends on the number
of lengths, never on the number of documents; the plan is broadcast.

Ranks need no shuffle of pieces: tokenising tasks number the pieces of each length they
write, and the counts per task and length say where each task's numbers begin.

Defined results: a null or empty text is the end token alone; repeated rows are packed
each; an empty table gives no rows. Sequence numbers have no order of meaning.
"""

from __future__ import annotations

import base64
import bisect
import os
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.stored import stored

CAPACITY = 1024
VOCABULARY = "byte_bpe_50k"
END_ID = 2
#: Blanks in a row that the fast encoder surely takes (it has taken 500,000).
SAFE_BLANKS = 100_000
_BLANKS = re.compile(r"\s+")
#: Counts per task and length that are broadcast; more are joined by a shuffle.
BROADCAST_COUNTS = 250_000


def encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """A text to ids, equal to those of the ``tokenizers`` file ``vocabulary.json``.

    The rank file of the same vocabulary gives the same ids several times faster.
    Texts with the name of a special token, which only the JSON file knows, go to it, and so do
    those with a run of blanks so long that the fast encoder's pattern runs out of stack.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    place = lambda kind: vocabulary + kind if os.sep in vocabulary else public_tokenizers.path(vocabulary + kind)
    with open(place(".tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if "<|" not in text and not (len(text) > SAFE_BLANKS and any(m.end() - m.start() > SAFE_BLANKS for m in _BLANKS.finditer(text))):
            return fast.encode_ordinary(text)
        if not exact:
            exact.append(Tokenizer.from_file(place(".json")))
        return exact[0].encode(text, add_special_tokens=False).ids

    return encode


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID, keep_ids: bool = True
) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids; only the first may be shorter.

    ``task`` and ``nth`` (from 0, per task and length) number the pieces once they are stored.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"] + ["ids"] * keep_ids
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint" + ", ids array<int>" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(vocabulary), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                flat = np.array([*encode(text or ""), end_id], dtype="<u4")
                first = len(flat) % capacity or capacity
                for piece, start in enumerate([0, *range(first, len(flat), capacity)]):
                    part = flat[start : first if piece == 0 else start + capacity]
                    row = (doc, piece, start, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)], part.astype("i4"))
                    seen[len(part)] += 1
                    for column, value in zip(rows, row):
                        column.append(value)
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple]:
    """Best fit, longest first, over counts: (length, rank_from, rank_to, per_sequence, sequence, offset).

    Sequences with the same free space are kept as runs of consecutive numbers. A run
    takes as many pieces of the length as fit, sequence by sequence, which is what best
    fit does with equal pieces: a sequence just used has the least room of those that fit.
    """
    plan, room, free, next_sequence = [], {}, [], 0

    def give_back(space: int, run: tuple[int, int]) -> None:
        if space > 0 and run[1] > 0:
            if space not in room:
                room[space] = []
                bisect.insort(free, space)
            room[space].append(run)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                space = free[at]
                sequence, run = room[space].pop()
                if not room[space]:
                    del room[space]
                    free.pop(at)
            else:
                space, sequence, run = capacity, next_sequence, -(-left // (capacity // length))
                next_sequence += run
            fits, offset = space // length, capacity - space
            for each, uses in ((fits, min(run, left // fits)), (left % fits, 1)):
                if uses and each and run and left and (each == fits or left < fits):
                    plan.append((length, rank, rank + each * uses, each, sequence, offset))
                    give_back(space - each * length, (sequence, uses))
                    rank, left, sequence, run = rank + each * uses, left - each * uses, sequence + uses, run - uses
            give_back(space, (sequence, run))
    return plan


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (stored pieces) with ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    by_task = stored(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = spark.createDataFrame(
        best_fit(counts, capacity),
        "of_length bigint, rank_from bigint, rank_to bigint, each bigint, sequence bigint, free_from bigint",
    )
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if by_task.count() <= BROADCAST_COUNTS:
        first = F.broadcast(first)
    ranked = cut.join(first, ["task", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    planned = ranked.join(
        F.broadcast(plan),
        (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")),
    )
    at = F.col("rank") - F.col("rank_from")
    return planned.select(
        *[c for c in cut.columns if c not in ("task", "nth")],
        (F.col("sequence") + F.floor(at / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("free_from") + at % F.col("each") * F.col("length")).cast("bigint").alias("offset"),
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """All pieces of ``docs`` with their places, ids included unless ``keep_ids`` is false."""
    return place(stored(pieces(docs, capacity, vocabulary, end_id, keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Finished sequences: sequence_id, ids. A group holds ``capacity`` ids at most."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def digest(docs: DataFrame) -> DataFrame:
    return pack(docs, keep_ids=False)
