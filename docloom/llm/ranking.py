"""Ranked lexical search for many items at once, sharing what their terms have in common.

The items' terms are mined for shared sets before any document is read: the pair of
accumulators that most items hold together becomes an accumulator of its own, in rounds,
until no two items share a pair. That gives a graph whose leaves are single terms and whose
inner nodes are sums of two others. A batch of documents computes every node once, as
one vector over its documents, level by level; an item's scores are the sum of the few
nodes left to it. A term an item holds n times enters as the powers of two that make up n.

Documents are read twice: once for their lengths and the counts of query terms, which are
stored, and for the counts over all documents that weigh the terms; then the stored counts
are scored. Tasks keep the best ``k`` of each item and hand on nothing else.

Memory: a graph is made for items with ``BLOCK_TERMS`` distinct terms in all (or for a single
longer item); more items are dealt over several graphs and the documents read for each. ``NUMBERS``
bounds the accumulators a task holds at a time. Pairs are mined among ``BAND`` accumulators of similar
frequency, which bounds the mining and changes no score.

Defined results: a null or empty text has no terms and is in no result; documents with a null
id count in the statistics and are not ranked; repeated rows are documents each; rows of one item
id are one item, equal ones once; items with a null id or without terms have no results; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.words import letter_words
from docloom.plans.stored import stored

BEST = 10
BLOCK_TERMS = 100_000
NUMBERS = 4_000_000
BAND = 32


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, n) for every item, equal rows of an item counted once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms, counts = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for term, n in Counter(letter_words(text)).items():
                    rows.append(row)
                    terms.append(term)
                    counts.append(n)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.binary()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "term", "n"])

    kind = items.schema["item_id"].dataType.simpleString()
    texts = items.select("item_id", "text").dropna().distinct()
    return texts.mapInArrow(count, f"item_id {kind}, term binary, n bigint").groupBy("item_id", "term").agg(F.sum("n").alias("n"))


class Graph:
    """Accumulators: ``leaves`` are (term number, power of two), ``sums`` pairs of earlier ones, ``left`` an item's."""

    def __init__(self, items: list[dict[bytes, int]]) -> None:
        self.terms = {t: i for i, t in enumerate(sorted(set().union(*items)))}
        numbers: dict[tuple[int, int], int] = {}
        self.left = [
            {
                numbers.setdefault((self.terms[t], bit), len(numbers))
                for t, n in sorted(item.items())
                for bit in range(n.bit_length())
                if n >> bit & 1
            }
            for item in items
        ]
        self.leaves = np.array(list(numbers), np.int64).reshape(-1, 2)
        self.sums: list[tuple[int, int]] = []
        self.levels: list[np.ndarray] = []  # rows of (sum, one, other)
        while self._share():
            pass

    def _share(self) -> bool:
        """One round of mining: disjoint pairs, those of most items first."""
        held = Counter(node for item in self.left for node in item)
        pairs: Counter = Counter()
        for item in self.left:
            common = sorted((-held[node], node) for node in item if held[node] > 1)
            for at in range(0, len(common), BAND):
                pairs.update(combinations(sorted(node for _, node in common[at : at + BAND]), 2))
        partner: dict[int, tuple[int, int]] = {}
        used, level, size = set(), [], len(self.leaves)
        for (a, b), n in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
            if n > 1 and a not in used and b not in used:
                used |= {a, b}
                partner[a] = (b, size + len(self.sums))
                level.append((size + len(self.sums), a, b))
                self.sums.append((a, b))
        for item in self.left:
            for a in [node for node in item if node in partner and partner[node][0] in item]:
                b, both = partner[a]
                item -= {a, b}
                item.add(both)
        if level:
            self.levels.append(np.array(level))
        return bool(level)

    def scores(self, parts: np.ndarray) -> np.ndarray:
        """Scores (items, documents) from what each term (terms, documents) adds."""
        nodes = np.empty((len(self.leaves) + len(self.sums), parts.shape[1]), np.int64)
        nodes[: len(self.leaves)] = parts[self.leaves[:, 0]] << self.leaves[:, 1:]
        for level in self.levels:
            nodes[level[:, 0]] = nodes[level[:, 1]] + nodes[level[:, 2]]
        return np.array([nodes[sorted(item)].sum(axis=0) for item in self.left])


def postings(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, counts of every document with terms; only the given ones are listed."""
    shipped = docs.sparkSession.sparkContext.broadcast(terms)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shipped.value
        for batch in batches:
            rows, sizes, listed, counts = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                words = letter_words(text)
                if words:
                    held = {number[t]: n for t, n in Counter(words).items() if t in number}
                    rows.append(row)
                    sizes.append(len(words))
                    listed.append(held.keys())
                    counts.append(held.values())
            lists = [pa.array([list(x) for x in column], pa.list_(pa.int32())) for column in (listed, counts)]
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(read, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


def weights(found: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the weight of each term, from stored postings."""

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_terms, np.int64)
        for batch in batches:
            sums += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        used = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["term", "df"])

    n_docs, length = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(n_terms)
    # one row a term of the block
    for row in found.select("terms").mapInArrow(holders, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row["term"]] = row["df"]
    return n_docs, length, np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


class _Best:
    """The best ``k`` documents of each item so far."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.scores, self.ids = k, [np.zeros(0, np.int64)] * items, [np.zeros(0, np.int64)] * items

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for item, new in enumerate(scores):
            least = self.scores[item][-1] if len(self.scores[item]) == self.k else 1
            good = np.nonzero(new >= least)[0]
            if len(good):
                both = np.concatenate([self.scores[item], new[good]]), np.concatenate([self.ids[item], ids[good]])
                order = np.lexsort((both[1], -both[0]))[: self.k]
                self.scores[item], self.ids[item] = both[0][order], both[1][order]


def _rank_block(docs: DataFrame, items: list[dict[bytes, int]], k: int) -> DataFrame:
    """(item, doc_id, score): every task's best ``k`` of each item, numbered by their places in ``items``."""
    graph = Graph(items)
    found = stored(postings(docs, graph.terms), "postings")
    n_docs, length, weight = weights(found, len(graph.terms))
    shipped = docs.sparkSession.sparkContext.broadcast(graph)
    some = max(1, NUMBERS // (len(graph.leaves) + len(graph.sums) + len(graph.terms) + len(items)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shipped.value
        best = _Best(len(items_of := graph.left), k)
        for whole in batches:
            for at in range(0, len(whole), some):
                batch = whole.slice(at, some)
                ids, n = (batch.column(c).to_numpy() for c in (0, 1))
                m = 25 + 75 * n * n_docs // length
                sizes = np.diff(batch.column(2).offsets.to_numpy())
                place = np.repeat(np.arange(len(batch)), sizes)
                term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                parts = np.zeros((len(weight), len(batch)), np.int64)
                parts[term, place] = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[place]))
                best.add(graph.scores(parts), ids)
        count = [len(best.ids[i]) for i in range(len(items_of))]
        if sum(count):
            columns = [np.repeat(np.arange(len(count), dtype=np.int32), count), np.concatenate(best.ids), np.concatenate(best.scores)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item", "doc_id", "score"])

    return found.where("doc_id IS NOT NULL AND size(terms) > 0").mapInArrow(score, "item int, doc_id bigint, score bigint")


def rank(docs: DataFrame, items: DataFrame, k: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the best ``k`` documents with a score of each item, ties by id."""
    spark = docs.sparkSession
    wanted = stored(item_terms(items), "item_terms")
    blocks = max(1, -(-wanted.count() // block_terms))
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, doc_id bigint, score bigint")
    for block in range(blocks):
        held: dict = defaultdict(dict)
        for row in wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator():
            held[row["item_id"]][bytes(row["term"])] = row["n"]
        if held:
            names = spark.createDataFrame(list(enumerate(held)), f"item int, item_id {kind}")
            out = out.unionByName(_rank_block(docs, list(held.values()), k).join(F.broadcast(names), "item").drop("item"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


_SQL_TERMS = (
    "unnest(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
)
ORACLE = f"""
WITH words AS (SELECT doc_id, {_SQL_TERMS.format("text")} AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
sizes AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sizes),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
norms AS (SELECT doc_id, 25 + CAST(75 * n * docs AS BIGINT) // length AS m FROM sizes, totals),
parts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS part FROM tf JOIN weights USING (term) JOIN norms USING (doc_id)),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_SQL_TERMS.format("text")} AS term FROM benchmark) GROUP BY item_id, term),
scores AS (SELECT item_id, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {BEST}
"""


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return rank(docs, benchmark)
