"""Periodic runs of words, found by convolving blocks with the text that follows them.

A run of period q and at least 4 q words holds, at the scale B = 2^s with B <= q < 2 B, a
block of B words that starts at a multiple of B and stands again q words later. So every
block meets the windows at distances B to 2 B - 1 behind it, all of them at once: the sum of
squared differences of word numbers is a convolution, computed by a number-theoretic
transform over as many primes as the largest possible sum needs, so a zero is exactly a
match. Distances at which enough neighbouring blocks match seed a run, which is then
extended word by word to both ends. Scales go from small to large; what lies in a known run
of a period that divides the distance is that run again.

Blocks that cannot match are not transformed: those with a word that does not come again
within 2 B, and those whose windows lie inside a known run of a smaller period. Both are
exact. All blocks of one scale in an Arrow batch are transformed together, some at a time,
so memory is bounded by ``AT_ONCE`` and the longest text; the time is about n log n transform
steps for n words, whatever the text repeats.

Defined results: a null or empty text has no words, no runs and collapses to the empty text;
equal rows are treated each; a null id is an id like any other and rewrites nothing in the
query; an empty table gives no rows. ``runs`` and ``collapse`` keep all columns, but for one that
already has the new column's name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.columns import arrow_function

#: A run has so many periods and so many words at least. Fewer than 4 periods break the argument above.
PERIODS = 4
LEAST = 6
#: Numbers transformed together.
AT_ONCE = 1 << 20

#: Primes k * 2^e + 1 below 2^32 and a generator of each.
PRIMES = ((3221225473, 5), (3489660929, 3), (2281701377, 3))

Run = tuple[int, int, int]  # start, length, period


class _Transform:
    """Number-theoretic transforms of rows of ``size`` (a power of two) numbers modulo one prime."""

    def __init__(self, prime: int, generator: int, size: int) -> None:
        self.prime, self.size = np.uint64(prime), size
        self.shrink = np.uint64(pow(size, -1, prime))
        root = pow(generator, (prime - 1) // size, prime)
        self.forth, self.back = (self._powers(r) for r in (root, pow(root, -1, prime)))

    def _powers(self, root: int) -> list[np.ndarray]:
        """For each halving of the size the powers its butterflies multiply with."""
        powers = np.ones(max(1, self.size // 2), np.uint64)
        done, step = 1, root  # step is root^done
        while done < len(powers):
            powers[done : 2 * done] = self.modulo(powers[:done] * np.uint64(step))
            done, step = 2 * done, pow(step, 2, int(self.prime))
        return [powers[:: 1 << k] for k in range(self.size.bit_length() - 1)]

    def modulo(self, x: np.ndarray) -> np.ndarray:
        return x - x // self.prime * self.prime

    def once(self, x: np.ndarray) -> np.ndarray:
        """``modulo`` for numbers below twice the prime: the difference wraps round where it is negative."""
        return np.minimum(x, x - self.prime)

    def forward(self, rows: np.ndarray) -> np.ndarray:
        """In place, to bit-reversed order."""
        for powers in self.forth:
            half = len(powers)
            parts = rows.reshape(len(rows), -1, 2, half)
            low, high = parts[:, :, 0], parts[:, :, 1]
            total, less = low + high, low + (self.prime - high)
            parts[:, :, 1] = self.modulo(self.once(less) * powers)
            parts[:, :, 0] = self.once(total)
        return rows

    def inverse(self, rows: np.ndarray) -> np.ndarray:
        """In place, from bit-reversed order."""
        for powers in reversed(self.back):
            half = len(powers)
            parts = rows.reshape(len(rows), -1, 2, half)
            low, high = parts[:, :, 0], self.modulo(parts[:, :, 1] * powers)
            total, less = low + high, low + (self.prime - high)
            parts[:, :, 1], parts[:, :, 0] = self.once(less), self.once(total)
        return self.modulo(rows * self.shrink)


class Matcher:
    """Finds where blocks stand again in the text behind them."""

    def __init__(self) -> None:
        self.transforms: dict[tuple[int, int], _Transform] = {}

    def zeros(self, words: np.ndarray, starts: np.ndarray, block: int, largest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(indexes into ``starts``, distances) of all exact matches at distances block .. 2 block - 1.

        ``words`` are numbers up to ``largest`` with 3 ``block`` of padding behind them.
        """
        some = max(1, AT_ONCE // (2 * block))
        for at in range(0, len(starts), some):
            rows = starts[at : at + some, None]
            left = words[rows + np.arange(block)]
            right = words[rows + np.arange(block, 3 * block)]
            zero, bound = None, 1
            for prime, generator in PRIMES:
                found = self._differences(left, right, block, prime, generator) == 0
                zero = found if zero is None else zero & found
                bound *= prime
                if bound > block * largest * largest:
                    break
            else:
                # sums may exceed the product of all primes: compare what is left directly
                zero &= [[np.array_equal(x, y[d : d + block]) if z else False for d, z in enumerate(row)] for x, y, row in zip(left, right, zero)]
            index, distance = np.nonzero(zero)
            yield at + index, distance + block

    def _differences(self, left: np.ndarray, right: np.ndarray, block: int, prime: int, generator: int) -> np.ndarray:
        """Sums of squared differences modulo ``prime`` for the ``block`` windows of each row."""
        size = 2 * block
        if (prime, size) not in self.transforms:
            self.transforms[prime, size] = _Transform(prime, generator, size)
        t = self.transforms[prime, size]
        x, y = t.modulo(left), t.modulo(right)
        turned = np.zeros((len(x), size), np.uint64)
        turned[:, :block] = x[:, ::-1]
        products = t.inverse(t.modulo(t.forward(turned) * t.forward(y.copy())))[:, block - 1 : 2 * block - 1]
        squares = np.cumsum(np.pad(t.modulo(y * y), ((0, 0), (1, 0))), axis=1, dtype=np.uint64)
        both = squares[:, block : 2 * block] - squares[:, :block] + t.modulo(x * x).sum(axis=1, dtype=np.uint64)[:, None]
        return t.modulo(t.modulo(both) + np.uint64(2) * (t.prime - products))


class _Text:
    """One text of a batch: its words as numbers, the runs found so far."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.runs = words, []

    def cover(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """For every block the end and the period of the run of a period below ``block`` around it and the next.

        Two such runs that share 2 ``block`` words would be one, so there is one at most.
        """
        end, period = (np.zeros(len(self.words) // block, np.int64) for _ in range(2))
        for start, length, q in self.runs:
            if q < block and length >= 2 * block:
                first, last = -(-start // block), (start + length) // block - 1
                end[first:last], period[first:last] = start + length, q
        return end, period

    def extend(self, low: int, high: int, q: int) -> None:
        """Add the run in which words low .. high - 1 equal those q behind, if it is long enough."""
        words, n = self.words, len(self.words)
        while low and words[low - 1] == words[low - 1 + q]:
            low -= 1
        while high + q < n and words[high] == words[high + q]:
            high += 1
        length = high + q - low
        if length >= max(LEAST, PERIODS * q):
            self.runs.append((low, length, q))


def find_runs(texts: list[np.ndarray], matcher: Matcher | None = None) -> list[list[Run]]:
    """All runs of each text, given as word numbers from 0, ordered by start, then period."""
    matcher = matcher or Matcher()
    found = [_Text(words) for words in texts]
    sizes = np.array([len(words) for words in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate([*texts, np.zeros(0, np.int64)])
    again = _next_distance(flat, sizes)
    block = 1
    while len(sizes) and PERIODS * block <= sizes.max():
        padded = np.concatenate([flat, np.zeros(3 * block, np.int64)]).astype(np.uint64)
        hopeless = np.concatenate([[0], np.cumsum(again >= 2 * block)])
        owners, numbers, largest, covers = [], [], 0, {}
        for i in np.nonzero(sizes >= PERIODS * block)[0]:
            numbered = np.arange(sizes[i] // block - 1)
            at = offsets[i] + numbered * block
            wanted = hopeless[at + block] == hopeless[at]
            if wanted.any():
                if found[i].runs:
                    covers[i] = end, period = found[i].cover(block)
                    wanted &= numbered * block + 3 * block > end[: len(wanted)]
                owners.append(np.full(wanted.sum(), i))
                numbers.append(numbered[wanted])
                largest = max(largest, int(texts[i].max()))
        if owners:
            owner, number = np.concatenate(owners), np.concatenate(numbers)
            matched = list(matcher.zeros(padded, offsets[owner] + number * block, block, largest))
            index = np.concatenate([m[0] for m in matched])
            distance = np.concatenate([m[1] for m in matched])
            _seed(found, owner[index], number[index], distance, block, sizes, covers)
        block *= 2
    return [sorted(text.runs, key=lambda run: (run[0], run[2])) for text in found]


def _next_distance(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How far behind each word the same word stands again in its text; very far where it does not."""
    far = np.iinfo(np.int64).max
    span = int(flat.max(initial=0)) + 1
    order = np.argsort(np.repeat(np.arange(len(sizes)), sizes) * span + flat, kind="stable")
    owner = np.repeat(np.arange(len(sizes)), sizes)[order]
    same = (flat[order][1:] == flat[order][:-1]) & (owner[1:] == owner[:-1])
    out = np.full(len(flat), far)
    out[order[:-1]] = np.where(same, order[1:] - order[:-1], far)
    return out


def _seed(found: list[_Text], owner: np.ndarray, number: np.ndarray, distance: np.ndarray, block: int, sizes: np.ndarray, covers: dict) -> None:
    """Extend every chain of neighbouring blocks that match at one distance and is long enough."""
    last = number * block + block + distance
    keep = last <= sizes[owner]
    for i, (end, period) in covers.items():
        mine = slice(*np.searchsorted(owner, (i, i + 1)))  # matches come text by text
        q = period[number[mine]]
        keep[mine] &= (q == 0) | (last[mine] > end[number[mine]]) | (distance[mine] % np.maximum(q, 1) > 0)
    owner, number, distance = owner[keep], number[keep], distance[keep]
    order = np.lexsort((number, distance, owner))
    owner, number, distance = owner[order], number[order], distance[order]
    if not len(owner):
        return
    breaks = np.nonzero((np.diff(owner) != 0) | (np.diff(distance) != 0) | (np.diff(number) != 1))[0] + 1
    first = np.concatenate([[0], breaks])
    count = np.diff(np.concatenate([first, [len(owner)]]))
    # a run matches over (PERIODS - 1) q words, and so many whole blocks lie in them wherever they begin
    enough = count >= np.maximum(1, ((PERIODS - 1) * distance[first] - block + 1) // block)
    for at, n in zip(first[enough], count[enough]):
        low = int(number[at]) * block
        found[owner[at]].extend(low, low + int(n) * block, int(distance[at]))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Numbers of the words that no run holds behind its first period."""
    marks = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        marks[start + q] += 1
        marks[start + length] -= 1
    return np.nonzero(np.cumsum(marks[:n]) == 0)[0]


def blank_split(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, as they stand."""
    return text.encode().split() if text else []


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def runs(docs: DataFrame, name: str = "runs") -> DataFrame:
    """``docs`` with all runs of ``text`` in a new column, ordered by start, then period."""

    @arrow_function(_RUNS)
    def find(text: pa.Array) -> pa.Array:
        found = find_runs([numbered(blank_split(t)) for t in text.to_pylist()])
        return pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found], _RUNS)

    return docs.withColumn(name, find("text"))


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with the first period of every run left in ``text``, words joined by single blanks."""

    @arrow_function(pa.string())
    def shorten(text: pa.Array) -> pa.Array:
        texts = [blank_split(t) for t in text.to_pylist()]
        found = find_runs([numbered(words) for words in texts])
        return pa.array([b" ".join(ws[i] for i in kept_words(len(ws), rs)).decode() for ws, rs in zip(texts, found)], pa.string())

    return docs.withColumn("text", F.when(F.col("text").isNotNull(), shorten("text")))


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The query's rule: in a tenth of the documents the words from some place on repeat."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


_DIGEST = pa.struct(
    [(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    + [(c, pa.string()) for c in ("runs_sha256", "collapsed_sha256")]
)


def _summary(words: list[bytes], found: list[Run]) -> dict:
    start, length, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{a},{n},{p}\n" for a, n, p in found)
    return {
        "n_runs": len(found),
        "start": start,
        "length": length,
        "period": q,
        "exponent_milli": 1000 * length // q if found else None,
        "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(b" ".join(words[i] for i in kept_words(len(words), found))).hexdigest(),
    }


def digest(docs: DataFrame, change: Callable[[list[bytes], int | None], list[bytes]] = rewritten) -> DataFrame:
    """Runs of every document's words after ``change``, the longest run, and what is left of the text."""

    @arrow_function(_DIGEST)
    def find(doc_id: pa.Array, text: pa.Array) -> pa.Array:
        texts = [change(blank_split(t), d) for d, t in zip(doc_id.to_pylist(), text.to_pylist())]
        found = find_runs([numbered(words) for words in texts])
        return pa.array([_summary(ws, rs) for ws, rs in zip(texts, found)], _DIGEST)

    return docs.select("doc_id", find(F.col("doc_id").cast("bigint"), "text").alias("found")).select("doc_id", "found.*")


_MATCHED = f"""
WITH split AS (
  SELECT doc_id, crc, CAST(floor(crc / 10) AS BIGINT) AS g, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS raw
  FROM (SELECT doc_id, text, xor(list_reduce([4294967295] || bits, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS crc
    FROM (SELECT doc_id, text, flatten([[(ascii(d) >> k) & 1 FOR k IN range(8)] FOR d IN string_split(CAST(doc_id AS VARCHAR), '')]) AS bits FROM documents))),
places AS (SELECT *, len(raw) AS n, g % len(raw) AS a FROM split),
docs AS (
  SELECT doc_id, n, CASE WHEN crc % 10 = 0 AND n > 0
    THEN raw[:a] || [raw[CAST(a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1 AS BIGINT)] FOR i IN range(a, n)] ELSE raw END AS w FROM places),
words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM docs),
pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y
    ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND {PERIODS} * (y.i - x.i) <= x.n),
stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island
  HAVING count(*) + q >= greatest({LEAST}, {PERIODS} * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length)"""

#: Stretches of equal period come from islands of equal words q apart; the smallest q of one place is its period.
ORACLE = f"""{_MATCHED},
longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS line FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (doc_id) LEFT JOIN longest USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
