"""Language-model scores from Brown classes.

Every word has one class. The ``CLUSTERED`` most frequent words start in ``CLASSES``
classes by rank and are moved by exchange clustering: each word in turn to the class that
raises the likelihood of the class bigrams most. All other words of the training rows start
in the class of their ending and are then placed once in any of the classes, the more frequent
ones (``HEAD``) before the rest: each goes where the model makes all its training occurrences
most probable. Only words that no training row has stay with their ending. The end of a text
is a class of its own and also stands before its first word. With class transitions and word emissions

    P(text) = product of P(class | class before) * P(word | class)

Counts of words, classes and transitions cover all training documents, and every training
word is placed. What is bounded is what one process holds: the words exchanged in turn, the
dictionary of frequent words tasks have (``HEAD``), and the matrix of class bigrams. A rarer word's
neighbours and its counts and class are met by shuffles, where no word is frequent enough to be hot; a
frequent word's neighbours come as one row a task, and only counts of classes are kept of them.

Emissions are (c + 0.5) / (N_class + 0.5 (V_class + 1)), transitions are smoothed with
``PRIOR`` observations of the class's share of all tokens.

Defined results: a null or empty text is one end token; a null doc_id trains; repeated rows
count and are scored each; without training rows every count is zero.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.columns import arrow_function
from docloom.llm.words import blank_words
from docloom.plans.stored import shuffles_dropped, stored
from docloom.session import work_folder, work_scope

FOLDS, HELD_OUT = 5, 1
HEAD = 131_072
CLUSTERED = 1_024
CLASSES = 32
#: Classes of endings for all other words.
ENDINGS = 64
SWEEPS = 5
PRIOR = 50.0
#: Distinct words a task counts before it hands them on.
FLUSH = 200_000
#: Occurrences a task holds the neighbours of before it hands them on.
SEEN = 2_000_000


def held_out(doc_id: Column) -> Column:
    text = doc_id.cast("string")
    return F.coalesce(F.crc32(text.cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def count_words(train: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``train`` (text); the end token is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(blank_words(text))
                seen[b""] += 1
                if len(seen) > FLUSH:
                    yield _counted(seen)
                    seen = Counter()
        if seen:
            yield _counted(seen)

    return train.select("text").mapInArrow(count, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _counted(seen: Counter) -> pa.RecordBatch:
    words = pa.array(list(seen.keys()), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(seen.values(), pa.int64())], ["word", "c"])


def neighbours(train: DataFrame, index: dict[bytes, int], units: np.ndarray, width: int, start: int) -> DataFrame:
    """(word, seen): the units before and after each word numbered ``start`` or higher; (pair, c): bigrams of units.

    ``index`` numbers words, ``units`` has the unit of each number; all others have the unit of their ending and
    numbers from ``len(units)`` on. The last of ``width`` units is the end's, those before it are the endings'.
    """
    shipped = train.sparkSession.sparkContext.broadcast((index, units))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, units = shipped.value
        sums, rest, held, size = np.zeros(width * width, np.int64), {}, [], 0
        for batch in batches:
            words = [b""]
            for text in batch.column(0).to_pylist():
                words += blank_words(text)
                words.append(b"")
            ids = np.array([index.get(w, -1) for w in words], np.int64)
            lost = np.nonzero(ids < 0)[0].tolist()
            at = units[ids]
            at[lost] = [width - 1 - ENDINGS + _ending(words[k]) for k in lost]
            sums += np.bincount(at[:-1] * width + at[1:], minlength=width * width)
            if start == len(units):
                ids[lost] = [start + rest.setdefault(words[k], len(rest)) for k in lost]
            places = np.nonzero(ids >= start)[0]  # neither the first nor the last, which are ends
            held.append((ids[places], np.stack([at[places - 1], at[places + 1]], axis=1).astype(np.uint16)))
            size += len(places)
            if size > SEEN or len(rest) > FLUSH:
                yield _seen(held, [*index, *rest])
                rest, held, size = {}, [], 0
        if size:
            yield _seen(held, [*index, *rest])
        used = np.nonzero(sums)[0]
        none = [pa.nulls(len(used), pa.string()), pa.nulls(len(used), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(used), pa.array(sums[used])], ["word", "seen", "pair", "c"])

    return train.select("text").mapInArrow(count, "word string, seen binary, pair bigint, c bigint")


def _seen(held: list[tuple[np.ndarray, np.ndarray]], names: list[bytes]) -> pa.RecordBatch:
    """A row for each word: all its pairs of neighbours, two bytes each."""
    ids, around = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    starts = np.nonzero(np.diff(ids, prepend=-1))[0]
    offsets = pa.py_buffer((4 * np.append(starts, len(ids))).astype(np.int32))
    seen = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(around[order].tobytes())])
    words = pa.array([names[i] for i in ids[starts].tolist()], pa.binary()).cast(pa.string())
    none = pa.nulls(len(starts), pa.int64())
    return pa.RecordBatch.from_arrays([words, seen, none, none], ["word", "seen", "pair", "c"])


def _bigrams(pairs: DataFrame, width: int) -> np.ndarray:
    """The matrix of (pair, c): at most width * width rows, whatever the corpus."""
    sums = pairs.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(width * width)
    out[sums.column("pair").to_numpy()] = sums.column("c").to_numpy()
    return out.reshape(width, width)


def exchange(bigrams: np.ndarray, movable: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of every unit: the first ``movable`` are exchanged, the others keep a class each."""
    units = len(bigrams)
    at = np.concatenate([np.arange(movable) % classes, classes + np.arange(units - movable)])
    total = classes + units - movable

    def xlogx(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1.0))

    pairs = np.zeros((total, total))
    np.add.at(pairs, (at[:, None].repeat(units, 1), at[None, :].repeat(units, 0)), bigrams)
    out, into = pairs.sum(axis=1), pairs.sum(axis=0)
    for _ in range(sweeps):
        moved = 0
        for u in range(movable):
            own, self_pair = at[u], bigrams[u, u]
            right = np.bincount(at, weights=bigrams[u], minlength=total)
            left = np.bincount(at, weights=bigrams[:, u], minlength=total)
            right[own] -= self_pair
            left[own] -= self_pair
            n_out, n_in = right.sum() + self_pair, left.sum() + self_pair
            pairs[own] -= right
            pairs[:, own] -= left
            pairs[own, own] -= self_pair
            out[own] -= n_out
            into[own] -= n_in
            rows, cols = pairs[:classes], pairs[:, :classes].T
            diagonal = np.arange(classes)
            gain = (xlogx(rows + right) - xlogx(rows)).sum(axis=1) + (xlogx(cols + left) - xlogx(cols)).sum(axis=1)
            both = pairs[diagonal, diagonal]
            gain -= xlogx(both + right[:classes]) + xlogx(both + left[:classes]) - xlogx(both)
            gain += xlogx(both + right[:classes] + left[:classes] + self_pair)
            gain -= xlogx(out[:classes] + n_out) - xlogx(out[:classes]) + xlogx(into[:classes] + n_in) - xlogx(into[:classes])
            best = int(gain.argmax())
            best = own if gain[best] <= gain[own] + 1e-9 else best
            moved += best != own
            at[u] = best
            pairs[best] += right
            pairs[:, best] += left
            pairs[best, best] += self_pair
            out[best] += n_out
            into[best] += n_in
        if not moved:
            break
    return at


def _of_classes(bigrams: np.ndarray, at: np.ndarray, total: int) -> np.ndarray:
    pairs = np.zeros((total, total))
    np.add.at(pairs, (at[:, None].repeat(len(at), 1), at[None, :].repeat(len(at), 0)), bigrams)
    return pairs


def _logs(pairs: np.ndarray, tokens: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of transitions and of what the emissions of each class are divided by."""
    share = (pairs.sum(axis=0) + 1) / (pairs.sum() + len(pairs))
    return np.log10((pairs + PRIOR * share) / (pairs.sum(axis=1, keepdims=True) + PRIOR)), np.log10(tokens + 0.5 * (types + 1))


def best_classes(seen: np.ndarray, own: np.ndarray, pairs: np.ndarray, tokens: np.ndarray, types: np.ndarray) -> np.ndarray:
    """The class in which the model makes what was seen around each word most probable.

    ``seen``: a row for each word, counts of the classes before it and then of those after it; ``own``: the class
    it stands in, which is judged without the word's own occurrences and stays unless another one is better.
    """
    total, c = len(pairs), seen[:, : len(pairs)].sum(axis=1)
    steps, emit = _logs(pairs, tokens, types)
    gain = seen @ np.concatenate([steps[:, :-1], steps[:-1].T]) - c[:, None] * emit[:-1]
    before, after = seen[:, :total], seen[:, total:]
    into, all_of = pairs.sum(axis=0), pairs.sum(axis=1)
    share = (into + 1) / (into.sum() + total)
    shift = PRIOR * (into[own] - c + 1) / (into.sum() + total)
    stay = (before * np.log10((pairs[:, own].T - before + shift[:, None]) / (all_of + PRIOR))).sum(axis=1)
    stay += (after * np.log10((pairs[own] - after + PRIOR * share) / (all_of[own] - c + PRIOR)[:, None])).sum(axis=1)
    stay -= c * np.log10(tokens[own] - c + 0.5 * types[own])
    rows = np.arange(len(seen))
    gain[rows, own] = stay
    best = gain.argmax(axis=1)
    return np.where(gain[rows, best] > stay + 1e-9, best, own)


def place(found: DataFrame, at: np.ndarray, pairs: np.ndarray, tokens: np.ndarray, types: np.ndarray) -> DataFrame:
    """(word, c, class) of every word of ``neighbours``, all moved at once from the class of their ending; ``at``: the class of each unit."""
    total = len(pairs)
    shipped = found.sparkSession.sparkContext.broadcast((at, pairs, tokens, types))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, *model = shipped.value

        def chosen(names: list[str], seen: np.ndarray) -> pa.RecordBatch:
            own = np.array([total - 1 - ENDINGS + _ending(w.encode()) for w in names], np.int64)
            columns = [pa.array(names, pa.string()), pa.array(seen[:, :total].sum(axis=1).astype(np.int64))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(best_classes(seen, own, *model).astype(np.int32))], ["word", "c", "class"])

        # rows of one word follow each other; of the last one only its counts are kept for the next batch
        names, seen = [], np.zeros((0, 2 * total))
        for batch in batches:
            if not batch.num_rows:
                continue
            words, lists = batch.column("word").to_pylist(), batch.column("seen").to_pylist()
            new = np.array([True, *(a != b for a, b in zip(words[1:], words))])
            group = np.cumsum(new) - 1
            codes = at[np.frombuffer(b"".join(lists), np.uint16)]
            codes[1::2] += total
            cells = np.repeat(group * 2 * total, [len(x) // 2 for x in lists]) + codes
            counts = np.bincount(cells, minlength=(group[-1] + 1) * 2 * total).reshape(-1, 2 * total).astype(float)
            firsts = [words[i] for i in np.nonzero(new)[0].tolist()]
            if names and names[0] == firsts[0]:
                counts[0] += seen[0]
            else:
                firsts, counts = names + firsts, np.concatenate([seen, counts])
            yield chosen(firsts[:-1], counts[:-1])
            names, seen = firsts[-1:], counts[-1:]
        yield chosen(names, seen)

    rows = found.where("word IS NOT NULL").select("word", "seen").repartition("word").sortWithinPartitions("word")
    return rows.mapInArrow(choose, "word string, c bigint, class int")


def _whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, sorted by the first column, in batches that hold all rows of a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(0)[-1]
        cut = pc.index(batch.column(0), last).as_py()
        if held and (cut or held[0].column(0)[0] != last):
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _paths(rows: DataFrame, rest: DataFrame, index: dict[bytes, int], of_class: np.ndarray, counts: np.ndarray, total: int) -> DataFrame:
    """doc_id, trained, n_tokens, n_known, emitted (the logs of its tokens' counts) and path (a byte for the class of each token) of every row."""
    shipped = rows.sparkSession.sparkContext.broadcast((index, of_class, np.append(np.log10(counts + 0.5), 0.0), np.append(counts > 0, False)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with the classes tasks know, and one for each of its rarer words with their places."""
        index, of_class, weight, known = shipped.value
        for batch in batches:
            texts, paths, rare_rows, rare_words, places = [], [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [*blank_words(text), b""]
                ids = np.array([index.get(w, -1) for w in words], np.int64)
                texts.append((len(words), int(known[ids].sum()), float(weight[ids].sum())))
                paths.append(of_class[ids].tobytes())
                rare: dict[bytes, list[int]] = {}
                for k in np.nonzero(ids < 0)[0].tolist():
                    rare.setdefault(words[k], []).append(k)
                rare_rows += [row] * len(rare)
                rare_words += rare
                places += [np.array(x, np.int32).tobytes() for x in rare.values()]
            n, m = len(texts), len(rare_rows)
            numbers = list(zip(*texts)) or [[]] * 3
            # the key of a text's own row is no word, so it meets no count and no other row
            keys = [f" {row}".encode() for row in batch.column(0).to_pylist()] + rare_words
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column(0), pa.array(rare_rows, pa.int64())]),
                    pa.array(keys, pa.binary()).cast(pa.string()),
                    pa.array([None] * n + places, pa.binary()),
                    pa.concat_arrays([batch.column(2), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([batch.column(3), pa.nulls(m, pa.bool_())]),
                    *[pa.array([*numbers[k], *[None] * m], pa.int64()) for k in (0, 1)],
                    pa.array([*numbers[2], *[None] * m], pa.float64()),
                    pa.array(paths + [None] * m, pa.binary()),
                ],
                ["row", "word", "places", "doc_id", "trained", "n_tokens", "known", "sure", "path"],
            )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_rows(batches):
            own, rare = (batch.filter(f(batch.column("path"))) for f in (pc.is_valid, pc.is_null))
            sizes = own.column("n_tokens").to_numpy()
            starts = np.cumsum(sizes) - sizes
            path = np.frombuffer(b"".join(own.column("path").to_pylist()), np.uint8).copy()
            of = np.searchsorted(own.column("row").to_numpy(), rare.column("row").to_numpy())
            lists = rare.column("places").to_pylist()
            n, c = np.array([len(x) // 4 for x in lists], np.int64), rare.column("c").to_numpy()
            path[np.repeat(starts[of], n) + np.frombuffer(b"".join(lists), np.int32)] = np.repeat(rare.column("class").to_numpy(), n)
            emitted = own.column("sure").to_numpy() + np.bincount(of, n * np.log10(c + 0.5), len(sizes))
            known = own.column("known").to_numpy() + np.bincount(of, n * (c > 0), len(sizes)).astype(np.int64)
            bounds = pa.py_buffer(np.append(starts, len(path)).astype(np.int32))
            packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, bounds, pa.py_buffer(path)])
            columns = [own.column(k) for k in ("doc_id", "trained", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(known), pa.array(emitted), packed], ["doc_id", "trained", "n_tokens", "n_known", "emitted", "path"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "text", F.col("doc_id").cast("bigint"), "trained")
    schema = "row bigint, word string, places binary, doc_id bigint, trained boolean, n_tokens bigint, known bigint, sure double, path binary"
    unseen = total - 1 - ENDINGS + F.crc32(F.substring(F.col("word").cast("binary"), -2, 2)) % ENDINGS
    told = numbered.mapInArrow(read, schema).join(rest, "word", "left").withColumn("class", F.coalesce("class", unseen).cast("int"))
    told = told.select("row", "places", F.coalesce("c", F.lit(0)).alias("c"), "class", "doc_id", "trained", "n_tokens", "known", "sure", "path")
    filled = "doc_id bigint, trained boolean, n_tokens bigint, n_known bigint, emitted double, path binary"
    return told.repartition("row").sortWithinPartitions("row").mapInArrow(fill, filled)


def _steps_of(paths: DataFrame, total: int) -> DataFrame:
    """(pair, c): bigrams of classes over all rows; every path ends with the end token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(total * total, np.int64)
        for batch in batches:
            at = np.frombuffer(bytes([total - 1]) + b"".join(batch.column(0).to_pylist()), np.uint8).astype(np.int64)
            sums += np.bincount(at[:-1] * total + at[1:], minlength=total * total)
        used = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["pair", "c"])

    return paths.select("path").mapInArrow(count, "pair bigint, c bigint")


def score(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    spark, kept = docs.sparkSession, work_folder(docs.sparkSession, "paths")
    rows = docs.select("doc_id", "text", train.alias("trained"))
    learn = rows.where("trained")
    with work_scope(spark, "classes"), shuffles_dropped(spark):
        counts = stored(count_words(learn), "counts")
        n_train, n_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        head = counts.where("word <> ''").orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
        ends = counts.where("word = ''").first()
        words = [b"", *head.column("word").cast(pa.binary()).to_pylist()]
        head_counts = np.append(float(ends["c"]) if ends else 0.0, head.column("c").to_numpy())
        index = {w: i for i, w in enumerate(words)}
        movable = min(CLUSTERED, len(words) - 1)
        classes = max(1, min(CLASSES, movable))
        total = classes + ENDINGS + 1

        # the most frequent words in turn, then all others of the dictionary, then the rest
        width = movable + ENDINGS + 1
        units = np.array([width - 1, *range(movable), *(movable + _ending(w) for w in words[1 + movable :])])
        found = stored(neighbours(learn, index, units, width, 1 + movable), "frequent")
        bigrams = _bigrams(found, width)
        at = exchange(bigrams, movable, classes)
        of_class = at[units]
        tail = F.crc32(F.substring(F.col("word").cast("binary"), -2, 2)) % ENDINGS
        sizes = counts.where("word <> ''").groupBy(tail.alias("ending")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
        tokens, types = np.zeros(total), np.zeros(total)
        for r in sizes:
            tokens[classes + r["ending"]], types[classes + r["ending"]] = r["c"], r["v"]
        tokens[-1], types[-1] = head_counts[0], float(head_counts[0] > 0)

        def move(numbers: np.ndarray, now: np.ndarray) -> None:
            """Words leave the class of their ending."""
            for i, c in zip(numbers.tolist(), now.tolist()):
                for to, sign in ((c, 1), (classes + _ending(words[i]), -1)):
                    tokens[to] += sign * head_counts[i]
                    types[to] += sign

        move(np.arange(1, 1 + movable), of_class[1 : 1 + movable])
        placed = place(found, at, _of_classes(bigrams, at, total), tokens, types).select("word", "class").toArrow()
        numbers = np.array([index[w] for w in placed.column("word").cast(pa.binary()).to_pylist()], np.int64)
        of_class[numbers] = placed.column("class").to_numpy()
        move(numbers, of_class[numbers])
        found = stored(neighbours(learn, index, of_class, total, len(words)), "rare")
        rest = stored(place(found, np.arange(total), _bigrams(found, total), tokens, types), "rest")
        drawn = rest.groupBy("class", tail.alias("ending")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
        for r in drawn:
            for to, sign in ((r["class"], 1), (classes + r["ending"], -1)):
                tokens[to] += sign * r["c"]
                types[to] += sign * r["v"]
        paths = stored(_paths(rows, rest, index, of_class.astype(np.uint8), head_counts, total), "paths", kept)
    steps, emit = _logs(_bigrams(_steps_of(paths.where("trained"), total), total), tokens, types)
    shipped = spark.sparkContext.broadcast((steps, emit))

    @arrow_function(pa.float64())
    def classed(path: pa.Array) -> pa.Array:
        steps, emit = shipped.value
        lists = path.to_pylist()
        after = np.frombuffer(b"".join(lists), np.uint8)
        before = np.append(len(emit) - 1, after[:-1])[: len(after)]
        starts = np.cumsum([0, *(len(x) for x in lists)])[:-1]
        return pa.array(np.add.reduceat(steps[before, after] - emit[after], starts) if len(after) else np.zeros(0))

    return paths.select(
        "doc_id",
        "trained",
        "n_tokens",
        "n_known",
        F.lit(int(n_train)).cast("bigint").alias("train_tokens"),
        (F.col("emitted") - F.col("n_tokens") * float(np.log10(n_train + 0.5 * (n_words + 1)))).alias("base_score"),
        (F.col("emitted") + classed("path")).alias("score"),
    )


def digest(docs: DataFrame) -> DataFrame:
    scored = score(docs, ~held_out(F.col("doc_id")))
    return scored.select(
        "doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
