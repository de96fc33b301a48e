"""Personal data: fixed base patterns, and contexts learnt from what they find.

Base kinds (email, ip, card, phone) come from their patterns. Every base span is a seed:
the words around it make lexical patterns. Candidates are what stands in such contexts and
matches no base pattern: runs of neighbouring digit groups of any length, and tokens with four digits
or an at sign. Patterns with ``SUPPORT`` certain instances and their candidates form
a graph that Spark scores in turns, per kind: a pattern is as good as the mean of its
instances, an instance as good as its patterns together (noisy or), seeds of the kind
being certain and those of other kinds certainly not. Instances that reach ``ACCEPT`` are accepted, add
their places under the kind that took them, and are certain from then on: the contexts they
stand in become patterns of the next generation, until one accepts nothing. Base spans always stay.

Counting distinct instances, not places, keeps a passage copied a thousand times from
making its own context trustworthy. All counts cover all documents; hot contexts are
summed before they are shuffled, and no pattern's instances meet in one place.

Defined results: null or empty text has no spans; repeated rows are searched each (rows
are told apart by a number of their own in a stored table, never by doc_id); a place is
added once, under the kind with the higher score (then as listed).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.columns import arrow_function
from docloom.llm.decontaminate import free_name
from docloom.plans.stored import stored

KINDS = ("email", "ip", "card", "phone")
#: Distinct instances a pattern needs before it counts.
SUPPORT = 5
#: Instances of doubt a pattern starts with.
DOUBT = 1.0
ROUNDS = 3
#: Score from which an instance counts as personal data.
ACCEPT = 0.8
#: Characters looked at on either side of a span for context words.
REACH = 60

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# a match can only begin at the front of a run of digits: matches end at the end of one
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may be an identifier: digit groups with up to three marks or blanks between two of them, or any token.
_TOKEN = re.compile(r"(?P<run>\(?[0-9]++(?:[\x20().\-/]{1,3}[0-9]++)*+(?![^\s.,;:!?)\]}>\"']))|[^\s]+")
_EDGE = "\"'`.,;:!?()[]{}<>|=*"
_WORD = re.compile(r"[^\W\d_]+")


def emails(text: str) -> list[tuple[int, int]]:
    """The pattern ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` in linear time: from one at sign to the next."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((start, match.end()))
            free = match.end()
        else:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = []
    if text and "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if text and _DIGIT.search(text):
        if "." in text:
            parts = ((m, m.group().split(".")) for m in _IP.finditer(text))
            # a part may have thousands of digits, so none is turned into a number
            out += [(m.start(), 1, m.end()) for m, p in parts if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) < 256 for x in p)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def _contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: two words before it; one before and one behind."""
    before = [w.lower() for w in _WORD.findall(text[max(0, start - REACH) : start])[-2:]]
    after = [w.lower() for w in _WORD.findall(text[end : end + REACH])[:1]]
    out = [" ".join(before) + " _"] if len(before) == 2 else []
    return out + [f"{before[-1]} _ {after[0]}"] if before and after else out


def _candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Between the base spans: runs of neighbouring digit groups, and tokens of letters with digits or an at sign."""
    out, at = [], 0
    for a, _, b in [*sorted(taken), (len(text), 0, len(text))]:
        for m in _TOKEN.finditer(text, at, max(at, a)):
            found = m.group()
            whole = m["run"] and (found[0] != "(" or ")" in found)
            inner = found if whole else found.strip(_EDGE)
            if len(inner) >= 5 and ("@" in inner or sum(map(str.isdigit, inner)) >= 4):
                start = m.start() + found.find(inner)
                out.append((start, start + len(inner)))
        at = max(at, b)
    return out


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])
_SEEN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
_FOUND = pa.struct([("base", pa.list_(_SPAN)), ("seen", pa.list_(_SEEN))])


@arrow_function(_FOUND)
def find(text: pa.Array) -> pa.Array:
    """Base spans, and every seed or candidate (kind null) with its value and contexts."""
    out = []
    for t in text.to_pylist():
        base = base_spans(t)
        loose = _candidates(t, base) if t and (base or "@" in t or _DIGIT.search(t)) else []
        seen = [
            {"start": a, "end": b, "kind": k, "value": t[a:b].lower(), "patterns": _contexts(t, a, b)}
            for a, k, b in [*base, *((a, None, b) for a, b in loose)]
        ]
        out.append({"base": [{"start": a, "end": b, "kind": k} for a, k, b in base], "seen": [s for s in seen if s["patterns"]]})
    return pa.array(out, _FOUND)


def bootstrap(seen: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """(value, kind, score) of unseen instances that are accepted, from ``seen`` (kind, value, patterns)."""
    edges = seen.select("value", "kind", F.explode("patterns").alias("pattern"))
    # one edge per pattern and value; a value that is a seed anywhere is a seed
    edges = stored(edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "graph")
    loose = edges.where("kind IS NULL").select("pattern", "value")
    crowd = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    accepted = edges.sparkSession.createDataFrame([], "value string, kind int, score double")
    while True:
        # seeds and what earlier generations accepted
        known = edges.where("kind IS NOT NULL").select("pattern", "kind").unionByName(loose.join(accepted, "value").select("pattern", "kind"))
        sure = known.groupBy("pattern", "kind").agg(F.count("*").alias("sure")).where(F.col("sure") >= support)
        patterns = stored(sure.join(crowd, "pattern"), "patterns")
        fresh = stored(_accepted(loose.join(accepted, "value", "left_anti").join(patterns, "pattern"), patterns, rounds, accept), "accepted")
        if fresh.isEmpty():
            return accepted
        accepted = accepted.unionByName(fresh)


def _accepted(edges: DataFrame, patterns: DataFrame, rounds: int, accept: float) -> DataFrame:
    """(value, kind, score) of one generation: patterns and their instances score each other in turns."""
    edges = stored(edges, "open")
    scores = edges.select("value", "kind").distinct().withColumn("score", F.lit(0.0))
    for _ in range(rounds):
        soft = edges.join(scores, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("soft"))
        trust = patterns.join(soft, ["pattern", "kind"], "left").select(
            "pattern", "kind", ((F.col("sure") + F.coalesce("soft", F.lit(0.0))) / (F.col("n") + DOUBT)).alias("trust")
        )
        missed = F.sum(F.log1p(-F.least("trust", F.lit(0.999))))
        told = edges.select("value", "pattern", "kind").join(trust, ["pattern", "kind"])
        scores = stored(told.groupBy("value", "kind").agg((1 - F.exp(missed)).alias("score")), "scores")
    best = Window.partitionBy("value").orderBy(F.desc("score"), "kind")
    return scores.where(F.col("score") >= accept).withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def spans(docs: DataFrame, name: str, row: str, **settings: float) -> DataFrame:
    """``docs`` (stored) with a row number ``row`` and a struct ``name``: base and added spans."""
    marked = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(name, find("text"))
    marked = stored(marked, "spans")  # row numbers are fixed from here on
    seen = marked.select(F.col(row).alias("row"), F.explode(f"{name}.seen").alias("s")).select("row", "s.*")
    accepted = bootstrap(seen.select("kind", "value", "patterns"), **settings)
    added = seen.where("kind IS NULL").select("row", "start", "end", "value").join(accepted, "value")
    added = added.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end", "kind"))).alias("added"))
    added = added.select(F.col("row").alias(f"_{row}"), F.col("added").alias(f"_{name}"))
    joined = marked.join(added, F.col(row) == F.col(f"_{row}"), "left").drop(f"_{row}")
    none = F.expr("CAST(array() AS array<struct<start: bigint, end: bigint, kind: int>>)")
    return joined.withColumn(name, F.struct(F.col(f"{name}.base").alias("base"), F.coalesce(f"_{name}", none).alias("added"))).drop(f"_{name}")


@arrow_function(pa.string())
def _masked(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for t, found in zip(text.to_pylist(), spans.to_pylist()):
        parts, at = [], 0
        for s in sorted(found or [], key=lambda s: (s["start"], -s["end"])):
            if s["end"] > at:  # spans may overlap
                parts += [t[at : max(at, s["start"])], f"<{KINDS[s['kind']].upper()}>" if s["start"] >= at else ""]
                at = s["end"]
        out.append("".join([*parts, t[at:]]) if parts else t)
    return pa.array(out, pa.string())


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind (``<EMAIL>``); ``n_chars``, if there is one, follows the text."""
    name, row = free_name(docs, "found"), free_name(docs, "row")
    found = spans(docs, name, row)
    out = found.withColumn("text", _masked("text", F.concat(f"{name}.base", f"{name}.added"))).drop(name, row)
    lengths = {c.lower(): c for c in docs.columns}
    if "n_chars" in lengths:
        c = lengths["n_chars"]
        out = out.withColumn(c, F.length("text").cast(dict(docs.dtypes)[c]))
    return out.select(*docs.columns)


def _listed(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["kind"].alias("k"), s["end"].alias("e"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(kind, s["k"]), s["a"], s["e"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    found = spans(docs.select("doc_id", "text"), "found", "row")
    of = lambda k: F.size(F.filter("found.base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_listed(F.col("found.base")), 256).alias("base_sha256"),
        _listed(F.concat("found.base", "found.added")).alias("spans"),
        F.size("found.added").cast("bigint").alias("n_added"),
    )
