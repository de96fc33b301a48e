"""SentencePiece encoding and decoding with a table of last tokens.

Merging leaves every prefix of a text with exactly one last token. A token ends a prefix
if the token that ends the rest before it is compatible with it, that is, if the two
strings merged together give these two tokens again. So one pass from left to right fills
a table: an automaton over the vocabulary names the tokens that end at a character, and
the pair test against the table's entry at the token's start leaves one of them. The ids
are read from the end of the table backwards. The work grows with the length of the text,
whatever it holds, and no merge queue over the text is needed.

Pairs are judged by merging the two strings as the library does, by score and then from
the left; verdicts are kept, as are the ids of short parts. A text is cut where no piece of
the vocabulary reaches across: before a blank or a mark that follows a letter, and around
characters that stand in no longer piece. Both caches are bounded.

The model file gives the vocabulary; it must be a merging (BPE) model that does not rewrite
characters and puts a blank before the text, which ``Pieces`` checks.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows
are encoded each; an empty table gives no rows. ``encode`` and ``decode`` keep all columns, but
for one that already has the new column's name.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Callable, Iterable
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.columns import arrow_function

MODEL = "piece_bpe_32k.model"
#: Parts and pair verdicts a worker keeps; beyond that the older half of the parts goes, and all verdicts.
KEPT_PARTS = 400_000
KEPT_PAIRS = 1_000_000
#: Only parts of so many characters at most are kept.
KEPT_LENGTH = 64

_BLANK = "▁"


def _keep(kept: dict, key, value, size: int) -> None:
    """Add to a dictionary of bounded size; the older half goes when it is full."""
    if len(kept) >= size:
        for old in list(islice(kept, size // 2)):
            del kept[old]
    kept[key] = value


class Pieces:
    """Encoder and decoder for one model file."""

    def __init__(self, model: str = MODEL) -> None:
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        file = SentencePieceProcessor(model_file=model if os.sep in model else public_tokenizers.path(model))
        ids = range(file.get_piece_size())
        plain = [i for i in ids if not (file.is_control(i) or file.is_unknown(i) or file.is_byte(i) or file.is_unused(i))]
        self.names = [file.id_to_piece(i) for i in ids]
        self.ids = {self.names[i]: i for i in plain}
        self.decimal = [str(i) for i in ids]
        self.scores = {self.names[i]: file.get_score(i) for i in plain}
        self.bytes = {int(self.names[i][3:5], 16): i for i in ids if file.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in ids if file.is_control(i)}
        self.shown: list[str | None] = list(self.names)
        for i in ids:
            if i in self.silent or file.is_unknown(i) or i in self.byte_of:
                self.shown[i] = "" if i in self.silent else " ⁇ " if file.is_unknown(i) else None
        if len(self.bytes) != 256 or file.encode("a  ﬁ ") != self._by_library_rules("a  ﬁ "):
            raise ValueError(f"{model} is no merging model with bytes, a blank in front and unchanged characters")

        if not all(c in self.ids for c in set().union(*self.ids)):
            raise ValueError(f"{model} has characters that are no pieces")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece) - 1, i))
        self.automaton.make_automaton()
        #: For each token the verdicts on tokens before it.
        self.pairs: list[dict[int, bool]] = [{} for _ in ids]
        self.judged = 0
        self.parts: dict[str, list[int]] = {}
        self.cut = re.compile(self._cuts())

    def _by_library_rules(self, text: str) -> list[int]:
        return [i for piece in self.merged(_BLANK + text.replace(" ", _BLANK)) for i in self._ids_of(piece)]

    def _cuts(self) -> str:
        """A pattern whose matches are the parts of a text, blanks already marked.

        ``alone``: characters of no longer piece. ``marks``: characters that follow no other kind of
        character inside a piece, so a text may be cut before the first of a run of them.
        """
        longer = [p for p in self.ids if len(p) > 1]
        follows = {(a, b) for p in longer for a, b in zip(p, p[1:])}
        if any(b == _BLANK != a for a, b in follows):
            return "(?s).+"
        inside = set().union(*longer)
        alone = {c for c in map(chr, range(0x80)) if c not in inside}
        marks = {c for c in inside if not c.isalpha()} - {_BLANK}
        while late := {b for a, b in follows if b in marks and a not in marks and a != _BLANK}:
            marks -= late
        one, run = ("".join(map(re.escape, sorted(chars))) for chars in (alone, marks))
        if not one or not run:
            return f"{_BLANK}*[^{_BLANK}]+|{_BLANK}+"
        return f"[{one}]|{_BLANK}*[{run}]*[^{_BLANK}{one}{run}]+|{_BLANK}*[{run}]+|{_BLANK}+"

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging neighbours, best score first, then from the left."""
        left, right = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        parts: list[str] = list(text)
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and right[i] < len(text):
                both = parts[i] + parts[right[i]]
                if both in self.scores:
                    heapq.heappush(queue, (-self.scores[both], i, both))

        for i in range(len(text) - 1):
            offer(i)
        while queue:
            _, i, both = heapq.heappop(queue)
            j = right[i]
            if parts[i] and j < len(text) and parts[i] + parts[j] == both:
                parts[i], parts[j] = both, ""
                right[i] = right[j]
                if right[j] < len(text):
                    left[right[j]] = i
                offer(left[i])
                offer(i)
        return [p for p in parts if p]

    def compatible(self, before: int, i: int) -> bool:
        """Whether the tokens stay two side by side; before -1, a text's start or a foreign character, one."""
        alone = [self.names[i]] if before < 0 else [self.names[before], self.names[i]]
        verdict = self.merged("".join(alone)) == alone
        if self.judged >= KEPT_PAIRS:
            self.judged = 0
            for verdicts in self.pairs:
                verdicts.clear()
        self.pairs[i][before] = verdict
        self.judged += 1
        return verdict

    def last_tokens(self, part: str) -> list[int]:
        """The last token of every prefix; -1 for the empty one and where a character is in no piece."""
        last, pairs = [-1] * (len(part) + 1), self.pairs
        for at, (less, i) in self.automaton.iter(part):
            if last[at + 1] < 0:
                before = last[at - less]
                fits = pairs[i].get(before)
                if fits or (fits is None and self.compatible(before, i)):
                    last[at + 1] = i
        return last

    def _ids_of(self, piece: str) -> Iterable[int]:
        if piece in self.ids:
            return (self.ids[piece],)
        return [self.bytes[b] for b in piece.encode()]

    def _part(self, part: str) -> list[int]:
        last, end, found, names = self.last_tokens(part), len(part), [], self.names
        while end:
            i = last[end]
            if i < 0:
                end -= 1
                found += [self.bytes[b] for b in reversed(part[end].encode())]
            else:
                end -= len(names[i])
                found.append(i)
        found.reverse()
        if len(part) <= KEPT_LENGTH:
            _keep(self.parts, part, found, KEPT_PARTS)
        return found

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            known = self.parts.get
            for part in self.cut.findall(_BLANK + text.replace(" ", _BLANK)):
                out += known(part) or self._part(part)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: bytes read as UTF-8, one replacement character a byte that is none."""
        out: list[str] = []
        raw, first, shown = bytearray(), True, self.shown
        for i in ids:
            piece = shown[i]
            if piece is None:
                raw.append(self.byte_of[i])
            else:
                if raw:
                    out.append(_read_bytes(bytes(raw)))
                    raw.clear()
                if first and piece.startswith(_BLANK):
                    piece = piece[1:]
                out.append(piece)
            first = first and i in self.silent
        out.append(_read_bytes(bytes(raw)))
        return "".join(out).replace(_BLANK, " ")


def _read_bytes(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def loader(model: str) -> Callable[[], Pieces]:
    """The model's ``Pieces``, loaded once in each worker."""
    kept: list[Pieces] = []

    def load() -> Pieces:
        if not kept:
            kept.append(Pieces(model))
        return kept[0]

    return load


def encode(docs: DataFrame, name: str = "ids", model: str = MODEL) -> DataFrame:
    """``docs`` with the ids of ``text`` in a new column."""
    load = loader(model)

    @arrow_function(pa.list_(pa.int32()))
    def ids(text: pa.Array) -> pa.Array:
        codec = load()
        return pa.array([codec.encode(t) for t in text.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(name, ids("text"))


def decode(tokens: DataFrame, name: str = "decoded", model: str = MODEL) -> DataFrame:
    """``tokens`` with the text of its ``ids`` in a new column; null ids are no ids."""
    load = loader(model)

    @arrow_function(pa.string())
    def text(ids: pa.Array) -> pa.Array:
        codec = load()
        return pa.array([codec.decode(i or ()) for i in ids.to_pylist()], pa.string())

    return tokens.withColumn(name, text("ids"))


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; ids are decoded in the task that found them."""
    load = loader(model)
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @arrow_function(kind)
    def both(text: pa.Array) -> pa.Array:
        codec, rows = load(), []
        for t in text:
            ids = codec.encode(t.as_py())
            listed = ",".join([codec.decimal[i] for i in ids])
            shas = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, codec.decode(ids))]
            rows.append({"n_tokens": len(ids), "ids_sha256": shas[0], "decoded_sha256": shas[1]})
        return pa.array(rows, kind)

    return docs.select("doc_id", both("text").alias("found")).select("doc_id", "found.*")
