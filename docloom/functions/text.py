"""Text cleaning columns.

Everything runs inside the JVM except the two Unicode repairs Spark has no
expression for; those go through one Arrow function that only receives the rows
a cheap pattern cannot rule out.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Python's idea of whitespace in Java syntax.
WS = r"[\s\x1c-\x1f]"

# Named character references decoded from html text; '&amp;' last.
ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#34;": '"',
    "&#39;": "'",
    "&#x27;": "'",
    "&apos;": "'",
    "&nbsp;": " ",
    "&#160;": " ",
    "&copy;": "©",
    "&reg;": "®",
    "&middot;": "·",
    "&pound;": "£",
    "&euro;": "€",
    "&hellip;": "…",
    "&ndash;": "–",
    "&mdash;": "—",
    "&lsquo;": "‘",
    "&rsquo;": "’",
    "&ldquo;": "“",
    "&rdquo;": "”",
    "&amp;": "&",
}

_NO_BREAK = re.compile("&(?:nbsp|#0*160(?![0-9])|#[xX]0*[aA]0(?![0-9A-Fa-f]));?")

# Below U+0300 every string is already in composed form.
_MAY_BE_DECOMPOSED = r"[\x{300}-\x{10FFFF}]"
# UTF-8 read as latin-1 or windows-1252: bytes 80 to BF as such characters.
_TAIL = "\u0080-¿€‚ƒ„…†‡ˆ‰Š‹Œ" \
    "Ž‘’“”•–—˜™š›œžŸ"
# What only garbling leaves behind. An accented letter before a quote or a no-break space is
# ordinary French or German and no evidence; so is any lead that is not followed as below.
_EVIDENCE = (
    rf"[ÂÃ][{_TAIL}]"
    rf"|â[€\u0080-\u009f][{_TAIL}]"
    rf"|ï(?:»¿|¬[{_TAIL}])"
    rf"|ð[Ÿ\u009f][{_TAIL}][{_TAIL}]"
    r"|[ÎÏÐ][¡-ª¬-º¼-¿]"
    rf"|(?<=[A-Za-z])[ÄÅ][{_TAIL}](?=[A-Za-z])"
)
_MAY_BE_MOJIBAKE = rf"[ÂÃÄÅÎÏÐ][{_TAIL}]|â€|ï[»¬]|ðŸ|[\x{{80}}-\x{{9f}}]"
_MOJIBAKE_RUN = re.compile(f"(?:{_EVIDENCE})+")

# Typographic characters and what they become.
_CURLY = str.maketrans("‘’‚‛“”„‟", "\'\'\'\'\"\"\"\"")
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


# C1 controls are windows-1252 read as latin-1; five of its bytes stand for nothing.
_C1 = {bytes([c]).decode("cp1252", "ignore"): chr(c) for c in range(0x80, 0xA0)}
_C1.pop("", None)
_FROM_C1, _TO_CP1252 = "".join(_C1.values()), "".join(_C1)
_C1_TABLE = str.maketrans(_FROM_C1, _TO_CP1252)
_BYTES = {char: ord(c1) for char, c1 in _C1.items()}
_HIGH_RUN = re.compile(f"[\x80-\xff{''.join(_BYTES)}]+")


def strip(text: Column) -> Column:
    """Python's ``str.strip`` for any Unicode whitespace."""
    return F.regexp_replace(text, rf"(?U)^{WS}+|{WS}+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(rf"(?U)[^\s\x1c-\x1f]")


def missing_token(text: Column, flag: Column | None = None) -> Column:
    """Null becomes ``MISSING``; a boolean becomes ``True`` or ``False``."""
    value = text
    if flag is not None:
        value = F.coalesce(text, F.initcap(flag.cast("string")))
    return F.coalesce(value, F.lit("MISSING"))


# Inside a tag: a quoted value hides whatever it holds. A quote swaps the states in and out of it, so attempts
# at different starts never meet in one state, three at most are alive anywhere, and the match is linear.
_IN_TAG = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""
# One token of markup. What opens a comment or a raw element always matches, to the end of the text
# if nothing closes it, as in an HTML parser; so no text is searched twice.
_MARKUP = (
    rf"(?is)<!--.*?(?:-->|\z)"
    rf"|<(script|style|template)\b{_IN_TAG}.*?(?:</\1\s*+>|\z)"
    rf"|</?[A-Za-z!?]{_IN_TAG}"
)


def strip_html(text: Column) -> Column:
    """Visible text of a markup string, tags replaced by a space, character references decoded.

    References are decoded as HTML does, those without a semicolon too, but no-break spaces become blanks.
    Rows whose references all stand in ``ENTITIES`` are decoded in the JVM.
    """
    bare = F.when(text.contains("<"), F.regexp_replace(text, _MARKUP, " ")).otherwise(text)
    common = "|".join(re.escape(e[1:]) for e in ENTITIES)
    odd = _once(bare, lambda t: F.when(t.contains("&") & t.rlike(f"&(?!{common})[#A-Za-z]"), t))
    decoded = _once(bare, lambda t: F.when(t.contains("&"), _decoded(t)).otherwise(t))
    return F.coalesce(_unescape(odd), decoded)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _decoded(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: html.unescape(_NO_BREAK.sub(" ", t)), na_action="ignore")


def plain_characters(text: Column) -> Column:
    """Curly quotes, full-width forms and ligatures as plain characters."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    narrow = "".join(map(chr, range(0x21, 0x7F)))
    curly = "".join(map(chr, _CURLY))

    def replaced(t: Column) -> Column:
        out = F.translate(t, curly + wide, curly.translate(_CURLY) + narrow)
        for ligature, letters in _LIGATURES.items():
            out = F.replace(out, F.lit(ligature), F.lit(letters))
        return F.when(t.rlike("[\u2018-\u201f\ufb00-\ufb06\uff01-\uff5e]"), out).otherwise(t)

    return _once(text, replaced)


def _redecode(run: str) -> str | None:
    """The run's characters as the bytes they were read from, windows-1252 and latin-1 mixed, read as UTF-8."""
    try:
        return bytes(_BYTES.get(c, ord(c)) for c in run).decode("utf-8")
    except (UnicodeError, ValueError):
        return None


def _one_layer(text: str) -> str:
    """Runs of high bytes with evidence in them, as a whole where that is UTF-8, else the evidence alone."""
    found = [m.span() for m in _MOJIBAKE_RUN.finditer(text)]
    if not found:
        return text
    out, done, k = [], 0, 0
    for run in _HIGH_RUN.finditer(text):
        mine = []
        while k < len(found) and found[k][1] <= run.end():
            mine.append(found[k])
            k += 1
        whole = _redecode(run.group()) if mine else None
        for start, end in [run.span()] if whole is not None else mine:
            part = text[start:end]
            out += [text[done:start], (whole if whole is not None else _redecode(part)) or part]
            done = end
    return "".join([*out, text[done:]])


def _ungarbled(text: str) -> str:
    """Layer after layer while there is evidence of one; every layer makes the text shorter."""
    while (less := _one_layer(text)) != text:
        text = less
    return text.translate(_C1_TABLE)


@F.pandas_udf(StringType())
def _undo_mojibake(text: pd.Series) -> pd.Series:
    return text.map(_ungarbled, na_action="ignore")


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def clean_udf(text: pd.Series) -> pd.Series:
    """Both Unicode repairs in one Arrow pass."""
    return text.map(lambda t: unicodedata.normalize("NFC", _ungarbled(t)), na_action="ignore")


def _only_if(text: Column, pattern: str, repair) -> Column:
    """Ship to Python only rows that match; the others travel as null."""
    return F.coalesce(repair(_once(text, lambda t: F.when(t.rlike(pattern), t))), text)


def fix_mojibake(text: Column) -> Column:
    """Undo UTF-8 that was decoded as windows-1252 or latin-1, any number of times.

    What is left of C1 controls becomes the windows-1252 characters they stand for.
    """
    return _only_if(text, _MAY_BE_MOJIBAKE, _undo_mojibake)


def nfc(text: Column) -> Column:
    return _only_if(text, _MAY_BE_DECOMPOSED, _compose)


def repair_unicode(text: Column) -> Column:
    return _only_if(text, f"{_MAY_BE_MOJIBAKE}|{_MAY_BE_DECOMPOSED}", clean_udf)


def strip_controls(text: Column) -> Column:
    """Delete control characters, newline included, leaving nothing behind."""
    return F.regexp_replace(text, r"[\x00-\x1F\x7F-\x9F]", "")


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"(?U){WS}+", " "))


def clean_text(text: Column, flag: Column | None = None, unicode_repair: bool = True) -> Column:
    """The whole cleaning chain in its fixed order."""
    out = strip_html(missing_token(text, flag))
    if unicode_repair:
        out = plain_characters(repair_unicode(out))
    return collapse_ws(strip_controls(out))


def survives_cleaning(text: Column) -> Column:
    """Whether cleaning leaves anything. A visible ASCII character without markup does; only other texts are cleaned."""
    plain = text.rlike("[!-~]") & ~text.contains("<") & ~text.contains("&")
    return F.when(plain, F.lit(True)).otherwise(clean_text(F.when(~plain, text)) != "")


def mask_references(text: Column) -> Column:
    """Replace portal reference numbers and postcodes by placeholders."""
    out = F.regexp_replace(text, r"\bPP-[0-9]+\b", "<PPR number>")
    return F.regexp_replace(
        out, r"\b[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2}\b", "<postcode>"
    )
