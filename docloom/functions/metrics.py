"""Answer metrics as columns."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Price per thousand tokens and the reading ease formula.
PROMPT_PRICE_PER_1K = 0.30 / 1000
COMPLETION_PRICE_PER_1K = 2.50 / 1000
EASE_BASE, EASE_PER_SENTENCE_WORD, EASE_PER_SYLLABLE = 206.835, 1.015, 84.6

VOWELS = "aeiouyàáâäãåèéêëìíîïòóôöõùúûü"
WORD_CHAR = r"\p{L}\p{N}_"
TOKEN = rf"[{WORD_CHAR}]{{2,}}"
# All Unicode blanks, as Python's str.split knows them, for a character class.
BLANKS = r"\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same blanks for a whole pattern: ASCII ones are tried first, and no other ASCII character meets the wide class.
BLANK_RUN = r"[\t-\r\x1c-\x20]+|(?![\x00-\x7f])[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
# what neither ends a sentence nor belongs to a word, once all blanks are spaces
_MARK_RUN = r"[\x00-\x1f\x22-\x2d/:->@\[-\^`\x7b-\x7f]+|(?![\x00-\x7f])[^\p{L}\p{N}\x00-\x7f]+"
# idf of a token in one text of a pair; in both it is 1
IDF_ONE = math.log(1.5) + 1


def throughput(tokens: Column, seconds: Column) -> Column:
    """Tokens per second, 0 when no time passed."""
    return F.when(seconds > 0, tokens / seconds).otherwise(F.lit(0.0))


def token_cost(prompt_tokens: Column, completion_tokens: Column) -> Column:
    return prompt_tokens / 1000 * PROMPT_PRICE_PER_1K + completion_tokens / 1000 * COMPLETION_PRICE_PER_1K


def word_count(text: Column) -> Column:
    """Whitespace separated words."""
    return F.regexp_count(even_blanks(text), F.lit("[^ ]+")).cast("bigint")


def sentence_marks(text: Column) -> Column:
    """Full stops, exclamation and question marks."""
    return F.regexp_count(text, F.lit("[.!?]")).cast("bigint")


def char_count(text: Column) -> Column:
    return F.length(text).cast("bigint")


def answer_counts(text: Column) -> dict[str, Column]:
    return {
        "word_count": word_count(text),
        "sentence_count": sentence_marks(text),
        "char_count": char_count(text),
    }


def even_blanks(text: Column) -> Column:
    """Every run of blanks as spaces, so that later patterns need to know no other blank."""
    return F.regexp_replace(text, BLANK_RUN, " ")


def spoken(even: Column) -> Column:
    """Words, spaces and sentence marks of a text with even blanks; other marks are left out."""
    return F.regexp_replace(even, _MARK_RUN, "")


def spoken_words(bare: Column) -> Column:
    """Runs between blanks with a word character in them, of ``spoken`` text."""
    return F.regexp_count(bare, F.lit("[^ .!?][^ ]*+")).cast("bigint")


def long_sentences(bare: Column) -> Column:
    """Sentences of at least three words in ``spoken`` text; at least one. A sentence is tried from its words' starts only."""
    three = r"(?<![^ .!?])[^ .!?]++ ++[^ .!?]++ ++[^ .!?][^.!?]*+"
    return F.greatest(F.regexp_count(bare, F.lit(three)), F.lit(1)).cast("bigint")


def solid_chars(even: Column) -> Column:
    return F.length(F.replace(even, F.lit(" "), F.lit(""))).cast("bigint")


def lexicon_count(text: Column) -> Column:
    """Words that are more than punctuation."""
    return spoken_words(spoken(even_blanks(text)))


def solid_char_count(text: Column) -> Column:
    """Characters that are not whitespace."""
    return solid_chars(even_blanks(text))


def spoken_sentences(text: Column) -> Column:
    """Sentences of at least three words; at least one."""
    return long_sentences(spoken(even_blanks(text)))


def syllable_count(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(f"[{VOWELS}]+")).cast("bigint")


def reading_ease(words: Column, sentences: Column, syllables: Column) -> Column:
    """Flesch reading ease from counts; 0 without words."""
    ease = (
        F.lit(EASE_BASE)
        - F.lit(EASE_PER_SENTENCE_WORD) * (words / sentences)
        - F.lit(EASE_PER_SYLLABLE) * F.try_divide(syllables, words)
    )
    return F.coalesce(ease, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def squared_l2(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x * x)


def norm(a: Column) -> Column:
    total = F.aggregate(a, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    return F.sqrt(total)


def embedding_cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 when one of them is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


@F.arrow_udf(DoubleType())
def _pair_cosine(left: pa.Array, right: pa.Array) -> pa.Array:
    out = []
    for a, b in zip(left.to_pylist(), right.to_pylist()):
        if a is None or b is None or not (a or b):
            out.append(None)
            continue
        a, b = Counter(a), Counter(b)
        shared = a.keys() & b.keys()
        size = lambda c: sum((n if t in shared else n * IDF_ONE) ** 2 for t, n in c.items())
        whole = math.sqrt(size(a)) * math.sqrt(size(b))
        out.append(sum(a[t] * b[t] for t in shared) / whole if whole else 0.0)
    return pa.array(out, pa.float64())


def tfidf_cosine(left: Column, right: Column) -> Column:
    """TF-IDF cosine of two texts of a row, fitted on just the two.

    Null when neither text has a token, or one of them is null; 0 when one has none.
    """
    tokens = [F.regexp_extract_all(F.lower(side), F.lit(TOKEN), F.lit(0)) for side in (left, right)]
    return _pair_cosine(*tokens)
