import time
import unicodedata

import pytest

from docloom.functions import compose as P
from docloom.functions import text as T
from docloom.operators import extract as X
from docloom.operators import items as I
from docloom.sources import read_item_docs
from pyspark.sql import functions as F


def apply(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.o for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


def test_strip_is_pythons(spark):
    values = ["  a b ", " x ", "\x1fy\x85", "", "\n\t"]
    assert apply(spark, T.strip, *values) == [v.strip() for v in values]


@pytest.mark.parametrize(
    "markup, text",
    [
        ("a<b>c</b>d", "a c d"),
        ("x<!-- no\n<p> -->y", "x y"),
        ("<script>var t='</p>';</script>seen<style>p{}</style>", "seen"),
        ('<a title="1 > 0">link</a>', "link"),
        ("1 &lt; 2 &amp; 3", "1 < 2 & 3"),
        ("&amp;lt;", "&lt;"),
        ("1 < 2", "1 < 2"),
        ("a\nb", "ab"),
        ("a   b", "a b"),
        ("<br/>", ""),
    ],
)
def test_clean_text(spark, markup, text):
    assert apply(spark, T.clean_text, markup) == [text]


def test_missing_and_flags(spark):
    df = spark.createDataFrame([(None, None), (None, True), (None, False), ("x", None)], "t string, f boolean")
    got = [r.o for r in df.select(T.missing_token(F.col("t"), F.col("f")).alias("o")).collect()]
    assert got == ["MISSING", "True", "False", "x"]


def test_fix_mojibake(spark):
    right = ["“Hello”", "café crème", "naïve", "Ω", "nothing", "Ân", "price £5"]
    garbled = []
    for t in right:
        raw = t.encode("utf-8")
        try:
            garbled.append(raw.decode("cp1252"))
        except UnicodeError:
            garbled.append(raw.decode("latin-1"))
    assert apply(spark, T.fix_mojibake, *garbled, *right) == right + right


def test_nfc(spark):
    values = ["éa", "ok", None, "한", "Å", "Å"]
    assert apply(spark, T.nfc, *values) == [v and unicodedata.normalize("NFC", v) for v in values]


def test_survives_cleaning_agrees_with_cleaning(spark):
    blanks = [c.encode("utf-8").decode("latin-1") for c in " \u0085 　"]
    values = ["", " ", "<br>", "&nbsp;", "a", None, "\x07", "<b>x</b>", "Â", *blanks, " ", blanks[0] + "a"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    rows = df.select(
        (T.clean_text(F.col("t")) != "").alias("chain"), T.survives_cleaning(F.col("t")).alias("short")
    ).collect()
    assert [r.short for r in rows] == [r.chain for r in rows]


def test_repair_needs_evidence(spark):
    sound = ["« café\u00a0»", "voilà\u00a0»", "RÉSUMÉ\u00a0:", "“CAFÉ”", "Â ge", "où\u00a0?", "„Größe“", "Åse"]
    assert apply(spark, T.fix_mojibake, *sound) == sound
    garbled = ["cafÃ©", "Â£5", "itâ€™s", "cÅ“ur", "ðŸ˜€", "ï»¿x", "Ã©Ã¨Ã\u00a0 là\u00a0»"]
    assert apply(spark, T.fix_mojibake, *garbled) == ["café", "£5", "it’s", "cœur", "😀", "\ufeffx", "éèà là\u00a0»"]


def test_repair_goes_through_all_layers(spark):
    def garble(t, charset, times):
        for _ in range(times):
            t = "".join(bytes([b]).decode(charset) if charset == "latin-1" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in t.encode())
        return t

    right = ["été", "voilà l’été — « ça »", "“Größe”", "naïve 😀 cœur"]
    values = [garble(t, c, n) for t in right for c in ("latin-1", "cp1252") for n in (1, 2, 3)]
    assert apply(spark, T.fix_mojibake, *values) == [t for t in right for _ in range(6)]
    assert apply(spark, T.fix_mojibake, "\x93Hi\x94 \x80 5\x85", "a\x81b") == ["“Hi” € 5…", "a\x81b"]
    sound = ["« café\u00a0»", "voilà\u00a0»", "RÉSUMÉ\u00a0:", "où\u00a0?", "Å", "Ω÷2"]
    assert apply(spark, T.clean_udf, *sound) == sound


@pytest.mark.parametrize("unit", ["<script>", "<!--", '<a "', "<a '\"", "<script ", "<style x='", "</script", "<!-- --", "<template><!--", "&amp", "<"])
def test_markup_is_linear(spark, unit):
    spark.range(1).select(T.strip_html(F.lit("<a>b"))).collect()
    long = spark.createDataFrame([(unit * (1_000_000 // len(unit)),)], "t string")
    started = time.perf_counter()
    got = long.select(F.length(T.strip_html(F.col("t"))).alias("n")).first().n
    assert got <= 1_000_000 and time.perf_counter() - started < 5


def test_unclosed_markup_and_references(spark):
    texts = {
        "a<script>b": "a ", "a<!-- b": "a ", "a<style>b</style>c<style>d": "a c ", "x<script>'<!--'</script>y": "x y", "<a 'b": "<a 'b",
        "&copy 2020": "© 2020", "&copy 2020 &eacute;": "© 2020 é", "&nbsp &#xa0;&#160 &nbsp;": "      ", "&notit; &#38;lt;": "¬it; &lt;", "a & b &c": "a & b &c",
    }
    got = apply(spark, T.strip_html, *texts)
    assert [g.replace("\u00a0", "?") for g in got[:7] + got[8:]] == [v for k, v in texts.items() if not k.startswith("&nbsp")]
    assert set(got[7]) == {" "}


def test_references_and_typography(spark):
    texts = ["&#8217;&#xA3;&eacute;&rarr;&nbsp;x", "AT&T &amp;eacute; &lt;b&gt;", "&unknown; &amp;", None]
    assert apply(spark, T.strip_html, *texts) == ["’£é→ x", "AT&T &eacute; <b>", "&unknown; &", None]
    assert apply(spark, T.plain_characters, "“ﬁ” ‘Ａ！’ é", "plain") == ["\"fi\" 'A!' é", "plain"]


def test_mask_references(spark):
    text = "Planning Portal Reference: PP-11298341 at WA14 4QP and M1 1AE, not PPX-1"
    assert apply(spark, T.mask_references, text) == [
        "Planning Portal Reference: <PPR number> at <postcode> and <postcode>, not PPX-1"
    ]


ITEM = "doc string, idx bigint, type string, question string, value_text string, value_bool boolean, section string"


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        ("a", 0, "image", None, None, None, "S"),
        ("a", 1, "checkbox", "Q?", None, True, "S"),
        ("a", 2, "checkbox", "Q?", None, None, "S"),
        ("a", 3, "header", None, "h", None, "S"),
        ("a", 4, "text", None, "<b>t</b>", None, "S"),
        ("a", 5, "text", None, "<br>", None, "S"),
        ("a", 6, "text", None, "kept", None, None),
        ("a", 7, "table", None, "no", None, "S"),
        ("a", 8, "text", None, "no", None, " "),
        ("b", None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, ITEM)


def test_broken_and_empty_item_files(spark, tmp_path):
    for name, content in {"broken": '[{"type":"text"', "empty": "[]", "odd": "[1]", "good": '[{"type":"image","section":"S"}]'}.items():
        (tmp_path / f"{name}.json").write_text(content)
    rows = read_item_docs(spark, str(tmp_path))
    assert {r.doc_path.split("/")[-1]: r.malformed for r in rows.collect()} == {
        "broken.json": True, "empty.json": False, "odd.json": True, "good.json": False,
    }
    lines = {r.doc_path.split("/")[-1]: r.input for r in I.compose_lines(rows).collect()}
    assert lines == {"empty.json": P.EMPTY_DOCUMENT_LINE, "good.json": "Image: S"}


def test_documents_without_items_keep_a_line(items, spark):
    docs = spark.createDataFrame([("a",), ("c",), ("c",)], "doc string")
    got = I.compose_lines(items.filter("doc = 'a'"), "doc", docs=docs).filter("doc = 'c'").collect()
    assert [(r.idx, r.input) for r in got] == [(None, P.EMPTY_DOCUMENT_LINE)]
    counts = {r.doc: (r.n_items, r.counts) for r in X.count_items(items.filter("doc = 'a'"), "doc", docs).collect()}
    assert counts["c"] == (0, "") and counts["a"][0] == 9


def test_compose_lines(items):
    lines = {(r.doc, r.idx): r.input for r in I.compose_lines(items, "doc").collect()}
    assert lines == {
        ("a", 0): "Image: S",
        ("a", 1): "Checkbox: SQUESTION:Q? ANSWER:True",
        ("a", 2): "Checkbox: SQUESTION:Q? ANSWER:None",
        ("a", 3): "Header: S h",
        ("a", 4): "Text: S <b>t</b>",
        ("a", 6): "Text: None kept",
        ("b", None): P.EMPTY_DOCUMENT_LINE,
    }
    cleaned = {(r.doc, r.idx): r.input for r in I.compose_lines(items, "doc", apply_cleaning=True).collect()}
    assert cleaned[("a", 4)] == "Text: S t"


@pytest.mark.parametrize("segment_rows", [2, 1_000_000])
def test_order_by_type(items, segment_rows):
    rows = I.order_by_type(items.filter("idx is not null"), "doc", segment_rows).orderBy("out_idx").collect()
    assert [r.idx for r in rows] == [4, 5, 6, 8, 3, 1, 2, 0]
    assert [r.out_idx for r in rows] == list(range(1, 9))
