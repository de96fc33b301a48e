"""Structured extraction: page elements to flat typed items.

The rules read neighbours, remember the open section and a pending question, and
let a checkbox swallow the label after it. All of that is expressed with windows
over (document, segment) ordered by element position, after one shuffle. A
document of at most ``segment_rows`` elements is one segment. Longer ones are cut
into segments that overlap by the rows the neighbour rules look at; what earlier
segments leave behind comes from a summary per segment that only long documents
have.

Element columns: ``<doc>``, ``idx`` (0-based, dense), ``type``, ``text``,
``text_as_html``, ``page_number`` and optionally ``n_elements`` (size of the
document) and ``page_present`` (false when the page key is absent).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import WS
from docloom.plans.lookup import lookup
from docloom.plans.stored import stored

SEGMENT_ROWS = 200_000

# Fixed values of the extraction rules.
LABELS = ("Yes", "No")
CHECKBOX_MARK = '<input class="Checkbox"'
CHECKED_MARK = "checked"
LOOK_BACK = 4
DEFAULT_SECTION = "Document Content"
UNKNOWN_QUESTION = "Unknown question"

# The rules are written as SQL expressions over the element columns.
_STRIPPED = f"regexp_replace(coalesce(text, ''), r'(?U)^{WS}+|{WS}+$', '')"
_UP_TO_HERE = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_BACK = [f"back{k}" for k in range(1, LOOK_BACK + 1)]


def _is_label(text: str) -> str:
    return f"{text} IN {LABELS}"


def _asks(text: str) -> str:
    return f"(contains({text}, '?') OR endswith({text}, ':'))"


def normalise_elements(elements: DataFrame) -> DataFrame:
    """Stripped non-null text, page 0 where the page key is absent, non-null html."""
    page = "page_number"
    if "page_present" in elements.columns:
        page = "CASE WHEN page_present THEN page_number ELSE 0 END"
    return elements.withColumns(
        {
            "text": F.expr(_STRIPPED),
            "text_as_html": F.expr("coalesce(text_as_html, '')"),
            "page_number": F.expr(f"CAST({page} AS BIGINT)"),
        }
    )


def checkbox_state(previous: str, following: str, html: str) -> str:
    """Answer of a checkbox from the label before it, else the label after it."""
    label = (
        f"CASE WHEN {_is_label(previous)} THEN {previous} WHEN {_is_label(following)} THEN {following} END"
    )
    return f"""CASE WHEN contains({html}, '{CHECKBOX_MARK}') THEN
        CASE WHEN ({label}) IS NULL THEN NULL
             WHEN NOT contains({html}, '{CHECKED_MARK}') THEN 'unchecked'
             WHEN ({label}) = 'Yes' THEN 'checked_yes' ELSE 'checked_no' END END"""


def _cut(elements: DataFrame, segment_rows: int) -> DataFrame:
    """Give each element its segment, and copies to the neighbours that look at it."""
    if segment_rows <= LOOK_BACK or segment_rows % 2:
        raise ValueError(f"segment_rows must be even and exceed {LOOK_BACK}")
    home = f"(idx div {segment_rows})"
    seen_by = f"""CASE
        WHEN idx % {segment_rows} = 0 AND idx > 0 THEN array({home} - 1, {home})
        WHEN idx % {segment_rows} >= {segment_rows - LOOK_BACK} THEN array({home}, {home} + 1)
        ELSE array({home}) END"""
    return elements.selectExpr("*", f"explode({seen_by}) AS segment").selectExpr(
        "*", f"segment = {home} AS own", f"idx % {segment_rows} AS place"
    )


def _facts(cut: DataFrame, doc: str) -> DataFrame:
    """Per element facts that need nothing from other segments.

    ``candidate`` marks a label right after a checkbox and ``anchor`` the last
    position that is not one. Halo rows are dropped once they have been read.
    """
    scan = f"OVER (PARTITION BY `{doc}`, segment ORDER BY idx)"
    near = [f"lag(text, {k}) {scan} AS back{k}" for k in range(1, LOOK_BACK + 1)]
    near.append(f"lead(text) {scan} AS following")
    if "null_text" in cut.columns:
        near += [f"lag(null_text, {k}) {scan} AS back{k}_null" for k in range(1, LOOK_BACK + 1)]
        near.append(f"lead(null_text) {scan} AS following_null")
    return (
        cut.selectExpr("*", *near)
        .selectExpr(
            "*",
            f"{checkbox_state('back1', 'following', 'text_as_html')} AS state",
            "coalesce(type = 'Title', false) AS is_title",
        )
        .selectExpr("*", "state IS NOT NULL AND NOT is_title AS is_checkbox")
        .selectExpr("*", f"coalesce(lag(is_checkbox) {scan}, false) AND {_is_label('text')} AS candidate")
        .filter("own")
        .selectExpr("*", f"max(CASE WHEN NOT candidate THEN idx END) {scan[:-1]} {_UP_TO_HERE}) AS anchor")
    )


def _consumed(swallowed_in: str) -> str:
    """Whether the element is a label that the checkbox before it swallows.

    A swallowed element is not a checkbox any more, so in a run of candidates
    every other one is swallowed, beginning with the first. A run that starts
    with the segment goes on from ``swallowed_in``, the fate of the element
    before it.
    """
    return f"""(candidate AND CASE WHEN anchor IS NULL THEN (place % 2 = 1) = {swallowed_in}
        ELSE (idx - anchor) % 2 = 1 END)"""


def _is_text(consumed: str) -> str:
    return f"""(NOT {consumed} AND NOT is_checkbox AND coalesce(type, '') NOT IN ('Title', 'Image', 'Header')
        AND text <> '' AND NOT {_is_label('text')})"""


def _left_behind(long: DataFrame, doc: str) -> DataFrame:
    """What each segment of a long document receives from the others.

    Each segment is summed up for both fates of the element before it. Which one
    holds follows from the last earlier segment that is not one single run of
    candidates; segment length is even, so such runs hand the fate on unchanged.
    A question before the first section is never pending, so it is not handed on.
    """
    summary = [
        "max(is_title) AS titled",
        f"max_by(CASE WHEN NOT (candidate AND anchor IS NULL) THEN {_consumed('false')} END, idx) AS swallowed_end",
    ]
    for fate in ("false", "true"):
        gone = _consumed(fate)
        opened_at = f"CASE WHEN is_title AND NOT {gone} THEN idx END"
        asked_at = f"CASE WHEN {_is_text(gone)} AND {_asks('text')} THEN idx END"
        summary += [
            f"max_by(text, {opened_at}) AS title_{fate}",
            f"min({opened_at}) AS first_title_{fate}",
            f"max_by(text, {asked_at}) AS asked_{fate}",
            f"max({asked_at}) AS asked_at_{fate}",
            f"max(CASE WHEN is_checkbox AND NOT {gone} THEN idx END) AS cleared_at_{fate}",
        ]
    earlier = f"OVER (PARTITION BY `{doc}` ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    whole = f"OVER (PARTITION BY `{doc}`)"
    picked = ", ".join(
        f"CASE WHEN swallowed_in THEN {name}_true ELSE {name}_false END AS {name}"
        for name in ("title", "first_title", "asked", "asked_at", "cleared_at")
    )
    valid = "NOT titled OR asked_at > first_title"
    return (
        long.groupBy(doc, "segment")
        .agg(*[F.expr(e) for e in summary])
        .selectExpr("*", f"coalesce(last_value(swallowed_end) IGNORE NULLS {earlier}, false) AS swallowed_in")
        .selectExpr(f"`{doc}`", "segment", "swallowed_in", "titled", *picked.split(", "))
        .selectExpr(
            "* EXCEPT (titled, first_title)", f"max(titled) {whole} AS titled", f"min(first_title) {whole} AS first_title"
        )
        .selectExpr(
            f"`{doc}` AS in_doc",
            "segment AS in_segment",
            "swallowed_in",
            "titled AS titled_in",
            f"last_value(title) IGNORE NULLS {earlier} AS section_in",
            f"last_value(CASE WHEN {valid} THEN asked END) IGNORE NULLS {earlier} AS asked_in",
            f"last_value(CASE WHEN {valid} THEN asked_at END) IGNORE NULLS {earlier} AS asked_at_in",
            f"last_value(cleared_at) IGNORE NULLS {earlier} AS cleared_at_in",
        )
    )


def annotate_elements(
    elements: DataFrame, doc: str = "doc_path", segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Every element with the facts the items are made of.

    Adds ``state``, ``is_checkbox``, ``consumed``, ``section``, ``answers``,
    ``is_text``, ``pending`` and ``looked_back``.
    """
    df = normalise_elements(elements)
    if "n_elements" not in df.columns:
        sizes = df.groupBy(doc).agg((F.max("idx") + 1).alias("n_elements"))
        df = lookup(df, sizes, [doc], ["idx"])
    long = _facts(_cut(df.filter(f"n_elements > {segment_rows}"), segment_rows), doc)
    received = _left_behind(long, doc)
    cut = _cut(df, segment_rows).join(
        received, F.expr(f"`{doc}` = in_doc AND segment = in_segment"), "left"
    )
    scan = f"PARTITION BY `{doc}`, segment ORDER BY idx"
    earlier = f"OVER ({scan} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    looked_back = ", ".join(
        f"CASE WHEN idx - {k} >= 1 AND {_asks(b)} THEN {b} END" for k, b in enumerate(_BACK, start=1)
    )
    asking = f"is_text AND {_asks('text')}"
    marked = (
        _facts(cut, doc)
        .selectExpr("*", f"{_consumed('coalesce(swallowed_in, false)')} AS consumed")
        .selectExpr(
            "*",
            "is_checkbox AND NOT consumed AS answers",
            f"coalesce(titled_in, max(is_title) OVER (PARTITION BY `{doc}`, segment)) AS has_title",
            f"coalesce(last_value(CASE WHEN is_title AND NOT consumed THEN text END) IGNORE NULLS"
            f" OVER ({scan} {_UP_TO_HERE}), section_in) AS open_section",
        )
        .selectExpr("*", f"coalesce(open_section, CASE WHEN NOT has_title THEN '{DEFAULT_SECTION}' END) AS section")
        .selectExpr("*", f"section IS NOT NULL AND {_is_text('consumed')} AS is_text")
        .selectExpr(
            "*",
            f"coalesce(last_value(CASE WHEN {asking} THEN idx END) IGNORE NULLS {earlier}, asked_at_in) AS asked_at",
            f"coalesce(last_value(CASE WHEN {asking} THEN text END) IGNORE NULLS {earlier}, asked_in) AS asked",
            f"coalesce(last_value(CASE WHEN answers THEN idx END) IGNORE NULLS {earlier}, cleared_at_in, -1) AS cleared_at",
        )
    )
    kept = [
        *df.columns, "state", "is_title", "is_checkbox", "consumed", "answers", "has_title", "section", "is_text",
        *_BACK, "following", *[c for c in marked.columns if c.endswith("_null")],
    ]
    return marked.selectExpr(
        *[f"`{c}`" for c in kept],
        "CASE WHEN asked_at > cleared_at THEN asked END AS pending",
        f"coalesce({looked_back}, '{UNKNOWN_QUESTION}') AS looked_back",
    )


def items_from_annotated(annotated: DataFrame, doc: str = "doc_path", keep: Sequence[str] = ()) -> DataFrame:
    """One row per item in document order: checkbox, image or text; with the columns ``keep`` of its element."""
    kind = """CASE WHEN answers THEN 'checkbox'
        WHEN is_title THEN CASE WHEN text <> '' THEN 'text' END
        WHEN type = 'Image' THEN 'image'
        WHEN type = 'Header' THEN CASE WHEN text <> '' THEN 'text' END
        WHEN is_text THEN 'text' END"""
    return (
        annotated.filter("section IS NOT NULL AND NOT consumed")
        .selectExpr("*", f"{kind} AS item")
        .filter("item IS NOT NULL")
        .selectExpr(
            f"`{doc}`",
            "idx",
            "item AS type",
            "CASE WHEN item = 'checkbox' THEN coalesce(pending, looked_back) END AS question",
            "CASE WHEN item = 'text' THEN text END AS value_text",
            "CASE WHEN item = 'checkbox' THEN CASE state WHEN 'checked_yes' THEN true WHEN 'checked_no' THEN false END"
            " END AS value_bool",
            "section",
            "page_number",
            *[f"`{c}`" for c in keep],
        )
    )


def extract_items(
    elements: DataFrame, doc: str = "doc_path", segment_rows: int = SEGMENT_ROWS, keep: Sequence[str] = ()
) -> DataFrame:
    return items_from_annotated(annotate_elements(elements, doc, segment_rows), doc, keep)


_FLAGS = ("null_text", "null_html", "malformed")


def _flagged(elements: DataFrame) -> DataFrame:
    return elements.withColumns({name: F.col(name) if name in elements.columns else F.lit(False) for name in _FLAGS})


def _rejected(annotated: DataFrame, flagged: DataFrame, doc: str) -> DataFrame:
    unanswered, seen = [], []
    for k, b in enumerate(_BACK, start=1):
        unanswered.append(" AND ".join([f"idx - {k} >= 1", f"{b}_null", *[f"NOT {_asks(s)}" for s in seen]]))
        seen.append(b)
    fails = f"""NOT consumed AND (malformed OR (null_html AND NOT is_title)
        OR (contains(text_as_html, '{CHECKBOX_MARK}') AND NOT is_title
            AND (coalesce(back1_null, false) OR coalesce(following_null, false)))
        OR (answers AND pending IS NULL AND ({" OR ".join(f"({u})" for u in unanswered)})))"""
    broken = flagged.filter(F.col("malformed") & F.col("idx").isNull())
    return annotated.filter(fails).select(doc).unionByName(broken.select(doc)).distinct()


def rejected_docs(
    elements: DataFrame, doc: str = "doc_path", segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Documents that cannot be extracted, one row each.

    A document is rejected when it is no JSON array of objects, when an element
    that is looked at lacks its type or metadata, has null markup, or when a
    neighbour whose label or question is asked for has an explicit null text.
    """
    flagged = _flagged(elements)
    return _rejected(annotate_elements(flagged, doc, segment_rows), flagged, doc)


def extract_sound(
    elements: DataFrame, doc: str = "doc_path", segment_rows: int = SEGMENT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Items of the sound documents, and the rejected documents; ``elements`` are read and annotated once.

    A sound document without items keeps one row with null ``idx``. Elements as they
    are parsed and as they are annotated are stored for the steps that follow.
    """
    flagged = stored(_flagged(elements), "elements")
    annotated = stored(annotate_elements(flagged, doc, segment_rows), "annotated")
    rejected = stored(_rejected(annotated, flagged, doc), "rejected")
    items = items_from_annotated(annotated, doc).join(rejected, doc, "left_anti")
    sound = flagged.select(doc).distinct().join(rejected, doc, "left_anti")
    bare = sound.join(items.select(doc).distinct(), doc, "left_anti")
    return items.unionByName(bare, allowMissingColumns=True), rejected


def quarantine_docs(
    elements: DataFrame, doc: str = "doc_path", segment_rows: int = SEGMENT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Elements of the sound documents, and the rejected documents, stored as both results read them."""
    rejected = stored(rejected_docs(elements, doc, segment_rows), "rejected")
    return elements.join(rejected, doc, "left_anti"), rejected


def count_items(items: DataFrame, doc: str = "doc_path", docs: DataFrame | None = None) -> DataFrame:
    """Items per document, with a line such as ``3 checkboxs, 1 image``.

    Documents of ``docs`` without items have 0 and an empty line.
    """
    per_type = items.groupBy(doc, "type").agg(F.count(F.lit(1)).alias("n"))
    label = F.concat(
        F.col("n").cast("string"), F.lit(" "), "type", F.when(F.col("n") != 1, "s").otherwise("")
    )
    counted = (
        per_type.groupBy(doc)
        .agg(
            F.sum("n").alias("n_items"),
            F.sort_array(F.collect_list(F.struct("type", label.alias("label")))).alias("parts"),
        )
        .select(doc, "n_items", F.array_join("parts.label", ", ").alias("counts"))
    )
    if docs is None:
        return counted
    every = docs.select(doc).distinct().join(counted, doc, "left")
    return every.select(doc, F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("counts", F.lit("")).alias("counts"))
