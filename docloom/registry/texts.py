"""Text cleaning, prompt and chunk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import prompts as P
from docloom.functions import text as T
from docloom.operators import chunks as C
from docloom.operators.items import skip_blank as keep_spoken
from docloom.plans.stored import stored
from docloom.registry import sql
from docloom.registry.tables import documents, table
from docloom.sources import path_parts as parts_of
from docloom.sources import six_digit_number

NBSP = " "
ACUTE = "é"


def _docs(spark, d):
    return documents(spark, d).select("doc_id", "text", "source")


def missing_token(spark, d):
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.col("text"))
    flag = F.when(k == 1, F.col("doc_id") % 2 == 0)
    return documents(spark, d).select("doc_id", T.missing_token(text, flag).alias("value"))


def strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", "html").select(
        "page_id", T.strip_html(F.col("html")).alias("text")
    )


def fix_mojibake(spark, d):
    """A third of the documents is garbled once, a third twice; all have to come out as they were."""
    once = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    k = F.col("doc_id") % 3
    text = F.when(k == 0, once).when(k == 1, F.decode(F.encode(once, "UTF-8"), "ISO-8859-1")).otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", T.fix_mojibake(text).alias("text"))


def nfc(spark, d):
    return _docs(spark, d).select(
        "doc_id", T.nfc(F.replace("text", F.lit("é"), F.lit(ACUTE))).alias("text")
    )


def strip_controls(spark, d):
    return _docs(spark, d).select("doc_id", T.strip_controls(F.col("text")).alias("text"))


def collapse_ws(spark, d):
    spaced = F.concat(F.lit("\n "), F.replace("text", F.lit(" "), F.lit(f" {NBSP} ")), F.lit("\t"))
    return _docs(spark, d).select("doc_id", T.collapse_ws(spaced).alias("text"))


#: Added to prose: references, curly quotes, a ligature, full-width letters, French quotes, garbling once and twice, C1 quotes.
ODD = " &lsquo;caf&eacute;&#8217; &copy 2020 “ﬁne” Ａ１ « cité\u00a0» Ã©tÃ© ÃƒÂ©tÃƒÂ© \x93Hi\x94"
ODD_CLEAN = " 'café' © 2020 \"fine\" A1 « cité » été été \"Hi\""


def clean_text(spark, d):
    """Marked-up pages and prose with decomposed letters and odd characters, whole chain."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("raw"))
    prose = _docs(spark, d).select(
        (-F.col("doc_id") - 1).alias("id"),
        F.concat(F.replace("text", F.lit("é"), F.lit(ACUTE)), F.lit(ODD)).alias("raw"),
    )
    return pages.unionByName(prose).select("id", T.clean_text(F.col("raw")).alias("text"))


def clean_udf(spark, d):
    """The Arrow function by itself, over every document."""
    return _docs(spark, d).select(
        "doc_id", T.clean_udf(F.replace("text", F.lit("é"), F.lit(ACUTE))).alias("text")
    )


def mask_references(spark, d):
    note = F.concat(
        F.lit("Planning Portal Reference: PP-"),
        (F.col("doc_id") + 11000000).cast("string"),
        F.lit(" at WA14 "),
        (F.col("doc_id") % 10).cast("string"),
        F.lit("QP. "),
        F.col("text"),
    )
    return _docs(spark, d).select("doc_id", T.mask_references(note).alias("text"))


def skip_blank(spark, d):
    text = F.when(F.col("doc_id") % 4 == 0, f" {NBSP}\n").otherwise(F.col("text"))
    return keep_spoken(documents(spark, d).withColumn("text", text), "text").select("doc_id", "text")


def path_parts(spark, d):
    path = F.concat(
        F.lit("/data/"), "source", F.lit("/"), (F.col("doc_id") + 100000).cast("string"), F.lit("-CND-22.md")
    )
    return documents(spark, d).select(
        "doc_id", *[c.alias(n) for n, c in parts_of(path).items()], six_digit_number(path).alias("number")
    )


def _prompted(spark, d):
    # every document is asked the benchmark item of its number, where there is one
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("asked"))
    return _docs(spark, d).join(asked, "doc_id", "left").select(
        "doc_id",
        F.replace("text", F.lit("\n"), F.lit("\n\n\n")).alias("context"),
        F.coalesce("asked", F.lit("What is proposed?")).alias("query"),
        F.lit("Answer in a few words. Text: <CONTEXT> Question: <QUERY>").alias("template"),
    )


def build_prompt(spark, d):
    prompt = P.build_prompt(F.col("template"), F.col("context"), F.col("query"))
    return _prompted(spark, d).select(
        "doc_id", prompt.alias("prompt"), F.length(prompt).cast("bigint").alias("full_promt_len_c")
    )


def rerank_prompt(spark, d):
    return _prompted(spark, d).select("doc_id", P.rerank_prompt(F.col("query"), F.col("context")).alias("prompt"))


def summary_prompt(spark, d):
    return _prompted(spark, d).select("doc_id", P.summary_prompt(F.col("query"), F.col("context")).alias("prompt"))


def chat_messages(spark, d):
    text = F.col("text")
    return table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        P.chat_messages(text, P.RERANK_SYSTEM).alias("ranking"),
        P.chat_messages(text).alias("nested"),
        P.chat_messages(text, nested=False).alias("plain"),
    )


def parse_rank_score(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", P.parse_rank_score(F.concat(F.lit("Score "), F.md5("text"))).cast("bigint").alias("score")
    )


def chunk_documents(spark, d):
    return C.chunk_documents(_docs(spark, d), "doc_id")


def chunk_fixed(spark, d):
    return C.chunk_fixed(_docs(spark, d), "doc_id")


def number_chunks(spark, d):
    chunks = stored(C.chunk_fixed(_docs(spark, d), "doc_id"), "chunks")
    return C.number_chunks(chunks, "doc_id").select(
        "doc_id", "chunk", "chunk_id"
    )


QUERIES = {
    "missing_token": missing_token,
    "strip_html": strip_html,
    "fix_mojibake": fix_mojibake,
    "nfc": nfc,
    "strip_controls": strip_controls,
    "collapse_ws": collapse_ws,
    "clean_text": clean_text,
    "clean_udf": clean_udf,
    "mask_references": mask_references,
    "skip_blank": skip_blank,
    "path_parts": path_parts,
    "build_prompt": build_prompt,
    "rerank_prompt": rerank_prompt,
    "summary_prompt": summary_prompt,
    "chat_messages": chat_messages,
    "parse_rank_score": parse_rank_score,
    "chunk_documents": chunk_documents,
    "chunk_fixed": chunk_fixed,
    "number_chunks": number_chunks,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _template(template: str, *values: str) -> str:
    pieces = template.split("%s")
    out = [_quoted(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        out += [value, _quoted(piece)]
    return " || ".join(out)


_CONTEXT = r"replace(text, chr(10), repeat(chr(10), 3))"
_QUERY = "coalesce((SELECT b.text FROM benchmark b WHERE b.item_id = doc_id), 'What is proposed?')"
_PROMPT = f"""replace('Answer in a few words. Text: ' || {_CONTEXT} || ' Question: ' || {_QUERY},
  repeat(chr(10), 2), chr(10))"""
_PART = "struct_pack(type := 'text', text := text)"

ORACLES = {
    "missing_token": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text
      WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END ELSE 'MISSING' END AS value
      FROM documents""",
    "strip_html": f"SELECT page_id, {sql.strip_html('html')} AS text FROM pages",
    "fix_mojibake": "SELECT doc_id, text FROM documents",
    "nfc": "SELECT doc_id, nfc_normalize(replace(text, 'é', 'e' || chr(769))) AS text FROM documents",
    "strip_controls": f"SELECT doc_id, {sql.strip_controls('text')} AS text FROM documents",
    "collapse_ws": f"""SELECT doc_id, {sql.collapse_ws("chr(10) || ' ' || replace(text, ' ', ' ' || chr(160) || chr(8195)) || chr(9)")} AS text
      FROM documents""",
    "clean_text": f"""SELECT page_id AS id, {sql.clean('html')} AS text FROM pages
      UNION ALL SELECT -doc_id - 1, {sql.clean("replace(text, 'é', 'e' || chr(769)) || " + _quoted(ODD_CLEAN))} FROM documents""",
    "clean_udf": "SELECT doc_id, nfc_normalize(replace(text, 'é', 'e' || chr(769))) AS text FROM documents",
    "mask_references": r"""SELECT doc_id, regexp_replace(regexp_replace(
        'Planning Portal Reference: PP-' || (doc_id + 11000000) || ' at WA14 ' || (doc_id % 10) || 'QP. ' || text,
        '\bPP-[0-9]+\b', '<PPR number>', 'g'),
        '\b[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2}\b', '<postcode>', 'g') AS text FROM documents""",
    "skip_blank": "SELECT doc_id, text FROM documents WHERE doc_id % 4 <> 0 AND trim(text, ' ' || chr(10)) <> ''",
    "path_parts": """SELECT doc_id, source AS application, (doc_id + 100000) || '-CND-22.md' AS filename,
      CAST(doc_id + 100000 AS VARCHAR) AS number FROM documents""",
    "build_prompt": f"SELECT doc_id, {_PROMPT} AS prompt, length({_PROMPT}) AS full_promt_len_c FROM documents",
    "rerank_prompt": f"SELECT doc_id, {_template(P.RERANK_TEMPLATE, _QUERY, _CONTEXT)} AS prompt FROM documents",
    "summary_prompt": f"SELECT doc_id, {_template(P.SUMMARY_TEMPLATE, _CONTEXT, _QUERY)} AS prompt FROM documents",
    "chat_messages": f"""SELECT conv_id, turn,
      CAST(to_json([struct_pack(role := 'system', content := [struct_pack(type := 'text', text := {_quoted(P.RERANK_SYSTEM)})]),
               struct_pack(role := 'user', content := [{_PART}])]) AS VARCHAR) AS ranking,
      CAST(to_json([struct_pack(role := 'user', content := [{_PART}])]) AS VARCHAR) AS nested,
      CAST(to_json([struct_pack(role := 'user', content := text)]) AS VARCHAR) AS plain
      FROM conversations""",
    "parse_rank_score": """SELECT conv_id, turn,
      coalesce(CAST(nullif(regexp_extract('Score ' || md5(text), '[0-9]'), '') AS BIGINT), 0) AS score FROM conversations""",
    "chunk_documents": f"WITH RECURSIVE {sql.SPLIT_CHUNKS} SELECT doc_id, chunk, document FROM numbered",
    "chunk_fixed": f"WITH {sql.FIXED_CHUNKS} SELECT doc_id, chunk, document FROM fixed",
    "number_chunks": f"""WITH {sql.FIXED_CHUNKS} SELECT doc_id, chunk,
      'md_' || (row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), chunk) - 1) AS chunk_id FROM fixed""",
}
