"""Prompt assembly and reply parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompts given to the ranking and summary models.
RERANK_TEMPLATE = (
    "\n"
    "            Query:\n"
    '            """%s"""\n'
    "            \n"
    "            Document:\n"
    '            """%s"""\n'
    "            \n"
    "            Evaluate how useful this document is for answering the query.\n"
    "            \n"
    "            Give ONE number from 0 to 9, where:\n"
    "            0 — not relevant at all,\n"
    "            9 — extremely relevant and useful.\n"
    "            \n"
    "            Reply with the number only.\n"
    "            "
)
SUMMARY_TEMPLATE = (
    "\n"
    "        Document:\n"
    '        """%s"""\n'
    "        \n"
    "        Focus on the facts that may help answer the query:\n"
    '        """%s"""\n'
    "        \n"
    "        Output 3–5 concise bullet points.\n"
    "        "
)
RERANK_SYSTEM = " You are helping to rank documents by how relevant they are to a user query."
SUMMARY_SYSTEM = "Create a short, factual summary of the text fragment."


def build_prompt(template: Column, context: Column, query: Column) -> Column:
    """Fill in context, then query, then halve each pair of newlines once."""
    filled = F.replace(template, F.lit("<CONTEXT>"), context)
    filled = F.replace(filled, F.lit("<QUERY>"), query)
    return F.replace(filled, F.lit("\n\n"), F.lit("\n"))


def rerank_prompt(query: Column, document: Column) -> Column:
    return F.format_string(RERANK_TEMPLATE, query, document)


def summary_prompt(query: Column, document: Column) -> Column:
    return F.format_string(SUMMARY_TEMPLATE, document, query)


def chat_messages(prompt: Column, system: str | None = None, nested: bool = True) -> Column:
    """Role and content list as JSON; nested content is a list of text parts."""

    def turn(role: str, text: Column) -> Column:
        content = text
        if nested:
            content = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    turns = [] if system is None else [turn("system", F.lit(system))]
    return F.to_json(F.array(*turns, turn("user", prompt)))


def parse_rank_score(reply: Column) -> Column:
    """First digit of a reply, 0 when there is none."""
    digit = F.regexp_extract(reply, "([0-9])", 1)
    return F.coalesce(F.when(digit != "", digit.cast("int")), F.lit(0))
