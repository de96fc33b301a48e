"""Readers for document folders, token lines, question files and gold answers."""

from docloom.sources.documents import (  # noqa: F401
    path_parts,
    read_element_docs,
    read_item_docs,
    read_markdown_docs,
    six_digit_number,
)
from docloom.sources.lists import (  # noqa: F401
    load_dataset,
    read_gold_answers,
    read_ordered_lines,
    read_token_jsonl,
)
