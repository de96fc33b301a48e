"""Incremental forms of the batch operators."""

from docloom.streaming.ingest import stream_ingest_docs  # noqa: F401
from docloom.streaming.token_speed import stream_token_speed  # noqa: F401
