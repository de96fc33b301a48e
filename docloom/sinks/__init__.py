"""Writers. Each lets Spark even out its files, hot applications included."""

from docloom.sinks.tables import (  # noqa: F401
    append_metrics_csv,
    item_documents,
    item_key,
    new_chunks,
    populate_chunks,
    report_columns,
    save_dataset,
    upsert_chunks,
    write_item_files,
    write_items,
    write_jsonl,
    write_packed_docs,
    write_report_csv,
)
