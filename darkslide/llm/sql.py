"""DuckDB SQL of the llm queries that SQL can express."""

ORACLES = {
    "p8_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
